"""Returns, windows and aggregates over the price panels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import kernels as K
from ..operators import quality as Q
from ..operators import series as S
from ..sources import panels as P
from ..sources.panels import with_panels
from .registry import query, rounded

KEYS, AT = ["symbol"], "date"


def _whole(keys: list[str]):
    return Window.partitionBy(*keys)


# ---------------------------------------------------------------- the metric block


@query(
    "q_metric_block",
    with_panels("ret")
    + """, w AS (SELECT *, level / max(level) OVER (PARTITION BY symbol ORDER BY date) - 1 AS dd,
        CASE WHEN count(r) OVER f >= 252 THEN avg(r) OVER f / nullif(stddev_samp(r) OVER f, 0) * sqrt(252) END AS rs
      FROM ret WINDOW f AS (PARTITION BY symbol ORDER BY date ROWS 251 PRECEDING)),
    a AS (SELECT symbol, count(r) AS n, arg_max(level, date) / arg_min(level, date) AS growth, date_diff('day', min(date), max(date)) AS days,
        stddev_samp(r) * sqrt(252) AS vol, avg(r) / stddev_samp(r) * sqrt(252) AS sharpe, sqrt(avg(pow(least(r, 0), 2)) FILTER (WHERE r IS NOT NULL)) AS down,
        avg(r) AS m, min(dd) AS maxdd, avg(rs) AS mean_rolling, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE r IS NOT NULL) AS hit, max(r) AS best, min(r) AS worst FROM w GROUP BY 1)
    SELECT symbol, n, round(growth - 1, 6) AS total_return, round(pow(growth, 1 / greatest(days / 365.25, 1 / 365.25)) - 1, 6) AS cagr, round(vol, 6) AS vol, round(sharpe, 6) AS sharpe,
        round(down, 6) AS downside_rms, round(m / down * sqrt(252), 6) AS sortino, round(maxdd, 6) AS maxdd,
        round((pow(growth, 1 / greatest(days / 365.25, 1 / 365.25)) - 1) / nullif(abs(maxdd), 0), 6) AS calmar, round(mean_rolling, 6) AS mean_rolling_sharpe,
        round(hit, 6) AS hit_rate, round(best, 6) AS best_day, round(worst, 6) AS worst_day FROM a""",
)
def metric_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elapsed-time growth, 252-basis risk and rolling Sharpe of every symbol."""
    r = P.returns(spark, sf_dir).withColumns(
        {"dd": S.drawdown("level", S.upto(KEYS, AT)), "rs": S.rolling_sharpe("r", S.trailing(KEYS, AT, 252), 252)}
    )
    a = r.groupBy("symbol").agg(
        F.count("r").alias("n"), (F.max_by("level", AT) / F.min_by("level", AT)).alias("growth"), F.datediff(F.max(AT), F.min(AT)).alias("days"),
        (F.stddev_samp("r") * F.sqrt(F.lit(252.0))).alias("vol"), (F.avg("r") / F.stddev_samp("r") * F.sqrt(F.lit(252.0))).alias("sharpe"),
        F.sqrt(F.avg(F.when(F.col("r").isNotNull(), F.pow(F.least(F.col("r"), F.lit(0.0)), 2)))).alias("downside_rms"), F.avg("r").alias("m"),
        F.min("dd").alias("maxdd"), F.avg("rs").alias("mean_rolling_sharpe"), F.avg((F.col("r") > 0).cast("double")).alias("hit_rate"), F.max("r").alias("best_day"), F.min("r").alias("worst_day"),
    )
    cagr = F.pow("growth", 1 / F.greatest(F.col("days") / 365.25, F.lit(1 / 365.25))) - 1
    out = a.select(
        "symbol", "n", (F.col("growth") - 1).alias("total_return"), cagr.alias("cagr"), "vol", "sharpe", "downside_rms",
        (F.col("m") / F.col("downside_rms") * F.sqrt(F.lit(252.0))).alias("sortino"), "maxdd", F.try_divide(cagr, F.nullif(F.abs("maxdd"), F.lit(0.0))).alias("calmar"),
        "mean_rolling_sharpe", "hit_rate", "best_day", "worst_day",
    )
    return rounded(out)


@query("q_a1_coverage", with_panels("px") + "SELECT symbol, min(date) AS first_date, max(date) AS last_date, count(*) AS n_rows, round(date_diff('day', min(date), max(date)) / 365.25, 2) AS years FROM px GROUP BY 1")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = P.px_line(spark, sf_dir).groupBy("symbol").agg(F.min(AT).alias("first_date"), F.max(AT).alias("last_date"), F.count("*").alias("n_rows"))
    return a.withColumn("years", F.round(F.datediff("last_date", "first_date") / 365.25, 2))


@query("q_a4_cagr_rows", with_panels("idx") + "SELECT symbol, round(CASE WHEN count(*) < 2 THEN 0.0 ELSE pow(arg_max(level, date) / arg_min(level, date), 365.0 / count(*)) - 1 END, 6) AS cagr_rows FROM idx GROUP BY 1")
def cagr_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    growth = F.max_by("level", AT) / F.min_by("level", AT)
    return rounded(P.px_index(spark, sf_dir).groupBy("symbol").agg(F.when(F.count("*") < 2, F.lit(0.0)).otherwise(F.pow(growth, 365.0 / F.count("*")) - 1).alias("cagr_rows")))


@query(
    "q_a8_legacy_metrics",
    with_panels("ret")
    + """, z AS (SELECT symbol, date, level, coalesce(r, 0) AS r FROM ret)
    SELECT symbol, count(r) AS n, round(avg(r) * 365, 6) AS ann_return, round(stddev_samp(r) * sqrt(365), 6) AS ann_vol,
        round(coalesce(avg(r) / nullif(stddev_samp(r), 0) * sqrt(365), 0), 6) AS sharpe_365 FROM z GROUP BY 1""",
)
def legacy_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """365-day family; the first day counts with return zero."""
    z = P.returns(spark, sf_dir).select("symbol", F.coalesce("r", F.lit(0.0)).alias("r"))
    sharpe = F.coalesce(F.try_divide(F.avg("r"), F.nullif(F.stddev_samp("r"), F.lit(0.0))) * F.sqrt(F.lit(365.0)), F.lit(0.0))
    return rounded(z.groupBy("symbol").agg(F.count("r").alias("n"), (F.avg("r") * 365).alias("ann_return"), (F.stddev_samp("r") * F.sqrt(F.lit(365.0))).alias("ann_vol"), sharpe.alias("sharpe_365")))


@query(
    "q_a12_var_cvar",
    with_panels("ret") + ", q AS (SELECT symbol, quantile_cont(r, 0.05) AS v FROM ret GROUP BY 1) SELECT symbol, round(v, 6) AS var95, round(avg(r), 6) AS cvar95, count(*) AS n_tail FROM ret JOIN q USING (symbol) WHERE r <= v GROUP BY symbol, v",
)
def var_cvar(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = P.returns(spark, sf_dir)
    tail = r.withColumn("v", S.percentile("r", 0.05).over(_whole(KEYS))).where("r <= v")
    return rounded(tail.groupBy("symbol").agg(F.max("v").alias("var95"), F.avg("r").alias("cvar95"), F.count("*").alias("n_tail")))


@query("q_a13_moments", with_panels("ret") + "SELECT symbol, round(skewness(r), 6) AS skew, round(kurtosis(r), 6) AS kurt FROM ret GROUP BY 1")
def moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.returns(spark, sf_dir).groupBy("symbol").agg(S.corrected_skew("r").alias("skew"), S.corrected_kurtosis("r").alias("kurt")))


@query(
    "q_a15_episode",
    with_panels("idx")
    + """, d AS (SELECT *, level / max(level) OVER (PARTITION BY symbol ORDER BY date) - 1 AS dd FROM idx),
    t AS (SELECT symbol, first(date ORDER BY dd, date) AS trough, min(dd) AS maxdd FROM d GROUP BY 1),
    p AS (SELECT symbol, trough, maxdd, first(date ORDER BY level DESC, date) AS peak FROM d JOIN t USING (symbol) WHERE date <= trough GROUP BY 1, 2, 3)
    SELECT p.symbol, round(maxdd, 6) AS maxdd, peak, trough, min(date) FILTER (WHERE dd >= -1e-12) AS recovered FROM p JOIN d ON d.symbol = p.symbol AND d.date >= p.trough GROUP BY 1, maxdd, 3, 4""",
)
def episode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peak, trough and recovery of the deepest drawdown; ties go to the earliest date."""
    d = P.px_index(spark, sf_dir).withColumn("dd", S.drawdown("level", S.upto(KEYS, AT)))
    d = d.withColumn("trough", F.min_by(AT, F.struct("dd", AT)).over(_whole(KEYS)))
    until = F.when(F.col(AT) <= F.col("trough"), F.struct(-F.col("level"), F.col(AT)))
    since = F.when((F.col(AT) >= F.col("trough")) & (F.col("dd") >= -1e-12), F.col(AT))
    return rounded(d.groupBy("symbol").agg(F.min("dd").alias("maxdd"), F.min_by(AT, until).alias("peak"), F.max("trough").alias("trough"), F.min(since).alias("recovered")))


@query("q_a16_monthly", with_panels("ret") + "SELECT symbol, CAST(date_trunc('month', date) AS DATE) AS month, round(product(1 + r) - 1, 6) AS ret, min(date) AS first_day, max(date) AS last_day, count(*) AS n_obs FROM ret WHERE r IS NOT NULL GROUP BY 1, 2")
def monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = P.returns(spark, sf_dir).where("r is not null")
    return rounded(r.groupBy("symbol", F.trunc(AT, "MM").alias("month")).agg((F.product(1 + F.col("r")) - 1).alias("ret"), F.min(AT).alias("first_day"), F.max(AT).alias("last_day"), F.count("*").alias("n_obs")))


@query(
    "q_a18_monthly_pivot",
    with_panels("ret")
    + ", m AS (SELECT symbol, year(date) AS y, month(date) AS m, product(1 + r) - 1 AS v FROM ret WHERE r IS NOT NULL GROUP BY 1, 2, 3) SELECT symbol, CAST(y AS BIGINT) AS y, "
    + ", ".join(f"round(max(v) FILTER (WHERE m = {k}), 6) AS m{k}" for k in range(1, 13))
    + " FROM m GROUP BY 1, 2",
)
def monthly_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = P.returns(spark, sf_dir).where("r is not null")
    m = r.groupBy("symbol", F.year(AT).cast("long").alias("y")).agg(*((F.product(F.when(F.month(AT) == k, 1 + F.col("r"))) - 1).alias(f"m{k}") for k in range(1, 13)))
    return rounded(m)


@query(
    "q_a19_crisis",
    with_panels("idx")
    + """, b AS (SELECT symbol, min(date) + 365 AS s, min(date) + 730 AS e FROM idx GROUP BY 1),
    a AS (SELECT symbol, max(date) AS anchor FROM idx JOIN b USING (symbol) WHERE date < s GROUP BY 1),
    x AS (SELECT symbol, date, level, level / lag(level) OVER (PARTITION BY symbol ORDER BY date) - 1 AS r, level / max(level) OVER (PARTITION BY symbol ORDER BY date) - 1 AS dd
        FROM idx JOIN b USING (symbol) JOIN a USING (symbol) WHERE date >= anchor AND date <= e)
    SELECT symbol, round(arg_max(level, date) / arg_min(level, date) - 1, 6) AS ret, round(min(dd), 6) AS maxdd, round(stddev_samp(r) * sqrt(252), 6) AS vol, count(r) AS n FROM x GROUP BY 1""",
)
def crisis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Window of the second year of every symbol, anchored at the last level strictly before it."""
    own = _whole(KEYS)
    x = P.px_index(spark, sf_dir).withColumn("s", F.date_add(F.min(AT).over(own), 365)).withColumn("e", F.date_add(F.min(AT).over(own), 730))
    x = x.withColumn("anchor", F.max(F.when(F.col(AT) < F.col("s"), F.col(AT))).over(own)).where("date >= anchor and date <= e")
    x = x.withColumns({"r": S.simple_return("level", S.ordered(KEYS, AT)), "dd": S.drawdown("level", S.upto(KEYS, AT))})
    return rounded(x.groupBy("symbol").agg((F.max_by("level", AT) / F.min_by("level", AT) - 1).alias("ret"), F.min("dd").alias("maxdd"), (F.stddev_samp("r") * F.sqrt(F.lit(252.0))).alias("vol"), F.count("r").alias("n")))


@query(
    "q_a21_turnover",
    with_panels("px")
    + """, m AS (SELECT CAST(date_trunc('month', date) AS DATE) AS month, symbol, sum(volume) AS v FROM px GROUP BY 1, 2), c AS (SELECT month FROM m GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT symbol) FROM px)),
    w AS (SELECT month, symbol, v / sum(v) OVER (PARTITION BY month) AS w FROM m JOIN c USING (month)), d AS (SELECT month, abs(w - lag(w) OVER (PARTITION BY symbol ORDER BY month)) AS d FROM w),
    t AS (SELECT month, sum(d) AS t FROM d WHERE d IS NOT NULL GROUP BY 1) SELECT round(avg(t), 6) AS mean_turnover, round(max(t), 6) AS max_turnover, count(*) AS n FROM t""",
)
def turnover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of absolute weight changes of a monthly volume-weighted book; the first rebalance has none."""
    px = P.px_line(spark, sf_dir)
    m = px.groupBy(F.trunc(AT, "MM").alias("month"), "symbol").agg(F.sum("volume").alias("v"))
    names = px.agg(F.count_distinct("symbol").alias("names"))
    full = m.groupBy("month").agg(F.count("*").alias("n")).crossJoin(F.broadcast(names)).where("n = names").select("month")  # names: one row
    w = m.join(full, "month", "left_semi").withColumn("w", F.col("v") / F.sum("v").over(_whole(["month"])))
    d = w.withColumn("d", F.abs(F.col("w") - F.lag("w").over(S.ordered(KEYS, "month")))).where("d is not null")
    t = d.groupBy("month").agg(F.sum("d").alias("t"))
    return rounded(t.agg(F.avg("t").alias("mean_turnover"), F.max("t").alias("max_turnover"), F.count("*").alias("n")))


@query("q_a25_category_medians", "SELECT r_name AS category, round(median(c_acctbal), 6) AS med, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def category_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact medians of few, large groups: values are counted, and their counts summed in order, so no task holds a group."""
    c, n, r = (P.table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    joined = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    counts = joined.groupBy(F.col("r_name").alias("category"), F.col("c_acctbal").alias("v")).agg(F.count("*").alias("k"))
    below = C.running_total(counts, "v", "k", "below", by="category").join(F.broadcast(counts.groupBy("category").agg(F.sum("k").alias("n"))), "category")
    first, last = F.floor((F.col("n") + 1) / 2), F.floor((F.col("n") + 2) / 2)
    holds = lambda rank: (F.col("below") < rank) & (rank <= F.col("below") + F.col("k"))
    middle = below.groupBy("category").agg(((F.sum(F.when(holds(first), F.col("v"))) + F.sum(F.when(holds(last), F.col("v")))) / 2).alias("med"), F.max("n").alias("n"))
    return rounded(middle)


@query("q_a26_dollar_volume", with_panels("px") + "SELECT symbol, round(median(close * volume), 4) AS dollar_volume, row_number() OVER (ORDER BY median(close * volume) DESC, symbol) AS rnk FROM px GROUP BY 1")
def dollar_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = P.px_line(spark, sf_dir).groupBy("symbol").agg(F.median(F.col("close") * F.col("volume")).alias("dollar_volume"))
    return rounded(d.withColumn("rnk", F.row_number().over(Window.orderBy(F.desc("dollar_volume"), "symbol")).cast("long")), 4)


@query(
    "q_a36_dispersion",
    with_panels("scores")
    + """, c AS (SELECT user_id, round(pit, 2) AS v, count(*) AS k FROM scores WHERE pit IS NOT NULL GROUP BY 1, 2), m AS (SELECT user_id, first(v ORDER BY k DESC, v) AS mode, max(k) AS top FROM c GROUP BY 1),
    a AS (SELECT user_id, count(pit) AS n, avg(pit) AS mean, median(pit) AS med, stddev_samp(pit) AS sd, min(pit) AS lo, max(pit) AS hi, quantile_cont(pit, 0.75) - quantile_cont(pit, 0.25) AS iqr,
      quantile_cont(pit, 0.05) AS p05, quantile_cont(pit, 0.95) AS p95, greatest(avg(CASE WHEN pit > 0 THEN 1.0 ELSE 0 END), avg(CASE WHEN pit < 0 THEN 1.0 ELSE 0 END)) AS sign_agreement FROM scores WHERE pit IS NOT NULL GROUP BY 1)
    SELECT user_id, n, round(mean, 6) AS mean, round(med, 6) AS med, round(sd, 6) AS sd, round(lo, 6) AS lo, round(hi, 6) AS hi, round(hi - lo, 6) AS rng, round(iqr, 6) AS iqr, round(p05, 6) AS p05, round(p95, 6) AS p95,
      round(mode, 2) AS mode, round(top * 1.0 / n, 6) AS mode_share, round(sign_agreement, 6) AS sign_agreement FROM a JOIN m USING (user_id)""",
)
def dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Location, spread, the most frequent value to two digits (the smallest of several) and the share of the commoner sign."""
    x = P.scores(spark, sf_dir).where("pit is not null")
    q = lambda p: S.percentile("pit", p)
    share = lambda c: F.avg(c.cast("double"))
    a = x.groupBy("user_id").agg(
        F.count("pit").alias("n"), F.avg("pit").alias("mean"), F.median("pit").alias("med"), F.stddev_samp("pit").alias("sd"), F.min("pit").alias("lo"), F.max("pit").alias("hi"),
        (F.max("pit") - F.min("pit")).alias("rng"), (q(0.75) - q(0.25)).alias("iqr"), q(0.05).alias("p05"), q(0.95).alias("p95"),
        F.greatest(share(F.col("pit") > 0), share(F.col("pit") < 0)).alias("sign_agreement"),
    )
    c = x.groupBy("user_id", F.round("pit", 2).alias("v")).agg(F.count("*").alias("k"))
    m = c.groupBy("user_id").agg(F.min_by("v", F.struct(-F.col("k"), F.col("v"))).alias("mode"), F.max("k").alias("top"))
    return rounded(a.join(m, "user_id").withColumn("mode_share", F.col("top") / F.col("n")).drop("top"))


#: The normal distribution function of a non-negative x by a rational expansion (absolute error below 8e-8).
_PHI = "(1 - exp(-x * x / 2) / sqrt(2 * pi()) * (0.319381530 * t - 0.356563782 * pow(t, 2) + 1.781477937 * pow(t, 3) - 1.821255978 * pow(t, 4) + 1.330274429 * pow(t, 5)))"


@query(
    "q_a37_signal_noise",
    with_panels("ret")
    + f""", l AS (SELECT symbol, r, lag(r) OVER (PARTITION BY symbol ORDER BY date) AS p FROM ret),
    a AS (SELECT symbol, abs(avg(r)) / stddev_samp(r) AS x, corr(r, p) AS rho, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) FILTER (WHERE r IS NOT NULL) AS up FROM l GROUP BY 1), b AS (SELECT *, 1 / (1 + 0.2316419 * x) AS t FROM a)
    SELECT symbol, round(x, 6) AS snr, round(rho, 6) AS rho, round(pow(rho, 2), 6) AS r2, round({_PHI}, 6) AS ceiling, round(up, 6) AS up FROM b""",
)
def signal_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signal ratio, first autocorrelation, share of rises, and the share of rises that a Gaussian drift of that ratio would give."""
    x = P.returns(spark, sf_dir).withColumn("p", F.lag("r").over(S.ordered(KEYS, AT)))
    rho = C.correlation("r", "p")
    a = x.groupBy("symbol").agg((F.abs(F.avg("r")) / F.stddev_samp("r")).alias("x"), rho.alias("rho"), F.pow(rho, 2).alias("r2"), F.avg((F.col("r") > 0).cast("double")).alias("up"))
    b = a.withColumn("t", 1 / (1 + 0.2316419 * F.col("x")))
    return rounded(b.select("symbol", F.col("x").alias("snr"), "rho", "r2", F.expr(_PHI).alias("ceiling"), "up"))


@query(
    "q_a38_moment_noise",
    with_panels("ret")
    + ", d AS (SELECT symbol, r - lag(r) OVER (PARTITION BY symbol ORDER BY date) AS d, date FROM ret), l AS (SELECT symbol, d, lag(d) OVER (PARTITION BY symbol ORDER BY date) AS p FROM d), g AS (SELECT symbol, var_samp(d) AS g0, corr(d, p) * var_samp(d) AS g1 FROM l GROUP BY 1) SELECT symbol, round(g0 * 1e6, 6) AS g0, round(g1 * 1e6, 6) AS g1, round(CASE WHEN g1 >= 0 THEN NULL ELSE (g0 + 2 * g1) / -g1 END, 6) AS q FROM g",
)
def moment_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = S.ordered(KEYS, AT)
    x = P.returns(spark, sf_dir).withColumn("d", F.col("r") - F.lag("r").over(w)).withColumn("p", F.lag("d").over(w))
    g = x.groupBy("symbol").agg(F.var_samp("d").alias("g0"), (C.correlation("d", "p") * F.var_samp("d")).alias("g1"))
    return rounded(g.select("symbol", (F.col("g0") * 1e6).alias("g0"), (F.col("g1") * 1e6).alias("g1"), F.when(F.col("g1") < 0, (F.col("g0") + 2 * F.col("g1")) / -F.col("g1")).alias("q")))


_PAIRED = """, y AS (SELECT a.symbol, a.date, a.r AS y, b.r AS x FROM ret a JOIN ret b ON a.date = b.date AND b.symbol = 'NO' WHERE a.symbol <> 'NO' AND a.r IS NOT NULL AND b.r IS NOT NULL)"""


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, date, y, x: every symbol beside the benchmark symbol on common dates."""
    r = P.returns(spark, sf_dir).where("r is not null")
    x = r.where("symbol = 'NO'").select(AT, F.col("r").alias("x"))
    return r.where("symbol <> 'NO'").join(x, AT).select("symbol", AT, F.col("r").alias("y"), "x")


@query("q_a39_regression", with_panels("ret") + _PAIRED + " SELECT symbol, round(regr_slope(y, x), 6) AS beta, round(regr_intercept(y, x) * 252, 6) AS alpha, round(regr_r2(y, x), 6) AS r2, round(corr(y, x), 6) AS rho, count(*) AS n FROM y GROUP BY 1")
def regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_paired(spark, sf_dir).groupBy("symbol").agg(F.regr_slope("y", "x").alias("beta"), (F.regr_intercept("y", "x") * 252).alias("alpha"), F.regr_r2("y", "x").alias("r2"), C.correlation("y", "x").alias("rho"), F.count("*").alias("n")))


@query("q_a45_active", with_panels("ret") + _PAIRED + " SELECT symbol, round(avg(y - x) * 252, 6) AS active, round(stddev_samp(y - x) * sqrt(252), 6) AS tracking_error, round(avg(y - x) * 252 / (stddev_samp(y - x) * sqrt(252)), 6) AS information_ratio FROM y GROUP BY 1")
def active(spark: SparkSession, sf_dir: str) -> DataFrame:
    gap = F.col("y") - F.col("x")
    a, te = F.avg(gap) * 252, F.stddev_samp(gap) * F.sqrt(F.lit(252.0))
    return rounded(_paired(spark, sf_dir).groupBy("symbol").agg(a.alias("active"), te.alias("tracking_error"), (a / te).alias("information_ratio")))


@query("q_a41b_implied_residual", with_panels("ret") + _PAIRED + " SELECT symbol, round(stddev_samp(y) * sqrt(252) * sqrt(greatest(0, 1 - regr_r2(y, x))), 6) AS residual_vol, round(regr_intercept(y, x) * 252 / (stddev_samp(y) * sqrt(252) * sqrt(greatest(0, 1 - regr_r2(y, x)))), 6) AS appraisal FROM y GROUP BY 1")
def implied_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    vol = F.stddev_samp("y") * F.sqrt(F.lit(252.0)) * F.sqrt(F.greatest(F.lit(0.0), 1 - F.regr_r2("y", "x")))
    return rounded(_paired(spark, sf_dir).groupBy("symbol").agg(vol.alias("residual_vol"), (F.regr_intercept("y", "x") * 252 / vol).alias("appraisal")))


@query(
    "q_a47_tail_table",
    with_panels("ret")
    + """, m AS (SELECT symbol, avg(r) AS mu, stddev_samp(r) AS sd, stddev_pop(r) AS sp, count(r) AS n, quantile_cont(r, 0.05) AS v FROM ret GROUP BY 1),
    p AS (SELECT symbol, avg(pow((r - mu) / sp, 3)) AS sk, avg(pow((r - mu) / sp, 4)) - 3 AS ku, avg(r) FILTER (WHERE r <= v) AS cvar FROM ret JOIN m USING (symbol) WHERE r IS NOT NULL GROUP BY 1)
    SELECT symbol, round(cvar, 6) AS cvar, round(mu - sd * 2.0627128075074275, 6) AS normal_cvar, round(cvar / (mu - sd * 2.0627128075074275), 6) AS ratio, round(n / 6.0 * (sk * sk + ku * ku / 4), 4) AS jb, round(exp(-n / 12.0 * (sk * sk + ku * ku / 4)), 6) AS jb_p FROM m JOIN p USING (symbol)""",
)
def tail_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Population skew and kurtosis, normal-implied CVaR (density over tail share at 5 %), Jarque-Bera with two degrees of freedom."""
    r = P.returns(spark, sf_dir).withColumn("v", S.percentile("r", 0.05).over(_whole(KEYS)))
    m = r.groupBy("symbol").agg(F.avg("r").alias("mu"), F.stddev_samp("r").alias("sd"), F.skewness("r").alias("sk"), F.kurtosis("r").alias("ku"), F.count("r").alias("n"), F.avg(F.when(F.col("r") <= F.col("v"), F.col("r"))).alias("cvar"))
    normal = F.col("mu") - F.col("sd") * 2.0627128075074275
    jb = F.col("n") / 6.0 * (F.col("sk") * F.col("sk") + F.col("ku") * F.col("ku") / 4)
    return rounded(m.select("symbol", "cvar", normal.alias("normal_cvar"), (F.col("cvar") / normal).alias("ratio"), F.round(jb, 4).alias("jb"), F.exp(-jb / 2).alias("jb_p")))


# ---------------------------------------------------------------- window functions


@query(
    "q_w1_padded_returns",
    with_panels("ord")
    + """, c AS (SELECT DISTINCT date FROM ord), s AS (SELECT DISTINCT symbol FROM ord), f AS (SELECT symbol, date, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date) AS v FROM c CROSS JOIN s LEFT JOIN ord USING (symbol, date))
    SELECT symbol, date, round(v / lag(v) OVER (PARTITION BY symbol ORDER BY date) - 1, 6) AS r FROM f""",
)
def padded_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns on the union calendar; a missing session repeats the last level, so its return is zero."""
    grid = union_calendar(P.px_orders(spark, sf_dir))
    return rounded(grid.select("symbol", AT, S.simple_return("close", S.ordered(KEYS, AT), fill="pad").alias("r")))


def union_calendar(px: DataFrame) -> DataFrame:
    """Every symbol on every date of the panel: dates times symbols, both of them small dimensions, then the panel joined on."""
    dates = px.select(AT).distinct()
    names = px.agg(F.collect_set("symbol").alias("s"))
    grid = dates.crossJoin(F.broadcast(names)).select(F.explode("s").alias("symbol"), AT)  # names: one row
    return grid.join(px, ["symbol", AT], "left")


@query(
    "q_w2_strict_returns",
    with_panels("ord")
    + """, c AS (SELECT DISTINCT date FROM ord), s AS (SELECT DISTINCT symbol FROM ord), f AS (SELECT symbol, date, close AS v FROM c CROSS JOIN s LEFT JOIN ord USING (symbol, date))
    SELECT symbol, count(*) AS n_rows, count(v) AS n_levels, count(r) AS n_returns, round(sum(r), 4) AS total FROM (SELECT *, v / lag(v) OVER (PARTITION BY symbol ORDER BY date) - 1 AS r FROM f) GROUP BY 1""",
)
def strict_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns on the union calendar; null beside every gap."""
    g = union_calendar(P.px_orders(spark, sf_dir)).withColumn("r", S.simple_return("close", S.ordered(KEYS, AT)))
    return rounded(g.groupBy("symbol").agg(F.count("*").alias("n_rows"), F.count("close").alias("n_levels"), F.count("r").alias("n_returns"), F.sum("r").alias("total")), 4)


@query("q_w3_yoy", with_panels("macro") + "SELECT month, round((d / lag(d, 12) OVER (ORDER BY month) - 1) * 100, 6) AS yoy FROM macro")
def yoy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.macro(spark, sf_dir).select("month", ((F.col("d") / F.lag("d", 12).over(Window.orderBy("month")) - 1) * 100).alias("yoy")))


@query("q_w4_log_returns", with_panels("idx") + "SELECT symbol, date, round(ln(level) - lag(ln(level)) OVER (PARTITION BY symbol ORDER BY date), 8) AS lr FROM idx")
def log_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.px_index(spark, sf_dir).select("symbol", AT, S.log_return("level", S.ordered(KEYS, AT)).alias("lr")), 8)


@query(
    "q_w5_rolling",
    with_panels("ret")
    + """ SELECT symbol, date, round(CASE WHEN count(r) OVER f >= 60 THEN avg(r) OVER f END, 8) AS mean60, round(CASE WHEN count(r) OVER f >= 60 THEN stddev_samp(r) OVER f END, 8) AS std60
    FROM ret WINDOW f AS (PARTITION BY symbol ORDER BY date ROWS 59 PRECEDING)""",
)
def rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = S.trailing(KEYS, AT, 60)
    return rounded(P.returns(spark, sf_dir).select("symbol", AT, S.rolling_mean("r", f, 60).alias("mean60"), S.rolling_std("r", f, 60).alias("std60")), 8)


@query(
    "q_w7_zscore",
    with_panels("macro")
    + " SELECT month, round(CASE WHEN count(d) OVER f >= 12 THEN (d - avg(d) OVER f) / nullif(stddev_samp(d) OVER f, 0) END, 5) AS z_d, round(CASE WHEN count(q) OVER f >= 12 THEN (q - avg(q) OVER f) / nullif(stddev_samp(q) OVER f, 0) END, 5) AS z_q FROM macro WINDOW f AS (ORDER BY month ROWS 23 PRECEDING)",
)
def rolling_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = Window.orderBy("month").rowsBetween(-23, 0)
    return rounded(P.macro(spark, sf_dir).select("month", S.zscore("d", f, 12).alias("z_d"), S.zscore("q", f, 12).alias("z_q")), 5)


#: Trailing median and deviation of r over 252 rows, each from its sixtieth value on: CTEs from ``source`` to mz (source's columns, z).
def robust_z_sql(source: str) -> str:
    frame = "WINDOW f AS (PARTITION BY symbol ORDER BY date ROWS 251 PRECEDING)"
    return f""", ma AS (SELECT *, CASE WHEN count(r) OVER f >= 60 THEN quantile_cont(r, 0.5) OVER f END AS med FROM {source} {frame}), mb AS (SELECT *, abs(r - med) AS dev FROM ma),
    mz AS (SELECT *, (r - med) / nullif(1.4826 * CASE WHEN count(dev) OVER f >= 60 THEN quantile_cont(dev, 0.5) OVER f END, 0) AS z FROM mb {frame})"""


@query("q_w8_mad_z", with_panels("ret") + robust_z_sql("ret") + " SELECT symbol, date, round(z, 5) AS z FROM mz")
def mad_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance from the trailing median in units of the trailing median deviation."""
    return rounded(Q.with_robust_z(P.returns(spark, sf_dir).select("symbol", AT, "r")).select("symbol", AT, "z"), 5)


@query(
    "q_w9_ewma",
    with_panels("ret")
    + """, p AS (SELECT symbol, date, r, pow(2.0, (row_number() OVER (PARTITION BY symbol ORDER BY date DESC) * -1.0) / 21.0) AS w FROM ret),
    c AS (SELECT symbol, date, sum(r * w) OVER f AS s1, sum(r * r * w) OVER f AS s2, sum(CASE WHEN r < 0 THEN r * r * w WHEN r IS NOT NULL THEN 0 END) OVER f AS s3, sum(CASE WHEN r IS NOT NULL THEN w END) OVER f AS s0 FROM p
      WINDOW f AS (PARTITION BY symbol ORDER BY date))
    SELECT symbol, date, round(s1 / s0, 8) AS ewma, round(sqrt(s2 / s0), 8) AS vol, round(sqrt(s3 / s0), 8) AS downside_vol FROM c""",
)
def ewma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, root mean square and that of the falls, half-life 21; positions count back from the last row, so weights never overflow."""
    r = P.returns(spark, sf_dir).withColumn("pos", -F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc(AT))))
    r = r.withColumns({"r2": F.col("r") * F.col("r"), "d2": F.when(F.col("r") < 0, F.col("r") * F.col("r")).when(F.col("r").isNotNull(), 0.0)})
    mean = lambda c: S.ewm_mean(c, "pos", 21, S.upto(KEYS, AT))
    return rounded(r.select("symbol", AT, mean("r").alias("ewma"), F.sqrt(mean("r2")).alias("vol"), F.sqrt(mean("d2")).alias("downside_vol")), 8)


@query(
    "q_w10_ewm_corr",
    with_panels("ret")
    + """, j AS (SELECT a.symbol AS a, b.symbol AS b, a.r AS x, b.r AS y, pow(2.0, row_number() OVER (PARTITION BY a.symbol, b.symbol ORDER BY a.date DESC) * -1.0 / 10.0) AS w
      FROM ret a JOIN ret b ON a.date = b.date AND a.symbol <= b.symbol WHERE a.r IS NOT NULL AND b.r IS NOT NULL),
    m AS (SELECT a, b, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my, 1 - sum(w * w) / pow(sum(w), 2) AS left_over FROM j GROUP BY 1, 2)
    SELECT a, b, round(sum(w * (x - mx) * (y - my)) / sum(w) / left_over * 1e6, 6) AS cov_ppm,
      round(CASE WHEN a = b THEN 1 ELSE greatest(-1, least(1, sum(w * (x - mx) * (y - my)) / sqrt(sum(w * (x - mx) * (x - mx)) * sum(w * (y - my) * (y - my))))) END, 6) AS rho FROM j JOIN m USING (a, b) GROUP BY a, b, left_over""",
)
def ewm_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exponentially weighted covariance (bias-corrected) and correlation of every pair at the last date, half-life ten common sessions."""
    p = P.returns(spark, sf_dir).where("r is not null")
    a = p.select(AT, F.col("symbol").alias("a"), F.col("r").alias("x"))
    b = p.select(AT, F.col("symbol").alias("b"), F.col("r").alias("y"))
    j = a.join(b, AT).where("a <= b")
    j = j.withColumn("w", F.pow(F.lit(2.0), -F.row_number().over(Window.partitionBy("a", "b").orderBy(F.desc(AT))) / 10.0))
    own = Window.partitionBy("a", "b")
    mean = lambda c: F.sum(F.col("w") * F.col(c)).over(own) / F.sum("w").over(own)
    j = j.withColumns({"dx": F.col("x") - mean("x"), "dy": F.col("y") - mean("y")})
    s = lambda u, v: F.sum(F.col("w") * F.col(u) * F.col(v))
    left_over = 1 - F.sum(F.col("w") * F.col("w")) / F.pow(F.sum("w"), 2)
    rho = F.when(F.col("a") == F.col("b"), 1.0).otherwise(C.clip(F.col("_rho"), -1, 1))
    out = j.groupBy("a", "b").agg((s("dx", "dy") / F.sum("w") / left_over * 1e6).alias("cov_ppm"), (s("dx", "dy") / F.sqrt(s("dx", "dx") * s("dy", "dy"))).alias("_rho"))
    return rounded(out.select("a", "b", "cov_ppm", rho.alias("rho")))


@query("q_w11_avg_corr", with_panels("ret") + ", j AS (SELECT a.symbol AS a, b.symbol AS b, corr(a.r, b.r) AS c FROM ret a JOIN ret b ON a.date = b.date AND a.symbol < b.symbol GROUP BY 1, 2) SELECT round(avg(c), 6) AS avg_corr, count(*) AS pairs FROM j")
def avg_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P.returns(spark, sf_dir)
    j = p.select(AT, F.col("symbol").alias("a"), F.col("r").alias("x")).join(p.select(AT, F.col("symbol").alias("b"), F.col("r").alias("y")), AT).where("a < b")
    return rounded(j.groupBy("a", "b").agg(C.correlation("x", "y").alias("c")).agg(F.avg("c").alias("avg_corr"), F.count("*").alias("pairs")))


@query("q_w12_drawdown", with_panels("idx") + "SELECT symbol, date, round(level / max(level) OVER (PARTITION BY symbol ORDER BY date) - 1, 8) AS dd FROM idx")
def drawdowns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.px_index(spark, sf_dir).select("symbol", AT, S.drawdown("level", S.upto(KEYS, AT)).alias("dd")), 8)


@query(
    "q_w13_wealth",
    with_panels("ret") + " SELECT symbol, date, round(product(1 + coalesce(r, 0)) OVER (PARTITION BY symbol ORDER BY date), 6) AS wealth FROM ret",
)
def wealth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compounded wealth; the anchor row has 1."""
    return rounded(P.returns(spark, sf_dir).select("symbol", AT, F.product(1 + F.coalesce("r", F.lit(0.0))).over(S.upto(KEYS, AT)).alias("wealth")))


@query(
    "q_w16_runs",
    with_panels("ret")
    + """, f AS (SELECT symbol, date, coalesce(abs(r) < 0.005, false) AS flat FROM ret), g AS (SELECT *, sum(CASE WHEN flat THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY date) AS island FROM f)
    SELECT symbol, date, CAST(CASE WHEN flat THEN count(*) FILTER (WHERE flat) OVER (PARTITION BY symbol, island) ELSE 0 END AS BIGINT) AS run FROM g""",
)
def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of the run of small returns that a row belongs to."""
    f = P.returns(spark, sf_dir).withColumn("flat", F.coalesce(F.abs("r") < 0.005, F.lit(False)))
    g = f.withColumn("island", S.islands(F.col("flat"), S.ordered(KEYS, AT)))
    return g.select("symbol", AT, F.when(F.col("flat"), F.sum(F.col("flat").cast("long")).over(Window.partitionBy("symbol", "island"))).otherwise(0).alias("run"))


@query("q_w17_crossing", with_panels("idx") + ", f AS (SELECT symbol, date, level > 100 AS above, lag(level > 100) OVER (PARTITION BY symbol ORDER BY date) AS was FROM idx) SELECT symbol, min(date) FILTER (WHERE above AND NOT coalesce(was, above)) AS first_cross, count(*) FILTER (WHERE above AND NOT coalesce(was, above)) AS crossings FROM f GROUP BY 1")
def crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First upward crossing; a first row above the threshold is none."""
    f = P.px_index(spark, sf_dir).withColumn("above", F.col("level") > 100).withColumn("was", F.lag("above").over(S.ordered(KEYS, AT)))
    up = F.col("above") & ~F.coalesce("was", "above")
    return f.groupBy("symbol").agg(F.min(F.when(up, F.col(AT))).alias("first_cross"), F.count_if(up).alias("crossings"))


@query(
    "q_w18_expanding_bucket",
    with_panels("macro")
    + """, h AS (SELECT a.month, count(*) AS n, count(*) FILTER (WHERE b.q < a.q) + (count(*) FILTER (WHERE b.q = a.q) + 1) / 2.0 AS rnk FROM macro a JOIN macro b ON b.month <= a.month GROUP BY 1)
    SELECT month, CAST(CASE WHEN n < 12 THEN 1 ELSE least(2, greatest(0, floor(rnk / n * 3))) END AS BIGINT) AS bucket FROM h""",
)
def expanding_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bucket of the average rank among the history up to now, by a sorted list that grows along the line; a short history gives the middle."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("month")
        return pd.DataFrame({"month": pdf.month, "n": np.arange(1, len(pdf) + 1), "rnk": K.expanding_rank(pdf.q.to_numpy())})

    h = P.macro(spark, sf_dir).select(F.lit("q").alias("line"), "month", "q").groupBy("line").applyInPandas(one, "month date, n long, rnk double")  # months
    bucket = F.when(F.col("n") < 12, 1).otherwise(F.least(F.lit(2), F.greatest(F.lit(0), F.floor(F.col("rnk") / F.col("n") * 3))))
    return h.select("month", bucket.cast("long").alias("bucket"))


@query(
    "q_w19_prior_z",
    with_panels("macro")
    + " SELECT month, round(CASE WHEN count(q) OVER f >= 12 AND stddev_samp(q) OVER f > 0 THEN (q - avg(q) OVER f) / stddev_samp(q) OVER f END, 5) AS z FROM macro WINDOW f AS (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)",
)
def prior_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    return rounded(P.macro(spark, sf_dir).select("month", S.zscore("q", w, 12).alias("z")), 5)


@query(
    "q_w20_percentile_score",
    "SELECT c_custkey, c_mktsegment, round((rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_mktsegment, c_acctbal) - 1) / 2.0) / count(*) OVER (PARTITION BY c_mktsegment) * 100, 6) AS score FROM customer",
)
def percentile_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average rank in few, large groups: values are counted and their counts summed in order, so no task holds a group."""
    c = P.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    counts = c.groupBy("c_mktsegment", "c_acctbal").agg(F.count("*").alias("k"))
    below = C.running_total(counts, "c_acctbal", "k", "below", by="c_mktsegment").join(F.broadcast(counts.groupBy("c_mktsegment").agg(F.sum("k").alias("n"))), "c_mktsegment")
    share = below.select("c_mktsegment", "c_acctbal", ((F.col("below") + (F.col("k") + 1) / 2) / F.col("n") * 100).alias("score"))
    return rounded(c.join(share, ["c_mktsegment", "c_acctbal"]).select("c_custkey", "c_mktsegment", "score"))


@query(
    "q_w21_ffill_limit",
    with_panels("ord")
    + """, c AS (SELECT DISTINCT date FROM ord), s AS (SELECT DISTINCT symbol FROM ord), f AS (SELECT symbol, date, close FROM c CROSS JOIN s LEFT JOIN ord USING (symbol, date)),
    l AS (SELECT symbol, date, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS 5 PRECEDING) AS v FROM f)
    SELECT date, count(v) AS n, round(avg(v), 4) AS mean FROM l GROUP BY 1 HAVING count(v) > 0.5 * (SELECT count(*) FROM s)""",
)
def ffill_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forward fill over at most five rows; dates with more than half of the symbols stay."""
    grid = union_calendar(P.px_orders(spark, sf_dir))
    v = grid.withColumn("v", F.last("close", True).over(S.ordered(KEYS, AT).rowsBetween(-5, 0)))
    return rounded(v.groupBy(AT).agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.count("*").alias("names")).where("n > 0.5 * names").drop("names"), 4)


@query(
    "q_w23_month_end",
    with_panels("brand")
    + """, m AS (SELECT symbol, last_day(date) AS month_end, arg_max(close, date) AS v FROM brand GROUP BY 1, 2), b AS (SELECT symbol, min(month_end) AS lo, max(month_end) AS hi FROM m GROUP BY 1),
    grid AS (SELECT symbol, last_day(CAST(unnest(generate_series(date_trunc('month', lo), date_trunc('month', hi), INTERVAL 1 MONTH)) AS DATE)) AS month_end FROM b)
    SELECT symbol, month_end, round(v, 6) AS v FROM grid LEFT JOIN m USING (symbol, month_end)""",
)
def month_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last level of every month; a month without one has null."""
    m = P.px_brand(spark, sf_dir).groupBy("symbol", F.last_day(AT).alias("month_end")).agg(F.max_by("close", AT).alias("v"))
    span = m.groupBy("symbol").agg(F.trunc(F.min("month_end"), "MM").alias("lo"), F.trunc(F.max("month_end"), "MM").alias("hi"))
    grid = span.select("symbol", F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias("m")).select("symbol", F.last_day("m").alias("month_end"))
    return rounded(grid.join(m, ["symbol", "month_end"], "left"))


@query("q_w24_first_session", with_panels("px") + "SELECT symbol, CAST(date_trunc('month', date) AS DATE) AS month, min(date) AS first_session FROM px GROUP BY 1, 2")
def first_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.px_line(spark, sf_dir).groupBy("symbol", F.trunc(AT, "MM").alias("month")).agg(F.min(AT).alias("first_session"))


@query(
    "q_w25_annual_dates",
    with_panels("px") + ", s AS (SELECT symbol, min(date) + 100 AS start FROM px GROUP BY 1) SELECT symbol, min(date) AS rebalance FROM px JOIN s USING (symbol) WHERE date >= start GROUP BY symbol, year(date)",
)
def annual_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First session on or after a start, then the first of every later year."""
    px = P.px_line(spark, sf_dir).withColumn("start", F.date_add(F.min(AT).over(_whole(KEYS)), 100))
    return px.where("date >= start").groupBy("symbol", F.year(AT).alias("y")).agg(F.min(AT).alias("rebalance")).drop("y")


@query(
    "q_w27_trailing_year",
    with_panels("ret")
    + " SELECT symbol, date, round(level / lag(level, 252) OVER (PARTITION BY symbol ORDER BY date) - 1, 6) AS ret_12m, round(CASE WHEN count(r) OVER f >= 30 THEN stddev_samp(r) OVER f * sqrt(252) END, 6) AS vol FROM ret WINDOW f AS (PARTITION BY symbol ORDER BY date ROWS 251 PRECEDING)",
)
def trailing_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    vol = S.rolling_std("r", S.trailing(KEYS, AT, 252), 30) * F.sqrt(F.lit(252.0))
    return rounded(P.returns(spark, sf_dir).select("symbol", AT, (F.col("level") / F.lag("level", 252).over(S.ordered(KEYS, AT)) - 1).alias("ret_12m"), vol.alias("vol")))


@query(
    "q_w28_armed_cap",
    with_panels("idx")
    + ", d AS (SELECT symbol, date, level / max(level) OVER (PARTITION BY symbol ORDER BY date) - 1 AS dd FROM idx) SELECT symbol, date, CAST(CASE WHEN lag(dd) OVER (PARTITION BY symbol ORDER BY date) < -0.1 THEN 0.5 ELSE 1.0 END AS DOUBLE) AS cap FROM d",
)
def armed_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cap holds on a day if the drawdown of the day before was below the arming level."""
    d = P.px_index(spark, sf_dir).withColumn("dd", S.drawdown("level", S.upto(KEYS, AT)))
    return d.select("symbol", AT, F.when(F.lag("dd").over(S.ordered(KEYS, AT)) < -0.1, F.lit(0.5)).otherwise(1.0).alias("cap"))
