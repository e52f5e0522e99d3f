"""Inference, simulation and allocation: relational where SQL can say it, grouped kernels elsewhere."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import kernels as K
from ..operators import rebalance, regression
from ..operators import series as S
from ..sources import panels as P
from ..sources.panels import with_panels
from .registry import query, rounded

KEYS, AT = ["symbol"], "date"



def long_run_sql(source: str) -> str:
    """CTEs from source (symbol, date, s) to lr (symbol, lags, n, v): bandwidth and long-run variance of every line."""
    return f""", z AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i, s, s - avg(s) OVER (PARTITION BY symbol) AS z FROM {source} WHERE s IS NOT NULL),
    l AS (SELECT *, lag(z) OVER (PARTITION BY symbol ORDER BY i) AS p FROM z),
    rho AS (SELECT symbol, count(*) AS n, greatest(-0.97, least(0.97, avg(z * p) / avg(z * z))) AS rho FROM l GROUP BY 1),
    band AS (SELECT symbol, n, CAST(greatest(1, least(n // 4, floor(1.1447 * pow(4 * rho * rho / pow(1 - rho * rho, 2) * n, 1.0 / 3)))) AS BIGINT) AS lags FROM rho),
    prod AS (SELECT a.symbol, k, avg(a.z * b.z) AS g FROM z a JOIN band USING (symbol), LATERAL (SELECT unnest(range(0, lags + 1)) AS k) t
      JOIN z b ON b.symbol = a.symbol AND b.i = a.i - k GROUP BY 1, 2),
    lr AS (SELECT symbol, lags, n, greatest(0, sum(CASE WHEN k = 0 THEN g ELSE 2 * (1 - k / (lags + 1.0)) * g END)) AS v FROM prod JOIN band USING (symbol) GROUP BY 1, 2, 3)"""


_PATH = """, path AS (SELECT symbol, date, CASE WHEN count(r) OVER f >= 252 THEN avg(r) OVER f / nullif(stddev_samp(r) OVER f, 0) * sqrt(252) END AS s FROM ret
    WINDOW f AS (PARTITION BY symbol ORDER BY date ROWS 251 PRECEDING))""" + long_run_sql("path")


def long_run(path: DataFrame) -> DataFrame:
    """symbol, n, mean, lags, lr_var of the values s (symbol, date, s) of every line, one kernel call a line."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        z = pdf.sort_values("date").s.to_numpy()
        lags = K.plug_in_lags(z)
        return pd.DataFrame({"symbol": [pdf.symbol.iloc[0]], "n": [len(z)], "mean": [z.mean()], "lags": [lags], "lr_var": [K.hac_variance(z, lags)]})

    return path.where("s is not null").groupBy("symbol").applyInPandas(one, "symbol string, n long, mean double, lags long, lr_var double")


def _stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long-run variance of the rolling Sharpe path."""
    path = P.returns(spark, sf_dir).select("symbol", AT, S.rolling_sharpe("r", S.trailing(KEYS, AT, 252), 252).alias("s"))
    return long_run(path).withColumnRenamed("mean", "mean_rolling")


@query("q_a41_long_run_variance", with_panels("ret") + _PATH + " SELECT symbol, n, lags, round(v, 5) AS lr_var FROM lr")
def long_run_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_stability(spark, sf_dir).select("symbol", "n", "lags", "lr_var"), 5)


@query("q_a44_stability_score", with_panels("ret") + _PATH + ", m AS (SELECT symbol, avg(s) AS m FROM z GROUP BY 1), q AS (SELECT symbol, m / sqrt(v) AS ssr FROM lr JOIN m USING (symbol)) SELECT symbol, round(ssr, 5) AS ssr, round((rank() OVER (ORDER BY ssr) + (count(*) OVER (PARTITION BY ssr) - 1) / 2.0) / count(*) OVER () * 100, 5) AS score FROM q")
def stability_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the path over its long-run deviation, with the percentile score over the universe (A43, A44, W20): one row a symbol."""
    s = _stability(spark, sf_dir).withColumn("ssr", F.col("mean_rolling") / F.sqrt("lr_var"))
    return rounded(s.select("symbol", "ssr", ((F.rank().over(Window.orderBy("ssr")) + (F.count("*").over(Window.partitionBy("ssr")) - 1) / 2) / F.count("*").over(Window.partitionBy()) * 100).alias("score")), 5)


@query(
    "q_a40_moments",
    with_panels("ret") + " SELECT a.symbol AS a, b.symbol AS b, round(covar_samp(a.r, b.r) * 252, 6) AS cov, round(avg(a.r) * 252, 6) AS mean_a, count(*) AS n FROM ret a JOIN ret b ON a.date = b.date WHERE a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY 1, 2",
)
def annual_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = P.returns(spark, sf_dir).where("r is not null")
    j = r.select(AT, F.col("symbol").alias("a"), F.col("r").alias("x")).join(r.select(AT, F.col("symbol").alias("b"), F.col("r").alias("y")), AT)
    return rounded(j.groupBy("a", "b").agg((F.covar_samp("x", "y") * 252).alias("cov"), (F.avg("x") * 252).alias("mean_a"), F.count("*").alias("n")))


@query(
    "q_k3_hac_regression",
    with_panels("ret")
    + """, y AS (SELECT a.symbol, a.date, a.r AS y, b.r AS x FROM ret a JOIN ret b ON a.date = b.date AND b.symbol = 'NO' WHERE a.symbol <> 'NO' AND a.r IS NOT NULL AND b.r IS NOT NULL),
    f AS (SELECT symbol, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, count(*) AS n, sum(x) AS sx, sum(x * x) AS sxx FROM y GROUP BY 1),
    u AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i, y - a - b * x AS u, (y - a - b * x) * x AS v FROM y JOIN f USING (symbol)),
    s AS (SELECT p.symbol, sum(CASE WHEN k = 0 THEN 1 ELSE 2 * (1 - k / 6.0) END * p.u * q.u) AS uu, sum(CASE WHEN k = 0 THEN 1 ELSE (1 - k / 6.0) END * (p.u * q.v + CASE WHEN k = 0 THEN 0 ELSE p.v * q.u END)) AS uv, sum(CASE WHEN k = 0 THEN 1 ELSE 2 * (1 - k / 6.0) END * p.v * q.v) AS vv
      FROM u p, range(0, 6) t(k) JOIN u q ON q.symbol = p.symbol AND q.i = p.i - k GROUP BY 1)
    SELECT symbol, round(b, 6) AS beta, round(a * 252, 6) AS alpha, round(a / sqrt((sxx * sxx * uu - 2 * sx * sxx * uv + sx * sx * vv) / pow(n * sxx - sx * sx, 2)), 5) AS t_alpha FROM f JOIN s USING (symbol)""",
)
def hac_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regression on the benchmark with a five-lag sandwich t value of the intercept."""
    r = P.returns(spark, sf_dir).where("r is not null")
    x = r.where("symbol = 'NO'").select(AT, F.col("r").alias("x"))
    out = regression.fitted(r.where("symbol <> 'NO'").join(x, AT).select("symbol", AT, F.col("r").alias("y"), "x"), "symbol", AT, "y", ["x"])
    return out.select("symbol", F.round(F.col("beta")[1], 6).alias("beta"), F.round(F.col("beta")[0] * 252, 6).alias("alpha"), F.round(F.col("t")[0], 5).alias("t_alpha"))


@query("q_k13_buy_hold", with_panels("idx") + ", f AS (SELECT symbol, date, level / first_value(level) OVER (PARTITION BY symbol ORDER BY date) AS rel FROM idx) SELECT date, round(sum(rel) / count(*), 6) AS wealth, count(*) AS n FROM f GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT symbol) FROM idx)")
def buy_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal first weights, never rebalanced; dates on which every symbol has a level."""
    f = P.px_index(spark, sf_dir).withColumn("rel", F.col("level") / F.first("level").over(S.upto(KEYS, AT)))
    wealth = f.groupBy(AT).agg((F.sum("rel") / F.count("*")).alias("wealth"), F.count("*").alias("n"))
    return rounded(wealth.crossJoin(F.broadcast(_names(f))).where("n = names").drop("names"))


def _names(df: DataFrame) -> DataFrame:
    """One row: how many symbols there are."""
    return df.agg(F.count_distinct("symbol").alias("names"))


@query(
    "q_k12_rebalanced",
    with_panels("idx")
    + """, c AS (SELECT date FROM idx GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT symbol) FROM idx)), m AS (SELECT date, min(date) OVER (PARTITION BY date_trunc('month', date)) AS reb FROM c),
    g AS (SELECT m.date, m.reb, avg(i.level / b.level) AS growth FROM m JOIN idx i USING (date) JOIN idx b ON b.symbol = i.symbol AND b.date = m.reb GROUP BY 1, 2),
    e AS (SELECT reb, lead(reb) OVER (ORDER BY reb) AS nxt FROM (SELECT DISTINCT reb FROM m)), s AS (SELECT e.reb, e.nxt, avg(n.level / b.level) AS seg FROM e JOIN idx b ON b.date = e.reb JOIN idx n ON n.symbol = b.symbol AND n.date = e.nxt GROUP BY 1, 2),
    w AS (SELECT nxt AS reb, product(seg) OVER (ORDER BY reb) AS w FROM s UNION ALL SELECT min(reb), 1.0 FROM e)
    SELECT date, round(w * growth, 6) AS wealth FROM g JOIN w USING (reb)""",
)
def rebalanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal weights restored at the first common session of every month: wealth inside a month is the wealth at its start times the mean relative."""
    i = P.px_index(spark, sf_dir)
    c = i.groupBy(AT).agg(F.count("*").alias("n")).crossJoin(F.broadcast(_names(i))).where("n = names").select(AT, F.min(AT).over(Window.partitionBy(F.trunc(AT, "MM"))).alias("reb"))
    rel = i.join(c, AT).join(i.select("symbol", F.col(AT).alias("reb"), F.col("level").alias("base")), ["symbol", "reb"])
    g = rel.groupBy(AT, "reb").agg(F.avg(F.col("level") / F.col("base")).alias("growth"))
    e = c.select("reb").distinct().withColumn("nxt", F.lead("reb").over(Window.orderBy("reb")))  # a row a month
    seg = i.select("symbol", F.col(AT).alias("reb"), F.col("level").alias("b")).join(e.where("nxt is not null"), "reb").join(i.select("symbol", F.col(AT).alias("nxt"), F.col("level").alias("v")), ["symbol", "nxt"])
    s = seg.groupBy("reb", "nxt").agg(F.avg(F.col("v") / F.col("b")).alias("seg"))
    w = s.select(F.col("nxt").alias("reb"), F.product("seg").over(Window.orderBy("reb").rowsBetween(Window.unboundedPreceding, 0)).alias("w")).unionAll(e.agg(F.min("reb").alias("reb")).withColumn("w", F.lit(1.0)))
    return rounded(g.join(w, "reb").select(AT, (F.col("w") * F.col("growth")).alias("wealth")))


_TARGETS = """, n AS (SELECT symbol, row_number() OVER (ORDER BY symbol) - 1 AS i FROM (SELECT DISTINCT symbol FROM ord)),
    m AS (SELECT month, date, row_number() OVER (ORDER BY month) - 1 AS k FROM (SELECT date_trunc('month', date) AS month, min(date) AS date FROM ord GROUP BY 1)),
    t AS (SELECT 'equal' AS rule, date, symbol, 0.2::DOUBLE AS weight FROM m, n UNION ALL SELECT 'tilt', date, symbol, CASE WHEN (k + i) % 7 = 0 THEN NULL ELSE 0.1 + 0.04 * i END FROM m, n WHERE k % 3 = 0
      UNION ALL SELECT 'turn', date, symbol, CASE WHEN i = k % 5 THEN 1.5::DOUBLE WHEN i = (k + 1) % 5 THEN -0.5 ELSE 0 END FROM m, n UNION ALL SELECT 'hold', date, symbol, 0.3 - 0.05 * i FROM m, n WHERE k = 0)"""


@query(
    "q_k12_simulated",
    with_panels("ord").replace("WITH", "WITH RECURSIVE")
    + _TARGETS
    + """, g AS (SELECT d.date, n.symbol, 100 + o.close / 10000 AS p, last_value(100 + o.close / 10000 IGNORE NULLS) OVER (PARTITION BY n.symbol ORDER BY d.date) AS last FROM (SELECT DISTINCT date FROM ord) d CROSS JOIN n LEFT JOIN ord o USING (date, symbol)),
    o AS (SELECT t.rule, t.date, row_number() OVER (PARTITION BY t.rule ORDER BY t.date) AS k, list(weight ORDER BY symbol) AS w, list(p ORDER BY symbol) AS p, list(last ORDER BY symbol) AS l FROM t JOIN g USING (date, symbol) GROUP BY 1, 2),
    s AS (SELECT rule, 0::BIGINT AS k, NULL::DATE AS date, 10000.0::DOUBLE AS cash, [0.0, 0.0, 0.0, 0.0, 0.0]::DOUBLE[] AS u FROM (SELECT DISTINCT rule FROM o)
      UNION ALL SELECT rule, k, date, v - list_sum(list_transform(list_zip(u2, l), lambda x: coalesce(x[1] * x[2], 0))), u2 FROM
        (SELECT *, list_transform(list_zip(w, p, u), lambda x: CASE WHEN x[1] IS NOT NULL AND x[2] IS NOT NULL THEN x[1] * v / x[2] ELSE x[3] END) AS u2 FROM
          (SELECT o.*, s.u, s.cash + list_sum(list_transform(list_zip(s.u, o.l), lambda x: coalesce(x[1] * x[2], 0))) AS v FROM s JOIN o ON o.rule = s.rule AND o.k = s.k + 1))),
    l AS (SELECT date, list(last ORDER BY symbol) AS l FROM g GROUP BY 1)
    SELECT d.rule, d.date, round(coalesce(s.cash, 10000), 4) + 0.0 AS cash, round(coalesce(s.cash + list_sum(list_transform(list_zip(s.u, d.l), lambda x: coalesce(x[1] * x[2], 0))), 10000), 4) AS wealth
    FROM (SELECT l.*, r.rule FROM l CROSS JOIN (SELECT DISTINCT rule FROM o) r) d ASOF LEFT JOIN (SELECT * FROM s WHERE k > 0) s ON s.rule = d.rule AND d.date >= s.date""",
)
def simulated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four sets of targets on lines with missing prices: equal weights every month, a tilt of every quarter that leaves lines out, a leveraged turn, and a first purchase that is held."""
    px = P.px_orders(spark, sf_dir).select("symbol", AT, (100 + F.col("close") / 10000).alias("price"))  # damped
    names = px.select("symbol").distinct().withColumn("i", F.row_number().over(Window.orderBy("symbol")) - 1)  # five lines
    months = px.groupBy(F.trunc(AT, "MM").alias("month")).agg(F.min(AT).alias(AT)).withColumn("k", F.row_number().over(Window.orderBy("month")) - 1).crossJoin(F.broadcast(names))  # months
    i, k = F.col("i"), F.col("k")
    rule = lambda name, weight, where: months.where(where).select(F.lit(name).alias("rule"), AT, "symbol", weight.cast("double").alias("weight"))
    targets = rule("equal", F.lit(0.2), "true").unionByName(rule("tilt", F.when((k + i) % 7 != 0, 0.1 + 0.04 * i), "k % 3 = 0"))
    targets = targets.unionByName(rule("turn", F.when(i == k % 5, 1.5).when(i == (k + 1) % 5, -0.5).otherwise(0.0), "true")).unionByName(rule("hold", 0.3 - 0.05 * i, "k = 0"))
    return rounded(rebalance.simulated(px, targets), 4).withColumn("cash", F.col("cash") + F.lit(0.0))  # no negative zero


@query(
    "q_k30_auc",
    "WITH j AS (SELECT toxic, n_chars FROM labels JOIN documents USING (doc_id)), r AS (SELECT toxic, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS rk FROM j) SELECT count(*) FILTER (WHERE toxic = 1) AS n1, count(*) FILTER (WHERE toxic = 0) AS n0, round((sum(rk) FILTER (WHERE toxic = 1) - count(*) FILTER (WHERE toxic = 1) * (count(*) FILTER (WHERE toxic = 1) + 1) / 2.0) / (count(*) FILTER (WHERE toxic = 1) * count(*) FILTER (WHERE toxic = 0)), 6) AS auc FROM r",
)
def auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area under the curve by average rank sums: the scores are counted first, and only their distinct values are ranked."""
    j = P.table(spark, sf_dir, "labels").join(P.table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    v = j.groupBy("n_chars").agg(F.count_if(F.col("toxic") == 1).alias("pos"), F.count_if(F.col("toxic") == 0).alias("neg"))
    v = C.running_total(v, "n_chars", "neg", "below")
    a = v.withColumn("won", F.col("pos") * (F.col("below") + F.col("neg") / 2)).agg(F.sum("pos").alias("n1"), F.sum("neg").alias("n0"), F.sum("won").alias("won"))
    return rounded(a.select("n1", "n0", (F.col("won") / (F.col("n1") * F.col("n0"))).alias("auc")))


@query("q_k46_relative", with_panels("idx") + ", f AS (SELECT symbol, date, level / first_value(level) OVER (PARTITION BY symbol ORDER BY date) AS v FROM idx) SELECT a.symbol, a.date, round(a.v / b.v, 6) AS relative FROM f a JOIN f b ON a.date = b.date AND b.symbol = 'NO' WHERE a.symbol <> 'NO'")
def relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = P.px_index(spark, sf_dir).withColumn("v", F.col("level") / F.first("level").over(S.upto(KEYS, AT)))
    b = f.where("symbol = 'NO'").select(AT, F.col("v").alias("b"))
    return rounded(f.where("symbol <> 'NO'").join(b, AT).select("symbol", AT, (F.col("v") / F.col("b")).alias("relative")))


# ---------------------------------------------------------------- grouped kernels (no SQL form; compared with plain numpy in tests)


def sessions_of(r: DataFrame) -> DataFrame:
    """(date, pos): the dates on which every symbol has a return."""
    names = r.agg(F.count_distinct("symbol").alias("names"))  # one row
    d = r.groupBy(AT).agg(F.count("*").alias("n")).crossJoin(F.broadcast(names)).where("n = names").select(AT)
    return C.positions(d, AT)


def windows_of(r: DataFrame, size: int, step: int, first: int = 0) -> DataFrame:
    """(end, date, symbol, r): the trailing window of every step-th date of the common calendar, counted from ``first``.

    A date belongs to at most size / step windows, whatever the history; only the
    date list is numbered, the panel itself is joined to it.
    """
    days = sessions_of(r)
    last = days.agg(F.max("pos").alias("last"))  # one row
    ends = days.crossJoin(F.broadcast(last)).withColumn("end", F.explode(F.expr(f"filter(transform(sequence(0, {-(-size // step)}), k -> (ceil((pos - {first}) / {step}) + k) * {step} + {first}), e -> e >= pos and e < pos + {size} and e >= {size - 1})")))
    return r.join(ends.where("end <= last"), AT).select("end", AT, "symbol", "r")


def slid(r: DataFrame, size: int, step: int, first: int, value: Callable[[np.ndarray], float], block: int = 256) -> DataFrame:
    """(date, value) of the trailing window of ``size`` common sessions at every step-th one counted from ``first``.

    A block of sessions and the ``size - 1`` before it are one group, in which the window slides: a row is in
    1 + size / block groups instead of size / step.
    """
    days = sessions_of(r)
    top = days.agg(F.floor(F.max("pos") / block).alias("top"))  # one row
    of = F.explode(F.sequence(F.floor(F.col("pos") / block), F.floor((F.col("pos") + size - 1) / block)))
    inside = days.withColumn("block", of).crossJoin(F.broadcast(top)).where("block <= top").select(AT, "pos", "block")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        lo = int(pdf.block.iloc[0]) * block
        w = pdf.pivot(index="pos", columns="symbol", values="r").sort_index()
        x, at, dates = w.to_numpy(), w.index.to_numpy(), pdf.drop_duplicates("pos").set_index("pos").date
        ends = [k for k in range(size - 1, len(at)) if at[k] >= lo and (at[k] - first) % step == 0]
        return pd.DataFrame({"date": pd.Series([dates[at[k]] for k in ends], dtype=object), "value": [value(x[k - size + 1 : k + 1]) for k in ends]})

    return r.join(inside, AT).groupBy("block").applyInPandas(run, "date date, value double")


def _wide(pdf: pd.DataFrame) -> tuple[pd.DataFrame, object]:
    w = pdf.pivot(index="date", columns="symbol", values="r").sort_index()
    return w, w.index[-1]


@query("q_w29_absorption")
def absorption(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absorption ratio of trailing 252-session windows every fifth session from the first full one, carried forward between them."""
    size = 252
    r = P.returns(spark, sf_dir).where("r is not null").select("symbol", AT, "r")
    got = slid(r, size, 5, size - 1, K.absorption).withColumnRenamed("value", "absorption")
    every = sessions_of(r).where(F.col("pos") >= size - 1).join(got, AT, "left")
    carried = F.last(F.when(~F.isnan("absorption"), F.col("absorption")), ignorenulls=True).over(Window.orderBy(AT).rowsBetween(Window.unboundedPreceding, 0))  # sessions
    return every.select(AT, F.coalesce(carried, F.lit(float("nan"))).alias("absorption"))


@query("q_w30_turbulence")
def turbulence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance of every session from the 252 before it."""
    r = P.returns(spark, sf_dir).where("r is not null").select("symbol", AT, "r")
    return slid(r, 253, 1, 0, lambda x: K.turbulence(x[:-1], x[-1])).withColumnRenamed("value", "turbulence")


@query("q_k2_bootstrap")
def bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block-bootstrap p value of the stability ratio: replicates are dealt in chunks over the cluster, p = (non-positive + failed + 1) / (B + 1), p_lower the same of the non-negative ones."""
    chunks, each = 40, 25

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        r, seeds = pdf.r.to_numpy(), int(pdf.chunk.iloc[0]) * each + np.arange(each)
        got = K.resampled_stability(r, seeds, K.block_length(r), 252)
        return pd.DataFrame({"symbol": pdf.symbol.iloc[0], "seed": seeds, "ssr": got, "observed": K.path_stability(r)[0]})

    r = P.returns(spark, sf_dir).where("r is not null").select("symbol", AT, "r")
    dealt = r.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    draws = dealt.groupBy("symbol", "chunk").applyInPandas(run, "symbol string, seed long, ssr double, observed double")
    failed = F.col("ssr").isNull() | F.isnan("ssr") | (F.abs("ssr") == float("inf"))
    tail = lambda hit: (F.count_if(failed | hit) + 1) / (F.count("*") + 1)
    return draws.groupBy("symbol").agg(F.max("observed").alias("ssr"), tail(F.col("ssr") <= 0).alias("p"), F.count("*").alias("n_boot"), tail(F.col("ssr") >= 0).alias("p_lower"))


@query("q_k5_risk_parity")
def risk_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walk-forward weights: at every 60th session, hierarchical parity on the 251 sessions strictly before it."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        w, last = _wide(pdf)
        return pd.DataFrame({"date": last, "symbol": w.columns, "weight": K.risk_parity(w.to_numpy()[:-1])})

    r = P.returns(spark, sf_dir).where("r is not null").select("symbol", AT, "r")
    return windows_of(r, 252, 60).groupBy("end").applyInPandas(one, "date date, symbol string, weight double")


@query("q_k7_posterior")
def posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views (last quarter's best over worst) blended with equal prior weights, then half of it mixed with parity weights (K7, K8)."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        w, last = _wide(pdf)
        x = w.to_numpy()[:-1]
        n, quarter = x.shape[1], x[-63:].sum(axis=0)
        pick = np.zeros((1, n))
        pick[0, quarter.argmax()], pick[0, quarter.argmin()] = 1, -1
        got = K.posterior_weights(x, np.full(n, 1 / n), pick, np.array([0.02 / 252]))
        return pd.DataFrame({"date": last, "symbol": w.columns, "weight": got, "blend": 0.5 * got + 0.5 * K.risk_parity(x)})

    r = P.returns(spark, sf_dir).where("r is not null").select("symbol", AT, "r")
    return windows_of(r, 252, 60).groupBy("end").applyInPandas(one, "date date, symbol string, weight double, blend double")


@query("q_k18_minimax")
def minimax(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixture of symbols with the best worst regime."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        a = pdf.pivot(index="symbol", columns="regime", values="ann").fillna(0).sort_index()
        mix, value = K.minimax(a.to_numpy())
        return pd.DataFrame({"symbol": a.index, "weight": mix, "value": value})

    from .relational_queries import label_ffill

    return label_ffill(spark, sf_dir).groupBy(F.lit(1).alias("_g")).applyInPandas(one, "symbol string, weight double, value double")  # symbols times regimes


@query("q_k21_jump_states")
def jump_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-state jump model of every symbol on return and trailing volatility."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        path, centre, _ = K.jump_model(pdf[["ret", "vol"]].to_numpy(), 20.0)
        order = np.argsort(np.argsort(-centre[:, 0], kind="stable"))
        return pd.DataFrame({"symbol": pdf.symbol, "date": pdf.date, "state": order[path]})

    f = S.trailing(KEYS, AT, 21)
    x = P.returns(spark, sf_dir).select("symbol", AT, S.rolling_mean("r", f, 21).alias("ret"), S.rolling_std("r", f, 21).alias("vol")).where("ret is not null")
    return x.groupBy("symbol").applyInPandas(one, "symbol string, date date, state long")


@query("q_k27_frontier")
def frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixty target means between the least and the greatest, the least-variance weights of each; targets are dealt over the cluster."""
    r = P.returns(spark, sf_dir).where("r is not null")
    j = r.select(AT, F.col("symbol").alias("a"), F.col("r").alias("x")).join(r.select(AT, F.col("symbol").alias("b"), F.col("r").alias("y")), AT)
    m = j.groupBy("a", "b").agg((F.covar_samp("x", "y") * 252).alias("cov"), (F.avg("x") * 252).alias("mu"))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        cov = pdf.pivot(index="a", columns="b", values="cov").sort_index()
        mu = pdf.groupby("a").mu.mean().sort_index()
        target = np.linspace(mu.min(), mu.max(), 60)[int(pdf.k.iloc[0])]
        w, ok = K.frontier_point(mu.to_numpy(), cov.to_numpy(), float(target))
        return pd.DataFrame({"k": pdf.k.iloc[0], "target": target, "feasible": ok, "variance": w @ cov.to_numpy() @ w, "symbol": mu.index, "weight": w})

    return m.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(59)))).groupBy("k").applyInPandas(one, "k int, target double, feasible boolean, variance double, symbol string, weight double")


@query("q_a35_signed_rank")
def signed_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact signed-rank tail of the paired scores of every user (a month of days)."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        w, p = K.signed_rank_tail((pdf.pit - pdf.nonpit).to_numpy())
        return pd.DataFrame({"user_id": [pdf.user_id.iloc[0]], "w_plus": [w], "p": [p], "n": [len(pdf)]})

    s = P.scores(spark, sf_dir).where("pit is not null and nonpit is not null")
    return s.groupBy("user_id").applyInPandas(one, "user_id long, w_plus double, p double, n long")


@query("q_k17_paths")
def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Block-bootstrap paths of the monthly panel: starts come from a hash of path and block, so a lost task draws the same again."""
    n_paths, horizon, block = 10_000, 6, 3
    m = P.macro(spark, sf_dir)
    pos = m.select(F.row_number().over(Window.orderBy("month")).alias("pos"), "d", "t", "q")  # months
    size = m.agg(F.count("*").alias("n"))
    tile = spark.range(n_paths).crossJoin(F.broadcast(size)).select(F.col("id").alias("path"), "n", F.explode(F.sequence(F.lit(0), F.lit(horizon // block - 1))).alias("b"))
    start = F.pmod(F.xxhash64("path", "b"), F.col("n") - block + 1) + 1
    step = tile.select("path", "b", start.alias("s"), F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("k"))
    return step.select("path", (F.col("b") * block + F.col("k")).alias("step"), (F.col("s") + F.col("k")).alias("pos")).join(F.broadcast(pos), "pos").drop("pos")
