"""Tests, spreads, report rows and composed overlays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import series as S
from ..sources import panels as P
from ..sources.panels import with_panels
from .kernel_queries import long_run, long_run_sql
from .registry import query, rounded

KEYS, AT = ["symbol"], "date"


@query("q_a46_hac_t", with_panels("ret") + ", rs AS (SELECT symbol, date, r AS s FROM ret)" + long_run_sql("rs") + ", m AS (SELECT symbol, avg(s) AS m FROM z GROUP BY 1) SELECT symbol, lags, round(m / sqrt(v / n), 5) AS t FROM lr JOIN m USING (symbol)")
def hac_t(spark: SparkSession, sf_dir: str) -> DataFrame:
    """t value of the mean return over its long-run variance, with the plug-in bandwidth."""
    v = long_run(P.returns(spark, sf_dir).select("symbol", AT, F.col("r").alias("s")))
    return rounded(v.select("symbol", "lags", (F.col("mean") / F.sqrt(F.col("lr_var") / F.col("n"))).alias("t")), 5)


@query(
    "q_a48_two_samples",
    """WITH e AS (SELECT value, event_type = 'click' AS a FROM events WHERE event_type IN ('click', 'view')), r AS (SELECT *, rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2.0 AS k FROM e)
    SELECT count(*) FILTER (WHERE a) AS n1, count(*) FILTER (WHERE NOT a) AS n2,
      round((avg(value) FILTER (WHERE a) - avg(value) FILTER (WHERE NOT a)) / sqrt(var_samp(value) FILTER (WHERE a) / count(*) FILTER (WHERE a) + var_samp(value) FILTER (WHERE NOT a) / count(*) FILTER (WHERE NOT a)), 5) AS welch_t,
      round(sum(k) FILTER (WHERE a) - count(*) FILTER (WHERE a) * (count(*) FILTER (WHERE a) + 1) / 2.0, 1) AS u FROM r""",
)
def two_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Welch t and Mann-Whitney U; the U statistic needs only the distinct values and their counts in order."""
    e = P.table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view"))
    a = F.col("event_type") == "click"
    v = e.groupBy("value").agg(F.count_if(a).alias("x"), F.count_if(~a).alias("y"))
    part = C.running_total(v, "value", "y", "below")
    u = part.agg(F.sum(F.col("x") * (F.col("below") + F.col("y") / 2)).alias("u"))
    m = e.agg(*(f(F.when(c, F.col("value"))).alias(f"{n}{i}") for i, c in ((1, a), (2, ~a)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))))
    t = (F.col("m1") - F.col("m2")) / F.sqrt(F.col("v1") / F.col("n1") + F.col("v2") / F.col("n2"))
    return m.crossJoin(F.broadcast(u)).select("n1", "n2", F.round(t, 5).alias("welch_t"), F.round("u", 1).alias("u"))  # one row each


@query(
    "q_a49_ks",
    """WITH c AS (SELECT value, count(*) FILTER (WHERE event_type = 'click') AS x, count(*) FILTER (WHERE event_type = 'view') AS y FROM events WHERE event_type IN ('click', 'view') GROUP BY 1),
    s AS (SELECT sum(x) OVER (ORDER BY value) * 1.0 / sum(x) OVER () AS fx, sum(y) OVER (ORDER BY value) * 1.0 / sum(y) OVER () AS fy FROM c) SELECT round(max(abs(fx - fy)), 6) AS d FROM s""",
)
def ks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest distance of two empirical distributions."""
    e = P.table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view"))
    c = e.groupBy("value").agg(F.count_if(F.col("event_type") == "click").alias("x"), F.count_if(F.col("event_type") == "view").alias("y"))
    s = C.running_total(C.running_total(c, "value", "x", "bx"), "value", "y", "by")
    total = c.agg(F.sum("x").alias("nx"), F.sum("y").alias("ny"))  # one row
    return rounded(s.crossJoin(F.broadcast(total)).agg(F.max(F.abs((F.col("bx") + F.col("x")) / F.col("nx") - (F.col("by") + F.col("y")) / F.col("ny"))).alias("d")))


@query("q_a50_vector_frequency", "SELECT round(l_discount, 2) AS d, round(l_tax, 2) AS t, count(*) AS n FROM lineitem GROUP BY 1, 2 ORDER BY n DESC, d, t LIMIT 5")
def vector_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most frequent rounded vectors: a top-k report."""
    return P.table(spark, sf_dir, "lineitem").groupBy(F.round("l_discount", 2).alias("d"), F.round("l_tax", 2).alias("t")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d", "t").limit(5)


@query("q_a51_score_row", "SELECT event_type AS version, count(value) AS n, round(avg(value), 6) AS mean, round(median(value), 6) AS med, round(quantile_cont(value, 0.9), 6) AS p90, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1")
def score_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = P.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("version"))
    return rounded(a.agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.median("value").alias("med"), S.percentile("value", 0.9).alias("p90"), F.min("value").alias("lo"), F.max("value").alias("hi")))


@query("q_a52_common_growth", with_panels("idx") + ", c AS (SELECT a.date, a.level AS x, b.level AS y FROM idx a JOIN idx b USING (date) WHERE a.symbol = 'AF' AND b.symbol = 'RF') SELECT round(arg_max(x, date) / arg_min(x, date) - 1, 6) AS gx, round(arg_max(y, date) / arg_min(y, date) - 1, 6) AS gy, count(*) AS n FROM c")
def common_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = P.px_index(spark, sf_dir)
    c = i.where("symbol = 'AF'").select(AT, F.col("level").alias("x")).join(i.where("symbol = 'RF'").select(AT, F.col("level").alias("y")), AT)
    return rounded(c.agg((F.max_by("x", AT) / F.min_by("x", AT) - 1).alias("gx"), (F.max_by("y", AT) / F.min_by("y", AT) - 1).alias("gy"), F.count("*").alias("n")))


@query("q_w22_ffill", with_panels("ord") + ", c AS (SELECT DISTINCT date FROM ord), s AS (SELECT DISTINCT symbol FROM ord), f AS (SELECT symbol, date, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date) AS v FROM c CROSS JOIN s LEFT JOIN ord USING (symbol, date)) SELECT symbol, date, round(ln(v), 6) AS v FROM f")
def ffill(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .series_queries import union_calendar

    g = union_calendar(P.px_orders(spark, sf_dir))
    return rounded(g.select("symbol", AT, F.ln(F.last("close", True).over(S.upto(KEYS, AT))).alias("v")))


@query(
    "q_w14_spread",
    with_panels("ret")
    + """, c AS (SELECT a.date, a.r - b.r AS d FROM ret a JOIN ret b USING (date) WHERE a.symbol = 'AF' AND b.symbol = 'NO' AND a.r IS NOT NULL AND b.r IS NOT NULL), f AS (SELECT min(date) AS d0 FROM c)
    SELECT date, round(product(1 + d) OVER (ORDER BY date), 6) AS curve FROM c UNION ALL SELECT CASE isodow(d0) WHEN 1 THEN d0 - 3 WHEN 7 THEN d0 - 2 ELSE d0 - 1 END, 1.0 FROM f""",
)
def spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compounded spread of two lines with a base row one business day before its first return."""
    r = P.returns(spark, sf_dir).where("r is not null")
    c = r.where("symbol = 'AF'").select(AT, F.col("r").alias("x")).join(r.where("symbol = 'NO'").select(AT, F.col("r").alias("y")), AT).withColumn("d", F.col("x") - F.col("y"))
    curve = c.select(AT, F.product(1 + F.col("d")).over(Window.orderBy(AT).rowsBetween(Window.unboundedPreceding, 0)).alias("curve"))  # one line
    base = c.agg(C.previous_business_day(F.min(AT)).alias(AT)).withColumn("curve", F.lit(1.0))
    return rounded(curve.unionByName(base))


@query(
    "q_k15_drift_weights",
    with_panels("idx") + ", f AS (SELECT symbol, date, level / first_value(level) OVER (PARTITION BY symbol ORDER BY date) AS v FROM idx) SELECT symbol, date, round(v / sum(v) OVER (PARTITION BY date), 6) AS weight FROM f",
)
def drift_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = P.px_index(spark, sf_dir).withColumn("v", F.col("level") / F.first("level").over(S.upto(KEYS, AT)))
    return rounded(f.select("symbol", AT, (F.col("v") / F.sum("v").over(Window.partitionBy(AT))).alias("weight")))


@query(
    "q_f10_overlay",
    with_panels("ret")
    + """, w AS (SELECT symbol, date, r, level / max(level) OVER (PARTITION BY symbol ORDER BY date) - 1 AS dd FROM ret), e AS (SELECT symbol, date, r, CASE WHEN lag(dd) OVER (PARTITION BY symbol ORDER BY date) < -0.1 THEN 0.5 ELSE 1.0 END AS e FROM w)
    SELECT a.symbol, count(*) AS n, round(sum(a.e * a.r + (1 - a.e) * b.r), 6) AS total FROM e a JOIN ret b ON a.date = b.date AND b.symbol = 'RO' WHERE a.symbol <> 'RO' AND a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY 1""",
)
def overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposure times the base plus the rest in cash, exposure from the drawdown of the day before."""
    r = P.returns(spark, sf_dir)
    e = r.withColumn("dd", S.drawdown("level", S.upto(KEYS, AT))).withColumn("e", F.when(F.lag("dd").over(S.ordered(KEYS, AT)) < -0.1, 0.5).otherwise(1.0))
    j = e.where("symbol <> 'RO' and r is not null").join(r.where("symbol = 'RO' and r is not null").select(AT, F.col("r").alias("cash")), AT)
    return rounded(j.groupBy("symbol").agg(F.count("*").alias("n"), F.sum(F.col("e") * F.col("r") + (1 - F.col("e")) * F.col("cash")).alias("total")))


@query("q_o13_distinct", "SELECT count(DISTINCT l_orderkey) AS orders, count(DISTINCT (l_orderkey, l_linenumber)) AS lines, count(*) AS n FROM lineitem")
def distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.table(spark, sf_dir, "lineitem").agg(F.count_distinct("l_orderkey").alias("orders"), F.count_distinct(F.struct("l_orderkey", "l_linenumber")).alias("lines"), F.count("*").alias("n"))


@query("q_o17_repeats_agree", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1 AND (min(l_quantity) IS DISTINCT FROM max(l_quantity) OR min(l_shipdate) IS DISTINCT FROM max(l_shipdate))")
def repeats_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated keys whose rows differ."""
    g = P.table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), *(f(c).alias(f"{n}{i}") for i, c in enumerate(("l_quantity", "l_shipdate")) for n, f in (("lo", F.min), ("hi", F.max))))
    return g.where("n > 1 and not (lo0 <=> hi0 and lo1 <=> hi1)").select("l_orderkey", "l_linenumber", "n")


@query("q_f4_conviction", "SELECT user_id, round(least(1, sqrt(sum(v * v)) / sqrt(5)), 6) AS conviction FROM (SELECT user_id, event_type, avg(value / (1 + abs(value))) AS v FROM events GROUP BY 1, 2) GROUP BY 1")
def conviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Length of a map of loadings over the square root of five."""
    v = P.table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.avg(F.col("value") / (1 + F.abs("value"))).alias("v"))
    m = v.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("m"))
    return rounded(m.select("user_id", C.conviction("m").alias("conviction")))


@query("q_f5_exposure", "WITH x AS (SELECT * FROM (VALUES ('click', 0.5::DOUBLE), ('view', -0.2), ('error', 1.0)) t(event_type, w)) SELECT user_id, round(sum(v * w), 6) AS tilt FROM (SELECT user_id, event_type, avg(value / (1 + abs(value))) AS v FROM events GROUP BY 1, 2) JOIN x USING (event_type) GROUP BY 1")
def exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dot product of loadings and a fixed exposure row."""
    x = spark.createDataFrame([("click", 0.5), ("view", -0.2), ("error", 1.0)], "event_type string, w double")
    v = P.table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.avg(F.col("value") / (1 + F.abs("value"))).alias("v"))
    return rounded(v.join(F.broadcast(x), "event_type").groupBy("user_id").agg(F.sum(F.col("v") * F.col("w")).alias("tilt")))


@query("q_a24_summary", with_panels("ret") + "SELECT metric, " + ", ".join(f"round(max(v) FILTER (WHERE symbol = '{s}'), 6) AS {s}" for s in ("AF", "NO")) + " FROM (SELECT symbol, unnest(['vol', 'mean', 'best']) AS metric, unnest([stddev_samp(r) * sqrt(252), avg(r) * 252, max(r)]) AS v FROM ret GROUP BY symbol) GROUP BY 1")
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of two lines side by side."""
    a = P.returns(spark, sf_dir).where(F.col("symbol").isin("AF", "NO")).groupBy("symbol").agg((F.stddev_samp("r") * F.sqrt(F.lit(252.0))).alias("vol"), (F.avg("r") * 252).alias("mean"), F.max("r").alias("best"))
    return rounded(a.unpivot("symbol", ["vol", "mean", "best"], "metric", "v").groupBy("metric").pivot("symbol", ["AF", "NO"]).agg(F.first("v")))


@query(
    "q_a17_monthly_rows",
    with_panels("ret") + " SELECT symbol, CAST(year(date) AS BIGINT) AS y, CAST(month(date) AS BIGINT) AS m, min(date) AS window_start, max(date) AS window_end, count(*) AS n_obs, round(product(1 + r) - 1, 6) AS ret FROM ret WHERE r IS NOT NULL GROUP BY 1, 2, 3",
)
def monthly_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = P.returns(spark, sf_dir).where("r is not null")
    g = r.groupBy("symbol", F.year(AT).cast("long").alias("y"), F.month(AT).cast("long").alias("m"))
    return rounded(g.agg(F.min(AT).alias("window_start"), F.max(AT).alias("window_end"), F.count("*").alias("n_obs"), (F.product(1 + F.col("r")) - 1).alias("ret")))


@query(
    "q_a22_view_switches",
    """WITH v AS (SELECT CAST(ts AS DATE) AS day, event_type, max(value) AS c FROM events GROUP BY 1, 2), t AS (SELECT day, first(event_type ORDER BY c DESC, event_type) AS top, count(*) AS n, avg(abs(c)) AS m FROM v GROUP BY 1),
    s AS (SELECT *, top <> lag(top) OVER (ORDER BY day) AS switched FROM t) SELECT round(avg(n), 6) AS views_per_date, round(avg(m), 6) AS mean_abs, round(count(*) FILTER (WHERE switched) * 1.0 / greatest(1, count(*) - 1), 6) AS switch_rate FROM s""",
)
def view_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views a date, their mean size, and how often the most confident one changes; the first maximum wins ties."""
    v = P.table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.max("value").alias("c"))
    t = v.groupBy("day").agg(F.min_by("event_type", F.struct(-F.col("c"), F.col("event_type"))).alias("top"), F.count("*").alias("n"), F.avg(F.abs("c")).alias("m"))
    s = t.withColumn("switched", F.col("top") != F.lag("top").over(Window.orderBy("day")))  # a row a day
    rate = F.count_if("switched") / F.greatest(F.lit(1), F.count("*") - 1)
    return rounded(s.agg(F.avg("n").alias("views_per_date"), F.avg("m").alias("mean_abs"), rate.alias("switch_rate")))


@query("q_a30_class_stats", "SELECT toxic AS arm, count(*) AS n, round(avg(n_chars), 6) AS mean_chars, round(stddev_samp(n_chars), 6) AS std_chars, round(avg(quality), 6) AS mean_quality, round(stddev_samp(quality), 6) AS std_quality FROM labels JOIN documents USING (doc_id) GROUP BY 1")
def class_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, mean and sample deviation of every feature by arm."""
    j = P.table(spark, sf_dir, "labels").join(P.table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    stats = [f(c).alias(f"{n}_{t}") for c, t in (("n_chars", "chars"), ("quality", "quality")) for n, f in (("mean", F.avg), ("std", F.stddev_samp))]
    return rounded(j.groupBy(F.col("toxic").alias("arm")).agg(F.count("*").alias("n"), *stats))


@query("q_k14_single_hold", with_panels("idx") + "SELECT date, round(level / first_value(level) OVER (ORDER BY date), 6) AS wealth FROM idx WHERE symbol = 'AF'")
def single_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = P.px_index(spark, sf_dir).where("symbol = 'AF'")
    return rounded(i.select(AT, (F.col("level") / F.first("level").over(S.upto(KEYS, AT))).alias("wealth")))


@query("q_w26_first_of_month", with_panels("ret") + ", c AS (SELECT DISTINCT date FROM ret WHERE r IS NOT NULL) SELECT CAST(date_trunc('month', date) AS DATE) AS month, min(date) AS first_date, count(*) AS n FROM c GROUP BY 1")
def first_of_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = P.returns(spark, sf_dir).where("r is not null").select(AT).distinct()
    return c.groupBy(F.trunc(AT, "MM").alias("month")).agg(F.min(AT).alias("first_date"), F.count("*").alias("n"))


@query(
    "q_o16_coherent_windows",
    with_panels("ret") + ", m AS (SELECT symbol, date_trunc('month', date) AS m, product(1 + r) AS g, min(date) AS lo, max(date) AS hi FROM ret WHERE r IS NOT NULL GROUP BY 1, 2), t AS (SELECT symbol, product(1 + r) AS g FROM ret WHERE r IS NOT NULL GROUP BY 1) SELECT m.symbol, count(*) AS months, min(lo) AS window_start, max(hi) AS window_end, abs(product(m.g) / t.g - 1) < 1e-9 AS compounds FROM m JOIN t ON m.symbol = t.symbol GROUP BY 1, t.g",
)
def coherent_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly rows of a line must compound to its total."""
    r = P.returns(spark, sf_dir).where("r is not null")
    m = r.groupBy("symbol", F.trunc(AT, "MM").alias("m")).agg(F.product(1 + F.col("r")).alias("g"), F.min(AT).alias("lo"), F.max(AT).alias("hi"))
    t = r.groupBy("symbol").agg(F.product(1 + F.col("r")).alias("total"))
    a = m.groupBy("symbol").agg(F.count("*").alias("months"), F.min("lo").alias("window_start"), F.max("hi").alias("window_end"), F.product("g").alias("g"))
    return a.join(t, "symbol").select("symbol", "months", "window_start", "window_end", (F.abs(F.col("g") / F.col("total") - 1) < 1e-9).alias("compounds"))
