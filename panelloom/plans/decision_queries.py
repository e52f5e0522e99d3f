"""Point-in-time filters, joins, scalar rules, report rows, certification and walk-forward targets."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import kernels as K
from ..operators import series as S
from ..sources import panels as P
from ..sources.panels import with_panels
from .kernel_queries import sessions_of, windows_of
from .registry import query, rounded

KEYS, AT = ["symbol"], "date"

# ---------------------------------------------------------------- point in time


@query(
    "q_p5_point_in_time",
    with_panels("px") + ", d AS (SELECT DISTINCT date_trunc('month', date)::DATE AS decision FROM px), s AS (SELECT DISTINCT symbol FROM px) SELECT s.symbol, decision, count(px.date) AS n_before, max(px.date) AS last_seen, round(arg_max(close, px.date), 6) AS last_close FROM d CROSS JOIN s LEFT JOIN px ON px.symbol = s.symbol AND px.date < decision GROUP BY 1, 2",
)
def point_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was known strictly before every month's first day: months are summed first, then carried forward, so no history is copied."""
    px = P.px_line(spark, sf_dir).select("symbol", AT, "close")
    grid = px.select(F.trunc(AT, "MM").alias("decision")).distinct().crossJoin(F.broadcast(px.select("symbol").distinct()))
    m = px.groupBy("symbol", F.trunc(AT, "MM").alias("decision")).agg(F.count("*").alias("n"), F.max(F.struct(AT, "close")).alias("l"))
    w = Window.partitionBy("symbol").orderBy("decision").rowsBetween(Window.unboundedPreceding, -1)
    out = grid.join(m, ["symbol", "decision"], "left").withColumns({"n_before": F.coalesce(F.sum("n").over(w), F.lit(0)), "seen": F.max("l").over(w)})
    return rounded(out.select("symbol", "decision", "n_before", F.col("seen.date").alias("last_seen"), F.col("seen.close").alias("last_close")))


_STUB = with_panels("idx") + ", v AS (SELECT symbol, date, CASE WHEN row_number() OVER (PARTITION BY symbol ORDER BY date) <= 40 THEN 100 ELSE level END AS level FROM idx)"


def _stubbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index panel with forty flat sessions in front."""
    n = F.row_number().over(S.ordered(KEYS, AT))
    return P.px_index(spark, sf_dir).withColumn("_n", n).select("symbol", AT, F.when(F.col("_n") <= 40, 100.0).otherwise(F.col("level")).alias("level"))


@query("q_p8_active_span", _STUB + ", f AS (SELECT *, first_value(level) OVER (PARTITION BY symbol ORDER BY date) AS f FROM v), m AS (SELECT symbol, min(date) FILTER (WHERE level <> f) AS moved FROM f GROUP BY 1), a AS (SELECT symbol, max(date) AS anchor FROM f JOIN m USING (symbol) WHERE date < moved GROUP BY 1) SELECT symbol, date, round(level, 6) AS level FROM v JOIN a USING (symbol) WHERE date >= anchor")
def active_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line from the last flat session before it first moves."""
    own = Window.partitionBy("symbol")
    f = _stubbed(spark, sf_dir).withColumn("f", F.first("level").over(S.upto(KEYS, AT)))
    f = f.withColumn("moved", F.min(F.when(F.col("level") != F.col("f"), F.col(AT))).over(own))
    f = f.withColumn("anchor", F.max(F.when(F.col(AT) < F.col("moved"), F.col(AT))).over(own))
    return rounded(f.where(F.col("moved").isNull() | (F.col(AT) >= F.col("anchor"))).select("symbol", AT, "level"))


@query(
    "q_p9_window_slice",
    with_panels("idx")
    + """, s AS (SELECT symbol, greatest(min(date) + 300, DATE '1993-06-01') AS s, min(date) + 900 AS e FROM idx GROUP BY 1), r AS (SELECT symbol, min(date) AS first_return, max(date) AS last_return, count(*) AS n FROM idx JOIN s USING (symbol) WHERE date BETWEEN s AND e GROUP BY 1)
    SELECT r.symbol, max(i.date) AS anchor, first_return, last_return, n FROM r JOIN idx i ON i.symbol = r.symbol AND i.date < first_return GROUP BY 1, 3, 4, 5""",
)
def window_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A requested window of every line, later where the line begins later, with the one level before it as anchor."""
    own = Window.partitionBy("symbol")
    i = P.px_index(spark, sf_dir).select("symbol", AT).withColumn("lo", F.min(AT).over(own))
    inside = F.col(AT).between(F.greatest(F.date_add("lo", 300), F.lit("1993-06-01").cast("date")), F.date_add("lo", 900))
    i = i.withColumn("first_return", F.min(F.when(inside, F.col(AT))).over(own))
    g = i.groupBy("symbol").agg(F.max(F.when(F.col(AT) < F.col("first_return"), F.col(AT))).alias("anchor"), F.min("first_return").alias("first_return"), F.max(F.when(inside, F.col(AT))).alias("last_return"), F.count_if(inside).alias("n"))
    return g.where("anchor is not null")


@query("q_p11_disjoint", with_panels("px") + ", w AS (SELECT symbol, min(date) AS lo, max(date) AS hi, min(date) + 500 AS cut FROM px GROUP BY 1) SELECT a.symbol AS oos, b.symbol AS tuning, (a.cut <= b.cut AND b.lo <= a.hi) AS overlaps FROM w a CROSS JOIN w b")
def disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the closed window after the cut of one line meets the closed window up to the cut of another: a row for each pair of symbols."""
    w = P.px_line(spark, sf_dir).groupBy("symbol").agg(F.min(AT).alias("lo"), F.max(AT).alias("hi")).withColumn("cut", F.date_add("lo", 500))
    a, b = w.select(F.col("symbol").alias("oos"), F.col("cut").alias("a_lo"), F.col("hi").alias("a_hi")), w.select(F.col("symbol").alias("tuning"), F.col("lo").alias("b_lo"), F.col("cut").alias("b_hi"))
    return a.crossJoin(F.broadcast(b)).select("oos", "tuning", C.overlaps("a_lo", "a_hi", "b_lo", "b_hi").alias("overlaps"))


@query(
    "q_p14_row_gate",
    with_panels("ret")
    + """, m AS (SELECT symbol, strftime(date_trunc('month', date), '%Y-%m') AS label, min(date) AS s, max(date) AS e, count(r) AS n, 252 + (CASE WHEN symbol = 'RO' THEN 113 ELSE 0 END) AS basis FROM ret GROUP BY 1, 2)
    SELECT symbol, label, CASE WHEN n = 0 THEN 'no returns' WHEN basis <> 252 THEN 'basis' WHEN strftime(s, '%Y-%m') <> label OR strftime(e, '%Y-%m') <> label THEN 'label' END AS violation FROM m""",
)
def row_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule a monthly report row breaks, null for a sound one."""
    m = P.returns(spark, sf_dir).groupBy("symbol", F.date_format(AT, "yyyy-MM").alias("label")).agg(F.min(AT).alias("s"), F.max(AT).alias("e"), F.count("r").alias("n"))
    m = m.withColumn("basis", F.when(F.col("symbol") == "RO", 365).otherwise(252))
    month = lambda c: F.date_format(c, "yyyy-MM")
    rule = F.when(F.col("n") == 0, "no returns").when(F.col("basis") != 252, "basis").when((month("s") != F.col("label")) | (month("e") != F.col("label")), "label")
    return m.select("symbol", "label", rule.alias("violation"))


@query("q_p16_finite", with_panels("ret") + ", x AS (SELECT symbol, date, CASE WHEN r > 0.002 THEN 'inf'::DOUBLE WHEN r < -0.002 THEN 'nan'::DOUBLE ELSE r END AS r FROM ret) SELECT symbol, count(*) FILTER (WHERE r IS NULL OR isnan(r) OR isinf(r)) AS offenders, min(date) FILTER (WHERE r IS NULL OR isnan(r) OR isinf(r)) AS first_offender FROM x GROUP BY 1")
def finite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values that are not finite numbers, and the first of their labels."""
    x = P.returns(spark, sf_dir).withColumn("r", F.when(F.col("r") > 0.002, float("inf")).when(F.col("r") < -0.002, float("nan")).otherwise(F.col("r")))
    bad = F.col("r").isNull() | F.isnan("r") | (F.abs("r") == float("inf"))
    return x.groupBy("symbol").agg(F.count_if(bad).alias("offenders"), F.min(F.when(bad, F.col(AT))).alias("first_offender"))


@query("q_p17_bounds", with_panels("scores") + "SELECT user_id, count(*) FILTER (WHERE NOT coalesce(pit BETWEEN 0 AND 1, false)) AS outside, count(*) AS n FROM scores GROUP BY 1")
def bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = P.scores(spark, sf_dir)
    return s.groupBy("user_id").agg(F.count_if(~F.coalesce(F.col("pit").between(0, 1), F.lit(False))).alias("outside"), F.count("*").alias("n"))


@query("q_p19_resolve", with_panels("scores") + ", d AS (SELECT day, count(*) AS asked FROM scores GROUP BY 1) SELECT d.day, user_id, s.day IS NOT NULL AS found, round(pit, 6) AS pit FROM d CROSS JOIN (SELECT DISTINCT user_id FROM scores WHERE user_id < 10) u LEFT JOIN scores s USING (user_id, day)")
def resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact look-up of (user, day) decisions; a missing one is reported, not filled."""
    s = P.scores(spark, sf_dir)
    asked = s.select("day").distinct().crossJoin(F.broadcast(s.where("user_id < 10").select("user_id").distinct()))
    return rounded(asked.join(s.select("user_id", "day", "pit", F.lit(True).alias("hit")), ["user_id", "day"], "left").select("day", "user_id", F.col("hit").isNotNull().alias("found"), "pit"))


# ---------------------------------------------------------------- joins


@query(
    "q_j5_column_concat",
    with_panels("macro", "ord")
    + ", a AS (SELECT month, d FROM macro WHERE d > 0.049), b AS (SELECT month, t FROM macro WHERE t < 0.041), c AS (SELECT date_trunc('month', date)::DATE AS month, max(close) AS v FROM ord WHERE symbol = '2-HIGH' GROUP BY 1) SELECT coalesce(a.month, b.month, c.month) AS month, round(d, 6) AS d, round(t, 6) AS t, round(v, 4) AS v FROM a FULL JOIN b USING (month) FULL JOIN c ON c.month = coalesce(a.month, b.month) WHERE d IS NOT NULL OR t IS NOT NULL OR v IS NOT NULL",
)
def column_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three monthly series side by side on the union of their months: stacked and aggregated, one shuffle for any number of them."""
    m = P.macro(spark, sf_dir)
    v = P.px_orders(spark, sf_dir).where("symbol = '2-HIGH'").groupBy(F.trunc(AT, "MM").alias("month")).agg(F.max("close").alias("v"))
    parts = [m.where("d > 0.049").select("month", "d"), m.where("t < 0.041").select("month", "t"), v]
    both = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    out = both.groupBy("month").agg(*(F.max(c).alias(c) for c in ("d", "t", "v"))).where("coalesce(d, t, v) is not null")
    return out.select("month", F.round("d", 6).alias("d"), F.round("t", 6).alias("t"), F.round("v", 4).alias("v"))


@query(
    "q_j8_anchored",
    with_panels("idx") + ", q AS (SELECT symbol, max(date) AS date FROM idx GROUP BY symbol, date_trunc('month', date)), x AS (SELECT q.symbol, q.date, i.level FROM q LEFT JOIN idx i USING (symbol, date)), l AS (SELECT *, lag(level) OVER (PARTITION BY symbol ORDER BY date) AS p, row_number() OVER (PARTITION BY symbol ORDER BY date) AS n FROM x) SELECT symbol, date, round(level / p - 1, 8) AS r FROM l WHERE n > 1",
)
def anchored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns between requested dates (month ends), the first of which is the anchor; a date without a price is an error."""
    i = P.px_index(spark, sf_dir)
    asked = i.groupBy("symbol", F.trunc(AT, "MM").alias("m")).agg(F.max(AT).alias(AT)).drop("m")
    x = asked.join(i, ["symbol", AT], "left")
    level = F.when(F.col("level").isNull(), F.raise_error(F.concat(F.lit("no price at "), F.col(AT).cast("string"))).cast("double")).otherwise(F.col("level"))
    w = S.ordered(KEYS, AT)
    x = x.withColumn("level", level).withColumns({"p": F.lag("level").over(w), "n": F.row_number().over(w)}).where("n > 1")
    return x.select("symbol", AT, F.round(F.col("level") / F.col("p") - 1, 8).alias("r"))


@query("q_j14_positions", with_panels("px") + ", n AS (SELECT symbol, date, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS pos FROM px), f AS (SELECT DISTINCT date_trunc('month', date)::DATE + 14 AS cutoff FROM px), s AS (SELECT DISTINCT symbol FROM px) SELECT s.symbol, cutoff, n.pos FROM (f CROSS JOIN s) ASOF LEFT JOIN n ON n.symbol = s.symbol AND cutoff >= n.date")
def lookup_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position of the last session at or before each cut-off; null where there is none."""
    n = P.px_line(spark, sf_dir).select("symbol", AT, (F.row_number().over(S.ordered(KEYS, AT)) - 1).cast("long").alias("pos"))
    cut = n.select(F.date_add(F.trunc(AT, "MM"), 14).alias(AT)).distinct().crossJoin(F.broadcast(n.select("symbol").distinct()))
    return S.as_of(cut, n, KEYS, AT, "pos", False, "pos").select("symbol", F.col(AT).alias("cutoff"), "pos")


@query("q_j17_by_position", "WITH a AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE event_type = 'view'), b AS (SELECT user_id, CASE WHEN value > 50 THEN NULL ELSE value END AS value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE event_type = 'click') SELECT a.user_id, count(*) AS pairs, count(b.value) AS kept, round(avg(b.value - a.value), 6) AS mean_delta FROM a JOIN b USING (user_id, k) GROUP BY 1")
def by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sequences paired by position; a pair goes if either side is missing."""
    e = P.table(spark, sf_dir, "events")
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    a = e.where("event_type = 'view'").select("user_id", F.col("value").alias("x"), nth.alias("k"))
    b = e.where("event_type = 'click'").select("user_id", F.when(F.col("value") <= 50, F.col("value")).alias("y"), nth.alias("k"))
    return rounded(a.join(b, ["user_id", "k"]).groupBy("user_id").agg(F.count("*").alias("pairs"), F.count("y").alias("kept"), F.avg(F.col("y") - F.col("x")).alias("mean_delta")))


@query(
    "q_j22_mechanism",
    with_panels("scores")
    + """, d AS (SELECT day, user_id, pit, nonpit, coalesce(pit, 0) * (1 - least(1, greatest(0, abs(coalesce(nonpit, 0))))) AS guarded FROM scores), l AS (SELECT day, user_id, config, v FROM d, LATERAL (VALUES ('pit_raw', pit), ('nonpit_raw', nonpit), ('pit_guarded', guarded)) t(config, v))
    SELECT config, day, round(max(v) FILTER (WHERE user_id = 1), 6) AS u1, round(max(v) FILTER (WHERE user_id = 2), 6) AS u2, round(max(v) FILTER (WHERE user_id = 3), 6) AS u3 FROM l GROUP BY 1, 2""",
)
def mechanism(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every configuration and decision date, an asset a column."""
    d = P.scores(spark, sf_dir)
    d = d.withColumn("guarded", C.guarded(F.coalesce("pit", F.lit(0.0)), F.abs(F.coalesce("nonpit", F.lit(0.0)))))
    rows = d.select("day", "user_id", F.explode(F.array(*(F.struct(F.lit(n).alias("config"), F.col(c).alias("v")) for n, c in (("pit_raw", "pit"), ("nonpit_raw", "nonpit"), ("pit_guarded", "guarded"))))).alias("x"))
    wide = rows.groupBy("x.config", "day").agg(*(F.max(F.when(F.col("user_id") == k, F.col("x.v"))).alias(f"u{k}") for k in (1, 2, 3)))
    return rounded(wide)


# ---------------------------------------------------------------- scalar rules


@query(
    "q_f6_overlay_scalars",
    with_panels("macro")
    + ", z AS (SELECT month, (d - avg(d) OVER ()) / stddev_samp(d) OVER () AS a, (t - avg(t) OVER ()) / stddev_samp(t) OVER () AS b, (q - avg(q) OVER ()) / stddev_samp(q) OVER () AS c FROM macro), s AS (SELECT *, CASE WHEN a <= 0.3 THEN 1.0 WHEN a >= 0.7 THEN 0.2 ELSE 1 - (a - 0.3) / 0.4 * 0.8 END AS scale FROM z) SELECT month, round((a + b) - (c + a * b), 6) AS spread, round(1 - scale * (1 - 0.25), 6) AS cash_pin, round(abs(c) * 0.01 * 1.27, 8) AS usd FROM s",
)
def overlay_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defensive spread (F6), cash pin from the correlation scale (F8) and pence to dollars."""
    z = _standardised(spark, sf_dir)
    spread = F.col("a") + F.col("b") - (F.col("c") + F.col("a") * F.col("b"))
    return z.select("month", F.round(spread, 6).alias("spread"), F.round(C.cash_pin(C.correlation_scale("a")), 6).alias("cash_pin"), F.round(C.to_usd(F.abs("c"), "GBp", 1.27), 8).alias("usd"))


def _standardised(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = P.macro(spark, sf_dir)
    s = m.agg(*(f(c).alias(f"{c}_{n}") for c in "dtq" for n, f in (("m", F.avg), ("s", F.stddev_samp))))  # one row
    z = lambda c: (F.col(c) - F.col(f"{c}_m")) / F.col(f"{c}_s")
    return m.crossJoin(F.broadcast(s)).select("month", z("d").alias("a"), z("t").alias("b"), z("q").alias("c"))


@query(
    "q_f9_caps",
    with_panels("macro")
    + ", z AS (SELECT month, (q - avg(q) OVER ()) / stddev_samp(q) OVER () AS c, (d - avg(d) OVER ()) / stddev_samp(d) OVER () AS a FROM macro), b AS (SELECT *, CASE WHEN c > 0.5 THEN 'bull' WHEN c < -0.5 THEN 'bear' ELSE 'neutral' END AS regime, CASE WHEN a < -0.5 THEN 0 WHEN a > 0.5 THEN 2 ELSE 1 END AS bucket FROM z), l AS (SELECT * FROM (VALUES ('bull', 0, 1.0), ('bull', 1, 0.9), ('bull', 2, 0.8), ('neutral', 0, 0.8), ('neutral', 1, 0.6), ('neutral', 2, 0.4), ('bear', 0, 0.5), ('bear', 1, 0.3), ('bear', 2, 0.1)) t(regime, bucket, cap)) SELECT month, regime, CAST(bucket AS BIGINT) AS bucket, round(greatest(0.2, least(1.0, cap * 1.1)), 6) AS exposure FROM b JOIN l USING (regime, bucket)",
)
def caps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exposure caps of a regime and a bucket, scaled, between a floor and one: a broadcast look-up of nine rows."""
    z = _standardised(spark, sf_dir)
    limits = {"bull": (1.0, 0.9, 0.8), "neutral": (0.8, 0.6, 0.4), "bear": (0.5, 0.3, 0.1)}
    table = spark.createDataFrame([(r, b, c) for r, row in limits.items() for b, c in enumerate(row)], "regime string, bucket long, cap double")
    regime = F.when(F.col("c") > 0.5, "bull").when(F.col("c") < -0.5, "bear").otherwise("neutral")
    bucket = F.when(F.col("a") < -0.5, 0).when(F.col("a") > 0.5, 2).otherwise(1).cast("long")
    x = z.select("month", regime.alias("regime"), bucket.alias("bucket")).join(F.broadcast(table), ["regime", "bucket"])
    return x.select("month", "regime", "bucket", F.round(C.clip(F.col("cap") * 1.1, 0.2, 1.0), 6).alias("exposure"))


@query("q_f11_control", with_panels("ret") + ", e AS (SELECT symbol, date, r, CASE WHEN month(date) % 2 = 0 THEN 0.4 ELSE 1.0 END AS e FROM ret WHERE r IS NOT NULL) SELECT e.symbol, e.date, round(e.e * e.r + (1 - e.e) * c.r, 10) AS r FROM e JOIN e c ON c.date = e.date AND c.symbol = 'NO' WHERE e.symbol <> 'NO'")
def control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns of an exposure between a line and cash."""
    r = P.returns(spark, sf_dir).where("r is not null")
    cash = r.where("symbol = 'NO'").select(AT, F.col("r").alias("cash"))
    e = F.when(F.month(AT) % 2 == 0, 0.4).otherwise(1.0)
    return r.where("symbol <> 'NO'").join(cash, AT).select("symbol", AT, F.round(e * F.col("r") + (1 - e) * F.col("cash"), 10).alias("r"))


@query(
    "q_f14_texts",
    with_panels("scores")
    + """, s AS (SELECT user_id, avg(pit - nonpit) FILTER (WHERE day <= DATE '2024-01-15') AS a, avg(pit - nonpit) FILTER (WHERE day > DATE '2024-01-15') AS b, avg(pit) AS ssr, abs(avg(nonpit)) AS p FROM scores GROUP BY 1)
    SELECT user_id, CASE WHEN a IS NULL OR b IS NULL THEN NULL WHEN abs(b) < 0.25 * abs(a) THEN 'collapsed' ELSE 'persists' END AS outcome, CASE WHEN a IS NULL OR b IS NULL THEN NULL ELSE printf('%+.4f -> %+.4f', a, b) END AS numbers,
      p < 0.05 AND ssr > 0 AS stable, p < 0.05 AND ssr < 0 AS stably_below, CASE WHEN ssr IS NULL OR p IS NULL THEN 'insufficient' WHEN p < 0.05 AND ssr > 0 THEN printf('SSR=%.2f stable p=%.3f', ssr, p) WHEN p < 0.05 AND ssr < 0 THEN printf('SSR=%.2f below p=%.3f', ssr, p) ELSE printf('SSR=%.2f open p=%.3f', ssr, p) END AS verdict FROM s""",
)
def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Premium outcome (F14), stability bits (F16) and the verdict sentence."""
    d = F.col("pit") - F.col("nonpit")
    s = P.scores(spark, sf_dir).groupBy("user_id").agg(F.avg(F.when(F.col("day") <= "2024-01-15", d)).alias("a"), F.avg(F.when(F.col("day") > "2024-01-15", d)).alias("b"), F.avg("pit").alias("ssr"), F.abs(F.avg("nonpit")).alias("p"))
    known = F.col("a").isNotNull() & F.col("b").isNotNull()
    stable, below, verdict = C.stability_verdict("ssr", "p")
    return s.select(
        "user_id", F.when(known, F.when(F.abs("b") < 0.25 * F.abs("a"), "collapsed").otherwise("persists")).alias("outcome"), F.when(known, F.format_string("%+.4f -> %+.4f", "a", "b")).alias("numbers"),
        stable.alias("stable"), below.alias("stably_below"), verdict.alias("verdict"),
    )


_VIEWS = "WITH e AS (SELECT event_id, user_id, value, event_type, event_id % 5 AS long_leg, (event_id + 1) % 6 AS short_leg, value / 100 AS confidence, CASE WHEN user_id % 7 = 0 THEN NULL ELSE least(1.0, user_id / 20.0) END AS p FROM events)"


@query("q_f36_confidence", _VIEWS + " SELECT event_id, CASE WHEN p IS NULL THEN round(confidence, 9) ELSE round(greatest(0, least(1, confidence * (1 - p) * CASE WHEN long_leg IN (0, 3) THEN 1.0 ELSE 0.5 END)), 9) END AS confidence, CASE WHEN p IS NULL THEN round(value, 9) ELSE round(value * (1 - least(1, greatest(0, p))), 9) END AS tilt FROM e WHERE p IS NULL OR p < 0.8")
def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence by recall and consistency (F36, F38), gated from 0.8 on, and the discounted tilt (F37); an unknown probability passes both."""
    e = _views(spark, sf_dir)
    fits = F.when(F.col("long_leg").isin(0, 3), 1.0).otherwise(0.5)
    kept = F.when(F.col("p").isNull(), F.col("confidence")).otherwise(C.clip(F.col("confidence") * (1 - F.col("p")) * fits, 0, 1))
    tilt = F.when(F.col("p").isNull(), F.col("value")).otherwise(C.guarded("value", "p"))
    return rounded(e.where("p is null or p < 0.8").select("event_id", kept.alias("confidence"), tilt.alias("tilt")), 9)


def _views(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.when(F.col("user_id") % 7 != 0, F.least(F.lit(1.0), F.col("user_id") / 20.0))
    return P.table(spark, sf_dir, "events").select("event_id", "user_id", "value", (F.col("event_id") % 5).alias("long_leg"), ((F.col("event_id") + 1) % 6).alias("short_leg"), (F.col("value") / 100).alias("confidence"), p.alias("p"))


@query("q_f39_pick_rows", _VIEWS + ", m AS (SELECT * FROM (VALUES (0, 'AF'), (1, 'AO'), (2, 'NF'), (3, 'NO'), (4, 'RF')) t(leg, symbol)), v AS (SELECT event_id, value, confidence, a.symbol AS lo, b.symbol AS sh FROM e JOIN m a ON a.leg = long_leg JOIN m b ON b.leg = short_leg WHERE a.symbol <> b.symbol) SELECT event_id, lo AS symbol, CAST(1 AS BIGINT) AS pick, round(value * least(1, greatest(0, confidence)) / 252, 8) AS q FROM v UNION ALL SELECT event_id, sh, CAST(-1 AS BIGINT), round(value * least(1, greatest(0, confidence)) / 252, 8) FROM v")
def pick_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views as long pick rows: one for the long leg, minus one for the short one; a view with an unknown leg goes."""
    m = spark.createDataFrame(list(enumerate(("AF", "AO", "NF", "NO", "RF"))), "leg long, symbol string")
    v = _views(spark, sf_dir).join(F.broadcast(m.select(F.col("leg").alias("long_leg"), F.col("symbol").alias("lo"))), "long_leg").join(F.broadcast(m.select(F.col("leg").alias("short_leg"), F.col("symbol").alias("sh"))), "short_leg").where("lo <> sh")
    q = F.round(F.col("value") * C.clip("confidence", 0, 1) / 252, 8)
    legs = F.array(F.struct(F.col("lo").alias("symbol"), F.lit(1).cast("long").alias("pick")), F.struct(F.col("sh").alias("symbol"), F.lit(-1).cast("long").alias("pick")))
    return v.select("event_id", q.alias("q"), F.explode(legs).alias("l")).select("event_id", "l.symbol", "l.pick", "q")


@query("q_f42_exposure_product", "WITH x AS (SELECT * FROM (VALUES ('click', 'gold', 0.5), ('click', 'cash', -0.2), ('view', 'gold', 0.1), ('view', 'cash', 0.4), ('error', 'cash', 1.0)) t(event_type, asset, w)), l AS (SELECT user_id, event_type, avg(value / (1 + abs(value))) AS v FROM events GROUP BY 1, 2) SELECT user_id, round(coalesce(sum(v * w) FILTER (WHERE asset = 'gold'), 0), 6) AS gold, round(coalesce(sum(v * w) FILTER (WHERE asset = 'cash'), 0), 6) AS cash FROM l JOIN x USING (event_type) GROUP BY 1")
def exposure_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loadings times a fixed exposure table, an asset a column."""
    x = spark.createDataFrame([("click", "gold", 0.5), ("click", "cash", -0.2), ("view", "gold", 0.1), ("view", "cash", 0.4), ("error", "cash", 1.0)], "event_type string, asset string, w double")
    l = P.table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.avg(F.col("value") / (1 + F.abs("value"))).alias("v"))
    j = l.join(F.broadcast(x), "event_type").groupBy("user_id").agg(*(F.coalesce(F.sum(F.when(F.col("asset") == a, F.col("v") * F.col("w"))), F.lit(0.0)).alias(a) for a in ("gold", "cash")))
    return rounded(j)


@query("q_f24_views_json", "WITH e AS (SELECT event_id, value, user_id FROM events WHERE event_id % 3 <> 2) SELECT event_id, 'Asset_' || user_id AS asset_long, round(value, 3) AS expected, 0.5::DOUBLE AS confidence FROM e WHERE event_id % 3 = 0 UNION ALL SELECT event_id, 'B', 1.0, 0.25 FROM e WHERE event_id % 3 = 1")
def views_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views from replies: a JSON array, fenced or not; items without a name or a number go, and replies that are no array."""
    e = P.table(spark, sf_dir, "events")
    good = F.concat(F.lit('```json\n[{"asset_long": "Asset_'), F.col("user_id").cast("string"), F.lit('", "expected_excess_annualized": '), F.round("value", 3).cast("string"), F.lit(', "confidence": 0.5}, {"confidence": 1}, 7]\n```'))
    reply = F.when(F.col("event_id") % 3 == 0, good).when(F.col("event_id") % 3 == 1, '[{"asset_long": "B", "expected_excess_annualized": "1.0", "confidence": 0.25}]').otherwise('{"asset_long": "C"}')
    return e.select("event_id", F.explode(C.views(reply)).alias("v")).select("event_id", F.col("v.asset_long").alias("asset_long"), F.round("v.expected", 3).alias("expected"), "v.confidence")


@query("q_f31_frame_hash", with_panels("px") + "SELECT symbol, sha256('symbol,date,volume' || chr(10) || string_agg(symbol || ',' || strftime(date, '%Y-%m-%d') || ',' || CAST(CAST(volume AS BIGINT) AS VARCHAR), chr(10) ORDER BY date)) AS frame FROM px GROUP BY 1")
def frame_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content hash of every line's frame: header and ordered rows; a line is one group."""
    row = F.concat_ws(",", "symbol", F.date_format(AT, "yyyy-MM-dd"), F.col("volume").cast("long").cast("string"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct(AT, row.alias("row")))), lambda x: x["row"])
    return P.px_line(spark, sf_dir).groupBy("symbol").agg(F.sha2(F.concat(F.lit("symbol,date,volume\n"), F.array_join(rows, "\n")), 256).alias("frame"))


# ---------------------------------------------------------------- reshapes


@query("q_o12_stacked", with_panels("idx") + ", c AS (SELECT max(date) - 200 AS cut FROM idx), old AS (SELECT symbol, date, level, 'old' AS segment FROM idx, c WHERE date <= cut), live AS (SELECT symbol, date, level, 'live' AS segment FROM idx, c WHERE date > cut) SELECT symbol, segment, count(*) AS n, min(date) AS lo, max(date) AS hi FROM (SELECT * FROM old UNION ALL SELECT * FROM live) GROUP BY 1, 2")
def stacked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replayed rows, then live ones, by column name."""
    i = P.px_index(spark, sf_dir)
    cut = i.agg(F.date_add(F.max(AT), -200).alias("cut"))
    x = i.crossJoin(F.broadcast(cut))  # one row
    old, live = x.where("date <= cut").select("symbol", AT, F.lit("old").alias("segment")), x.where("date > cut").select(F.lit("live").alias("segment"), AT, "symbol")
    return old.unionByName(live).groupBy("symbol", "segment").agg(F.count("*").alias("n"), F.min(AT).alias("lo"), F.max(AT).alias("hi"))


@query("q_o15_transposed", with_panels("scores") + ", a AS (SELECT user_id, avg(pit) AS pit, avg(nonpit) AS nonpit FROM scores WHERE user_id IN (1, 2, 3) GROUP BY 1) SELECT field, round(max(v) FILTER (WHERE user_id = 1), 6) AS u1, round(max(v) FILTER (WHERE user_id = 2), 6) AS u2, round(max(v) FILTER (WHERE user_id = 3), 6) AS u3 FROM a, LATERAL (VALUES ('pit', pit), ('nonpit', nonpit)) t(field, v) GROUP BY 1")
def transposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields as rows and the given keys as columns, in a fixed order."""
    a = P.scores(spark, sf_dir).where("user_id in (1, 2, 3)").groupBy("user_id").agg(F.avg("pit").alias("pit"), F.avg("nonpit").alias("nonpit"))
    long = a.unpivot("user_id", ["pit", "nonpit"], "field", "v")
    return rounded(long.groupBy("field").agg(*(F.max(F.when(F.col("user_id") == k, F.col("v"))).alias(f"u{k}") for k in (1, 2, 3))))


@query("q_o18_sample", "SELECT o_orderkey, md5('seed-0:' || o_orderkey) AS h FROM orders ORDER BY md5('seed-0:' || o_orderkey), o_orderkey LIMIT 50")
def sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty orders drawn without replacement by a seeded hash: a sampling operator, a top-k that any retry repeats."""
    o = P.table(spark, sf_dir, "orders").select("o_orderkey", F.md5(F.concat(F.lit("seed-0:"), F.col("o_orderkey").cast("string"))).alias("h"))
    return o.orderBy("h", "o_orderkey").limit(50)


# ---------------------------------------------------------------- report rows


_CRISIS = """, b AS (SELECT symbol, min(date) + 365 AS s, min(date) + 730 AS e FROM idx GROUP BY 1), a AS (SELECT symbol, max(date) AS anchor FROM idx JOIN b USING (symbol) WHERE date < s GROUP BY 1),
    x AS (SELECT symbol, date, level, level / lag(level) OVER (PARTITION BY symbol ORDER BY date) - 1 AS r, level / max(level) OVER (PARTITION BY symbol ORDER BY date) - 1 AS dd FROM idx JOIN b USING (symbol) JOIN a USING (symbol) WHERE date >= anchor AND date <= e),
    cr AS (SELECT symbol, arg_max(level, date) / arg_min(level, date) - 1 AS crisis_return, min(dd) AS crisis_max_drawdown, stddev_samp(r) * sqrt(252) AS crisis_vol_ann FROM x GROUP BY 1)"""


@query("q_a20_crisis_table", with_panels("idx") + _CRISIS + " SELECT symbol, round(crisis_return, 6) AS crisis_return, round(crisis_max_drawdown, 6) AS crisis_max_drawdown, round(crisis_vol_ann, 6) AS crisis_vol_ann FROM cr")
def crisis_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three columns of the crisis metrics, a row a line."""
    return _crisis(spark, sf_dir).select("symbol", "crisis_return", "crisis_max_drawdown", "crisis_vol_ann")


def _crisis(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .series_queries import crisis

    return crisis(spark, sf_dir).select("symbol", F.col("ret").alias("crisis_return"), F.col("maxdd").alias("crisis_max_drawdown"), F.col("vol").alias("crisis_vol_ann"))


@query(
    "q_a23_head_to_head",
    with_panels("ret")
    + _CRISIS
    + """, m AS (SELECT symbol, date_trunc('month', date)::DATE AS month, sum(volume) AS v FROM px GROUP BY 1, 2), t AS (SELECT symbol, month, v / sum(v) OVER (PARTITION BY month) AS w FROM m), d AS (SELECT symbol, month, w, lag(w) OVER (PARTITION BY symbol ORDER BY month) AS p FROM t),
    u AS (SELECT symbol, avg(abs(w - p)) AS avg_turnover, min(month) FILTER (WHERE p < 0.2 AND w >= 0.2) AS lead, arg_min(w, month) AS w0 FROM d GROUP BY 1),
    g AS (SELECT symbol, arg_max(level, date) / arg_min(level, date) - 1 AS total_return, stddev_samp(r) * sqrt(252) AS annualized_vol, avg(r) / stddev_samp(r) * sqrt(252) AS sharpe FROM ret GROUP BY 1)
    SELECT symbol, round(total_return, 6) AS total_return, round(annualized_vol, 6) AS annualized_vol, round(sharpe, 6) AS sharpe, round(crisis_return, 6) AS crisis_return, round(crisis_max_drawdown, 6) AS crisis_max_drawdown, round(avg_turnover, 6) AS avg_turnover,
      CASE WHEN lead IS NOT NULL THEN strftime(lead, '%Y-%m-%d') WHEN w0 >= 0.2 THEN 'already defensive at sample start' ELSE '-' END AS defensive_lead_date FROM g LEFT JOIN cr USING (symbol) JOIN u USING (symbol)""",
)
def head_to_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a line: return, risk, crisis, turnover of its share of volume, and when that share first rose to a fifth."""
    r = P.returns(spark, sf_dir)
    g = r.groupBy("symbol").agg((F.max_by("level", AT) / F.min_by("level", AT) - 1).alias("total_return"), (F.stddev_samp("r") * F.sqrt(F.lit(252.0))).alias("annualized_vol"), (F.avg("r") / F.stddev_samp("r") * F.sqrt(F.lit(252.0))).alias("sharpe"))
    m = P.px_line(spark, sf_dir).groupBy("symbol", F.trunc(AT, "MM").alias("month")).agg(F.sum("volume").alias("v"))
    d = m.withColumn("w", F.col("v") / F.sum("v").over(Window.partitionBy("month"))).withColumn("p", F.lag("w").over(S.ordered(KEYS, "month")))
    rose = (F.col("p") < 0.2) & (F.col("w") >= 0.2)
    u = d.groupBy("symbol").agg(F.avg(F.abs(F.col("w") - F.col("p"))).alias("avg_turnover"), F.min(F.when(rose, F.col("month"))).alias("lead"), F.min_by("w", "month").alias("w0"))
    when = F.when(F.col("lead").isNotNull(), F.date_format("lead", "yyyy-MM-dd")).when(F.col("w0") >= 0.2, "already defensive at sample start").otherwise("-")
    out = g.join(_crisis(spark, sf_dir).drop("crisis_vol_ann"), "symbol", "left").join(u, "symbol")
    return rounded(out.select(*g.columns, "crisis_return", "crisis_max_drawdown", "avg_turnover", when.alias("defensive_lead_date")))


@query("q_a53_moment_tables", with_panels("ret") + ", j AS (SELECT a.symbol AS a, b.symbol AS b, a.date, a.r AS x, b.r AS y FROM ret a JOIN ret b ON a.date = b.date WHERE a.r IS NOT NULL AND b.r IS NOT NULL), s AS (SELECT a, b, count(*) AS n, min(date) AS window_start, max(date) AS window_end, covar_samp(x, y) * 252 AS c, avg(x) * 252 AS mean FROM j GROUP BY 1, 2) SELECT a AS symbol, n, window_start, window_end, round(mean, 6) AS mean, round(max(c) FILTER (WHERE b = 'AF') OVER w, 6) AS cov_AF, round(max(c) FILTER (WHERE b = 'NO') OVER w, 6) AS cov_NO, sha256(a || ':' || window_start || ':' || window_end) AS window_id FROM s WINDOW w AS (PARTITION BY a) QUALIFY a = b")
def moment_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annual moments as one row an asset, covariances as columns, with the window's identity."""
    r = P.returns(spark, sf_dir).where("r is not null")
    j = r.select(AT, F.col("symbol").alias("a"), F.col("r").alias("x")).join(r.select(AT, F.col("symbol").alias("b"), F.col("r").alias("y")), AT)
    s = j.groupBy("a", "b").agg(F.count("*").alias("n"), F.min(AT).alias("window_start"), F.max(AT).alias("window_end"), (F.covar_samp("x", "y") * 252).alias("c"), (F.avg("x") * 252).alias("mean"))
    own = F.col("a") == F.col("b")
    pick = lambda c: F.max(F.when(own, F.col(c)))
    out = s.groupBy(F.col("a").alias("symbol")).agg(*(pick(c).alias(c) for c in ("n", "window_start", "window_end", "mean")), *(F.max(F.when(F.col("b") == k, F.col("c"))).alias(f"cov_{k}") for k in ("AF", "NO")))
    return rounded(out.withColumn("window_id", F.sha2(F.concat_ws(":", "symbol", F.col("window_start").cast("string"), F.col("window_end").cast("string")), 256)))


@query(
    "q_k43_reader_rows",
    with_panels("ret")
    + """, j AS (SELECT a.symbol, a.date, a.r, a.r - c.r AS x FROM ret a JOIN ret c ON c.date = a.date AND c.symbol = 'NO' WHERE a.symbol <> 'NO' AND a.r IS NOT NULL AND c.r IS NOT NULL), m AS (SELECT symbol, min(date) AS s, max(date) AS e, count(*) AS n, avg(x) / stddev_samp(x) * sqrt(252) AS sharpe, avg(x) / sqrt(avg(pow(least(x, 0), 2))) * sqrt(252) AS sortino, stddev_samp(r) * sqrt(252) AS vol FROM j GROUP BY 1),
    t AS (SELECT a.symbol, min(a.date) AS s, max(a.date) AS e, count(*) AS n, regr_slope(a.r, b.r) AS beta FROM ret a JOIN ret b ON a.date = b.date AND b.symbol = 'NO' WHERE a.symbol IN ('AF', 'RF') AND a.r IS NOT NULL AND b.r IS NOT NULL GROUP BY 1)
    SELECT m.symbol, m.s AS window_start, m.e AS window_end, m.n, round(sharpe, 6) AS excess_sharpe, round(sortino, 6) AS excess_sortino, round(vol, 6) AS vol, CASE WHEN t.s = m.s AND t.e = m.e AND t.n = m.n THEN round(beta, 6) END AS beta FROM m LEFT JOIN t USING (symbol)""",
)
def reader_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excess ratios of every line, with its attribution only where that has the same window."""
    r = P.returns(spark, sf_dir).where("r is not null")
    cash = r.where("symbol = 'NO'").select(AT, F.col("r").alias("c"))
    j = r.where("symbol <> 'NO'").join(cash, AT).withColumn("x", F.col("r") - F.col("c"))
    year = F.sqrt(F.lit(252.0))
    m = j.groupBy("symbol").agg(
        F.min(AT).alias("window_start"), F.max(AT).alias("window_end"), F.count("*").alias("n"), (F.avg("x") / F.stddev_samp("x") * year).alias("excess_sharpe"),
        (F.avg("x") / F.sqrt(F.avg(F.pow(F.least(F.col("x"), F.lit(0.0)), 2))) * year).alias("excess_sortino"), (F.stddev_samp("r") * year).alias("vol"),
    )
    t = j.where("symbol in ('AF', 'RF')").groupBy("symbol").agg(F.min(AT).alias("s"), F.max(AT).alias("e"), F.count("*").alias("k"), F.regr_slope("r", "c").alias("beta"))
    same = (F.col("s") == F.col("window_start")) & (F.col("e") == F.col("window_end")) & (F.col("k") == F.col("n"))
    return rounded(m.join(t, "symbol", "left").select(*m.columns, F.when(same, F.col("beta")).alias("beta")))


@query("q_k41_consensus", "WITH d AS (SELECT user_id, value / (1 + abs(value)) - 0.9 AS v FROM events WHERE event_type <> 'error'), a AS (SELECT user_id, count(*) AS n, median(v) AS location, avg(CASE WHEN v > 0 THEN 1.0 ELSE 0 END) AS up, avg(CASE WHEN abs(v) < 0.02 THEN 1.0 ELSE 0 END) AS trough FROM d GROUP BY 1) SELECT user_id, n, round(location, 6) AS location, round(greatest(up, 1 - up), 6) AS agreement, up BETWEEN 0.25 AND 0.75 AND trough < 0.05 AS multimodal FROM a")
def consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws of every key: median, share of the commoner decision, and whether two clusters stand apart."""
    d = P.table(spark, sf_dir, "events").where("event_type <> 'error'").select("user_id", (F.col("value") / (1 + F.abs("value")) - 0.9).alias("v"))
    share = lambda c: F.avg(c.cast("double"))
    a = d.groupBy("user_id").agg(F.count("*").alias("n"), F.median("v").alias("location"), share(F.col("v") > 0).alias("up"), share(F.abs("v") < 0.02).alias("trough"))
    return rounded(a.select("user_id", "n", "location", F.greatest("up", 1 - F.col("up")).alias("agreement"), (F.col("up").between(0.25, 0.75) & (F.col("trough") < 0.05)).alias("multimodal")))


_MIXES = {
    "all_cash": (0, 0, 0, 1), "equal_weight": (1, 1, 1, 1), "defensive_60_40": (0.4, 0, 0, 0.6), "inflation_hedge": (0.2, 0, 0.5, 0.3), "growth_tilt": (0.35, 0.5, 0, 0.15),
    "balanced_defensive": (0.2, 0.2, 0.3, 0.3), "aggressive_growth": (0.35, 0.5, 0, 0.15), "risk_parity_approx": (0.25, 0.15, 0.3, 0.3),
}  # fixed values
_ASSETS = ("AF", "NF", "NO", "RF")


@query(
    "q_k20_candidates",
    with_panels("ret") + ", m(name, symbol, w) AS (VALUES " + ", ".join(f"('{n}', '{a}', {w / sum(ws)}::DOUBLE)" for n, ws in _MIXES.items() for a, w in zip(_ASSETS, ws)) + "), c AS (SELECT date FROM ret WHERE r IS NOT NULL AND symbol IN ('AF', 'NF', 'NO', 'RF') GROUP BY 1 HAVING count(*) = 4), p AS (SELECT name, date, sum(w * r) AS r FROM m JOIN ret USING (symbol) JOIN c USING (date) GROUP BY 1, 2) SELECT name, count(*) AS n, round(avg(r) * 252, 6) AS mean, round(stddev_samp(r) * sqrt(252), 6) AS vol FROM p GROUP BY 1",
)
def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight fixed mixes of four assets, with their annual moments on the common sessions."""
    mix = spark.createDataFrame([(n, a, w / sum(ws)) for n, ws in _MIXES.items() for a, w in zip(_ASSETS, ws, strict=True)], "name string, symbol string, w double")
    r = P.returns(spark, sf_dir).where(F.col("r").isNotNull() & F.col("symbol").isin(*_ASSETS)).select("symbol", AT, "r")
    common = r.groupBy(AT).agg(F.count("*").alias("k")).where("k = 4").select(AT)
    p = r.join(common, AT).join(F.broadcast(mix), "symbol").groupBy("name", AT).agg(F.sum(F.col("w") * F.col("r")).alias("r"))
    return rounded(p.groupBy("name").agg(F.count("*").alias("n"), (F.avg("r") * 252).alias("mean"), (F.stddev_samp("r") * F.sqrt(F.lit(252.0))).alias("vol")))


@query("q_k29_max_start", with_panels("ord") + ", f AS (SELECT symbol, min(date) AS first_date FROM ord GROUP BY 1), m AS (SELECT max(first_date) AS s, count(*) AS n FROM f) SELECT s AS last_first_date, n, s + CAST((12 - isodow(s)) % 7 AS INTEGER) AS max_start FROM m")
def max_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first Friday on which every asset has a price."""
    f = P.px_orders(spark, sf_dir).groupBy("symbol").agg(F.min(AT).alias("first_date")).agg(F.max("first_date").alias("last_first_date"), F.count("*").alias("n"))
    ahead = (11 - F.weekday("last_first_date")) % 7
    return f.select("last_first_date", "n", F.date_add("last_first_date", ahead).alias("max_start"))


@query("q_k16_static_rows", with_panels("idx") + ", s AS (SELECT max(m) AS s FROM (SELECT min(date) AS m FROM idx WHERE symbol IN ('AF', 'NF', 'NO', 'RF') GROUP BY symbol)), c AS (SELECT date FROM idx, s WHERE symbol IN ('AF', 'NF', 'NO', 'RF') AND date >= s GROUP BY 1 HAVING count(*) = 4), i AS (SELECT symbol, date, level / first_value(level) OVER (PARTITION BY symbol ORDER BY date) AS g FROM idx JOIN c USING (date) WHERE symbol IN ('AF', 'NF', 'NO', 'RF')), v AS (SELECT date, sum(g) / 4 AS wealth FROM i GROUP BY 1) SELECT count(*) AS n, min(date) AS window_start, max(date) AS window_end, round(arg_max(wealth, date) - 1, 6) AS total_return, round(min(wealth), 6) AS least FROM v")
def static_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of each of four assets bought on the first common session and held."""
    i = P.px_index(spark, sf_dir).where(F.col("symbol").isin(*_ASSETS))
    common = i.groupBy(AT).agg(F.count("*").alias("k")).where("k = 4").select(AT)
    g = i.join(common, AT).withColumn("g", F.col("level") / F.first("level").over(S.upto(KEYS, AT)))
    v = g.groupBy(AT).agg((F.sum("g") / 4).alias("wealth"))
    return rounded(v.agg(F.count("*").alias("n"), F.min(AT).alias("window_start"), F.max(AT).alias("window_end"), (F.max_by("wealth", AT) - 1).alias("total_return"), F.min("wealth").alias("least")))


# ---------------------------------------------------------------- gates and certification


@query(
    "q_k31_verdict",
    with_panels("scores")
    + """, a AS (SELECT user_id, avg(CASE WHEN pit > nonpit THEN 1.0 ELSE 0 END) AS auc, count(*) AS n, avg(CASE WHEN pit IS NULL THEN 0.0 ELSE 1 END) AS parsed, avg(CASE WHEN pit IS NOT NULL THEN abs(nonpit) END) AS control FROM scores GROUP BY 1),
    b AS (SELECT *, auc - 1.96 * sqrt(0.25 / n) AS lo, auc + 1.96 * sqrt(0.25 / n) AS hi, 2 * least(auc, 1 - auc) AS p, CASE WHEN control IS NULL THEN NULL ELSE 1 - control END AS control_p FROM a)
    SELECT user_id, CASE WHEN p < 0.05 AND auc > 0.5 THEN 'recalls' WHEN control_p IS NULL OR control_p >= 0.05 THEN 'detector_unvalidated' WHEN p > 0.1 AND lo <= 0.5 AND hi >= 0.5 AND parsed >= 0.9 THEN 'certified_no_recall' ELSE 'inconclusive' END AS verdict FROM b""",
)
def verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The certification rule on stand-in statistics of every user."""
    a = P.scores(spark, sf_dir).groupBy("user_id").agg(
        F.avg(F.coalesce(F.col("pit") > F.col("nonpit"), F.lit(False)).cast("double")).alias("auc"), F.count("*").alias("n"), F.avg(F.col("pit").isNotNull().cast("double")).alias("parsed"),
        (1 - F.avg(F.when(F.col("pit").isNotNull(), F.abs("nonpit")))).alias("control_p"),
    )
    half = 1.96 * F.sqrt(0.25 / F.col("n"))
    b = a.withColumns({"lo": F.col("auc") - half, "hi": F.col("auc") + half, "p": 2 * F.least(F.col("auc"), 1 - F.col("auc"))})
    return b.select("user_id", C.certification("auc", "lo", "hi", "p", "control_p", "parsed").alias("verdict"))


@query(
    "q_k4_gates",
    with_panels("ret")
    + """, d AS (SELECT symbol, date, level, r, level / max(level) OVER (PARTITION BY symbol ORDER BY date) - 1 AS dd FROM ret), s AS (SELECT symbol, avg(r) / stddev_samp(r) * sqrt(count(r)) AS t, avg(r) / nullif(stddev_samp(r), 0) AS appraisal, avg(r) > 0 AS stable, avg(r) * 100 AS premium,
      (arg_max(level, date) / arg_min(level, date) - 1) / nullif(abs(min(dd)), 0) AS calmar, min(dd) AS maxdd FROM d GROUP BY 1),
    g AS (SELECT a.symbol, coalesce(a.t > 2.0 AND NOT isnan(a.t) AND a.appraisal IS NOT NULL, false) AS skill, coalesce(a.stable, false) AS stability, coalesce(abs(a.premium) <= 0.05, false) AS recall, coalesce(a.calmar >= b.calmar AND abs(a.maxdd) <= abs(b.maxdd), false) AS risk_shape FROM s a JOIN s b ON b.symbol = 'NO')
    SELECT symbol, skill, stability, recall, risk_shape, skill AND stability AND recall AND risk_shape AS passed, CASE WHEN NOT skill THEN 'skill' WHEN NOT stability THEN 'stability' WHEN NOT recall THEN 'recall' WHEN NOT risk_shape THEN 'risk_shape' END AS first_failure FROM g""",
)
def four_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skill, stability, recall and risk shape of every line against one of them; the first gate that fails is named."""
    d = P.returns(spark, sf_dir).withColumn("dd", S.drawdown("level", S.upto(KEYS, AT)))
    ratio = F.avg("r") / F.nullif(F.stddev_samp("r"), F.lit(0.0))
    s = d.groupBy("symbol").agg(
        (ratio * F.sqrt(F.count("r"))).alias("t"), ratio.alias("appraisal"), (F.avg("r") > 0).alias("stable"), (F.avg("r") * 100).alias("premium"),
        F.try_divide(F.max_by("level", AT) / F.min_by("level", AT) - 1, F.nullif(F.abs(F.min("dd")), F.lit(0.0))).alias("calmar"), F.min("dd").alias("maxdd"),
    )
    base = s.where("symbol = 'NO'").select(F.col("calmar").alias("base_calmar"), F.col("maxdd").alias("base_maxdd"))
    passed, first = C.gates("t", "appraisal", "stable", "premium", "calmar", "base_calmar", "maxdd", "base_maxdd")
    x = s.crossJoin(F.broadcast(base))  # one row
    return x.select("symbol", *(c.alias(k) for k, c in passed.items()), first.isNull().alias("passed"), first.alias("first_failure"))


def certify(rows: DataFrame, keys: list[str], features: list[str], label: str, n_boot: int = 200, n_perm: int = 500, chunk: int = 35) -> DataFrame:
    """keys, auc, ci_low, ci_high, perm_p, n: how well a cross-validated logistic fit tells the classes of every key apart.

    The rows of a key are bounded by whoever drew them; replicates are dealt in chunks over the cluster.
    """
    draws = [("fit", 0)] + [("boot", s) for s in range(n_boot)] + [("perm", s) for s in range(n_perm)]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        k = int(pdf._chunk.iloc[0])
        mine = draws[k * chunk : (k + 1) * chunk]
        pdf = pdf.sort_values([label, *features])
        x, y = pdf[features].to_numpy(float), pdf[label].to_numpy()
        sd = x.std(axis=0)
        x = (x - x.mean(axis=0)) / np.where(sd > 0, sd, 1)
        got = K.separation(x, y, mine) if min((y == 1).sum(), (y == 0).sum()) >= 5 else np.full(len(mine), np.nan)
        return pd.DataFrame({**{c: pdf[c].iloc[0] for c in keys}, "kind": [d for d, _ in mine], "auc": got, "n": len(y)})

    dealt = rows.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit((len(draws) - 1) // chunk))))
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keys)
    got = dealt.groupBy(*keys, "_chunk").applyInPandas(run, f"{kinds}, kind string, auc double, n long")
    fit = got.groupBy(*keys).agg(F.max(F.when(F.col("kind") == "fit", F.col("auc"))).alias("_auc"))
    far = F.abs(F.col("auc") - 0.5) >= F.abs(F.col("_auc") - 0.5)
    boot = F.when(F.col("kind") == "boot", F.col("auc"))
    out = got.join(fit, keys).groupBy(*keys).agg(
        F.max("_auc").alias("auc"), F.percentile(boot, F.lit(0.025)).alias("ci_low"), F.percentile(boot, F.lit(0.975)).alias("ci_high"),
        ((F.count_if((F.col("kind") == "perm") & far) + 1) / (F.count_if(F.col("kind") == "perm") + 1)).alias("perm_p"), F.max("n").alias("n"),
    )
    return out


@query("q_k30_certification")
def certification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxic against other documents of every language, 60 a class at the most drawn by a hash (the screen's number of prompts): area, interval, permutation p and verdict."""
    d = P.table(spark, sf_dir, "documents").where("lang is not null").select("doc_id", "lang", "n_chars", F.size(F.split("text", " ")).alias("n_words"))
    j = P.table(spark, sf_dir, "labels").join(d, "doc_id").select("lang", "doc_id", F.col("toxic").cast("int").alias("y"), F.ln(F.col("n_chars") + 1.0).alias("a"), (F.col("n_chars") / F.greatest(F.col("n_words"), F.lit(1))).alias("b"), F.col("quality").cast("double").alias("c"))
    few = j.withColumn("k", F.row_number().over(Window.partitionBy("lang", "y").orderBy(F.xxhash64("doc_id"), "doc_id"))).where("k <= 60").drop("k", "doc_id")
    s = certify(few, ["lang"], ["a", "b", "c"], "y").withColumns({"control_p": F.lit(0.01), "parsed": F.lit(1.0)})
    return s.select("lang", "n", "auc", "ci_low", "ci_high", "perm_p", C.certification("auc", "ci_low", "ci_high", "perm_p", "control_p", "parsed").alias("verdict"))


# ---------------------------------------------------------------- walk-forward targets (grouped kernels)


def _returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.returns(spark, sf_dir).where("r is not null").select("symbol", AT, "r")


def _targets(windows: DataFrame, weigh) -> DataFrame:
    """(date, symbol, weight) of every window of returns: weigh(matrix, names) on the rows before its last."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        w = pdf.pivot(index="date", columns="symbol", values="r").sort_index()
        return pd.DataFrame({"date": w.index[-1], "symbol": w.columns, "weight": weigh(w.to_numpy()[:-1], list(w.columns))})

    return windows.groupBy("end").applyInPandas(one, "date date, symbol string, weight double")


@query("q_k6_pinned")
def pinned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter pinned to one asset, tail-risk parity for the rest, at every 60th session on the 251 before it."""
    return _targets(windows_of(_returns(spark, sf_dir), 252, 60), lambda x, names: K.pinned_parity(x, np.array([0.25 if n == "NO" else np.nan for n in names])))


@query("q_k9_momentum")
def momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parity among the assets that rose over a year; cash if none did."""
    return _targets(windows_of(_returns(spark, sf_dir), 316, 60), lambda x, names: K.momentum_parity(x, 252, names.index("NO")))


@query("q_k11_annual")
def annual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parity at the first session of every year on up to 756 sessions before it, if there are at least 189."""
    r = _returns(spark, sf_dir)
    days = sessions_of(r)
    first = days.withColumn("n", F.row_number().over(Window.partitionBy(F.year(AT)).orderBy(AT))).where("n = 1").select(F.col("pos").alias("end"))
    inside = days.join(F.broadcast(first.where("end >= 189")), F.col("pos").between(F.col("end") - 756, F.col("end")))  # a date a year
    return _targets(r.join(inside.select("end", AT), AT), lambda x, names: K.risk_parity(x))


@query("q_k25_labels")
def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walk-forward regime of every line at the first session of every year: a jump model on the rows strictly before, neutral below 504 of them or where its states are close."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        year = pdf.date.map(lambda d: d.year).to_numpy()
        at = np.flatnonzero(np.r_[True, year[1:] != year[:-1]])
        return pd.DataFrame({"symbol": pdf.symbol.iloc[0], "date": pdf.date.to_numpy()[at], "n_before": at, "label": K.walked_regimes(pdf[["a", "b", "c"]].to_numpy(), at.tolist(), 50.0)})

    return S.jump_features(P.px_index(spark, sf_dir), KEYS, AT, "level").groupBy("symbol").applyInPandas(run, "symbol string, date date, n_before long, label string")
