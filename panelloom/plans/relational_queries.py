"""Sources, predicates, joins, orders, reshapes and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import quality as Q
from ..operators import series as S
from ..sources import panels as P
from ..sources.panels import with_panels
from ..sources.scratch import new_folder
from .registry import query, rounded
from .series_queries import robust_z_sql

KEYS, AT = ["symbol"], "date"

# ---------------------------------------------------------------- sources and predicates


@query("q_s7_universe", "SELECT n_name AS symbol, r_name AS category, count(*) OVER (PARTITION BY r_name) AS peers FROM nation JOIN region ON n_regionkey = r_regionkey")
def universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = P.table(spark, sf_dir, "nation"), P.table(spark, sf_dir, "region")
    j = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("symbol"), F.col("r_name").alias("category"))
    return j.withColumn("peers", F.count("*").over(Window.partitionBy("category")))


@query("q_s8_price_scan", with_panels("px") + "SELECT symbol, date, round(close, 6) AS close FROM px WHERE symbol IN ('AF', 'NO') AND date BETWEEN DATE '1998-01-01' AND DATE '1999-12-31'")
def price_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One field of the named symbols in an inclusive date range; symbol and date filters reach the scan as column predicates."""
    px = P.px_line(spark, sf_dir).where(F.col("symbol").isin("AF", "NO") & F.col(AT).between("1998-01-01", "1999-12-31"))
    return rounded(px.select("symbol", AT, "close"))


@query(
    "q_s8b_price_wide",
    with_panels("px") + "SELECT date, " + ", ".join(f"round(ln(max(close) FILTER (WHERE symbol = '{s}')), 6) AS {s}" for s in ("AF", "AO", "NF", "NO", "RF", "RO")) + " FROM px GROUP BY 1",
)
def price_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Date by symbol; the symbols are given, so the pivot needs no extra pass."""
    return rounded(P.px_line(spark, sf_dir).groupBy(AT).pivot("symbol", ["AF", "AO", "NF", "NO", "RF", "RO"]).agg(F.ln(F.first("close"))))


@query("q_s11_sentinel_parse", "SELECT count(*) AS raw_rows, count(*) FILTER (WHERE trim(v) = '.') AS dropped, round(sum(TRY_CAST(v AS DOUBLE)), 4) AS total FROM (SELECT CASE WHEN event_id % 7 = 0 THEN '.' ELSE CAST(round(value, 2) AS VARCHAR) END AS v FROM events)")
def sentinel_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text numbers in which only a single point may stand for missing; any other text raises."""
    v = P.table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 7 == 0, F.lit(".")).otherwise(F.round("value", 2).cast("string")).alias("v"))
    return rounded(v.select(C.sentinel_double("v").alias("x"), F.col("v")).agg(F.count("*").alias("raw_rows"), F.count_if(F.trim("v") == ".").alias("dropped"), F.sum("x").alias("total")), 4)


@query("q_s14_normalize", with_panels("ord") + "SELECT symbol, min(date) AS first_date, max(date) AS last_date, count(*) AS n_rows, count(*) FILTER (WHERE NOT (close > 0)) AS violations FROM ord WHERE close IS NOT NULL GROUP BY 1")
def normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = P.px_orders(spark, sf_dir).where(F.col("close").isNotNull())
    bad = F.isnan("close") | ~(F.col("close") > 0)
    return px.groupBy("symbol").agg(F.min(AT).alias("first_date"), F.max(AT).alias("last_date"), F.count("*").alias("n_rows"), F.count_if(bad).alias("violations"))


@query("q_s19_revision_diff", with_panels("px") + "SELECT symbol, count(*) AS cells, count(*) FILTER (WHERE (close IS DISTINCT FROM (CASE WHEN day(date) = 1 THEN close + 1 ELSE close END))) AS changed FROM px GROUP BY 1")
def revision_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that differ between two versions of a panel, nulls equal."""
    folder = new_folder(spark, "panel")
    P.px_line(spark, sf_dir).select("symbol", AT, "close").write.parquet(folder)  # means of two runs can differ in their last digit
    now = spark.read.schema("symbol string, date date, close double").parquet(folder)
    was = now.withColumn("close", F.when(F.day(AT) == 1, F.col("close") + 1).otherwise(F.col("close")))
    j = now.join(was.withColumnRenamed("close", "then"), ["symbol", AT])
    return j.groupBy("symbol").agg(F.count("*").alias("cells"), F.count_if(~F.col("close").eqNullSafe(F.col("then"))).alias("changed"))


@query("q_s26_locale_csv", with_panels("px") + "SELECT symbol, CAST(date AS VARCHAR) AS iso, replace(printf('%.4f', ln(close)), '.', ',') AS de, printf('%.4f', ln(close)) AS us FROM px")
def locale_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of both locale mirrors of a numeric column."""
    return P.px_line(spark, sf_dir).select("symbol", F.date_format(AT, "yyyy-MM-dd").alias("iso"), C.locale_number(F.ln("close"), 4, "de").alias("de"), C.locale_number(F.ln("close"), 4, "us").alias("us"))


@query("q_p1_rename", "SELECT n_name AS symbol, CASE n_name WHEN 'FRANCE' THEN 'A1' WHEN 'GERMANY' THEN 'A2' ELSE n_name END AS alias FROM nation")
def rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names mapped where a map has them, passed through where not."""
    return P.table(spark, sf_dir, "nation").select(F.col("n_name").alias("symbol"), C.mapped("n_name", {"FRANCE": "A1", "GERMANY": "A2"}).alias("alias"))


@query("q_p3_start_filter", with_panels("brand") + "SELECT symbol, min(date) AS first_date, count(*) AS n FROM brand GROUP BY 1 HAVING min(date) <= (SELECT min(date) + 2 FROM brand) AND count(*) >= 504")
def start_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols that begin within two days of the panel's first date and have two windows of rows."""
    a = P.px_brand(spark, sf_dir).groupBy("symbol").agg(F.min(AT).alias("first_date"), F.count("*").alias("n"))
    lead = a.agg(F.date_add(F.min("first_date"), 2).alias("start"))  # one row
    return a.crossJoin(F.broadcast(lead)).where("first_date <= start and n >= 504").drop("start")


@query("q_p6_tail_complete", with_panels("ret") + ", t AS (SELECT symbol, date, r, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS k FROM ret WHERE date < DATE '2000-01-01') SELECT symbol, count(r) AS n, round(avg(r), 8) AS m FROM t WHERE k <= 252 AND r IS NOT NULL GROUP BY 1")
def tail_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strictly earlier rows, the last 252 of them, then those without nulls: in this order."""
    t = P.returns(spark, sf_dir).where(F.col(AT) < "2000-01-01").withColumn("k", F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc(AT)))).where("k <= 252 and r is not null")
    return rounded(t.groupBy("symbol").agg(F.count("r").alias("n"), F.avg("r").alias("m")), 8)


@query("q_p7_complete_months", with_panels("macro") + "SELECT month, round(q, 6) AS q FROM macro WHERE month < (SELECT date_trunc('month', max(l_shipdate)) FROM lineitem)")
def complete_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = P.table(spark, sf_dir, "lineitem").agg(F.trunc(F.max("l_shipdate"), "MM").alias("now"))  # one row
    return rounded(P.macro(spark, sf_dir).crossJoin(F.broadcast(line)).where("month < now").select("month", "q"))


@query(
    "q_p10_windows",
    with_panels("px")
    + """, b AS (SELECT symbol, min(date) AS lo, max(date) AS hi, CASE symbol WHEN 'AF' THEN min(date) - 1 WHEN 'NO' THEN max(date) ELSE min(date) + 1000 END AS dev FROM px GROUP BY 1),
    w AS (SELECT symbol, 'full' AS label, lo AS s, hi AS e, true AS available, NULL AS coincides FROM b
      UNION ALL SELECT symbol, 'development', lo, least(dev, hi), lo <= dev, CASE WHEN lo <= dev AND hi <= dev THEN 'full' END FROM b
      UNION ALL SELECT symbol, 'holdout', greatest(dev + 1, lo), hi, hi >= dev + 1, CASE WHEN hi >= dev + 1 AND lo >= dev + 1 THEN 'full' END FROM b)
    SELECT w.symbol, label, available, coincides, CASE WHEN available THEN s END AS s, CASE WHEN available THEN e END AS e, count(px.date) AS n
    FROM w LEFT JOIN px ON px.symbol = w.symbol AND available AND px.date BETWEEN s AND e GROUP BY 1, 2, 3, 4, 5, 6""",
)
def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The full, development and holdout windows of every symbol: one that is the whole span says so, one outside it is not available. One pass, no range join."""
    px = P.px_line(spark, sf_dir).select("symbol", AT)
    b = px.groupBy("symbol").agg(F.min(AT).alias("lo"), F.max(AT).alias("hi"))
    b = b.withColumn("dev", F.when(F.col("symbol") == "AF", F.date_add("lo", -1)).when(F.col("symbol") == "NO", F.col("hi")).otherwise(F.date_add("lo", 1000)))
    cut = F.date_add("dev", 1)
    row = lambda label, s, e, ok, same: F.struct(F.lit(label).alias("label"), s.alias("s"), e.alias("e"), ok.alias("available"), F.when(ok & same, "full").alias("coincides"))
    w = b.select("symbol", F.explode(F.array(
        row("full", F.col("lo"), F.col("hi"), F.lit(True), F.lit(False)),
        row("development", F.col("lo"), F.least("dev", "hi"), F.col("lo") <= F.col("dev"), F.col("hi") <= F.col("dev")),
        row("holdout", F.greatest(cut, F.col("lo")), F.col("hi"), F.col("hi") >= cut, F.col("lo") >= cut),
    )).alias("w")).select("symbol", "w.*")
    inside = F.col(AT).between(F.col("s"), F.col("e")) & F.col("available")
    known = lambda c: F.when(F.col("available"), F.col(c)).alias(c)
    return px.join(F.broadcast(w), "symbol").groupBy("symbol", "label", "available", "coincides", known("s"), known("e")).agg(F.count_if(inside).alias("n"))  # three windows a symbol


@query("q_p15_index_checks", with_panels("px") + ", l AS (SELECT symbol, date, lag(date) OVER (PARTITION BY symbol ORDER BY date) AS p FROM px) SELECT symbol, count(*) AS n, count(DISTINCT date) AS n_dates, count(*) FILTER (WHERE p >= date) AS disorder FROM l GROUP BY 1")
def index_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = P.px_line(spark, sf_dir).withColumn("p", F.lag(AT).over(S.ordered(KEYS, AT)))
    return x.groupBy("symbol").agg(F.count("*").alias("n"), F.count_distinct(AT).alias("n_dates"), F.count_if(F.col("p") >= F.col(AT)).alias("disorder"))


@query("q_p18_evidence", "SELECT source, count(*) AS n, count(DISTINCT sha256(text)) AS n_texts, count(*) FILTER (WHERE length(text) <> n_chars) AS bad_length FROM documents GROUP BY 1")
def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = P.table(spark, sf_dir, "documents")
    return d.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct(F.sha2("text", 256)).alias("n_texts"), F.count_if(F.length("text") != F.col("n_chars")).alias("bad_length"))


@query("q_p20_first_draw", "SELECT user_id, event_type, arg_min(value, event_id) AS value FROM events WHERE event_type <> 'error' GROUP BY 1, 2")
def first_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed draws dropped, the first of every key kept."""
    return P.table(spark, sf_dir, "events").where("event_type <> 'error'").groupBy("user_id", "event_type").agg(F.min_by("value", "event_id").alias("value"))


# ---------------------------------------------------------------- joins


@query("q_j1_left_join", with_panels("px") + ", meta AS (SELECT * FROM (VALUES ('AF', 'alpha'), ('NO', 'beta')) m(symbol, category)) SELECT symbol, category, count(*) AS n FROM px LEFT JOIN meta USING (symbol) GROUP BY 1, 2")
def left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = spark.createDataFrame([("AF", "alpha"), ("NO", "beta")], "symbol string, category string")
    return P.px_line(spark, sf_dir).join(F.broadcast(meta), "symbol", "left").groupBy("symbol", "category").agg(F.count("*").alias("n"))


@query("q_j4_outer_calendar", with_panels("px", "ord") + "SELECT date, round(ln(a.close), 6) AS line, round(ln(b.close), 6) AS orders FROM (SELECT * FROM px WHERE symbol = 'NO') a FULL JOIN (SELECT * FROM ord WHERE symbol = '1-URGENT') b USING (date)")
def outer_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = P.px_line(spark, sf_dir).where("symbol = 'NO'").select(AT, F.ln("close").alias("line"))
    b = P.px_orders(spark, sf_dir).where("symbol = '1-URGENT'").select(AT, F.ln("close").alias("orders"))
    return rounded(a.join(b, AT, "full"))


@query("q_j6_complete_case", with_panels("ord") + "SELECT date, count(*) AS n, round(avg(close), 4) AS mean FROM ord GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT symbol) FROM ord)")
def complete_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = P.px_orders(spark, sf_dir)
    names = px.agg(F.count_distinct("symbol").alias("names"))  # one row
    d = px.groupBy(AT).agg(F.count("*").alias("n"), F.avg("close").alias("mean"))
    return rounded(d.crossJoin(F.broadcast(names)).where("n = names").drop("names"), 4)


@query("q_j7_strict_difference", with_panels("ret") + "SELECT date, round(a.r - b.r, 8) AS gap, count(*) OVER () AS n FROM ret a JOIN ret b USING (date) WHERE a.symbol = 'AF' AND b.symbol = 'NO' AND a.r IS NOT NULL AND b.r IS NOT NULL")
def strict_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = P.returns(spark, sf_dir).where("r is not null")
    a, b = r.where("symbol = 'AF'").select(AT, F.col("r").alias("x")), r.where("symbol = 'NO'").select(AT, F.col("r").alias("y"))
    j = a.join(b, AT)
    n = j.agg(F.count("*").alias("n"))  # one row
    return rounded(j.select(AT, (F.col("x") - F.col("y")).alias("gap")).crossJoin(F.broadcast(n)), 8)


@query(
    "q_j9_asof_strict",
    with_panels("ord", "macro") + "SELECT o.symbol, o.date, round(m.q, 6) AS q FROM ord o ASOF LEFT JOIN macro m ON o.date > m.month",
)
def asof_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest macro row strictly before each session: one window over the stacked sides, per month block."""
    return _macro_as_of(spark, sf_dir, strict=True)


@query(
    "q_j10_asof_inclusive",
    with_panels("ord")
    + """, f AS (SELECT d::DATE AS date FROM (SELECT unnest(generate_series((SELECT min(date) FROM ord), (SELECT max(date) FROM ord), INTERVAL 1 DAY)) AS d) WHERE isodow(d) = 5), s AS (SELECT DISTINCT symbol FROM ord)
    SELECT f.date, s.symbol, CASE WHEN f.date - o.date <= 3 THEN round(o.close, 6) END AS v, CAST(f.date - o.date AS BIGINT) AS age FROM (f CROSS JOIN s) ASOF LEFT JOIN ord o ON o.symbol = s.symbol AND f.date >= o.date""",
)
def asof_inclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest observation at or before every Friday, with its age in days; one older than three days gives no value."""
    px = P.px_orders(spark, sf_dir)
    span = px.agg(F.min(AT).alias("lo"), F.max(AT).alias("hi"))
    fridays = span.select(F.explode(F.sequence("lo", "hi")).alias(AT)).where(F.weekday(AT) == 4)
    cut = fridays.crossJoin(F.broadcast(px.select("symbol").distinct()))
    seen = px.select("symbol", AT, F.struct(F.col(AT).alias("at"), F.col("close").alias("v")).alias("o"))
    got = S.as_of(cut, seen, KEYS, AT, "o", False, "o").withColumn("age", F.datediff(AT, "o.at").cast("long"))
    return rounded(got.select(AT, "symbol", F.when(F.col("age") <= 3, F.col("o.v")).alias("v"), "age"))


def _macro_as_of(spark: SparkSession, sf_dir: str, strict: bool) -> DataFrame:
    px = P.px_orders(spark, sf_dir).select("symbol", AT)
    names = px.select("symbol").distinct()
    m = P.macro(spark, sf_dir).select(F.col("month").alias(AT), "q").crossJoin(F.broadcast(names))  # a row of each month for each symbol
    return rounded(S.as_of(px, m, KEYS, AT, "q", strict, "asof").select("symbol", AT, F.col("asof").alias("q")))


@query("q_j11_asof_forward", with_panels("ord") + ", d AS (SELECT DISTINCT date_trunc('month', date)::DATE AS m FROM ord), s AS (SELECT DISTINCT symbol FROM ord) SELECT s.symbol, d.m AS month, (SELECT min(date) FROM ord o WHERE o.symbol = s.symbol AND o.date >= d.m) AS next_session FROM d CROSS JOIN s")
def asof_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first session on or after each month start: the as-of join run backwards in time."""
    px = P.px_orders(spark, sf_dir).select("symbol", AT)
    months = px.select(F.trunc(AT, "MM").alias(AT)).distinct().crossJoin(F.broadcast(px.select("symbol").distinct()))
    both = months.withColumn("q", F.lit(True)).withColumn("v", F.lit(None).cast("date")).unionByName(px.withColumn("q", F.lit(False)).withColumn("v", F.col(AT)))
    w = Window.partitionBy("symbol").orderBy(AT, F.desc("q")).rowsBetween(0, Window.unboundedFollowing)
    return both.withColumn("next_session", F.first("v", True).over(w)).where("q").select("symbol", F.col(AT).alias("month"), "next_session")


@query("q_j13_direction", with_panels("idx") + ", m AS (SELECT symbol, date_trunc('month', date)::DATE AS month, arg_min(level, date) AS v FROM idx GROUP BY 1, 2) SELECT symbol, month, CAST(sign(lead(v) OVER (PARTITION BY symbol ORDER BY month) / v - 1) AS BIGINT) AS direction FROM m")
def direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = P.px_index(spark, sf_dir).groupBy("symbol", F.trunc(AT, "MM").alias("month")).agg(F.min_by("level", AT).alias("v"))
    return m.select("symbol", "month", F.signum(F.lead("v").over(S.ordered(KEYS, "month")) / F.col("v") - 1).cast("long").alias("direction"))


@query("q_j15_semi", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = P.table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return P.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey").join(c, "o_custkey", "left_semi")


@query("q_j16_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
def anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = P.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return P.table(spark, sf_dir, "customer").select("c_custkey").join(o, "c_custkey", "left_anti")


@query("q_j18_paired_premium", with_panels("scores") + "SELECT count(*) AS n, round(avg(pit - nonpit), 6) AS mean_delta, round(median(pit) - median(nonpit), 6) AS median_delta, round(CASE WHEN stddev_pop(pit - nonpit) > 1e-12 THEN avg(pit - nonpit) / stddev_pop(pit - nonpit) ELSE 0 END, 6) AS cohen_d FROM scores WHERE pit IS NOT NULL AND nonpit IS NOT NULL")
def paired_premium(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Premium of paired scores: mean, difference of medians, paired effect size."""
    d = F.col("pit") - F.col("nonpit")
    p = P.scores(spark, sf_dir).where("pit is not null and nonpit is not null")
    return rounded(p.agg(F.count("*").alias("n"), F.avg(d).alias("mean_delta"), (F.median("pit") - F.median("nonpit")).alias("median_delta"), F.when(F.stddev_pop(d) > 1e-12, F.avg(d) / F.stddev_pop(d)).otherwise(0.0).alias("cohen_d")))


@query("q_j19_replay_audit", "SELECT a.event_id, a.value IS DISTINCT FROM b.v AS differs FROM events a FULL JOIN (SELECT event_id, CASE WHEN event_id % 100 = 0 THEN NULL ELSE value END AS v FROM events) b USING (event_id) WHERE a.value IS DISTINCT FROM b.v")
def replay_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows where two copies disagree, nulls equal."""
    e = P.table(spark, sf_dir, "events").select("event_id", "value")
    b = e.select("event_id", F.when(F.col("event_id") % 100 != 0, F.col("value")).alias("v"))
    differs = ~F.col("value").eqNullSafe(F.col("v"))
    return e.join(b, "event_id", "full").where(differs).select("event_id", differs.alias("differs"))


@query("q_j20_many_to_one", "SELECT n_name, count(*) AS n, round(sum(s_acctbal), 4) AS bal FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey GROUP BY 1")
def many_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = P.table(spark, sf_dir, "supplier"), P.table(spark, sf_dir, "nation")
    return rounded(s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey, "left").groupBy("n_name").agg(F.count("*").alias("n"), F.sum("s_acctbal").alias("bal")), 4)  # nation: 25 rows at every scale


_REGIME = "CASE WHEN z_d > 1 THEN 'inflation' WHEN z_t > 1 OR z_q < -1.5 THEN 'recession' ELSE 'normal' END"
_Z = ", z AS (SELECT month, " + ", ".join(f"({c} - avg({c}) OVER ()) / stddev_samp({c}) OVER () AS z_{c}" for c in "dtq") + " FROM macro)"


def macro_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-sample z-scores of the macro series."""
    m = P.macro(spark, sf_dir)
    stat = m.agg(*(f(c).alias(f"{n}_{c}") for c in "dtq" for n, f in (("m", F.avg), ("s", F.stddev_samp))))  # one row
    return m.crossJoin(F.broadcast(stat)).select("month", *(((F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")).alias(f"z_{c}") for c in "dtq"))


def regime_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return macro_scores(spark, sf_dir).withColumn("regime", C.rule_regime("z_d", "z_t", "z_q"))


@query("q_j12_label_ffill", with_panels("ret", "macro") + _Z + f", g AS (SELECT month, {_REGIME} AS regime FROM z) SELECT r.symbol, g.regime, count(*) AS n, round(avg(r.r) * 252, 6) AS ann FROM ret r ASOF JOIN g ON r.date >= g.month WHERE r.r IS NOT NULL GROUP BY 1, 2")
def label_ffill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean return by symbol and month-start regime carried forward (A29, F12): every date has its month's label, so an equi-join does."""
    g = regime_months(spark, sf_dir).select("month", "regime")
    r = P.returns(spark, sf_dir).where("r is not null").withColumn("month", F.trunc(AT, "MM"))
    return rounded(r.join(g, "month").groupBy("symbol", "regime").agg(F.count("*").alias("n"), (F.avg("r") * 252).alias("ann")))


_MIX = [("equal", "AF", 0.5), ("equal", "NO", 0.5), ("tilt", "AF", 0.2), ("tilt", "NO", 0.3), ("tilt", "RF", 0.5)]


@query(
    "q_j21_payoff",
    with_panels("ret", "macro") + _Z + f", g AS (SELECT month, {_REGIME} AS regime FROM z), a AS (SELECT r.symbol, g.regime, avg(r.r) AS m FROM ret r ASOF JOIN g ON r.date >= g.month WHERE r.r IS NOT NULL GROUP BY 1, 2), w AS (SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{s}', {w}::DOUBLE)" for p, s, w in _MIX) + ") v(portfolio, symbol, w)) SELECT portfolio, regime, round(sum(w * m) * 252, 6) AS payoff FROM a JOIN w USING (symbol) GROUP BY 1, 2",
)
def payoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annualised payoff of fixed mixes in every regime."""
    g = regime_months(spark, sf_dir).select("month", "regime")
    a = P.returns(spark, sf_dir).where("r is not null").withColumn("month", F.trunc(AT, "MM")).join(g, "month").groupBy("symbol", "regime").agg(F.avg("r").alias("m"))
    w = spark.createDataFrame(_MIX, "portfolio string, symbol string, w double")
    return rounded(a.join(F.broadcast(w), "symbol").groupBy("portfolio", "regime").agg((F.sum(F.col("w") * F.col("m")) * 252).alias("payoff")))


@query("q_a28_label_share", with_panels("macro") + _Z + f", g AS (SELECT {_REGIME} AS regime FROM z), v AS (SELECT * FROM (VALUES ('inflation'), ('recession'), ('normal'), ('boom')) t(regime)) SELECT v.regime, count(g.regime) AS n, round(count(g.regime) * 1.0 / (SELECT count(*) FROM g), 6) AS share FROM v LEFT JOIN g USING (regime) GROUP BY 1")
def label_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label frequencies over a fixed vocabulary, zeros included."""
    g = regime_months(spark, sf_dir).select("regime")
    v = spark.createDataFrame([(x,) for x in ("inflation", "recession", "normal", "boom")], "regime string")
    counted = v.join(g.groupBy("regime").agg(F.count("*").alias("n")), "regime", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    total = g.agg(F.count("*").alias("total"))  # one row
    return rounded(counted.crossJoin(F.broadcast(total)).select("regime", "n", (F.col("n") / F.col("total")).alias("share")))


# ---------------------------------------------------------------- orders, sets, reshapes


@query(
    "q_o3_top_per_category",
    """WITH want AS (SELECT * FROM (VALUES ('EUROPE', 1), ('AFRICA', 2), ('ASIA', 3)) t(category, place)), k AS (SELECT place, category, c_custkey, c_acctbal, row_number() OVER (PARTITION BY category ORDER BY c_acctbal DESC, c_custkey) AS rnk
      FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN want ON category = r_name) SELECT place, category, c_custkey, c_acctbal, rnk, 1.0::DOUBLE / count(*) OVER () AS weight FROM k WHERE rnk <= 3""",
)
def top_per_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best three of every requested category with its place in the request, equally weighted; a category with fewer is an error. The report is a top-k, kept small before the shuffle."""
    c, n, r = (P.table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    want = spark.createDataFrame([("EUROPE", 1), ("AFRICA", 2), ("ASIA", 3)], "category string, place int")
    j = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    j = j.select(F.col("r_name").alias("category"), "c_custkey", "c_acctbal").join(F.broadcast(want), "category")
    top = j.withColumn("rnk", F.row_number().over(Window.partitionBy("category").orderBy(F.desc("c_acctbal"), "c_custkey")).cast("long")).where("rnk <= 3")
    found = F.count("*").over(Window.partitionBy("category"))
    short = F.when(found < 3, F.raise_error(F.concat(F.lit("too few in "), "category")).cast("long")).otherwise(F.col("rnk"))
    return top.select("place", "category", "c_custkey", "c_acctbal", short.alias("rnk"), (1.0 / F.count("*").over(Window.partitionBy())).alias("weight"))  # three rows a category


@query("q_o5_top_abs", with_panels("ret") + ", z AS (SELECT symbol, date, (r - avg(r) OVER (PARTITION BY symbol)) / stddev_samp(r) OVER (PARTITION BY symbol) AS z FROM ret) SELECT symbol, date, round(z, 5) AS z FROM z WHERE z IS NOT NULL ORDER BY abs(z) DESC, symbol, date LIMIT 20")
def top_abs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = Window.partitionBy("symbol")
    z = P.returns(spark, sf_dir).withColumn("z", (F.col("r") - F.avg("r").over(own)) / F.stddev_samp("r").over(own)).where("z is not null")
    return rounded(z.orderBy(F.desc(F.abs("z")), "symbol", AT).limit(20).select("symbol", AT, "z"), 5)


@query("q_o9_intersection", with_panels("px", "ord") + "SELECT date FROM px WHERE symbol = 'NO' INTERSECT SELECT date FROM ord WHERE symbol = '1-URGENT'")
def intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.px_line(spark, sf_dir).where("symbol = 'NO'").select(AT).intersect(P.px_orders(spark, sf_dir).where("symbol = '1-URGENT'").select(AT))


@query("q_o10_difference", with_panels("px", "ord") + "SELECT date FROM px WHERE symbol = 'NO' EXCEPT SELECT date FROM ord WHERE symbol = '1-URGENT'")
def difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.px_line(spark, sf_dir).where("symbol = 'NO'").select(AT).subtract(P.px_orders(spark, sf_dir).where("symbol = '1-URGENT'").select(AT))


@query("q_o11_union_widen", "SELECT 'customer' AS kind, c_mktsegment AS segment, NULL AS priority, count(*) AS n FROM customer GROUP BY 2 UNION ALL SELECT 'orders', NULL, o_orderpriority, count(*) FROM orders GROUP BY 3")
def union_widen(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = P.table(spark, sf_dir, "customer").groupBy(F.lit("customer").alias("kind"), F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"))
    o = P.table(spark, sf_dir, "orders").groupBy(F.lit("orders").alias("kind"), F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"))
    return c.unionByName(o, allowMissingColumns=True)


@query("q_o14_unpivot", with_panels("macro") + "SELECT month, name, round(value, 6) AS value FROM macro UNPIVOT (value FOR name IN (d, t, q))")
def unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.macro(spark, sf_dir).unpivot("month", ["d", "t", "q"], "name", "value"))


@query("q_o8_even_sample", "WITH o AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS pos, count(*) OVER () AS n FROM customer), p AS (SELECT DISTINCT CAST(round_even(i * (n - 1) / 9.0, 0) AS BIGINT) AS pos FROM (SELECT max(n) AS n FROM o), range(10) t(i)) SELECT c_custkey, pos FROM o JOIN p USING (pos)")
def even_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten evenly spaced rows, positions rounded half to even: the sample is the feature."""
    c = P.table(spark, sf_dir, "customer").select("c_custkey")
    n = c.agg(F.count("*").alias("n"))
    p = spark.range(10).crossJoin(F.broadcast(n)).select(F.bround(F.col("id") * (F.col("n") - 1) / 9.0).cast("long").alias("pos")).distinct()
    return C.positions(c, "c_custkey").join(F.broadcast(p), "pos").select("c_custkey", "pos")  # ten positions


# ---------------------------------------------------------------- scalar functions


@query("q_f1_guard", with_panels("scores") + "SELECT user_id, day, round(pit * (1 - least(1, greatest(0, nonpit))), 6) AS guarded, round(least(0.5, greatest(-0.5, pit)), 6) AS clipped FROM scores WHERE pit IS NOT NULL AND nonpit IS NOT NULL")
def guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = P.scores(spark, sf_dir).where("pit is not null and nonpit is not null")
    return rounded(s.select("user_id", "day", C.guarded("pit", "nonpit").alias("guarded"), C.clip("pit", -0.5, 0.5).alias("clipped")))


@query("q_f7_scale", with_panels("scores") + "SELECT user_id, round(CASE WHEN c IS NULL OR isnan(c) OR c <= 0.3 THEN 1 WHEN c >= 0.7 THEN 0.2 ELSE 1 - (c - 0.3) / 0.4 * 0.8 END, 6) AS scale FROM (SELECT user_id, abs(corr(pit, nonpit)) AS c FROM scores GROUP BY 1)")
def scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.scores(spark, sf_dir).groupBy("user_id").agg(F.abs(C.correlation("pit", "nonpit")).alias("c")).select("user_id", C.correlation_scale("c").alias("scale")))


@query("q_f12_regimes", with_panels("macro") + _Z + f" SELECT month, {_REGIME} AS regime FROM z")
def regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regime_months(spark, sf_dir).select("month", "regime")


@query("q_f13_bins", with_panels("macro") + _Z + " SELECT month, CASE WHEN coalesce(z_t, 0) > 1 THEN 'credit_stress' WHEN coalesce(z_d, 0) > 0.5 AND coalesce(z_q, 0) < 0 THEN 'stagflation_risk' WHEN coalesce(z_d, 0) < 0 AND coalesce(z_t, 0) < 0 THEN 'goldilocks' ELSE 'neutral' END AS label FROM z")
def bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regime_months(spark, sf_dir).select("month", C.bin_regime("z_d", "z_t", "z_q").alias("label"))


@query(
    "q_f18_fridays",
    "SELECT strftime(d + INTERVAL 22 HOUR, '%Y-%m-%d %H:%M:%S') AS cutoff_utc, CAST(isodow(d) AS INTEGER) AS dow FROM (SELECT unnest(generate_series((SELECT min(l_shipdate)::DATE FROM lineitem), (SELECT max(l_shipdate)::DATE FROM lineitem), INTERVAL 1 DAY)) AS d) WHERE isodow(d) = 5",
)
def fridays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every Friday at 22 h UTC, whatever the session's zone: a wall time without a zone."""
    span = P.table(spark, sf_dir, "lineitem").agg(F.to_date(F.min("l_shipdate")).alias("lo"), F.to_date(F.max("l_shipdate")).alias("hi"))
    d = span.select(F.explode(F.sequence("lo", "hi")).alias("friday")).where(F.weekday("friday") == 4)
    return d.select(F.date_format(F.col("friday").cast("timestamp_ntz") + F.expr("interval 22 hours"), "yyyy-MM-dd HH:mm:ss").alias("cutoff_utc"), (F.weekday("friday") + 1).alias("dow"))


@query("q_f20_business_day", "SELECT o_orderkey, CASE isodow(o_orderdate) WHEN 1 THEN o_orderdate::DATE - 3 WHEN 7 THEN o_orderdate::DATE - 2 ELSE o_orderdate::DATE - 1 END AS before FROM orders")
def business_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.table(spark, sf_dir, "orders").select("o_orderkey", C.previous_business_day(F.to_date("o_orderdate")).alias("before"))


@query("q_f21_json", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, least(1, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) / 50) AS clipped FROM events")
def json_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A number from the first brace to the last of a reply: JSON first, a regular expression where that fails."""
    k = C.axis_value("props", "k")
    return P.table(spark, sf_dir, "events").select("event_id", k.alias("k"), F.least(F.lit(1.0), k / 50).alias("clipped"))


_AXIS = r"""(?i)["']?\\bk\\b["']?\\s*(?::|=|->)\\s*([+-]?[0-9]*\\.?[0-9]+(?:e[+-]?[0-9]+)?)""".replace("\\\\", "\\")


@query(
    "q_f22_axis_regex",
    "WITH r AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN concat('K -> ', value, ' then k=1') WHEN 2 THEN concat('the ''k'' = -', abs(value), 'e1;') ELSE 'weak 3' END AS reply FROM events) SELECT event_id, TRY_CAST(nullif(regexp_extract(reply, '"
    + _AXIS.replace("'", "''")
    + "', 1), '') AS DOUBLE) AS k FROM r",
)
def axis_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number named by an axis in a reply: quotes or none, a colon, an equals sign or an arrow, a sign and an exponent; the first match."""
    e = P.table(spark, sf_dir, "events")
    by = F.col("event_id") % 4
    reply = F.when(by == 0, F.col("props")).when(by == 1, F.concat(F.lit("K -> "), F.col("value").cast("string"), F.lit(" then k=1"))).when(by == 2, F.concat(F.lit("the 'k' = -"), F.abs("value").cast("string"), F.lit("e1;"))).otherwise("weak 3")
    return e.select("event_id", F.regexp_extract(reply, _AXIS, 1).try_cast("double").alias("k"))


@query("q_f26_last_match", "SELECT item_id, list_last(regexp_extract_all(text, '[a-z]+ing')) AS last_ing, CAST(len(regexp_extract_all(text, '[a-z]+ing')) AS INTEGER) AS n FROM benchmark")
def last_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all("text", F.lit("[a-z]+ing"), F.lit(0))
    return P.table(spark, sf_dir, "benchmark").select("item_id", F.when(F.size(found) > 0, F.element_at(found, -1)).alias("last_ing"), F.size(found).alias("n"))


@query("q_f27_prompt", with_panels("macro") + _Z + " SELECT month, printf('state %s: d=%+.3f q=%+.3f t=%+.3f', strftime(month, '%Y-%m'), z_d, z_q, z_t) AS prompt, sha256(strftime(month, '%Y-%m')) AS id FROM z")
def prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deterministic template with sorted keys, and its hash."""
    m = regime_months(spark, sf_dir).withColumn("ym", F.date_format("month", "yyyy-MM"))
    return m.select("month", F.format_string("state %s: d=%+.3f q=%+.3f t=%+.3f", "ym", "z_d", "z_q", "z_t").alias("prompt"), F.sha2("ym", 256).alias("id"))


@query("q_f33_tolerance", with_panels("px") + "SELECT symbol, date, CASE WHEN close = 0 THEN abs(v) <= 1e-6 ELSE abs(v - close) / abs(close) <= 1e-6 END AS ok FROM (SELECT symbol, date, close, CASE WHEN day(date) = 15 THEN close * 1.01 ELSE close END AS v FROM px)")
def tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = P.px_line(spark, sf_dir).withColumn("v", F.when(F.day(AT) == 15, F.col("close") * 1.01).otherwise(F.col("close")))
    return px.select("symbol", AT, C.within("close", "v", 1e-6).alias("ok"))


#: The price panel with faults put in by rule, so that every flag has rows.
_FAULTY = with_panels("px") + """, fpx AS (SELECT symbol, date, CASE WHEN n % 400 = 100 THEN high * 1.004 WHEN n % 400 = 150 THEN high * 1.1 ELSE open END AS open, CASE WHEN n % 400 = 200 THEN low * 0.5 ELSE high END AS high, low,
      CASE WHEN n % 300 = 250 THEN close * 1.5 WHEN n % 500 >= 490 THEN 900.0 ELSE close END AS close, CASE WHEN n % 500 >= 490 THEN 0 ELSE volume END AS volume
      FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS n FROM px)),
    fb AS (SELECT *, greatest(0, close / high - 1, 1 - close / low) AS out_close, greatest(0, close / high - 1, 1 - close / low, open / high - 1, 1 - open / low) AS out_any, ln(close) - lag(ln(close)) OVER (PARTITION BY symbol ORDER BY date) AS r FROM fpx)""" + robust_z_sql("fb") + """,
    fc AS (SELECT *, high < low OR open <= 0 OR high <= 0 OR low <= 0 OR close <= 0 OR out_any > 0.01 AS structural, close <= 0 OR high < low OR out_close > 0.01 AS bad_close, lead(r) OVER (PARTITION BY symbol ORDER BY date) AS nx,
      coalesce(close = lag(close) OVER (PARTITION BY symbol ORDER BY date), false) AND coalesce(volume, 0) = 0 AS flat, count(z) OVER (PARTITION BY date) AS seen, count(*) FILTER (WHERE abs(z) > 3) OVER (PARTITION BY date) AS moved FROM mz),
    fd AS (SELECT *, coalesce(sign(nx) = -sign(r) AND abs(nx) >= 0.6 * abs(r), false) AS undone, seen >= 5 AND moved / greatest(seen, 1) >= 0.5 AS market, sum(CASE WHEN flat THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY date) AS run FROM fc),
    fe AS (SELECT *, coalesce(abs(z) > 6 AND abs(r) >= 0.002, false) AND undone AND NOT market AS spike FROM fd),
    ff AS (SELECT *, out_any > 0 AND NOT structural AS ohlc_quirk, spike AND abs(r) >= ln(1.05) AS fat_finger, spike AND NOT abs(r) >= ln(1.05) AS jitter, coalesce(abs(r) >= ln(1.8), false) AND NOT undone AS level_shift,
      flat AND count(*) FILTER (WHERE flat) OVER (PARTITION BY symbol, run) >= 5 AS stale FROM fe), flags AS (SELECT *, structural OR fat_finger OR jitter OR level_shift OR stale AS any_error FROM ff)"""


def _faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = P.px_line(spark, sf_dir).withColumn("n", F.row_number().over(S.ordered(KEYS, AT)))
    at = lambda m, k: F.col("n") % m == k
    dead = F.col("n") % 500 >= 490
    return px.select(
        "symbol", AT, F.when(at(400, 100), F.col("high") * 1.004).when(at(400, 150), F.col("high") * 1.1).otherwise(F.col("open")).alias("open"), F.when(at(400, 200), F.col("low") * 0.5).otherwise(F.col("high")).alias("high"), "low",
        F.when(at(300, 250), F.col("close") * 1.5).when(dead, 900.0).otherwise(F.col("close")).alias("close"), F.when(dead, 0).otherwise(F.col("volume")).alias("volume"),
    )


@query("q_f40_qc_flags", _FAULTY + " SELECT symbol, date, structural, fat_finger, jitter, level_shift, stale, ohlc_quirk, bad_close, any_error AS any, round(z, 4) AS z FROM flags")
def qc_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every flag of every row of a panel with faults."""
    x = Q.flagged(_faulty(spark, sf_dir))
    return rounded(x.select("symbol", AT, *Q.ERRORS, "ohlc_quirk", "bad_close", "any", "z"), 4)


@query(
    "q_a27_qc_summary",
    _FAULTY + " SELECT coalesce(symbol, 'TOTAL') AS symbol, count(*) AS n_rows, " + ", ".join(f"round(avg(CAST({c} AS INTEGER)) * 100, 6) AS {n}" for c, n in [*((x, x) for x in ("structural", "fat_finger", "jitter", "level_shift", "stale", "ohlc_quirk")), ("any_error", '"any"')]) + " FROM flags GROUP BY ROLLUP (symbol)",
)
def qc_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per cent of rows flagged, a symbol at a time and over all rows."""
    return rounded(Q.summary(Q.flagged(_faulty(spark, sf_dir))))


@query(
    "q_f40_clean",
    _FAULTY + ", g AS (SELECT *, NOT (bad_close OR fat_finger OR jitter) AS good FROM flags) SELECT symbol, date, round(CASE WHEN good THEN open END, 6) AS open, round(CASE WHEN good THEN high END, 6) AS high, round(CASE WHEN good THEN low END, 6) AS low, round(last_value(CASE WHEN good THEN close END IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date), 6) AS close, volume FROM g",
)
def qc_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel without its bad rows' prices, closes carried forward."""
    return rounded(Q.cleaned(Q.flagged(_faulty(spark, sf_dir))))


@query("q_a34_wilson", "SELECT source, count(*) AS n, sum(toxic)::BIGINT AS k, round((p + z * z / (2 * n_) - z * sqrt(p * (1 - p) / n_ + z * z / (4 * n_ * n_))) / (1 + z * z / n_), 6) AS lo, round((p + z * z / (2 * n_) + z * sqrt(p * (1 - p) / n_ + z * z / (4 * n_ * n_))) / (1 + z * z / n_), 6) AS hi FROM (SELECT *, avg(toxic) OVER (PARTITION BY source) AS p, count(*) OVER (PARTITION BY source) AS n_, 1.96::DOUBLE AS z FROM labels JOIN documents USING (doc_id)) GROUP BY source, p, n_, z")
def wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binomial score interval of the toxic share of every source."""
    j = P.table(spark, sf_dir, "labels").join(P.table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    a = j.groupBy("source").agg(F.count("*").alias("n"), F.sum("toxic").alias("k"))
    lo, hi = C.wilson("k", "n", 1.96)
    return rounded(a.select("source", "n", "k", lo.alias("lo"), hi.alias("hi")))


@query("q_a33_score_report", with_panels("scores") + "SELECT user_id, count(*) AS n, round(avg(pit), 6) AS mean, round(median(pit), 6) AS med, round(quantile_cont(pit, 0.9), 6) AS p90, round(avg(CASE WHEN pit IS NULL THEN 1.0 ELSE 0 END), 6) AS fail_rate FROM scores GROUP BY 1")
def score_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(P.scores(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"), F.avg("pit").alias("mean"), F.median("pit").alias("med"), S.percentile("pit", 0.9).alias("p90"), F.avg(F.col("pit").isNull().cast("double")).alias("fail_rate")))


@query("q_a31_stability", with_panels("scores") + ", x AS (SELECT user_id, day, pit, abs(pit - lag(pit) OVER (PARTITION BY user_id ORDER BY day)) AS c FROM scores WHERE pit IS NOT NULL) SELECT user_id, round(CASE WHEN count(*) < 2 THEN 0 ELSE stddev_pop(pit) END, 6) AS std, round(coalesce(avg(c), 0), 6) AS mac FROM x GROUP BY 1")
def stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Population deviation and mean absolute change of a score over its dates; fewer than two give zero."""
    x = P.scores(spark, sf_dir).where("pit is not null").withColumn("c", F.abs(F.col("pit") - F.lag("pit").over(S.ordered(["user_id"], "day"))))
    return rounded(x.groupBy("user_id").agg(F.when(F.count("*") < 2, 0.0).otherwise(F.stddev_pop("pit")).alias("std"), F.coalesce(F.avg("c"), F.lit(0.0)).alias("mac")))


@query("q_p13_premium_split", with_panels("scores") + ", s AS (SELECT CASE WHEN day <= DATE '2024-01-15' THEN 'in_training' ELSE 'post_cutoff' END AS segment, pit - nonpit AS d FROM scores WHERE pit IS NOT NULL AND nonpit IS NOT NULL) SELECT coalesce(segment, 'full') AS segment, count(*) AS n, round(avg(d), 6) AS mean FROM s GROUP BY ROLLUP (segment)")
def premium_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = P.scores(spark, sf_dir).where("pit is not null and nonpit is not null").select(F.when(F.col("day") <= "2024-01-15", "in_training").otherwise("post_cutoff").alias("segment"), (F.col("pit") - F.col("nonpit")).alias("d"))
    return rounded(s.rollup("segment").agg(F.count("*").alias("n"), F.avg("d").alias("mean")).withColumn("segment", F.coalesce("segment", F.lit("full"))))
