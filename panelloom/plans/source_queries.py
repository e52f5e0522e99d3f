"""Sources, sinks and contracts as queries: shapes, normalised levels, snapshots, written tables, canonical texts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import series as S
from ..sources import catalog
from ..sources import panels as P
from ..sources.panels import with_panels
from ..sources.scratch import new_folder
from .registry import query, rounded

KEYS, AT = ["symbol"], "date"


@query("q_s5_columns", """SELECT table_name AS "table", CAST(ordinal_position AS INTEGER) AS position, column_name AS "column" FROM information_schema.columns WHERE table_name IN ('nation', 'region', 'orders')""")
def table_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of some tables by position."""
    return catalog.table_shapes(spark, sf_dir, ("nation", "region", "orders"))


@query("q_s6_preview", "SELECT n_nationkey, n_name FROM nation ORDER BY n_nationkey LIMIT 5")
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rows of a table in the order of its key: a preview is a limit."""
    return P.table(spark, sf_dir, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").limit(5)


@query("q_s15_own_dates", with_panels("ord") + ", x AS (SELECT symbol, date, CASE day(date) WHEN 3 THEN -close WHEN 4 THEN 'nan'::DOUBLE WHEN 5 THEN NULL ELSE close END AS rate FROM ord) SELECT symbol, count(*) AS n, min(date) AS lo, max(date) AS hi, round(avg(rate), 4) AS mean FROM x WHERE rate > 0 AND NOT isnan(rate) AND NOT isinf(rate) GROUP BY 1")
def own_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finite positive observations on their own dates, nothing filled."""
    day = F.day(AT)
    rate = F.when(day == 3, -F.col("close")).when(day == 4, float("nan")).when(day == 5, None).otherwise(F.col("close"))
    x = P.px_orders(spark, sf_dir).withColumn("rate", rate).where(C.finite_positive("rate"))
    return x.groupBy("symbol").agg(F.count("*").alias("n"), F.min(AT).alias("lo"), F.max(AT).alias("hi"), F.round(F.avg("rate"), 4).alias("mean"))


@query("q_s18_snapshot_frame", with_panels("px", "ord") + ", a AS (SELECT date, close AS af FROM px WHERE symbol = 'AF'), b AS (SELECT date, close AS urgent FROM ord WHERE symbol = '1-URGENT') SELECT date, round(af, 6) AS af, round(urgent, 4) AS urgent FROM a FULL JOIN b USING (date) WHERE date BETWEEN DATE '1993-01-01' AND DATE '1996-12-31'")
def snapshot_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two level tables on the union of their dates, fixed columns, an inclusive window that reaches both scans."""
    inside = F.col(AT).between("1993-01-01", "1996-12-31")
    a = P.px_line(spark, sf_dir).where((F.col("symbol") == "AF") & inside).select(AT, F.round("close", 6).alias("af"))
    b = P.px_orders(spark, sf_dir).where((F.col("symbol") == "1-URGENT") & inside).select(AT, F.round("close", 4).alias("urgent"))
    return a.join(b, AT, "full").select(AT, "af", "urgent")


@query("q_s22_shape_faults", "SELECT * FROM (VALUES ('c_custkey', 'ok'), ('c_acctbal', 'type'), ('c_missing', 'missing'), ('c_name', 'ok')) t(name, finding)")
def shape_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared columns against those of a table."""
    want = {"c_custkey": ("int", "bigint"), "c_acctbal": ("string",), "c_missing": ("string",), "c_name": ("string",)}
    have = dict(P.table(spark, sf_dir, "customer").dtypes)
    return spark.createDataFrame([(c, "missing" if c not in have else "ok" if have[c] in kinds else "type") for c, kinds in want.items()], "name string, finding string")


@query("q_s25_parquet_sink", with_panels("scores") + "SELECT user_id, day, round(pit, 9) AS pit FROM scores WHERE pit IS NOT NULL")
def parquet_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table with its date as a column, written into a new folder and read again (S25, S29: an existing folder is an error)."""
    folder = new_folder(spark, "table")
    P.scores(spark, sf_dir).where("pit is not null").select("user_id", "day", F.round("pit", 9).alias("pit")).write.mode("errorifexists").parquet(folder)
    return spark.read.parquet(folder)


@query("q_s28_canonical_json", """SELECT event_id, '{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || '}' AS body, sha256('{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || '}') AS id FROM events""")
def canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compact JSON with its keys in order, and its hash."""
    body = F.to_json(F.struct(*sorted(["event_id", "user_id", "event_type"])))
    return P.table(spark, sf_dir, "events").select("event_id", body.alias("body"), F.sha2(body, 256).alias("id"))


@query("q_s30_jsonl_source", "SELECT event_id, user_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) IS NOT NULL")
def jsonl_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence written as one JSON object a line and read with a declared schema; lines without a whole k go."""
    folder = new_folder(spark, "table")
    rows = P.table(spark, sf_dir, "events").select("event_id", "user_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"))
    rows.write.mode("errorifexists").json(folder)
    return spark.read.schema("event_id long, user_id long, k long").json(folder).where("k is not null")


@query("q_p2_descriptors", "SELECT r_name AS category, string_agg('asset_' || n_nationkey, ',' ORDER BY n_nationkey) AS ids FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neutral ids and categories, no names; a category holds a few assets."""
    n, r = P.table(spark, sf_dir, "nation"), P.table(spark, sf_dir, "region")
    j = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey)
    ids = F.transform(F.array_sort(F.collect_list("n_nationkey")), lambda k: F.concat(F.lit("asset_"), k.cast("string")))
    return j.groupBy(F.col("r_name").alias("category")).agg(F.array_join(ids, ",").alias("ids"))


@query("q_f2_finite_or_zero", with_panels("ret") + "SELECT symbol, date, round(CASE WHEN x IS NULL OR isnan(x) OR isinf(x) THEN 0 ELSE x END, 8) AS v FROM (SELECT symbol, date, CASE WHEN r > 0.003 THEN 'inf'::DOUBLE WHEN r < -0.003 THEN 'nan'::DOUBLE ELSE r END AS x FROM ret)")
def finite_or_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.when(F.col("r") > 0.003, float("inf")).when(F.col("r") < -0.003, float("nan")).otherwise(F.col("r"))
    return P.returns(spark, sf_dir).withColumn("x", x).select("symbol", AT, F.round(C.finite_or_zero("x"), 8).alias("v"))


@query("q_f34_maps", "SELECT user_id, string_agg(event_type || '=' || n, ';' ORDER BY event_type) AS counts FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) GROUP BY 1")
def maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map for every key, rendered with its keys in order."""
    n = P.table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    m = n.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    text = F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return m.select("user_id", F.array_join(text, ";").alias("counts"))


@query("q_f35_flatten_log", "SELECT event_id, CAST(pos AS INTEGER) AS pos, CASE pos WHEN 0 THEN event_type ELSE 'user_' || user_id END AS item FROM events, LATERAL (VALUES (0), (1)) t(pos)")
def flatten_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision logs, each a JSON array, as one row an item with its place."""
    log = F.to_json(F.array("event_type", F.concat(F.lit("user_"), F.col("user_id").cast("string"))))
    items = F.from_json(log, "array<string>")
    return P.table(spark, sf_dir, "events").select("event_id", F.posexplode(items).alias("pos", "item"))


@query(
    "q_k26_weekly_values",
    with_panels("ord", "px")
    + """, f AS (SELECT d::DATE AS date FROM (SELECT unnest(generate_series((SELECT min(date) FROM ord), (SELECT max(date) FROM ord), INTERVAL 1 DAY)) AS d) WHERE isodow(d) = 5), s AS (SELECT DISTINCT symbol FROM ord), fx AS (SELECT date, 1 + close / 10000 AS rate FROM px WHERE symbol = 'NO'),
    v AS (SELECT f.date, s.symbol, o.close, o.date AS seen FROM (f CROSS JOIN s) ASOF LEFT JOIN ord o ON o.symbol = s.symbol AND f.date >= o.date)
    SELECT v.date, v.symbol, CASE WHEN v.date - seen <= 3 AND v.date - fx.date <= 3 THEN round(v.close * 0.01 * rate, 6) END AS usd, CAST(v.date - seen AS BIGINT) AS price_age, CAST(v.date - fx.date AS BIGINT) AS rate_age FROM v ASOF LEFT JOIN fx ON v.date >= fx.date""",
)
def weekly_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every Friday's value in dollars from the last price and the last rate, with the age of both; older than three days gives none."""
    px = P.px_orders(spark, sf_dir)
    span = px.agg(F.min(AT).alias("lo"), F.max(AT).alias("hi"))
    names = px.select("symbol").distinct()
    cut = span.select(F.explode(F.sequence("lo", "hi")).alias(AT)).where(F.weekday(AT) == 4).crossJoin(F.broadcast(names))
    price = px.select("symbol", AT, F.struct(F.col(AT).alias("at"), F.col("close").alias("v")).alias("o"))
    fx = P.px_line(spark, sf_dir).where("symbol = 'NO'").select(AT, F.struct(F.col(AT).alias("at"), (1 + F.col("close") / 10000).alias("v")).alias("o"))
    got = S.as_of(cut, price, KEYS, AT, "o", False, "p")
    got = S.as_of(got, fx.crossJoin(F.broadcast(names)), KEYS, AT, "o", False, "x")  # a rate a session for every name
    age = lambda c: F.datediff(AT, f"{c}.at").cast("long")
    fresh = (age("p") <= 3) & (age("x") <= 3)
    return got.select(AT, "symbol", F.when(fresh, F.round(C.to_usd("p.v", "GBp", 1.0) * F.col("x.v"), 6)).alias("usd"), age("p").alias("price_age"), age("x").alias("rate_age"))


@query(
    "q_k28_point_checks",
    with_panels("ret")
    + """, c AS (SELECT date FROM ret WHERE r IS NOT NULL AND symbol IN ('AF', 'RF') GROUP BY 1 HAVING count(*) = 2), j AS (SELECT date, max(r) FILTER (WHERE symbol = 'AF') AS x, max(r) FILTER (WHERE symbol = 'RF') AS y FROM ret JOIN c USING (date) GROUP BY 1),
    k AS (SELECT k, k / 4.0 AS w FROM range(0, 5) t(k)), p AS (SELECT k, w, w * x + (1 - w) * y AS r, x, y FROM j, k) SELECT CAST(k AS INTEGER) AS k, abs(var_samp(r) - (w * w * var_samp(x) + (1 - w) * (1 - w) * var_samp(y) + 2 * w * (1 - w) * covar_samp(x, y))) < 1e-12 AS variance_ok, abs(avg(r) - (w * avg(x) + (1 - w) * avg(y))) < 1e-12 AS mean_ok, count(*) AS n FROM p GROUP BY k, w""",
)
def point_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored weights against moments: mean and variance of the weighted returns equal those computed from the moments."""
    r = P.returns(spark, sf_dir).where("r is not null and symbol in ('AF', 'RF')")
    j = r.groupBy(AT).agg(F.max(F.when(F.col("symbol") == "AF", F.col("r"))).alias("x"), F.max(F.when(F.col("symbol") == "RF", F.col("r"))).alias("y")).where("x is not null and y is not null")
    p = j.withColumn("k", F.explode(F.array(*(F.lit(k) for k in range(5))))).withColumn("w", F.col("k") / 4.0)
    w = F.col("w")
    p = p.withColumn("r", w * F.col("x") + (1 - w) * F.col("y"))
    g = p.groupBy("k", "w").agg(F.var_samp("r").alias("v"), F.var_samp("x").alias("vx"), F.var_samp("y").alias("vy"), F.covar_samp("x", "y").alias("c"), F.avg("r").alias("m"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.count("*").alias("n"))
    variance = w * w * F.col("vx") + (1 - w) * (1 - w) * F.col("vy") + 2 * w * (1 - w) * F.col("c")
    return g.select("k", (F.abs(F.col("v") - variance) < 1e-12).alias("variance_ok"), (F.abs(F.col("m") - (w * F.col("mx") + (1 - w) * F.col("my"))) < 1e-12).alias("mean_ok"), "n")


@query("q_a54_seam", with_panels("scores") + ", m AS (SELECT user_id, median(pit) AS consensus, arg_max(pit, day) FILTER (WHERE pit IS NOT NULL) AS recorded FROM scores GROUP BY 1) SELECT count(*) AS n, round(avg(abs(consensus - recorded)), 6) AS mean_gap, round(max(abs(consensus - recorded)), 6) AS max_gap, count(*) FILTER (WHERE sign(consensus) <> sign(recorded)) AS flips FROM m WHERE recorded IS NOT NULL")
def seam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The median of the draws of every key against the value that was recorded last."""
    s = P.scores(spark, sf_dir).where("pit is not null")
    m = s.groupBy("user_id").agg(F.median("pit").alias("consensus"), F.max_by("pit", "day").alias("recorded"))
    gap = F.abs(F.col("consensus") - F.col("recorded"))
    return rounded(m.agg(F.count("*").alias("n"), F.avg(gap).alias("mean_gap"), F.max(gap).alias("max_gap"), F.count_if(F.signum("consensus") != F.signum("recorded")).alias("flips")))


def local_level(y: np.ndarray) -> tuple[float, float]:
    """(signal ratio, log likelihood) of a local level model: the ratio of level to noise variance that fits best, by golden section on its logarithm."""

    def fit(log_ratio: float) -> float:
        q, a, p, total, logs = np.exp(log_ratio), y[0], 1.0 + np.exp(log_ratio), 0.0, 0.0
        for v in y[1:]:
            p += q
            f, e = p + 1, v - a
            total += e * e / f
            logs += np.log(f)
            a, p = a + p / f * e, p / f
        n = len(y) - 1
        return -0.5 * (n * np.log(2 * np.pi * max(total / n, 1e-300)) + logs + n)

    lo, hi, gold = -12.0, 6.0, (np.sqrt(5) - 1) / 2
    for _ in range(60):
        x, z = hi - gold * (hi - lo), lo + gold * (hi - lo)
        lo, hi = (lo, z) if fit(x) > fit(z) else (x, hi)
    best = (lo + hi) / 2
    return float(np.exp(best)), fit(best)


@query("q_k42_local_level")
def signal_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signal to noise of every line's monthly return, by the likelihood of a local level model."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values("m").r.to_numpy()
        ratio, like = local_level(y) if len(y) > 3 else (np.nan, np.nan)
        return pd.DataFrame({"symbol": [pdf.symbol.iloc[0]], "n": [len(y)], "ratio": [ratio], "loglik": [like]})

    m = P.returns(spark, sf_dir).where("r is not null").groupBy("symbol", F.trunc(AT, "MM").alias("m")).agg((F.product(1 + F.col("r")) - 1).alias("r"))
    return m.groupBy("symbol").applyInPandas(one, "symbol string, n long, ratio double, loglik double")


@query("q_j23_reader_join", with_panels("ret") + ", a AS (SELECT symbol, year(date) AS y, min(date) AS s, max(date) AS e, count(r) AS n FROM ret GROUP BY 1, 2), b AS (SELECT symbol, year(date) AS y, min(date) AS s, max(date) AS e, count(*) AS n FROM ret WHERE r IS NOT NULL GROUP BY 1, 2) SELECT symbol, CAST(y AS BIGINT) AS y, a.s = b.s AND a.e = b.e AND a.n = b.n AS same_window FROM a JOIN b USING (symbol, y)")
def reader_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reader rows and attributions of one window, and whether their bounds and counts agree."""
    r = P.returns(spark, sf_dir)
    side = lambda df, n: df.groupBy("symbol", F.year(AT).cast("long").alias("y")).agg(F.min(AT).alias(f"s{n}"), F.max(AT).alias(f"e{n}"), F.count("r").alias(f"n{n}"))
    j = side(r, "a").join(side(r.where("r is not null"), "b"), ["symbol", "y"])
    return j.select("symbol", "y", ((F.col("sa") == F.col("sb")) & (F.col("ea") == F.col("eb")) & (F.col("na") == F.col("nb"))).alias("same_window"))
