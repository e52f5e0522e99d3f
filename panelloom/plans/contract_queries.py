"""Contracts on rows, records and tables: what is built wrong on purpose has to be found, and nothing else."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..operators import contracts, regression
from ..operators import series as S
from ..sources import catalog, sentinel, sinks
from ..sources import panels as P
from ..sources.panels import with_panels
from ..sources.scratch import new_folder
from .kernel_queries import bootstrap
from .registry import query, rounded
from .relational_queries import paired_premium

KEYS, AT = ["symbol"], "date"
_CODE = "ascii(symbol) + 3 * ascii(substr(symbol, 2, 1))"


# ---------------------------------------------------------------- report rows


@query(
    "q_p14_report_rows",
    with_panels("ret")
    + f""", m AS (SELECT symbol, strftime(date, '%Y-%m') AS label, count(*) AS days, (year(min(date)) * 12 + month(min(date)) + {_CODE}) % 19 AS k FROM ret GROUP BY 1, 2),
    y AS (SELECT symbol, strftime(date, '%Y') AS label, (year(min(date)) + {_CODE}) % 7 AS k FROM ret GROUP BY 1, 2)
    SELECT symbol, label, CASE k WHEN 0 THEN 'schema' WHEN 1 THEN 'label' WHEN 2 THEN 'provenance' WHEN 3 THEN 'blank' WHEN 4 THEN CASE WHEN days > 1 THEN 'period' END WHEN 5 THEN 'n_obs' WHEN 6 THEN 'basis' WHEN 7 THEN 'currency'
      WHEN 8 THEN 'month' WHEN 9 THEN 'return' WHEN 10 THEN 'window' WHEN 11 THEN 'days' WHEN 12 THEN 'unknown' WHEN 13 THEN 'monthly_field' WHEN 14 THEN 'n_obs' WHEN 15 THEN 'unknown' WHEN 16 THEN 'periods' END AS violation FROM m
    UNION ALL SELECT symbol, label, CASE k WHEN 1 THEN 'attribution_window' WHEN 2 THEN 'attributed_kind' WHEN 3 THEN 'row_kind' WHEN 5 THEN 'basis' WHEN 6 THEN 'unknown' END FROM y""",
)
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly and yearly report rows of every line as maps, most of them with one planted fault, through the whole row gate."""
    r = P.returns(spark, sf_dir)
    text = lambda c: c.cast("string")

    def rows(pattern: str, k: F.Column) -> DataFrame:
        g = r.groupBy("symbol", F.date_format(AT, pattern).alias("label")).agg(F.min(AT).alias("s"), F.max(AT).alias("e"), F.count("*").alias("n"))
        return g.withColumn("k", k)

    def gated(g: DataFrame, fields: dict[str, F.Column]) -> DataFrame:
        entries = F.create_map(*(x for name, v in fields.items() for x in (F.lit(name), text(v))), F.col("extra"), F.lit("1"))
        row = F.map_filter(entries, lambda name, v: (name != "") & v.isNotNull())
        return g.select("symbol", "label", row.alias("row")).select("symbol", "label", contracts.report_violation(F.col("row")).alias("violation"))

    code = F.expr(_CODE)
    at = lambda k, wrong, right: F.when(F.col("k") == k, wrong).otherwise(right)
    base = {"portfolio_id": F.col("symbol"), "return_basis": F.lit("price"), "cash_benchmark_id": F.lit("NO")}
    m = rows("yyyy-MM", (F.year("s") * 12 + F.month("s") + code) % 19)
    m = m.withColumn("extra", F.when(F.col("k") == 1, "CAPM_alpha").when(F.col("k") == 12, "weather").when(F.col("k") == 15, "raw_market_model_beta").otherwise(""))
    monthly = gated(m, base | {
        "schema": at(0, F.lit("monthly"), F.lit("monthly_returns.reader.v1")), "source": at(2, F.lit(None), F.lit("lineitem")), "window_label": at(3, F.lit("  "), F.col("label")),
        "start": at(4, F.col("e"), F.col("s")), "end": at(4, F.col("s"), F.col("e")), "n_obs": F.when(F.col("k") == 5, "0").when(F.col("k") == 11, "40").when(F.col("k") == 14, "1.5").otherwise(text(F.col("n"))),
        "periods_per_year": F.when(F.col("k") == 6, "252").when(F.col("k") == 16, "-12").otherwise("12"), "currency_basis": at(7, F.lit("EUR"), F.lit("USD")), "month": at(8, F.lit(13), F.month("s")),
        "monthly_return": at(9, F.lit("nan"), F.lit("0.01")), "year": F.when(F.col("k") == 10, F.year("s") + 1).when(F.col("k") != 13, F.year("s")),
    })
    y = rows("yyyy", (F.year("s") + code) % 7).withColumn("extra", F.when(F.col("k") == 6, "crisis_return").otherwise(""))
    part = lambda v: F.when(F.col("k").isin(0, 1, 2), v)
    yearly = gated(y, base | {
        "schema": F.lit("portfolio_metrics.reader.v2"), "source": F.lit("lineitem"), "window_label": F.col("label"), "start": F.col("s"), "end": F.col("e"), "n_obs": F.col("n"), "currency_basis": F.lit("USD"), "cagr": F.lit("0.1"),
        "periods_per_year": at(5, F.lit(365), F.lit(252)), "row_kind": F.when(F.col("k").isin(0, 1), "full").when(F.col("k") == 3, "half").otherwise("performance_only"),
        "raw_market_model_start": part(F.col("s")), "raw_market_model_end": part(F.col("e")), "raw_market_model_n_obs": part(F.when(F.col("k") == 1, F.col("n") + 1).otherwise(F.col("n"))),
    })
    return monthly.unionByName(yearly)


# ---------------------------------------------------------------- evidence


@query(
    "q_p18_evidence_faults",
    """WITH e AS (SELECT event_id, user_id, CAST(ts AS DATE) AS rebalance_date, event_id % 31 AS m, CASE WHEN event_id % 31 = 0 THEN 'other' WHEN event_type = 'view' THEN 'pit' ELSE 'nonpit_diagnostic' END AS variant FROM events WHERE event_type IN ('view', 'click')),
    j AS (SELECT *, CASE m WHEN 0 THEN 'variant' WHEN 1 THEN 'origin' WHEN 2 THEN 'segment' WHEN 3 THEN 'score' WHEN 4 THEN 'score_state' WHEN 5 THEN 'score_state' WHEN 6 THEN 'loading_state' WHEN 7 THEN 'loading_state' WHEN 8 THEN 'response_sha256' WHEN 9 THEN 'artifact' WHEN 10 THEN 'loading' WHEN 11 THEN 'score_origin'
      ELSE CASE WHEN row_number() OVER (PARTITION BY user_id, variant, rebalance_date ORDER BY event_id) > 1 THEN 'repeated' WHEN rebalance_date <= max(rebalance_date) OVER (PARTITION BY user_id, variant ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 'order' END END AS fault FROM e),
    want AS (SELECT DISTINCT user_id, variant, CAST(ts AS DATE) AS rebalance_date FROM events, (VALUES ('pit'), ('nonpit_diagnostic')) v(variant) WHERE event_type <> 'error' AND day(ts) <> 15),
    have AS (SELECT DISTINCT user_id, variant, rebalance_date FROM e)
    SELECT user_id, variant, rebalance_date, fault FROM j WHERE fault IS NOT NULL UNION ALL (SELECT *, 'missing' FROM (FROM want EXCEPT FROM have)) UNION ALL (SELECT *, 'unexpected' FROM (FROM have EXCEPT FROM want))""",
)
def evidence_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dated evidence of every user with planted faults: enums, states, digests, keys and coverage."""
    e = P.table(spark, sf_dir, "events")
    m, value = F.col("event_id") % 31, F.col("value")
    text = lambda name: F.concat(F.lit(f"{name} "), F.col("event_id").cast("string"))
    variant = F.when(m == 0, "other").when(F.col("event_type") == "view", "pit").otherwise("nonpit_diagnostic")
    axes = {f"loading_{a}": F.when(m == 10, float("nan")).when((m == 6) & F.lit(a == "policy"), None).otherwise(F.lit(0.1 * i)) for i, a in enumerate(contracts.AXES)}
    records = e.where("event_type in ('view', 'click')").select(
        "event_id", "user_id", F.to_date("ts").alias("rebalance_date"), variant.alias("variant"), F.when(m == 1, "x").otherwise("raw_nim").alias("response_origin"), F.when(m == 2, " ").otherwise("in").alias("segment"),
        F.when(m == 11, None).otherwise("guard").alias("score_origin"), F.when(m == 3, float("inf")).otherwise(value).alias("score_p_memorized"), F.when(m == 4, "r").alias("score_fail_reason"), (m != 5).alias("score_parse_ok"),
        (m != 7).alias("loadings_parse_ok"), *(v.alias(k) for k, v in axes.items()), *(text(t).alias(f"{t}_text") for t in contracts.TEXTS),
        *(F.sha2(text(t), 256).alias(f"{t}_sha256") for t in contracts.TEXTS[:2]),
        F.sha2(F.when(m == 8, "other").otherwise(text("response")), 256).alias("response_sha256"), F.lit("file").alias("source_artifact"), F.when(m != 9, "digest").alias("source_artifact_sha256"),
    )
    both = F.explode(F.array(*(F.lit(v) for v in contracts.VARIANTS)))
    expected = e.where((F.col("event_type") != "error") & (F.day("ts") != 15)).select("user_id", both.alias("variant"), F.to_date("ts").alias("rebalance_date"))
    return contracts.evidence_faults(records, expected, ["user_id"], "rebalance_date", "event_id")


@query(
    "q_p15_index_rules",
    with_panels("ord") + """, n AS (SELECT symbol, count(*) + CASE WHEN symbol LIKE '4%' THEN count(*) FILTER (WHERE day(date) = 3) ELSE 0 END AS n FROM ord GROUP BY 1)
    SELECT symbol, n, CASE left(symbol, 1) WHEN '2' THEN 'null' WHEN '3' THEN 'zone' WHEN '4' THEN 'repeated' WHEN '5' THEN 'order' END AS fault FROM n UNION ALL SELECT 'none', 0, 'empty'""",
)
def index_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexes of lines given as texts, each line with a fault of its own, and one line without any label."""
    o = P.px_orders(spark, sf_dir).select("symbol", AT, F.left("symbol", F.lit(1)).alias("kind"), F.datediff(AT, F.lit("1990-01-01").cast("date")).alias("pos"))
    day = F.date_format(AT, "yyyy-MM-dd")
    label = F.when((F.col("kind") == "2") & (F.day(AT) == 13), "no day").when((F.col("kind") == "3") & (F.day(AT) == 7), F.concat(day, F.lit(" 00:00:00Z"))).otherwise(day)
    x = o.select("symbol", F.when(F.col("kind") == "5", -F.col("pos")).otherwise(F.col("pos")).alias("pos"), label.alias("label"))
    x = x.unionByName(o.where((F.col("kind") == "4") & (F.day(AT) == 3)).select("symbol", "pos", day.alias("label")))
    lines = o.select("symbol").distinct().unionByName(spark.createDataFrame([("none",)], "symbol string"))
    return contracts.index_faults(x, lines, "symbol", "label", "pos")


# ---------------------------------------------------------------- loadings

_PERCENT = [f"(event_id * {7 + j}) % 301 - 150" for j in range(5)]
_LOADED = "WITH l AS (SELECT event_id, user_id, " + ", ".join(f"CASE WHEN event_id % 6 < 4 THEN greatest(-1.0, least(1.0, ({h}) / 100.0)) END::DOUBLE AS {a}" for a, h in zip(contracts.AXES, _PERCENT)) + " FROM events)"


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six shapes of a reply: JSON, JSON in prose, a labelled list, JSON with one axis outside it, an axis missing, and a truth value for a number."""
    number = [F.concat(F.expr(h).cast("string"), F.lit("e-2")) for h in _PERCENT]
    pairs = list(zip(contracts.AXES, number))
    body = lambda some: F.concat(F.lit("{"), F.concat_ws(", ", *(F.concat(F.lit(f'"{a}": '), n) for a, n in some)), F.lit("}"))
    listed = F.concat_ws("; ", *(F.concat(F.lit(f"{a.upper()} -> "), n) for a, n in pairs))
    shape = F.col("event_id") % 6
    reply = (
        F.when(shape == 0, body(pairs)).when(shape == 1, F.concat(F.lit("So:\n"), body(pairs), F.lit("\nas asked."))).when(shape == 2, listed)
        .when(shape == 3, F.concat(body([p for p in pairs if p[0] != "policy"]), F.lit(" and policy: "), number[3]))
        .when(shape == 4, body(pairs[:4])).otherwise(body([(a, F.lit("true") if a == "policy" else n) for a, n in pairs]))
    )
    said = P.table(spark, sf_dir, "events").select("event_id", "user_id", reply.alias("reply"))
    return said.select("event_id", "user_id", contracts.loadings(F.col("reply"), C.axis_value).alias("loadings"))


@query("q_f21_loadings", _LOADED + " SELECT event_id, " + ", ".join(f"round({a}, 6) AS {a}" for a in contracts.AXES) + " FROM l")
def parsed_loadings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five axes of a reply or none."""
    return rounded(_replies(spark, sf_dir).select("event_id", *(F.col("loadings")[a].alias(a) for a in contracts.AXES)))


_SPREAD = [f"CASE WHEN count(*) < 2 THEN 0 ELSE stddev_pop({a}) END" for a in contracts.AXES], [f"coalesce(avg(c_{a}), 0)" for a in contracts.AXES]


@query(
    "q_a31_loadings",
    _LOADED + ", x AS (SELECT *, " + ", ".join(f"abs({a} - lag({a}) OVER (PARTITION BY user_id ORDER BY event_id)) AS c_{a}" for a in contracts.AXES) + " FROM l WHERE policy IS NOT NULL) SELECT user_id, count(*) AS n, "
    + ", ".join(f"round({e}, 6) AS {k}_{a}" for k, es in zip(("std", "mac"), _SPREAD) for a, e in zip(contracts.AXES, es)) + ", " + ", ".join(f"round(({' + '.join(es)}) / 5, 6) AS mean_{k}" for k, es in zip(("std", "mac"), _SPREAD)) + " FROM x GROUP BY 1",
)
def loadings_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stability of all axes over every user's parsed replies, and its means."""
    return rounded(contracts.loading_stability(_replies(spark, sf_dir), ["user_id"], "event_id", "loadings"))


# ---------------------------------------------------------------- curves and panels

_KINDS = {"NF": "controlled_pit_unguarded_vs_guarded", "RF": "combined_nonpit_unguarded_vs_pit_guarded_stress"}  # fixed values


@query(
    "q_k46_curves",
    with_panels("idx") + ", c AS (SELECT date FROM idx WHERE symbol IN ('AF', 'NF', 'NO', 'RF') GROUP BY 1 HAVING count(*) = 4), v AS (SELECT date, symbol, level / first_value(level) OVER (PARTITION BY symbol ORDER BY date) AS w FROM idx JOIN c USING (date) WHERE symbol IN ('AF', 'NF', 'NO', 'RF')), k(symbol, kind) AS (VALUES "
    + ", ".join(f"('{s}', '{k}')" for s, k in _KINDS.items()) + ") SELECT v.date, v.symbol AS configuration, round(v.w, 6) AS wealth, round(v.w / max(v.w) OVER (PARTITION BY v.symbol ORDER BY v.date) - 1, 6) AS drawdown, CASE WHEN kind IS NOT NULL THEN round(v.w / b.w, 6) END AS relative, kind FROM v JOIN v b ON b.date = v.date AND b.symbol = 'AF' LEFT JOIN k ON k.symbol = v.symbol",
)
def curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four curves on their common dates with falls, two of them against the first."""
    v = P.px_index(spark, sf_dir).where("symbol in ('AF', 'NF', 'NO', 'RF')").select(AT, F.col("symbol").alias("configuration"), F.col("level").alias("value"))
    return rounded(contracts.guard_curves(v, "AF", _KINDS)).withColumn("drawdown", F.col("drawdown") + F.lit(0.0))


@query(
    "q_j22_panel",
    with_panels("scores", "macro")
    + """, x AS (SELECT user_id, day, v.variant, v.guarded, v.raw, CASE WHEN v.guarded THEN v.raw * (1 - least(1, greatest(0, abs(coalesce(nonpit, 0))))) ELSE v.raw END AS applied FROM scores, LATERAL (VALUES ('pit', true, pit), ('pit', false, pit), ('nonpit_diagnostic', true, nonpit), ('nonpit_diagnostic', false, nonpit)) v(variant, guarded, raw)),
    w AS (SELECT variant, guarded, day, """ + ", ".join(f"max({c}) FILTER (WHERE user_id = {k}) AS {c}_{k}" for c in ("raw", "applied") for k in (1, 2, 3)) + """, count(raw) AS known FROM x GROUP BY 1, 2, 3)
    SELECT variant, guarded, day, known, """ + ", ".join(f"round({c}_{k}, 6) AS {c}_{k}" for c in ("raw", "applied") for k in (1, 2, 3)) + """, month, round(d, 6) AS d, round(t, 6) AS t, round(q, 6) AS q FROM w ASOF LEFT JOIN macro m ON w.day - INTERVAL 28 YEAR > m.month""",
)
def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each of four configurations and decision day: raw and applied values of three assets, and the macro row strictly before the day, which is 28 years back in these tables."""
    s = P.scores(spark, sf_dir)
    configs = F.explode(F.array(*(F.struct(F.lit(v).alias("variant"), F.lit(g).alias("guarded"), F.col(c).alias("raw")) for v, c in (("pit", "pit"), ("nonpit_diagnostic", "nonpit")) for g in (True, False))))
    x = s.select("user_id", "day", "nonpit", configs.alias("c")).select("user_id", "day", "c.*", F.when(F.col("c.guarded"), C.guarded("c.raw", F.abs(F.coalesce("nonpit", F.lit(0.0))))).otherwise(F.col("c.raw")).alias("applied"))
    wide = x.groupBy("variant", "guarded", "day").agg(*(F.max(F.when(F.col("user_id") == k, F.col(c))).alias(f"{c}_{k}") for c in ("raw", "applied") for k in (1, 2, 3)), F.count("raw").alias("known"))
    m = P.macro(spark, sf_dir).select(F.col("month").alias("at"), F.struct("month", "d", "t", "q").alias("m"))
    days = wide.select("day").distinct().withColumn("at", F.add_months("day", -12 * 28))
    dated = S.as_of(days.withColumn("k", F.lit(1)), m.withColumn("k", F.lit(1)), ["k"], "at", "m", True, "m")  # days and months
    return rounded(wide.join(dated.select("day", "m"), "day").select("variant", "guarded", "day", "known", *(f"{c}_{k}" for c in ("raw", "applied") for k in (1, 2, 3)), "m.*"))


# ---------------------------------------------------------------- tables and versions


@query("q_s4_find_tables", "SELECT 'lineitem' AS \"table\", count(*) AS n FROM lineitem UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'part', count(*) FROM part")
def find_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of the catalog whose name holds a keyword, with their rows."""
    names = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
    for n in names:
        P.table(spark, sf_dir, n).createOrReplaceTempView(f"shelf_{n}")
    found = [r.table for r in catalog.find_tables(spark, ("SHELF_ORD", "shelf_line", "shelf_part")).collect()]  # names
    counts = [spark.table(t).agg(F.lit(t.removeprefix("shelf_")).alias("table"), F.count("*").alias("n")) for t in found]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query(
    "q_s19_versions",
    with_panels("px") + """, o AS (SELECT concat(l_returnflag, l_linestatus) AS symbol, CAST(l_shipdate AS DATE) AS date, avg(l_extendedprice / l_quantity) AS close FROM lineitem WHERE l_orderkey % 10 <> 0 AND l_shipdate < DATE '1998-06-01' GROUP BY 1, 2)
    SELECT symbol, date_trunc('year', date)::DATE AS year, count(*) AS cells, count(*) FILTER (WHERE o.close IS NULL) AS added, count(*) FILTER (WHERE o.close IS NOT NULL AND abs(px.close - o.close) > 1e-9 * abs(o.close)) AS revised,
      round(max(abs(px.close / o.close - 1)), 6) AS most FROM px FULL JOIN o USING (symbol, date) GROUP BY 1, 2""",
)
def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions of a panel, the older one from nine tenths of the rows up to a day: cells added and revised a year, and the largest revision."""
    now = P.px_line(spark, sf_dir).select("symbol", AT, F.col("close").alias("now"))
    old = P.table(spark, sf_dir, "lineitem").where("l_orderkey % 10 <> 0 and l_shipdate < DATE '1998-06-01'")
    was = old.groupBy(F.concat("l_returnflag", "l_linestatus").alias("symbol"), F.to_date("l_shipdate").alias(AT)).agg(F.avg(F.col("l_extendedprice") / F.col("l_quantity")).alias("was"))
    j = now.join(was, ["symbol", AT], "full")
    revised = F.col("was").isNotNull() & (F.abs(F.col("now") - F.col("was")) > 1e-9 * F.abs("was"))
    g = j.groupBy("symbol", F.trunc(AT, "YEAR").alias("year")).agg(F.count("*").alias("cells"), F.count_if(F.col("was").isNull()).alias("added"), F.count_if(revised).alias("revised"), F.max(F.abs(F.col("now") / F.col("was") - 1)).alias("most"))
    return rounded(g)


@query("q_s22_contract", "SELECT 'o_orderkey' AS name, 'ok' AS finding, count(*) FILTER (WHERE o_orderkey IS NULL) AS nulls, count(*) FILTER (WHERE o_orderkey < 0) AS outside FROM orders UNION ALL SELECT 'o_totalprice', 'ok', count(*) FILTER (WHERE o_totalprice IS NULL), count(*) FILTER (WHERE NOT o_totalprice BETWEEN 1000 AND 400000) FROM orders UNION ALL SELECT 'o_orderpriority', 'ok', count(*) FILTER (WHERE o_orderpriority IS NULL), count(*) FILTER (WHERE o_orderpriority = '5-LOW') FROM orders UNION ALL SELECT 'o_custkey', 'type', NULL, NULL UNION ALL SELECT 'o_comment', 'missing', NULL, NULL")
def contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table against a contract of types and rules: what is missing or of another type, and how many values break a rule."""
    o = P.table(spark, sf_dir, "orders")
    rules = {
        "o_orderkey": ("bigint", F.col("o_orderkey") >= 0), "o_totalprice": ("double", F.col("o_totalprice").between(1000, 400000)), "o_orderpriority": ("string", F.col("o_orderpriority") != "5-LOW"),
        "o_custkey": ("string", F.lit(True)), "o_comment": ("string", F.lit(True)),
    }
    return contracts.column_faults(o, rules)


@query(
    "q_s11_sentinel_source",
    with_panels("ord") + "SELECT symbol, count(*) AS n, min(date) AS first_day, round(avg(round(close, 4)), 2) AS mean, (SELECT count(*) FROM ord) AS rows_read, (SELECT count(*) FROM ord WHERE day(date) = 5) AS sentinels FROM ord WHERE day(date) <> 5 AND date >= DATE '1995-01-01' GROUP BY 1",
)
def sentinel_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A panel through the sentinel source in the comma locale and back, filtered while it is read, with what the sentinels stood for."""
    sentinel.register(spark)
    px = P.px_orders(spark, sf_dir).select("symbol", AT, F.when(F.day(AT) != 5, F.col("close")).alias("close"))
    folder = new_folder(spark, "sentinel")
    px.write.format("sentinel_csv").option("locale", "de").option("digits", 4).mode("append").save(folder)
    read = spark.read.format("sentinel_csv").option("locale", "de")
    counts = read.option("report", "true").load(folder).where("column = 'close'").agg(F.sum("rows").alias("rows_read"), F.sum("missing").alias("sentinels"))  # one row
    back = read.option("report", "false").schema("symbol string, date date, close double").load(folder).where("close IS NOT NULL AND date >= DATE '1995-01-01'")
    g = back.groupBy("symbol").agg(F.count("*").alias("n"), F.min(AT).alias("first_day"), F.round(F.avg("close"), 2).alias("mean"))
    return g.crossJoin(F.broadcast(counts))


@query("q_s27_mirror_faults", with_panels("px") + "SELECT symbol, date FROM px WHERE day(date) IN (1, 9)")
def mirror_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A panel against its mirror in the other locale, read back after cells of one day were changed and rows of another left out."""
    px = P.px_line(spark, sf_dir).select("symbol", AT, "close", "volume")
    folder = new_folder(spark, "mirror")
    sinks.write_locale_csv(px.where(F.day(AT) != 9).withColumn("close", F.when(F.day(AT) == 1, F.col("close") + 1e-6).otherwise(F.col("close"))), folder, "de")
    return sinks.mirror_faults(px, sinks.read_locale_csv(spark, folder, T.StructType(px.schema.fields), "de"), ["symbol", AT], 5e-8)


@query("q_o18_positions")
def seeded_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty orders at the sorted positions that numpy's generator draws from seed 0 without replacement: a sampling operator."""
    o = P.table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    n = o.count()
    drawn = np.sort(np.random.default_rng(0).choice(n, min(50, n), replace=False))
    at = spark.createDataFrame([(int(x),) for x in drawn], "pos long")
    return C.positions(o, "o_orderkey").join(F.broadcast(at), "pos").select("pos", "o_orderkey", "o_totalprice")


# ---------------------------------------------------------------- gates on real statistics


def gate_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, t, appraisal (against the benchmark line), ssr, ssr_p (block bootstrap), premium (paired scores), calmar, maxdd and the benchmark's."""
    r = P.returns(spark, sf_dir)
    b = r.where("symbol = 'NO' and r is not null").select(AT, F.col("r").alias("x"))
    fit = regression.fitted(r.where("symbol <> 'NO' and r is not null").join(b, AT), "symbol", AT, "r", ["x"])
    skill = fit.select("symbol", F.col("t")[0].alias("t"), (F.col("beta")[0] * F.sqrt(F.lit(252.0)) / F.nullif(F.col("s"), F.lit(0.0))).alias("appraisal"))
    d = r.withColumn("dd", S.drawdown("level", S.upto(KEYS, AT)))
    years = F.datediff(F.max(AT), F.min(AT)) / 365.25
    shape = d.groupBy("symbol").agg((F.pow(F.max_by("level", AT) / F.min_by("level", AT), 1 / years) - 1).alias("cagr"), F.min("dd").alias("maxdd"))
    shape = shape.select("symbol", F.try_divide("cagr", F.abs("maxdd")).alias("calmar"), "maxdd")
    base = shape.where("symbol = 'NO'").select(F.col("calmar").alias("base_calmar"), F.col("maxdd").alias("base_maxdd"))  # one row
    premium = paired_premium(spark, sf_dir).select(F.col("mean_delta").alias("premium"))  # one row
    stable = bootstrap(spark, sf_dir).select("symbol", "ssr", F.col("p").alias("ssr_p"))
    return skill.join(shape, "symbol").join(stable, "symbol").crossJoin(F.broadcast(base)).crossJoin(F.broadcast(premium))


@query("q_k4_verdicts")
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four gates of every line on its own statistics, in the absolute and in the relative mode, with the figures of the first that fails."""
    x = gate_inputs(spark, sf_dir)
    x = x.withColumn("mode", F.explode(F.array(F.lit("absolute"), F.lit("relative"))))
    one = lambda relative: x.where(F.col("mode") == ("relative" if relative else "absolute")).select(*x.columns, *contracts.gate_verdict(relative))
    return one(False).unionByName(one(True))


@query("q_k43_full_rows")
def full_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reader rows with their stability ratio, both bootstrap tails and the verdict's sentence."""
    from .decision_queries import reader_rows

    b = bootstrap(spark, sf_dir).select("symbol", F.col("ssr").alias("ssr"), F.col("p").alias("ssr_p"), F.col("p_lower").alias("ssr_p_lower"), "n_boot")
    stable, _, said = C.stability_verdict("ssr", "ssr_p")
    return reader_rows(spark, sf_dir).join(b, "symbol").withColumns({"stable": stable, "stably_below": F.coalesce((F.col("ssr_p_lower") < 0.05) & (F.col("ssr") < 0), F.lit(False)), "verdict": said})
