"""Recorded decisions: prompts and replies, the look-ahead rule, paired tests, replayed steps and the records of two lines."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import prompts as T
from ..operators import kernels as K
from ..operators import series as S
from ..sources import panels as P
from ..sources.panels import with_panels
from .decision_queries import _VIEWS, _views
from .kernel_queries import long_run, long_run_sql
from .registry import query, rounded
from .relational_queries import _Z, regime_months

AT = "date"
NAMES = {"Asset_A": "AF", "Asset_B": "NF", "Asset_C": "NO", "Asset_D": "RF"}


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _fill(template: str, **slots: str) -> str:
    out = _quoted(template)
    for name, value in slots.items():
        out = f"replace({out}, '{{{name}}}', {value})"
    return out


# ---------------------------------------------------------------- look-ahead and replies

_CHANGES = (
    """WITH c AS (SELECT event_id, ['regime_view', 'overlay', 'blend', 'axes'][event_id % 4 + 1] AS kind, 'p' || (event_id % 7) AS param,
    CASE event_id % 5 WHEN 0 THEN '{"requires_future": true}' WHEN 1 THEN '{"walk_forward": false}' WHEN 2 THEN '{"walk_forward": true, "requires_future": 0}' WHEN 3 THEN '0.25' ELSE '{"requires_future": "", "walk_forward": null}' END AS value FROM events)"""
)


@query(
    "q_p12_look_ahead",
    _CHANGES
    + """ SELECT event_id, CASE WHEN coalesce(CAST(json_extract(value, '$.requires_future') AS VARCHAR), 'null') NOT IN ('null', 'false', '0', '""') THEN kind || ':' || param || ' requires post-decision (future) data'
    WHEN kind IN ('regime_view', 'overlay') AND CAST(json_extract(value, '$.walk_forward') AS VARCHAR) = 'false' THEN kind || ' fitted on a non-walk-forward window (uses post-decision data)' END AS reason FROM c""",
)
def look_ahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why each proposed change would look ahead, null where it does not."""
    e, by = P.table(spark, sf_dir, "events"), F.col("event_id") % 5
    kind = F.element_at(F.array(*map(F.lit, ("regime_view", "overlay", "blend", "axes"))), (F.col("event_id") % 4 + 1).cast("int"))
    value = F.when(by == 0, '{"requires_future": true}').when(by == 1, '{"walk_forward": false}').when(by == 2, '{"walk_forward": true, "requires_future": 0}').when(by == 3, "0.25").otherwise('{"requires_future": "", "walk_forward": null}')
    c = e.select("event_id", kind.alias("kind"), F.concat(F.lit("p"), (F.col("event_id") % 7).cast("string")).alias("param"), value.alias("value"))
    return c.select("event_id", T.look_ahead("kind", "param", "value").alias("reason"))


@query(
    "q_f23_object_slice",
    """WITH r AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'so: {"inflation": ' || (event_id % 200 - 100) || 'e-2, "growth": true, "policy": "0.5"} done' WHEN 1 THEN '{"growth": ' || (event_id % 3) || ', "other": 4, "risk_appetite": -0.25}' WHEN 2 THEN 'no object' WHEN 3 THEN '} reversed {' WHEN 4 THEN 'broken {"growth": }' ELSE '[{"growth": null, "credit_stress": 0.125}]' END AS reply FROM events),
    j AS (SELECT event_id, nullif(regexp_extract(reply, '(?s)\\{.*\\}'), '') AS s FROM r), v AS (SELECT event_id, s, s IS NOT NULL AND json_valid(s) AS ok FROM j)
    SELECT event_id, ok AS found, """
    + ", ".join(f"CASE WHEN ok THEN CASE WHEN json_type(s, '$.{a}') IN ('DOUBLE', 'BIGINT', 'UBIGINT') THEN CAST(json_extract(s, '$.{a}') AS DOUBLE) END END AS {a}" for a in T.AXES)
    + " FROM v",
)
def object_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loadings of replies: the object between the outermost braces, numbers only (no booleans, texts or nulls)."""
    by, n = F.col("event_id") % 6, lambda c: c.cast("string")
    reply = (
        F.when(by == 0, F.concat(F.lit('so: {"inflation": '), n(F.col("event_id") % 200 - 100), F.lit('e-2, "growth": true, "policy": "0.5"} done')))
        .when(by == 1, F.concat(F.lit('{"growth": '), n(F.col("event_id") % 3), F.lit(', "other": 4, "risk_appetite": -0.25}')))
        .when(by == 2, "no object").when(by == 3, "} reversed {").when(by == 4, 'broken {"growth": }').otherwise('[{"growth": null, "credit_stress": 0.125}]')
    )
    x = P.table(spark, sf_dir, "events").select("event_id", T.object_loadings(reply).alias("m"))
    return x.select("event_id", F.col("m").isNotNull().alias("found"), *(F.col("m")[a].alias(a) for a in T.AXES))


_LOADED = {"inflation": "z_d / 3", "growth": "-z_q / 3", "credit_stress": "z_t / 3", "policy": "(z_d - z_t) / 4", "risk_appetite": "(z_q - z_d) / 4"}
_LOADS = ", l AS (SELECT month, z_d, z_t, z_q, " + ", ".join(f"greatest(-1, least(1, round({e}, 2))) + 0.0::DOUBLE AS {a}" for a, e in _LOADED.items()) + " FROM z)"
_REPLY = "'{' || concat_ws(', ', " + ", ".join(f"'\"{a}\": ' || CAST({a} AS VARCHAR)" for a in T.AXES) + ") || '}'"


def _loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """month, z_d, z_t, z_q and a loading on every axis."""
    z = regime_months(spark, sf_dir)
    return z.select("month", "z_d", "z_t", "z_q", *(C.clip(F.round(F.expr(e), 2), -1, 1).alias(a) for a, e in _LOADED.items()))


@query("q_f25_reply", with_panels("macro") + _Z + _LOADS + f" SELECT month, CASE WHEN month(month) % 5 = 0 THEN '' ELSE {_REPLY} END AS reply, CASE WHEN month(month) % 5 <> 0 THEN true END AS same FROM l")
def reply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reply that stands for recorded loadings, empty where none were, and whether it parses back to them."""
    l = _loaded(spark, sf_dir)
    known = {a: F.when(F.month("month") % 5 != 0, F.col(a)) for a in T.AXES}
    r = l.withColumn("reply", T.loadings_reply(known)).withColumn("m", T.object_loadings("reply"))
    same = F.forall(F.array(*(F.col("m")[a] == F.col(a) for a in T.AXES)), lambda x: x)
    return r.select("month", "reply", F.when(F.col("m").isNotNull(), same).alias("same"))


# ---------------------------------------------------------------- prompts

_MACRO = {"cpi_yoy_z": "z_d", "t10y2y_z": "z_t", "hy_oas_z": "z_q"}
_TRAIL = {"trailing 12m return": "t12", "trailing annualized vol": "vol"}


def _sql_round(x: str, digits: int) -> str:
    return f"CAST(round_even({x}, {digits}) AS VARCHAR)"


@query(
    "q_f28_directional",
    with_panels("ret", "macro")
    + _Z
    + """, t AS (SELECT symbol, date, level / lag(level, 252) OVER w - 1 AS t12, CASE WHEN count(r) OVER f = 252 THEN stddev_samp(r) OVER f * sqrt(252) END AS vol FROM ret WINDOW w AS (PARTITION BY symbol ORDER BY date), f AS (PARTITION BY symbol ORDER BY date ROWS 251 PRECEDING)),
    a AS (SELECT symbol, date_trunc('month', date)::DATE AS month, arg_max(struct_pack(t12 := t12, vol := vol), date) AS x FROM t GROUP BY 1, 2),
    p AS (SELECT month, """
    + ", ".join(f"max(x.{c}) FILTER (WHERE symbol = '{s}') AS {s}_{c}" for s in NAMES.values() for c in ("t12", "vol"))
    + " FROM a GROUP BY 1) SELECT z.month, "
    + _fill(
        T.DIRECTIONAL,
        macro_block="concat_ws(chr(10), " + ", ".join(f"'  {k} = ' || {_sql_round(c, 2)}" for k, c in _MACRO.items()) + ")",
        asset_block="concat_ws(chr(10), " + ", ".join(f"concat_ws(', ', '  - {n} ({T.ASSETS[n]})', " + ", ".join(f"'{label}=' || {_sql_round(f'{s}_{c}', 3)}" for label, c in _TRAIL.items()) + ")" for n, s in NAMES.items()) + ")",
        lead_asset="'Asset_A'",
    )
    + " AS prompt FROM z JOIN p USING (month)",
)
def directional(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The directional prompt of every month: macro state and trailing numbers of four assets at its last session."""
    w = S.ordered(["symbol"], AT)
    f = S.trailing(["symbol"], AT, 252)
    t = P.returns(spark, sf_dir).select("symbol", AT, S.simple_return("level", w, 252).alias("t12"), (S.rolling_std("r", f, 252) * F.sqrt(F.lit(252.0))).alias("vol"))
    a = t.groupBy("symbol", F.trunc(AT, "MM").alias("month")).agg(F.max_by(F.struct("t12", "vol"), AT).alias("x"))
    p = a.groupBy("month").agg(*(F.max(F.when(F.col("symbol") == s, F.col(f"x.{c}"))).alias(f"{s}_{c}") for s in NAMES.values() for c in ("t12", "vol")))
    m = regime_months(spark, sf_dir).join(p, "month")
    assets = [(n, {label: F.col(f"{s}_{c}") for label, c in _TRAIL.items()}) for n, s in NAMES.items()]
    return m.select("month", T.directional({k: F.col(c) for k, c in _MACRO.items()}, assets).alias("prompt"))


_SIGNED = {k: f"printf('%+.2f', {c})" for k, c in sorted(_MACRO.items())}
# square roots: means of cents fall on ties of the sixth digit, which the order of a sum decides
_LEVELS = {"discount": "sqrt(d)", "quantity": "sqrt(q)", "tax": "sqrt(t)"}
_LOADINGS_SQL = _fill(
    T.LOADINGS,
    macro_block="concat_ws(chr(10), " + ", ".join(f"'  - {k}: ' || {v}" for k, v in _SIGNED.items()) + ")",
    asset_block=_quoted("\n".join(f"  - {a}: {c}" for a, c in T.ASSETS.items())),
)


def _prompt() -> Column:
    return T.loadings_prompt({k: F.col(c) for k, c in _MACRO.items()})


@query(
    "q_f27_loadings_prompt",
    with_panels("macro")
    + _Z
    + f" SELECT month, {_LOADINGS_SQL} AS prompt, {_LOADINGS_SQL} || "
    + _fill(T.IDENTIFYING, as_of="CAST(month AS VARCHAR)", names=_quoted("\n".join(f"  - {a}: {s}" for a, s in NAMES.items())), levels="concat_ws(chr(10), " + ", ".join(f"'  - {k}: ' || format('{{:g}}', {c})" for k, c in _LEVELS.items()) + ")")
    + " AS identifying FROM z JOIN macro USING (month)",
)
def loadings_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The anonymous loadings prompt of every month, and the same with date, names and raw levels after it."""
    m = regime_months(spark, sf_dir).join(P.macro(spark, sf_dir), "month")
    raw = {k: F.expr(c) for k, c in _LEVELS.items()}
    return m.select("month", _prompt().alias("prompt"), T.identified(_prompt(), F.col("month").cast("string"), NAMES, raw).alias("identifying"))


@query(
    "q_f29_prose",
    with_panels("macro")
    + _Z
    + " SELECT month, "
    + _fill(
        T.PROSE, as_of="CAST(month AS VARCHAR)", names=_quoted(", ".join(NAMES.values())), categories=_quoted(", ".join(T.ASSETS.values())),
        levels="concat_ws('; ', " + ", ".join(f"'{k} prints at ' || format('{{:g}}', {c} * 1e6)" for k, c in _LEVELS.items()) + ")", macro_block="concat_ws('; ', " + ", ".join(f"'{k} at ' || {v}" for k, v in _SIGNED.items()) + ")",
    )
    + " AS prompt FROM z JOIN macro USING (month)",
)
def prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The narrative control prompt of every month; levels in millionths, so that some need an exponent."""
    m = regime_months(spark, sf_dir).join(P.macro(spark, sf_dir), "month")
    raw = {k: F.expr(c) * 1e6 for k, c in _LEVELS.items()}
    return m.select("month", T.prose(F.col("month").cast("string"), list(NAMES.values()), {k: F.col(c) for k, c in _MACRO.items()}, raw).alias("prompt"))


# ---------------------------------------------------------------- paired tests


@query(
    "q_a35_sign_test",
    with_panels("scores")
    + """, d AS (SELECT user_id, pit - nonpit AS d FROM scores WHERE pit IS NOT NULL AND nonpit IS NOT NULL), a AS (SELECT user_id, count(*) AS n, avg(d) AS m, median(d) AS med, stddev_samp(d) AS sd, avg(d) / nullif(stddev_pop(d), 0) AS paired_d, count(*) FILTER (WHERE d > 0) AS positives FROM d GROUP BY 1)
    SELECT user_id, n, round(m, 6) AS mean_delta, round(med, 6) AS median_delta, round(sd, 6) AS sample_sd, round(paired_d, 5) AS paired_d, positives, round((SELECT sum(exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2))) FROM range(0, 400) t(k) WHERE k BETWEEN positives AND n) + 1e-10, 6) AS sign_p FROM a""",
)
def sign_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Location, spread and the one-sided sign test of the paired scores of every user."""
    a = _paired(spark, sf_dir)
    return rounded(a.select("user_id", "n", F.col("m").alias("mean_delta"), "median_delta", "sample_sd", F.round("paired_d", 5).alias("paired_d"), "positives", (C.sign_tail("positives", "n") + 1e-10).alias("sign_p")))


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = P.scores(spark, sf_dir).select("user_id", (F.col("pit") - F.col("nonpit")).alias("d")).where("d is not null")
    return d.groupBy("user_id").agg(
        F.count("*").alias("n"), F.avg("d").alias("m"), F.median("d").alias("median_delta"), F.stddev_samp("d").alias("sample_sd"),
        (F.avg("d") / F.nullif(F.stddev_pop("d"), F.lit(0.0))).alias("paired_d"), F.count_if(F.col("d") > 0).alias("positives"),
    )


@query("q_a35_t_interval")
def t_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """t value, its one-sided tail and the 95 % interval of the mean difference of every user with two pairs or more; null for fewer, or without spread."""

    @F.pandas_udf("struct<p double, half double>")
    def student(t: pd.Series, n: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"p": [K.student_tail(x, int(m) - 1) for x, m in zip(t, n, strict=True)], "half": [K.student_quantile(0.975, int(m) - 1) for m in n]})

    a = _paired(spark, sf_dir).withColumn("se", F.nullif(F.col("sample_sd"), F.lit(0.0)) / F.sqrt("n"))
    a = a.withColumn("t_stat", F.col("m") / F.col("se"))
    known = a.where("t_stat is not null").withColumn("s", student("t_stat", "n"))
    known = known.select("user_id", F.col("s.p").alias("t_p"), (F.col("m") - F.col("s.half") * F.col("se")).alias("ci_low"), (F.col("m") + F.col("s.half") * F.col("se")).alias("ci_high"))
    return a.select("user_id", "n", F.col("m").alias("mean_delta"), "t_stat").join(known, "user_id", "left")


# ---------------------------------------------------------------- replayed steps

_EXPOSED = [(n, a, w) for n, c in T.ASSETS.items() for a, w in zip(T.AXES, T.EXPOSURE[c], strict=True)]
_EVIDENCE = (
    with_panels("macro")
    + _Z
    + _LOADS
    + f""", now AS (SELECT month, variant, {_LOADINGS_SQL} AS prompt FROM z CROSS JOIN (VALUES ('nonpit'), ('pit')) v(variant)),
    ev AS (SELECT month, variant, prompt || CASE WHEN month(month) % 7 = 0 THEN ' ' ELSE '' END AS asked, month(month) % 5 <> 0 AS reads, month(month) % 5 <> 0 AND month(month) <> 3 AS recorded, CASE WHEN month(month) % 4 = 0 THEN NULL ELSE round(greatest(0, least(1, (z_d + 3) / 6)), 2) END AS p
      FROM now JOIN z USING (month) WHERE NOT (month(month) = 11 AND variant = 'nonpit')),
    st AS (SELECT now.month, now.variant, p, CASE WHEN asked IS NULL THEN 'no evidence' WHEN asked <> prompt THEN 'prompt differs' WHEN reads <> recorded THEN 'parse differs' WHEN reads THEN 'replayed' ELSE 'replayed without views' END AS status FROM now LEFT JOIN ev USING (month, variant))"""
)


def _replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """month, variant, status, p, and m, the parsed loadings, of every decision: its evidence by exact key, used only if the prompt asked then is the one of now."""
    l = _loaded(spark, sf_dir).withColumn("variant", F.explode(F.array(F.lit("nonpit"), F.lit("pit")))).withColumn("prompt", _prompt())
    by = F.month("month")
    text = F.when(by % 5 == 0, "no view").otherwise(T.loadings_reply({a: F.col(a) for a in T.AXES}))
    evidence = l.where(~((by == 11) & (F.col("variant") == "nonpit"))).select(
        "month", "variant", F.concat("prompt", F.when(by % 7 == 0, " ").otherwise("")).alias("asked"), text.alias("reply"),
        ((by % 5 != 0) & (by != 3)).alias("recorded"), F.when(by % 4 != 0, F.round(C.clip((F.col("z_d") + 3) / 6, 0, 1), 2)).alias("p"),
    )
    x = l.select("month", "variant", "prompt").join(evidence, ["month", "variant"], "left").withColumn("m", T.object_loadings("reply"))
    status = (
        F.when(F.col("asked").isNull(), "no evidence").when(F.col("asked") != F.col("prompt"), "prompt differs")
        .when(F.col("m").isNotNull() != F.col("recorded"), "parse differs").when(F.col("m").isNotNull(), "replayed").otherwise("replayed without views")
    )
    return x.select("month", "variant", status.alias("status"), "p", "m")


@query("q_k38_replay", _EVIDENCE + " SELECT month, variant, status FROM st")
def replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the record of each decision can stand for the model's answer; a prompt or a parse that differs is reported, never used."""
    return _replayed(spark, sf_dir).select("month", "variant", "status")


@query(
    "q_k36_factor_step",
    _EVIDENCE
    + ", x(asset, axis, w) AS (VALUES " + ", ".join(f"('{n}', '{a}', {w}::DOUBLE)" for n, a, w in _EXPOSED) + "), u AS (UNPIVOT (SELECT month, " + ", ".join(T.AXES) + " FROM l) ON " + ", ".join(T.AXES) + " INTO NAME axis VALUE v),"
    + """ c AS (SELECT month, least(1, sqrt(sum(v * v)) / sqrt(5)) AS conviction FROM u GROUP BY 1), tilt AS (SELECT month, asset, sum(v * w) AS tilt FROM u JOIN x USING (axis) GROUP BY 1, 2)
    SELECT st.month, variant, p IS NOT NULL AS steered, asset, round(tilt * (1 - coalesce(p, 0)), 6) AS tilt, round(tilt * (1 - coalesce(p, 0)) * conviction / 252, 9) AS q FROM st JOIN c USING (month) JOIN tilt USING (month) WHERE status = 'replayed'
    UNION ALL SELECT month, variant, false, NULL, NULL, NULL FROM st WHERE status = 'replayed without views'""",
)
def factor_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decision's views: loadings times the exposure of each asset, discounted by the recall probability where known, and their daily size; a reply without loadings is one row without views."""
    x = _replayed(spark, sf_dir).where("status in ('replayed', 'replayed without views')")
    conviction = C.conviction("m")
    legs = [F.struct(F.lit(n).alias("asset"), sum((F.coalesce(F.col("m")[a], F.lit(0.0)) * w for a, w in zip(T.AXES, T.EXPOSURE[c], strict=True)), F.lit(0.0)).alias("raw")) for n, c in T.ASSETS.items()]
    x = x.select("month", "variant", (F.col("p").isNotNull() & F.col("m").isNotNull()).alias("steered"), "p", conviction.alias("conviction"), F.explode_outer(F.when(F.col("m").isNotNull(), F.array(*legs))).alias("leg"))
    tilt = F.when(F.col("p").isNull(), F.col("leg.raw")).otherwise(C.guarded("leg.raw", "p"))
    return x.select("month", "variant", "steered", F.col("leg.asset").alias("asset"), F.round(tilt, 6).alias("tilt"), F.round(tilt * F.col("conviction") / 252, 9).alias("q"))


@query(
    "q_k37_steered_step",
    _VIEWS
    + """, s AS (SELECT event_id, value, long_leg, short_leg, p, CASE WHEN p IS NULL THEN confidence ELSE greatest(0, least(1, confidence * (1 - p) * CASE WHEN long_leg IN (0, 3) THEN 1.0 ELSE 0.5 END)) END AS shaped FROM e WHERE p IS NULL OR p < 0.8)
    SELECT event_id, p IS NOT NULL AS steered, long_leg, short_leg, round(value * least(1, greatest(0, shaped)) / 252, 12) AS q FROM s WHERE long_leg <> short_leg AND short_leg < 5
    UNION ALL SELECT event_id, true, NULL, NULL, NULL FROM e WHERE p >= 0.8""",
)
def steered_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A decision's views with confidence shaped by recall and consistency; a decision gated by recall is one row without views."""
    v = _views(spark, sf_dir)
    fits = F.when(F.col("long_leg").isin(0, 3), 1.0).otherwise(0.5)
    shaped = F.when(F.col("p").isNull(), F.col("confidence")).otherwise(C.clip(F.col("confidence") * (1 - F.col("p")) * fits, 0, 1))
    gated = F.coalesce(F.col("p") >= 0.8, F.lit(False))
    leg = F.when(~gated, F.struct("long_leg", "short_leg", F.round(F.col("value") * C.clip(shaped, 0, 1) / 252, 12).alias("q")))
    kept = v.where(gated | ((F.col("long_leg") != F.col("short_leg")) & (F.col("short_leg") < 5)))
    return kept.select("event_id", F.col("p").isNotNull().alias("steered"), leg.alias("leg")).select("event_id", "steered", "leg.*")


# ---------------------------------------------------------------- records of two lines

_LINES = {"pit": "AF", "nonpit": "RF"}
_RECORD = ("n", "total_return", "vol", "sharpe", "maxdd", "ssr", "intercept", "beta", "r2")


@query(
    "q_k45_records",
    with_panels("ret")
    + """, two AS (SELECT CASE a.symbol WHEN 'AF' THEN 'pit' ELSE 'nonpit' END AS line, a.date, a.r, a.r - c.r AS x, m.r AS market FROM ret a JOIN ret c ON c.date = a.date AND c.symbol = 'NO' JOIN ret m ON m.date = a.date AND m.symbol = 'NF' WHERE a.symbol IN ('AF', 'RF') AND a.r IS NOT NULL AND c.r IS NOT NULL AND m.r IS NOT NULL),
    spread AS (SELECT 'differential' AS line, n.date, n.r - p.r AS x FROM two n JOIN two p ON p.date = n.date AND p.line = 'pit' WHERE n.line = 'nonpit'),
    streams AS (SELECT line AS symbol, date, x AS r FROM two UNION ALL SELECT line, date, x FROM spread),
    path AS (SELECT symbol, date, CASE WHEN count(r) OVER f >= 252 THEN avg(r) OVER f / nullif(stddev_samp(r) OVER f, 0) * sqrt(252) END AS s FROM streams WINDOW f AS (PARTITION BY symbol ORDER BY date ROWS 251 PRECEDING))"""
    + long_run_sql("path")
    + """, ssr AS (SELECT symbol AS line, avg(s) / sqrt(any_value(v)) AS ssr FROM z JOIN lr USING (symbol) GROUP BY 1),
    eq AS (SELECT line, date, r, product(1 + r) OVER (PARTITION BY line ORDER BY date) AS e FROM two), dd AS (SELECT *, e / greatest(1, max(e) OVER (PARTITION BY line ORDER BY date)) - 1 AS d, min(date) OVER (PARTITION BY line) + 365 AS lo FROM eq),
    whole AS (SELECT line, count(*) AS n, arg_max(e, date) - 1 AS total_return, stddev_samp(r) * sqrt(252) AS vol, avg(r) / stddev_samp(r) * sqrt(252) AS sharpe, min(d) AS maxdd FROM dd GROUP BY 1),
    crisis AS (SELECT line, r, date, product(1 + r) OVER (PARTITION BY line ORDER BY date) AS e FROM dd WHERE date BETWEEN lo AND lo + 365), cd AS (SELECT *, e / greatest(1, max(e) OVER (PARTITION BY line ORDER BY date)) - 1 AS d FROM crisis),
    ex AS (SELECT symbol AS line, count(*) AS n, stddev_samp(r) * sqrt(252) AS vol, avg(r) / stddev_samp(r) * sqrt(252) AS sharpe FROM streams GROUP BY 1),
    rec AS (SELECT line, 'reader' AS kind, n, NULL::DOUBLE AS total_return, vol, sharpe, NULL::DOUBLE AS maxdd, ssr, NULL::DOUBLE AS intercept, NULL::DOUBLE AS beta, NULL::DOUBLE AS r2 FROM ex LEFT JOIN ssr USING (line) WHERE line <> 'differential'
      UNION ALL SELECT line, 'differential', n, NULL, vol, sharpe, NULL, ssr, NULL, NULL, NULL FROM ex LEFT JOIN ssr USING (line) WHERE line = 'differential'
      UNION ALL SELECT line, 'legacy', n, total_return, vol, sharpe, maxdd, NULL, NULL, NULL, NULL FROM whole
      UNION ALL SELECT line, 'attribution', count(*), NULL, NULL, NULL, NULL, NULL, regr_intercept(r, market) * 252, regr_slope(r, market), regr_r2(r, market) FROM two GROUP BY 1
      UNION ALL SELECT line, 'crisis', count(*), arg_max(e, date) - 1, stddev_samp(r) * sqrt(252), NULL, min(d), NULL, NULL, NULL, NULL FROM cd GROUP BY 1)
    SELECT line, kind, n, """
    + ", ".join(f"round({c}, 5) AS {c}" for c in _RECORD[1:])
    + " FROM rec",
)
def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine records of a recall-guarded line, its diagnostic twin and their daily difference: excess ratios with stability, plain equity, market model, second-year crisis."""
    r = P.returns(spark, sf_dir).where("r is not null")
    side = lambda s, c: r.where(F.col("symbol") == s).select(AT, F.col("r").alias(c))
    line = F.when(F.col("symbol") == _LINES["pit"], "pit").otherwise("nonpit")
    two = r.where(F.col("symbol").isin(*_LINES.values())).select(line.alias("line"), AT, "r").join(side("NO", "cash"), AT).join(side("NF", "market"), AT).withColumn("x", F.col("r") - F.col("cash"))
    both = two.groupBy(AT).agg(F.max(F.when(F.col("line") == "nonpit", F.col("r"))).alias("b"), F.max(F.when(F.col("line") == "pit", F.col("r"))).alias("a"))
    streams = two.select("line", AT, F.col("x").alias("r")).unionAll(both.select(F.lit("differential").alias("line"), AT, (F.col("b") - F.col("a")).alias("r")).where("r is not null"))
    year = F.sqrt(F.lit(252.0))
    vol, sharpe = (F.stddev_samp("r") * year).alias("vol"), (F.avg("r") / F.stddev_samp("r") * year).alias("sharpe")

    path = streams.select(F.col("line").alias("symbol"), AT, S.rolling_sharpe("r", S.trailing(["line"], AT, 252), 252).alias("s"))
    ssr = long_run(path).select(F.col("symbol").alias("line"), (F.col("mean") / F.sqrt("lr_var")).alias("ssr"))
    kind = F.when(F.col("line") == "differential", "differential").otherwise("reader")
    excess = streams.groupBy("line").agg(F.count("*").alias("n"), vol, sharpe).join(ssr, "line", "left").withColumn("kind", kind)

    def equity(df: DataFrame) -> DataFrame:
        """One row a line: what the returns grow to, and the deepest fall from the anchor on."""
        e = df.withColumn("e", F.product(1 + F.col("r")).over(S.upto(["line"], AT)))
        e = e.withColumn("d", F.col("e") / F.greatest(F.lit(1.0), F.max("e").over(S.upto(["line"], AT))) - 1)
        return e.groupBy("line").agg(F.count("*").alias("n"), (F.max_by("e", AT) - 1).alias("total_return"), vol, sharpe, F.min("d").alias("maxdd"))

    lo = F.date_add(F.min(AT).over(Window.partitionBy("line")), 365)
    second = two.withColumn("lo", lo).where(F.col(AT).between(F.col("lo"), F.date_add("lo", 365)))
    model = two.groupBy("line").agg(F.count("*").alias("n"), (F.regr_intercept("r", "market") * 252).alias("intercept"), F.regr_slope("r", "market").alias("beta"), F.regr_r2("r", "market").alias("r2"))
    parts = [excess, equity(two).withColumn("kind", F.lit("legacy")), model.withColumn("kind", F.lit("attribution")), equity(second).drop("sharpe").withColumn("kind", F.lit("crisis"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return rounded(out.select("line", "kind", *_RECORD), 5)
