"""Rules on report rows, evidence records, line indexes and tables, as columns: the first rule a row breaks, null for a sound one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AXES = ("inflation", "growth", "credit_stress", "policy", "risk_appetite")  # fixed values

# fixed values: report families with the periods a year that their identity pins (none: any)
FAMILIES = {
    "portfolio_metrics.reader.v2": ("reader", 252), "portfolio_metrics.vectorbt365.v1": ("legacy", 365), "portfolio_metrics.differential.v2": ("differential", 252),
    "attribution.raw_market_model.v1": ("attribution", None), "crisis_metrics.boundary_anchored.v1": ("crisis", None), "monthly_returns.reader.v1": ("monthly", 12),
}
CURRENCIES = ("USD", "legacy_mixed_local_quotes")
PROVENANCE = ("schema", "portfolio_id", "return_basis", "window_label", "start", "end", "n_obs", "periods_per_year", "cash_benchmark_id", "currency_basis", "source")
METRICS = ("total_return", "maxdd", "cagr", "ann_vol", "sharpe", "sortino", "calmar")
#: Fields of a family besides its provenance.
FIELDS = {"reader": ("row_kind", *METRICS), "legacy": METRICS[:2], "differential": METRICS, "attribution": (), "crisis": (), "monthly": ("year", "month", "monthly_return")}
#: Families that may carry attribution fields, all of this beginning.
ATTRIBUTED, PREFIX = ("reader", "attribution"), "raw_market_model_"


def report_violation(row: Column) -> Column:
    """The first broken rule of a report row, given as a map of its fields' texts; an absent field, a null and NaN are alike.

    In order: schema, prohibited label, provenance, blank, period, n_obs, periods,
    basis, currency, row_kind, monthly field, month, return, window, days, unknown
    field, kind of an attributed row, attribution window.
    """
    get = lambda k: F.try_element_at(row, F.lit(k))
    present = lambda k: get(k).isNotNull() & (F.lower(get(k)) != "nan")
    whole = lambda k: get(k).try_cast("long")
    positive = lambda k: F.coalesce(get(k).rlike(r"^\d+$") & (whole(k) > 0), F.lit(False))
    day = lambda k: get(k).try_cast("date")
    known = lambda pick: F.create_map(*(F.lit(x) for s, v in FAMILIES.items() for x in (s, pick(v))))
    schema = F.coalesce(get("schema"), F.lit(""))
    family = F.try_element_at(known(lambda v: v[0]), schema)
    pinned = F.try_element_at(known(lambda v: v[1] or 0), schema)
    keys = F.map_keys(row)
    month = F.make_date(whole("year").cast("int"), F.lit(1), F.lit(1)) + F.make_ym_interval(F.lit(0), whole("month").cast("int") - 1)
    month = F.when(F.coalesce(whole("month").between(1, 12), F.lit(False)), month)
    monthly, reader = family == "monthly", family == "reader"
    attributed = F.exists(keys, lambda k: k.startswith(PREFIX))
    def spoken(name: str) -> Callable[[Column], Column]:
        return lambda k: k.isin(*PROVENANCE, *FIELDS[name]) | (k.startswith(PREFIX) if name in ATTRIBUTED else F.lit(False))

    allowed = F.lit(False)
    for name in FIELDS:
        allowed = F.when(family == name, F.forall(keys, spoken(name))).otherwise(allowed)
    bad_number = ~F.coalesce(get("monthly_return").try_cast("double").isNotNull() & present("monthly_return") & (F.abs(get("monthly_return").try_cast("double")) < float("inf")), F.lit(False))
    same = lambda a, b: F.coalesce(get(PREFIX + a) == get(b), F.lit(False))
    rules = [
        ("schema", family.isNull()),
        ("label", F.exists(keys, lambda k: F.lower(k).rlike("capm|jensen"))),
        ("provenance", ~_all(present(k) for k in PROVENANCE)),
        ("blank", ~_all(F.trim(get(k)) != "" for k in ("portfolio_id", "return_basis", "window_label", "cash_benchmark_id", "source"))),
        ("period", day("start").isNull() | day("end").isNull() | (day("start") > day("end"))),
        ("n_obs", ~positive("n_obs")),
        ("periods", ~positive("periods_per_year")),
        ("basis", (pinned > 0) & (whole("periods_per_year") != pinned)),
        ("currency", ~get("currency_basis").isin(*CURRENCIES)),
        ("row_kind", reader & ~F.coalesce(get("row_kind").isin("full", "performance_only"), F.lit(False))),
        ("monthly_field", monthly & ~_all(F.array_contains(keys, k) for k in FIELDS["monthly"])),
        ("month", monthly & (F.coalesce(~get("year").rlike(r"^\d+$"), F.lit(True)) | month.isNull())),
        ("return", monthly & bad_number),
        ("window", monthly & ((F.trunc(day("start"), "MM") != month) | (F.trunc(day("end"), "MM") != month))),
        ("days", monthly & (whole("n_obs") > F.day(F.last_day(month)))),
        ("unknown", ~allowed),
        ("attributed_kind", reader & attributed & (get("row_kind") != "full")),
        ("attribution_window", reader & attributed & ~(same("start", "start") & same("end", "end") & same("n_obs", "n_obs"))),
    ]
    return first_broken(rules)


def _all(conditions) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & F.coalesce(c, F.lit(False))
    return out


def first_broken(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first condition that holds; an unknown one does not."""
    return F.coalesce(*(F.when(F.coalesce(broken, F.lit(False)), name) for name, broken in rules), F.lit(None).cast("string"))


def loadings(text: Column, axis_value: Callable[[Column, str], Column], axes: tuple[str, ...] = AXES) -> Column:
    """Map of all axes of a reply, each within -1 and 1; null where one is missing: none is made up."""
    values = F.array(*(axis_value(text, a) for a in axes))
    clipped = F.transform(values, lambda x: F.when(x.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))))
    return F.when(F.forall(clipped, lambda x: x.isNotNull()), F.map_from_arrays(F.array(*map(F.lit, axes)), clipped))


def loading_stability(rows: DataFrame, keys: list[str], at: str, loadings_of: str, axes: tuple[str, ...] = AXES) -> DataFrame:
    """keys, then std and mac of every axis over its dates, and their means over the axes: population deviation and mean absolute change, zero below two rows; rows without loadings are left out."""
    w = Window.partitionBy(*keys).orderBy(at)
    known = rows.where(F.col(loadings_of).isNotNull())
    x = known.select(*keys, at, *(F.col(loadings_of)[a].alias(a) for a in axes))
    x = x.select("*", *(F.abs(F.col(a) - F.lag(a).over(w)).alias(f"_{a}") for a in axes))
    few = F.count("*") < 2
    out = x.groupBy(*keys).agg(F.count("*").alias("n"), *(F.when(few, 0.0).otherwise(F.stddev_pop(a)).alias(f"std_{a}") for a in axes), *(F.coalesce(F.avg(f"_{a}"), F.lit(0.0)).alias(f"mac_{a}") for a in axes))
    mean = lambda kind: sum((F.col(f"{kind}_{a}") for a in axes), F.lit(0.0)) / len(axes)
    return out.withColumns({"mean_std": mean("std"), "mean_mac": mean("mac")})


# fixed values
VARIANTS, ORIGINS = ("pit", "nonpit_diagnostic"), ("raw_nim", "reconstructed_from_v1_loadings", "generation_failed")
TEXTS = ("pit_prompt", "source_prompt", "response")


def evidence_violation(at: str = "rebalance_date") -> Column:
    """The first broken rule of an evidence record's columns: enums, blanks, finite numbers, parse states, text digests, and a source with its digest."""
    c = F.col
    finite = lambda x: c(x).isNull() | (~F.isnan(x) & (F.abs(x) < float("inf")))
    axes = [f"loading_{a}" for a in AXES]
    blank = lambda x: F.coalesce(F.trim(x) == "", F.lit(True))
    scored = c("score_p_memorized").isNotNull() & c("score_fail_reason").isNull()
    unscored = c("score_p_memorized").isNull() & F.coalesce(c("score_fail_reason") != "", F.lit(False))
    return first_broken([
        ("variant", ~F.coalesce(c("variant").isin(*VARIANTS), F.lit(False))),
        ("date", c(at).isNull()),
        ("origin", ~F.coalesce(c("response_origin").isin(*ORIGINS), F.lit(False))),
        ("segment", blank("segment")),
        ("score_origin", blank("score_origin")),
        ("score", ~finite("score_p_memorized")),
        ("loading", ~_all(finite(a) for a in axes)),
        ("score_state", ~F.coalesce(F.when(c("score_parse_ok"), scored).otherwise(unscored), F.lit(False))),
        ("loading_state", ~F.when(c("loadings_parse_ok"), _all(c(a).isNotNull() for a in axes)).otherwise(_all(c(a).isNull() for a in axes))),
        *((f"{t}_sha256", ~F.coalesce(c(f"{t}_sha256") == F.sha2(f"{t}_text", 256), F.lit(False))) for t in TEXTS),
        ("artifact", c("source_artifact").isNull() != c("source_artifact_sha256").isNull()),
    ])


def evidence_faults(records: DataFrame, expected: DataFrame, bundle: list[str], at: str, order: str) -> DataFrame:
    """(bundle, variant, at, fault) of a bundle's records: its own first broken rule, else a repeated key, else a date not after the one before it in the order given; and expected keys without a record, and keys that were not expected.

    Duplicate texts are sound, duplicate keys are not.  A record is judged before it is
    sorted, so that only its key, its order and its fault travel; one count of every
    key's records and expectations gives both kinds of coverage, and null keys are alike.
    """
    key, line = [*bundle, "variant", at], [*bundle, "variant"]
    judged = records.select(*key, order, evidence_violation(at).alias("fault"))
    # the lines are dealt once: a key's records lie in one line
    back = F.col(at) <= F.max(at).over(Window.partitionBy(*line).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    judged = judged.withColumn("_back", back).withColumn("_again", F.row_number().over(Window.partitionBy(*key).orderBy(order)) > 1)
    judged = judged.select(*key, F.coalesce("fault", F.when(F.col("_again"), "repeated"), F.when(F.col("_back"), "order")).alias("fault"))
    own = judged.where("fault is not null")
    sides = records.select(*key, F.lit(True).alias("_had")).unionByName(expected.select(*key, F.lit(False).alias("_had")))
    met = sides.groupBy(*key).agg(F.min("_had").alias("_lo"), F.max("_had").alias("_hi")).where("_lo = _hi")
    return own.unionByName(met.select(*key, F.when(F.col("_hi"), "unexpected").otherwise("missing").alias("fault")))


def index_faults(labels: DataFrame, lines: DataFrame, key: str, label: str, order: str) -> DataFrame:
    """(key, n, fault) of every line: empty, a label that is no time, a label with a zone, repeated or not increasing labels in the order given; null for a sound index.

    Labels are texts; lines without any label are empty, which their table says.
    """
    at = F.col(label).try_cast("timestamp_ntz")
    zone = F.coalesce(F.col(label).rlike(r"([Zz]|[+-]\d\d:?\d\d)$") & F.col(label).rlike(r"\d:\d"), F.lit(False))
    x = labels.select(key, order, at.alias("_at"), zone.alias("_zone")).withColumn("_p", F.max("_at").over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)))
    g = x.groupBy(key).agg(F.count("*").alias("n"), F.count_if("_zone").alias("_zones"), F.count_if(F.col("_at").isNull() & ~F.col("_zone")).alias("_nulls"), F.count_distinct("_at").alias("_distinct"), F.count("_at").alias("_known"), F.count_if(F.col("_at") < F.col("_p")).alias("_back"))
    fault = first_broken([("empty", F.col("n") == 0), ("null", F.col("_nulls") > 0), ("zone", F.col("_zones") > 0), ("repeated", F.col("_distinct") < F.col("_known")), ("order", F.col("_back") > 0)])
    return lines.select(key).distinct().join(g, key, "left").na.fill(0, ["n"]).select(key, "n", fault.alias("fault"))


def gate_verdict(relative: bool = False, t_min: float = 2.0, premium_max: float = 0.05, alpha: float = 0.05) -> list[Column]:
    """skill, stability, recall, risk_shape, passed and the first failure's text from columns t, appraisal, ssr, ssr_p, premium, calmar, base_calmar, maxdd, base_maxdd.

    An unknown or infinite input fails its gate.  In relative mode skill asks only for a positive t and appraisal.
    """
    known = lambda *names: _all(F.col(n).isNotNull() & ~F.isnan(n) & (F.abs(n) < float("inf")) for n in names)
    text = lambda pattern, *names: F.format_string(pattern, *(F.coalesce(n, F.lit(float("nan"))) if isinstance(n, str) else n for n in names))
    c = F.col
    skilled = (c("t") > 0) & (c("appraisal") > 0) if relative else c("t") > t_min
    rules = [
        ("skill", known("t", "appraisal") & skilled, text("skill: t=%.4f, appraisal=%.4f", "t", "appraisal")),
        ("stability", known("ssr", "ssr_p") & (c("ssr_p") < alpha) & (c("ssr") > 0), text("stability: p=%.4f, SSR=%.4f", "ssr_p", "ssr")),
        ("recall", known("premium") & (F.abs("premium") <= premium_max), text("recall: |premium|=%.4f", F.abs("premium"))),
        ("risk_shape", known("calmar", "base_calmar", "maxdd", "base_maxdd") & (c("calmar") >= c("base_calmar")) & (F.abs("maxdd") <= F.abs("base_maxdd")), text("risk_shape: Calmar=%.4f of %.4f, maxDD=%.4f of %.4f", "calmar", "base_calmar", "maxdd", "base_maxdd")),
    ]
    passed = [F.coalesce(ok, F.lit(False)).alias(name) for name, ok, _ in rules]
    failure = F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), said) for _, ok, said in rules))
    return [*passed, failure.isNull().alias("passed"), failure.alias("first_failure")]


def column_faults(df: DataFrame, contract: dict[str, tuple[str, Column]]) -> DataFrame:
    """(name, finding, nulls, outside) of the columns of a contract (type, rule of its values): missing, of another type, or ok with the numbers of nulls and of values that break the rule; one pass over the rows."""
    have = dict(df.dtypes)
    ok = {n: rule for n, (kind, rule) in contract.items() if have.get(n) == kind}
    parts = [F.struct(F.lit(n).alias("name"), F.lit("ok").alias("finding"), F.count_if(F.col(n).isNull()).alias("nulls"), F.count_if(~F.coalesce(rule, F.lit(True))).alias("outside")) for n, rule in ok.items()]
    none = F.lit(None).cast("long")
    parts += [F.struct(F.lit(n).alias("name"), F.lit("missing" if n not in have else "type").alias("finding"), none.alias("nulls"), none.alias("outside")) for n in contract if n not in ok]
    return df.agg(F.array(*parts).alias("a")).select(F.inline("a"))


def guard_curves(values: DataFrame, base: str, kinds: dict[str, str]) -> DataFrame:
    """(date, configuration, wealth, drawdown, relative, kind) of curves (configuration, date, value) on their common dates: each from one, its fall from its high, and for the configurations of kinds the ratio to the base's."""
    n = values.agg(F.count_distinct("configuration").alias("_n"))  # one row
    common = values.where("value is not null").groupBy("date").agg(F.count("*").alias("_k")).crossJoin(F.broadcast(n)).where("_k = _n").select("date")
    own = Window.partitionBy("configuration").orderBy("date")
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    v = values.join(common, "date").withColumn("wealth", F.col("value") / F.first("value").over(upto))
    v = v.withColumn("drawdown", F.col("wealth") / F.max("wealth").over(upto) - 1)
    b = v.where(F.col("configuration") == base).select("date", F.col("wealth").alias("_base"))
    kind = F.try_element_at(F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv)), F.col("configuration"))
    return v.join(b, "date").select("date", "configuration", "wealth", "drawdown", F.when(kind.isNotNull(), F.col("wealth") / F.col("_base")).alias("relative"), kind.alias("kind"))
