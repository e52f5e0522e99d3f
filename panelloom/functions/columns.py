"""Scalar expressions: every function takes columns or their names and gives a Column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..sources.scratch import new_folder


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clip(x: str | Column, lo: float, hi: float) -> Column:
    """Null stays null, though greatest and least skip it."""
    return F.when(_c(x).isNotNull(), F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), _c(x))))


def finite_or_zero(x: str | Column) -> Column:
    bad = _c(x).isNull() | F.isnan(_c(x)) | (F.abs(_c(x)) == float("inf"))
    return F.when(bad, 0.0).otherwise(_c(x))


def guarded(raw: str | Column, p: str | Column) -> Column:
    """raw times what the clipped probability leaves."""
    return _c(raw) * (1 - clip(p, 0, 1))


def correlation_scale(c: str | Column, normal: float = 0.3, crisis: float = 0.7, least: float = 0.2) -> Column:
    """1 up to the normal correlation, falling linearly to the least scale; unknown counts as normal."""
    return F.when(_c(c).isNull() | F.isnan(_c(c)) | (_c(c) <= normal), 1.0).when(_c(c) >= crisis, least).otherwise(1 - (_c(c) - normal) / (crisis - normal) * (1 - least))


def correlation(x: str | Column, y: str | Column, noise: float = 1e-13) -> Column:
    """An aggregate as F.corr, but NaN where a side is constant, which divides by zero there and raises; null without a pair.

    A side whose deviation is below ``noise`` of its mean is constant: equal means of
    doubles differ in their last digit with the order in which they were summed.
    """
    cov = F.covar_pop(_c(x), _c(y))
    sides = F.when(_c(y).isNotNull(), _c(x)), F.when(_c(x).isNotNull(), _c(y))
    spread = [F.when(F.stddev_pop(v) > noise * F.abs(F.avg(v)), F.stddev_pop(v)) for v in sides]
    return F.when(cov.isNotNull(), F.coalesce(F.try_divide(cov, spread[0] * spread[1]), F.lit(float("nan"))))


def mapped(x: str | Column, names: dict[str, str]) -> Column:
    """names[x], or x where it has no entry."""
    pairs = F.create_map(*(F.lit(v) for kv in names.items() for v in kv))
    return F.coalesce(F.element_at(pairs, _c(x)), _c(x))


def sentinel_double(x: str | Column) -> Column:
    """A number, null for a lone point; any other text raises."""
    value = _c(x).try_cast("double")
    return F.when(value.isNotNull(), value).when(F.trim(_c(x)) == ".", F.lit(None).cast("double")).otherwise(F.raise_error(F.concat(F.lit("not a number: "), _c(x))).cast("double"))


def locale_number(x: str | Column, digits: int, locale: str) -> Column:
    """Fixed digits with the decimal mark of the locale; null is empty."""
    text = F.when(_c(x).isNull(), "").otherwise(F.format_string(f"%.{digits}f", _c(x)))
    return F.translate(text, ".", ",") if locale == "de" else text


def rule_regime(inflation: str, credit: str, growth: str) -> Column:
    """Inflation first, then recession, else normal; NaN compares as false."""
    real = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    return F.when(real(inflation) & (F.col(inflation) > 1), "inflation").when((real(credit) & (F.col(credit) > 1)) | (real(growth) & (F.col(growth) < -1.5)), "recession").otherwise("normal")


def bin_regime(inflation: str, credit: str, growth: str) -> Column:
    """Four labels in order of precedence; a missing score is zero."""
    i, c, g = (F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0)) for x in (inflation, credit, growth))
    return F.when(c > 1, "credit_stress").when((i > 0.5) & (g < 0), "stagflation_risk").when((i < 0) & (c < 0), "goldilocks").otherwise("neutral")


def previous_business_day(d: Column) -> Column:
    back = F.when(F.weekday(d) == 0, 3).when(F.weekday(d) == 6, 2).otherwise(1)
    return F.date_sub(d, back)


def axis_value(text: str | Column, axis: str) -> Column:
    """A number named axis in a reply: from its JSON object, else by pattern."""
    inside = F.regexp_extract(_c(text), r"(?s)\{.*\}", 0)
    by_json = F.get_json_object(inside, f"$.{axis}").try_cast("double")
    by_pattern = F.regexp_extract(_c(text), rf"(?i)[\"']?\b{axis}\b[\"']?\s*(?::|=|->)\s*([+-]?[0-9]*\.?[0-9]+(?:e[+-]?[0-9]+)?)", 1).try_cast("double")
    return F.coalesce(by_json, by_pattern)


def within(published: str | Column, again: str | Column, tolerance: float) -> Column:
    """Relative tolerance; absolute where the published value is zero; nulls equal."""
    p, a = _c(published), _c(again)
    return F.when(p.isNull() | a.isNull(), p.eqNullSafe(a)).when(p == 0, F.abs(a) <= tolerance).otherwise(F.abs(a - p) / F.abs(p) <= tolerance)


def wilson(k: str | Column, n: str | Column, z: float) -> tuple[Column, Column]:
    """Score interval of a share; null for no trials."""
    p, m = F.try_divide(_c(k), _c(n)), F.nullif(_c(n), F.lit(0))
    mid, half = p + z * z / (2 * m), z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m))
    return (mid - half) / (1 + z * z / m), (mid + half) / (1 + z * z / m)


def conviction(loadings: str | Column) -> Column:
    """Length of a map's values over the square root of five, at most one."""
    return F.least(F.lit(1.0), F.sqrt(F.aggregate(F.map_values(_c(loadings)), F.lit(0.0), lambda a, v: a + v * v)) / F.sqrt(F.lit(5.0)))


def _ranged(df: DataFrame, *keys: str) -> DataFrame:
    """df in ranges of its keys, with the number of its range in _p, written once: every reader sees the same ranges, however Spark prunes, coalesces or recomputes its branch."""
    spark, folder = df.sparkSession, new_folder(df.sparkSession, "ranged")
    parted = df.repartitionByRange(*keys).withColumn("_p", F.spark_partition_id())
    parted.write.parquet(folder)
    return spark.read.schema(parted.schema).parquet(folder)


def numbered(df: DataFrame, keys: list[str]) -> DataFrame:
    """df with pos, the rank of its unique keys from 0: range partitions are written and counted, then numbered inside each.

    Only the counts of the partitions meet in one place.
    """
    parted = _ranged(df, *keys)
    count = parted.groupBy("_p").agg(F.count("*").alias("_n"))
    base = count.withColumn("_base", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = parted.withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy(*keys)) - 1)
    return inside.join(F.broadcast(base), "_p").withColumn("pos", F.col("_base") + F.col("_i")).drop("_p", "_i", "_base")  # a row a shuffle partition


def positions(df: DataFrame, key: str) -> DataFrame:
    """df with pos, the rank of its unique key from 0."""
    return numbered(df, [key])


def running_total(df: DataFrame, key: str, value: str, out: str, by: str | None = None) -> DataFrame:
    """df with out, the sum of value over all smaller keys (of the same ``by``, null being one of its values): written range partitions are summed first, so no task holds all rows."""
    own = [by] if by else []
    parted = _ranged(df, *own, key)
    total = parted.groupBy("_p", *own).agg(F.sum(value).alias("_s"))
    earlier = Window.partitionBy(*own).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    base = total.select(F.col("_p").alias("_q"), *(F.col(c).alias("_by") for c in own), F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_base"))
    inside = F.coalesce(F.sum(value).over(Window.partitionBy("_p", *own).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    same = F.col("_p") == F.col("_q")
    for c in own:
        same = same & F.col(c).eqNullSafe(F.col("_by"))
    return parted.withColumn("_i", inside).join(base, same).withColumn(out, F.col("_base") + F.col("_i")).drop("_p", "_i", "_base", "_q", "_by")


def certification(auc: str, lo: str, hi: str, p: str, control_p: str, parsed: str, alpha: float = 0.05, unlike: float = 0.1, least: float = 0.9) -> Column:
    """Labels in order of precedence; an unknown control or parse rate never certifies."""
    c = F.col
    fired = F.coalesce(c(control_p) < alpha, F.lit(False))
    clean = (c(p) > unlike) & (c(lo) <= 0.5) & (c(hi) >= 0.5) & F.coalesce(c(parsed) >= least, F.lit(False))
    return F.when((c(p) < alpha) & (c(auc) > 0.5), "recalls").when(~fired, "detector_unvalidated").when(clean, "certified_no_recall").otherwise("inconclusive")


def _known(*names: str) -> Column:
    ok = F.lit(True)
    for n in names:
        ok = ok & F.col(n).isNotNull() & ~F.isnan(n) & (F.abs(n) < float("inf"))
    return ok


def gates(t: str, appraisal: str, stable: str, premium: str, calmar: str, base_calmar: str, drawdown: str, base_drawdown: str) -> tuple[dict[str, Column], Column]:
    """The four gates, and the name of the first that fails; an unknown input fails its gate."""
    passed = {
        "skill": _known(t, appraisal) & (F.col(t) > 2.0),
        "stability": F.coalesce(F.col(stable), F.lit(False)),
        "recall": _known(premium) & (F.abs(premium) <= 0.05),
        "risk_shape": _known(calmar, base_calmar, drawdown, base_drawdown) & (F.col(calmar) >= F.col(base_calmar)) & (F.abs(drawdown) <= F.abs(base_drawdown)),
    }
    passed = {k: F.coalesce(v, F.lit(False)) for k, v in passed.items()}
    return passed, F.coalesce(*(F.when(~v, k) for k, v in passed.items()))


def overlaps(lo: str, hi: str, other_lo: str, other_hi: str) -> Column:
    """Whether two closed intervals meet."""
    return (F.col(lo) <= F.col(other_hi)) & (F.col(other_lo) <= F.col(hi))


def cash_pin(scale: str | Column, base: float = 0.25) -> Column:
    """The cash weight that a scale of the rest leaves."""
    return 1 - _c(scale) * (1 - base)


def to_usd(price: str | Column, unit: str, rate: float) -> Column:
    """A price in pence or in a currency, in dollars."""
    return _c(price) * (0.01 if unit == "GBp" else 1.0) * rate


def stability_verdict(ratio: str, p: str, alpha: float = 0.05) -> tuple[Column, Column, Column]:
    """(stable, stably below, sentence) of a ratio with its tail probability."""
    r, q = F.col(ratio), F.col(p)
    stable, below = (q < alpha) & (r > 0), (q < alpha) & (r < 0)
    said = lambda word: F.format_string(f"SSR=%.2f {word} p=%.3f", r, q)
    return stable, below, F.when(r.isNull() | q.isNull(), "insufficient").when(stable, said("stable")).when(below, said("below")).otherwise(said("open"))


def views(reply: str | Column) -> Column:
    """Views (asset_long, expected, confidence) of a reply: a JSON array, perhaps between code fences; items without a name or a number are left out."""
    bare = F.regexp_replace(F.trim(_c(reply)), r"(?s)^`+\s*(?:json)?\s*|\s*`+$", "")
    items = F.from_json(F.when(bare.startswith("["), bare), "array<string>")
    field = lambda x, name: F.get_json_object(x, f"$.{name}")
    view = lambda x: F.struct(field(x, "asset_long").alias("asset_long"), field(x, "expected_excess_annualized").try_cast("double").alias("expected"), field(x, "confidence").try_cast("double").alias("confidence"))
    return F.filter(F.transform(items, view), lambda v: v["asset_long"].isNotNull() & v["expected"].isNotNull() & v["confidence"].isNotNull())


def finite_positive(x: str | Column) -> Column:
    """Whether a number is finite and above zero; null is not."""
    return F.coalesce((_c(x) > 0) & ~F.isnan(_c(x)) & (_c(x) < float("inf")), F.lit(False))


def sign_tail(k: str | Column, n: str | Column) -> Column:
    """Chance of k heads or more in n fair throws, summed over logarithms of binomial coefficients."""
    start = F.struct((-_c(n) * F.ln(F.lit(2.0))).alias("term"), F.lit(0.0).alias("total"))
    step = lambda a, j: F.struct(
        (a["term"] + F.when(j < _c(n), F.ln((_c(n) - j) / (j + 1.0))).otherwise(0.0)).alias("term"), (a["total"] + F.when(j >= _c(k), F.exp(a["term"])).otherwise(0.0)).alias("total")
    )
    return F.least(F.lit(1.0), F.aggregate(F.sequence(F.lit(0), _c(n).cast("int")), start, step, lambda a: a["total"]))
