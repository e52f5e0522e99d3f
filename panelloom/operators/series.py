"""Returns, drawdowns, rolling, expanding and weighted statistics on long panels.

Every transform takes the frame, its partition keys and its order column, and
adds columns; nothing is collected.  Frames count rows, never days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

YEAR = 252


def ordered(keys: list[str], order: str):
    return Window.partitionBy(*keys).orderBy(order)


def upto(keys: list[str], order: str):
    """All rows to the current one."""
    return ordered(keys, order).rowsBetween(Window.unboundedPreceding, 0)


def before(keys: list[str], order: str):
    """All rows strictly before the current one."""
    return ordered(keys, order).rowsBetween(Window.unboundedPreceding, -1)


def trailing(keys: list[str], order: str, n: int):
    """The current row and the n - 1 before it."""
    return ordered(keys, order).rowsBetween(1 - n, 0)


def simple_return(value: str, w, periods: int = 1, fill: str = "strict") -> Column:
    """value / lagged value - 1; with fill='pad' gaps take the last observed value first."""
    now, then = F.col(value), F.lag(value, periods).over(w)
    if fill == "pad":
        cumulative = w.rowsBetween(Window.unboundedPreceding, 0)
        now = F.last(value, True).over(cumulative)
        then = F.last(value, True).over(w.rowsBetween(Window.unboundedPreceding, -periods))
    return F.try_divide(now, then) - 1


def log_return(value: str, w) -> Column:
    return F.ln(value) - F.lag(F.ln(value)).over(w)


def drawdown(value: str, w) -> Column:
    """value over its running maximum, minus one; w is a cumulative frame."""
    return F.col(value) / F.max(value).over(w) - 1


def full(column: Column, value: str, frame, n: int) -> Column:
    """column where the frame holds at least n observations."""
    return F.when(F.count(value).over(frame) >= n, column)


def rolling_mean(value: str, frame, n: int) -> Column:
    return full(F.avg(value).over(frame), value, frame, n)


def rolling_std(value: str, frame, n: int) -> Column:
    return full(F.stddev_samp(value).over(frame), value, frame, n)


def rolling_sharpe(value: str, frame, n: int) -> Column:
    """Annualised on 252 whatever the frame; null on a flat window."""
    std = F.stddev_samp(value).over(frame)
    return full(F.try_divide(F.avg(value).over(frame), F.nullif(std, F.lit(0.0))) * F.sqrt(F.lit(float(YEAR))), value, frame, n)


def zscore(value: str, frame, least: int) -> Column:
    std = F.stddev_samp(value).over(frame)
    return full(F.try_divide(F.col(value) - F.avg(value).over(frame), F.nullif(std, F.lit(0.0))), value, frame, least)


def percentile(value: str | Column, p: float) -> Column:
    """Exact, linear between neighbours."""
    return F.percentile(value, F.lit(p))


def ewm_mean(value: str, position: str, halflife: float, frame) -> Column:
    """Weights 0.5 ** (age / halflife), all of them normalised; nulls are skipped but age goes on."""
    weight = F.pow(F.lit(2.0), F.col(position) / F.lit(float(halflife)))
    seen = F.when(F.col(value).isNotNull(), weight)
    return F.sum(F.col(value) * weight).over(frame) / F.sum(seen).over(frame)


def average_rank_share(value: str, keys: list[str]) -> Column:
    """Average rank of ties, divided by the number of rows."""
    ties = F.count("*").over(Window.partitionBy(*keys, value))
    return (F.rank().over(Window.partitionBy(*keys).orderBy(value)) + (ties - 1) / 2) / F.count("*").over(Window.partitionBy(*keys))


def islands(flag: Column, w) -> Column:
    """A number that changes wherever flag is false: runs of true rows share it."""
    return F.sum(F.when(flag, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))


def corrected_skew(value: str) -> Column:
    n = F.count(value)
    return F.skewness(value) * F.sqrt(n * (n - 1)) / (n - 2)


def corrected_kurtosis(value: str) -> Column:
    """Excess kurtosis with the small-sample correction."""
    n = F.count(value)
    return (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(value) + 6)


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str, strict: bool, out: str) -> DataFrame:
    """left with the last non-null value of right at or before (strict: before) each row, without a range join.

    Both sides are stacked and one window carries the value forward, so the cost
    is one shuffle on the keys.
    """
    mark = 0 if strict else 1
    rows = left.withColumns({"_side": F.lit(mark), "_v": F.lit(None).cast(right.schema[value].dataType)})
    seen = right.select(*keys, at, F.lit(1 - mark).alias("_side"), F.col(value).alias("_v"))
    both = rows.withColumn("_own", F.lit(True)).unionByName(seen, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(out, F.last("_v", True).over(w)).where("_own").drop("_side", "_v", "_own")


def jump_features(px: DataFrame, keys: list[str], at: str, level: str, halflife: float = 21) -> DataFrame:
    """keys, at, a, b, c of every session with a return: weighted mean of log returns, their root mean square, and that of the falls alone.

    The session without a return counts as one without a fall.
    """
    own = Window.partitionBy(*keys)
    x = px.withColumns({"_r": log_return(level, ordered(keys, at)), "_pos": -F.row_number().over(own.orderBy(F.desc(at)))})
    x = x.withColumns({"_r2": F.col("_r") * F.col("_r"), "_d2": F.when(F.col("_r") < 0, F.col("_r") * F.col("_r")).otherwise(0.0)})
    mean = lambda c: ewm_mean(c, "_pos", halflife, upto(keys, at))
    return x.select(*keys, at, mean("_r").alias("a"), F.sqrt(mean("_r2")).alias("b"), F.sqrt(mean("_d2")).alias("c")).where("a is not null")
