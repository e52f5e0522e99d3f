"""Files with a contract: locale CSV mirrors that are read back, and tables checked against a declared shape."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import locale_number

SEPARATOR = {"us": ",", "de": ";"}


def locale_text(df: DataFrame, locale: str, digits: int = 8) -> DataFrame:
    """Every column as the text its mirror shows: fixed digits, ISO dates, empty for null."""
    def text(name: str, kind: str):
        if kind in ("double", "float"):
            return locale_number(name, digits, locale)
        if kind in ("date", "timestamp", "timestamp_ntz"):
            return F.coalesce(F.date_format(name, "yyyy-MM-dd"), F.lit(""))
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    return df.select(*(text(n, k).alias(n) for n, k in df.dtypes))


def write_locale_csv(df: DataFrame, path: str, locale: str, digits: int = 8) -> None:
    """A new folder of CSV parts; an existing one is an error."""
    locale_text(df, locale, digits).write.mode("errorifexists").option("header", True).option("sep", SEPARATOR[locale]).option("emptyValue", "").csv(path)


def read_locale_csv(spark: SparkSession, path: str, schema: T.StructType, locale: str) -> DataFrame:
    raw = spark.read.option("header", True).option("sep", SEPARATOR[locale]).csv(path)
    number = lambda c: F.translate(c, ",", ".") if locale == "de" else F.col(c)
    return raw.select(*((number(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)).cast(f.dataType).alias(f.name) for f in schema))


def mirror_faults(df: DataFrame, again: DataFrame, keys: list[str], tolerance: float = 5e-9) -> DataFrame:
    """Keys whose rows differ between a table and its mirror: rows missing on a side, null places, numbers beyond the tolerance, other values not equal."""
    values = [c for c in df.columns if c not in keys]
    a = df.select(*keys, F.struct(*values).alias("_a"), F.lit(True).alias("_in_a"))
    b = again.select(*keys, F.struct(*values).alias("_b"), F.lit(True).alias("_in_b"))
    bad = F.lit(False)
    for c, k in df.dtypes:
        if c in values:
            x, y = F.col(f"_a.{c}"), F.col(f"_b.{c}")
            off = (x.isNull() != y.isNull()) | F.coalesce(F.abs(x - y) > tolerance, F.lit(False)) if k in ("double", "float") else ~x.eqNullSafe(y)
            bad = bad | off
    lone = F.col("_in_a").isNull() | F.col("_in_b").isNull()
    return a.join(b, keys, "full").where(lone | bad).select(*keys)


@dataclass(frozen=True)
class Shape:
    """What a table must look like; optional columns may be absent but not of another type."""

    columns: dict[str, str]
    least_rows: int = 0
    optional: tuple[str, ...] = ()

    def faults(self, df: DataFrame) -> list[str]:
        have = dict(df.dtypes)
        out = [f"{c} is missing" for c in self.columns if c not in have and c not in self.optional]
        out += [f"{c} is {have[c]}, not {k}" for c, k in self.columns.items() if c in have and have[c] != k]
        if self.least_rows and not out and (n := df.count()) < self.least_rows:
            out.append(f"{n} rows, {self.least_rows} needed")
        return out
