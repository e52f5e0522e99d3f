"""Catalog browsing: schemas, tables, columns and previews as DataFrames."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def schemas(spark: SparkSession) -> DataFrame:
    """Schema names in order; system schemas are hidden."""
    names = sorted(d.name for d in spark.catalog.listDatabases() if not re.match(r"pg_|information_schema$", d.name))
    return spark.createDataFrame([(n,) for n in names], "schema string")


def tables(spark: SparkSession, schema: str | None = None) -> DataFrame:
    """Tables and views of one schema or the current one, by name."""
    found = spark.catalog.listTables(schema) if schema else spark.catalog.listTables()
    return spark.createDataFrame([(schema or (t.namespace or [""])[0], t.name) for t in found], "schema string, table string").orderBy("schema", "table")


def find_tables(spark: SparkSession, keywords: tuple[str, ...]) -> DataFrame:
    """Tables whose name contains one of the keywords, whatever the case."""
    pattern = "(?i)" + "|".join(map(re.escape, keywords))
    return tables(spark).where(F.col("table").rlike(pattern))


def columns(spark: SparkSession, table: str) -> DataFrame:
    """Name, type and nullability by position."""
    fields = spark.table(table).schema.fields
    return spark.createDataFrame([(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(fields, 1)], "position int, name string, type string, nullable boolean").orderBy("position")


def preview(spark: SparkSession, table: str, n: int = 5) -> DataFrame:
    return spark.table(table).limit(n)


def table_shapes(spark: SparkSession, sf_dir: str, names: tuple[str, ...]) -> DataFrame:
    """(table, position, column) of the named tables of a folder, from their files' footers."""
    rows = [(n, i, f.name) for n in names for i, f in enumerate(spark.read.parquet(f"{sf_dir}/{n}.parquet").schema.fields, 1)]
    return spark.createDataFrame(rows, "table string, position int, column string")
