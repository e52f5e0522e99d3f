from __future__ import annotations

import datetime as dt

import pytest

from panelloom.sources import catalog, sinks

ROWS = [("a", dt.date(2020, 1, 1), 1.5, 3), ("b", None, None, 4), ("c", dt.date(2021, 2, 3), -1234.56789012, None)]
SCHEMA = "k string, d date, x double, n int"


def test_catalog(spark):
    spark.createDataFrame(ROWS, SCHEMA).createOrReplaceTempView("etf_rows")
    assert "etf_rows" in {r.table for r in catalog.find_tables(spark, ("ETF", "fund")).collect()}
    assert [r.name for r in catalog.columns(spark, "etf_rows").collect()] == ["k", "d", "x", "n"]
    assert catalog.preview(spark, "etf_rows", 2).count() == 2
    assert "default" in {r.schema for r in catalog.schemas(spark).collect()}


@pytest.mark.parametrize("locale", ["us", "de"])
def test_mirror_round_trip(spark, tmp_path, locale):
    df = spark.createDataFrame(ROWS, SCHEMA)
    path = str(tmp_path / "mirror")
    sinks.write_locale_csv(df, path, locale)
    again = sinks.read_locale_csv(spark, path, df.schema, locale)
    assert sinks.mirror_faults(df, again, ["k"]).count() == 0
    changed = again.replace(1.5, 1.6)
    assert [r.k for r in sinks.mirror_faults(df, changed.where("k <> 'b'"), ["k"]).orderBy("k").collect()] == ["a", "b"]
    with pytest.raises(Exception, match="exist"):
        sinks.write_locale_csv(df, path, locale)


def test_shape(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert sinks.Shape({"k": "string", "x": "double", "z": "int"}, 3, ("z",)).faults(df) == []
    assert sinks.Shape({"k": "int", "y": "double"}).faults(df) == ["y is missing", "k is string, not int"]
    assert sinks.Shape({"k": "string"}, 9).faults(df) == ["3 rows, 9 needed"]
