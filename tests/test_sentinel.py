"""The sentinel source: round trips, ranges, faults, counts, filters and commits."""

from __future__ import annotations

from datetime import date
from pathlib import Path

import pytest

from panelloom.sources import sentinel

SCHEMA = "day date, name string, rate double, n bigint"
ROWS = [(date(2020, 1, 1 + i % 28), f"n{i % 5}", None if i % 7 == 0 else i / 8, None if i % 11 == 0 else i) for i in range(200)]


@pytest.fixture(autouse=True)
def known(spark):
    sentinel.register(spark)


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("locale", ["us", "de"])
@pytest.mark.parametrize("size", [1 << 20, 64, 7])
def test_round_trip_in_any_ranges(spark, tmp_path, locale, size):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    df.write.format("sentinel_csv").option("locale", locale).mode("append").save(f"{tmp_path}/t")
    files = list(Path(f"{tmp_path}/t").iterdir())
    assert len(files) == 3 and all(f.name.startswith("part-") for f in files)
    again = spark.read.format("sentinel_csv").schema(SCHEMA).option("locale", locale).option("rangeBytes", size).load(f"{tmp_path}/t")
    assert rows(again) == rows(df)
    late = again.where("day >= DATE '2020-01-20' AND rate IS NOT NULL AND name LIKE '%2'")
    assert rows(late) == rows(df.where("day >= DATE '2020-01-20' AND rate IS NOT NULL AND name LIKE '%2'"))


def test_counts_of_sentinels(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).coalesce(1).write.format("sentinel_csv").mode("append").save(f"{tmp_path}/t")
    got = {r.column: (r.rows, r.missing) for r in spark.read.format("sentinel_csv").option("report", "true").load(f"{tmp_path}/t").collect()}
    assert got == {"day": (200, 0), "name": (200, 0), "rate": (200, 29), "n": (200, 19)}


def test_faults_name_the_file_and_the_row(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("day,rate\n2020-01-01,1\n2020-01-02,.\n2020-01-03,n/a\n")
    read = lambda s: spark.read.format("sentinel_csv").schema(s).load(f"{tmp_path}/bad.csv")
    with pytest.raises(Exception, match=r"bad\.csv, row 4: 'n/a' is no double"):
        read("day date, rate double").collect()
    assert rows(read("day date").where("day < DATE '2020-01-03'")) == rows(spark.createDataFrame([(date(2020, 1, 1),), (date(2020, 1, 2),)], "day date"))
    (tmp_path / "ragged.csv").write_text("a,b\n1,2\n3\n")
    with pytest.raises(Exception, match=r"ragged\.csv, row 3: 1 fields, not 2"):
        spark.read.format("sentinel_csv").schema("a double").load(f"{tmp_path}/ragged.csv").collect()


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 1.0), ("c", 2.0)], "name string, rate double").repartition(2)
    with pytest.raises(Exception, match="holds the separator"):
        df.write.format("sentinel_csv").mode("append").save(f"{tmp_path}/t")
    assert list(Path(f"{tmp_path}/t").iterdir()) == []
    df.write.format("sentinel_csv").option("locale", "de").mode("append").save(f"{tmp_path}/t")
    df.write.format("sentinel_csv").option("locale", "de").mode("overwrite").save(f"{tmp_path}/t")
    assert spark.read.format("sentinel_csv").schema("name string, rate double").option("locale", "de").load(f"{tmp_path}/t").count() == 2


def test_empty_files(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "none.csv").write_text("rate\n")
    assert spark.read.format("sentinel_csv").schema("rate double").load(f"{tmp_path}/t").count() == 0
