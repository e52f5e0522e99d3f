"""Ranks and running totals from written ranges equal one global window, however Spark cuts the shuffle."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelloom.functions import columns as C

ROWS = 1_000_000


@pytest.fixture(scope="module")
def wide(spark, tmp_path_factory):
    """Unique shuffled keys, a narrow group, and a side column of 128 characters."""
    folder = str(tmp_path_factory.mktemp("wide") / "rows")
    key = (F.col("id") * 7919 % ROWS).alias("key")
    side = F.concat(F.sha2(F.col("id").cast("string"), 256), F.sha2((F.col("id") + 1).cast("string"), 256)).alias("side")
    by = F.when(F.col("id") % 11 == 0, None).otherwise(F.col("id") % 3).alias("g")
    spark.range(ROWS).select(key, by, (F.col("id") % 5).alias("v"), side).write.parquet(folder)
    return spark.read.parquet(folder)


@pytest.fixture(params=["2m", "64m"])
def cut(spark, request):
    """Advisory sizes, with exchanges not reused."""
    names = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": request.param, "spark.sql.exchange.reuse": "false", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.shuffle.partitions": "64"}
    was = {n: spark.conf.get(n, None) for n in names}
    for n, v in names.items():
        spark.conf.set(n, v)
    yield request.param
    for n, v in was.items():
        spark.conf.unset(n) if v is None else spark.conf.set(n, v)


def test_positions_keep_every_wide_row(wide, cut):
    got = C.positions(wide, "key")
    n, right, sides = got.select(F.count("*"), F.count_if(F.col("pos") == F.col("key")), F.count("side")).first()
    assert (n, right, sides) == (ROWS, ROWS, ROWS)


def test_running_total_keeps_every_wide_row(wide, cut):
    got = C.running_total(wide, "key", "v", "below", by="g").select("key", "g", "below")
    w = Window.partitionBy("g").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    plain = wide.select("key", F.coalesce(F.sum("v").over(w), F.lit(0)).alias("expected"))
    n, right = got.join(plain, "key").select(F.count("*"), F.count_if(F.col("below") == F.col("expected"))).first()
    assert (n, right) == (ROWS, ROWS)


def test_empty_and_single_rows(spark):
    one = spark.createDataFrame([(3, 2)], "key long, v long")
    assert [tuple(r) for r in C.positions(one, "key").select("key", "pos").collect()] == [(3, 0)]
    assert C.positions(one.where("key < 0"), "key").collect() == []
    assert C.running_total(one.where("key < 0"), "key", "v", "below").collect() == []
    assert C.running_total(one, "key", "v", "below").first().below == 0
