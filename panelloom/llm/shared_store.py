"""Cutting lineage through tables in the cluster's shared folder."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from ..sources.scratch import new_folder

#: While a table is written: a job's shuffle files go when the job is done, as a written table never needs them again; rows travel to Python in small batches.
_WHILE = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}
_lock, _users = threading.Lock(), [0]
_was: dict[str, str | None] = {}


#: Folders of the steps that are running, the innermost last.
_steps: list[str] = []


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def step(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside go when the step is done, whatever wrote them; its result has to be written elsewhere by then."""
    folder = new_folder(spark, "step")
    _steps.append(folder)
    try:
        yield
    finally:
        _steps.remove(folder)
        _delete(spark, folder)


class _Tidy:
    """The settings hold while any thread is inside; the old ones come back with the last one out."""

    def __init__(self, spark: SparkSession):
        self.conf = spark.conf

    def __enter__(self) -> None:
        with _lock:
            if not _users[0]:
                for name, value in _WHILE.items():
                    _was[name] = self.conf.get(name, None)
                    self.conf.set(name, value)
            _users[0] += 1

    def __exit__(self, *_: object) -> None:
        with _lock:
            _users[0] -= 1
            if not _users[0]:
                for name, value in _was.items():
                    self.conf.unset(name) if value is None else self.conf.set(name, value)


class Scratch:
    """Tables of one run, written as Parquet under a folder of their own and read again; ``drop`` removes those that are done with."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{_steps[-1]}/{uuid.uuid4().hex}" if _steps else new_folder(spark, "scratch")

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        with _Tidy(self.spark):
            df.write.parquet(f"{self.folder}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.folder}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, f"{self.folder}/{name}")


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet in the shared folder and read again."""
    return Scratch(spark).keep(df, name)
