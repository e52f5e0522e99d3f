"""Every query with a statement gives the rows that DuckDB gives."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from panelloom.plans import registry

for _name in ("plans.series_queries", "plans.relational_queries", "plans.kernel_queries", "plans.report_queries", "plans.decision_queries", "plans.source_queries", "plans.replay_queries", "plans.search_queries", "plans.function_queries", "plans.contract_queries", "streaming.events", "streaming.stateful"):
    __import__(f"panelloom.{_name}")


def plain(v) -> str:
    if v is None or v != v:
        return "null"
    if isinstance(v, float):
        return "null" if math.isnan(v) else f"{v + 0.0:.9g}"
    return str(v)[:10] if type(v).__name__ in ("Timestamp", "date", "datetime") else str(v)


def rows(df) -> list[tuple]:
    df = df[sorted(df.columns)].astype(object).where(df.notna(), None)
    return sorted(tuple(map(plain, r)) for r in df.itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for f in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows(spark, sf_dir, duck, name):
    mine = registry.QUERIES[name](spark, sf_dir).toPandas()
    theirs = duck.execute(registry.ORACLES[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 6
    assert set(entry.oracle_sql()) <= set(entry.queries())
