"""Block-wise regressions against the kernel that has a whole line at once."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelloom.operators import kernels as K
from panelloom.operators import regression


def panel(seed, sizes):
    rng, parts = np.random.default_rng(seed), []
    for line, n in sizes.items():
        x, z = rng.normal(0, 1, n), rng.normal(0, 2, n)
        e = np.convolve(rng.normal(0, 1, n + 2), [1, 0.6, 0.3], "valid")
        parts.append(pd.DataFrame({"line": line, "at": np.arange(n) * 3, "y": 0.1 + 0.5 * x - 0.2 * z + e, "x": x, "z": z}))
    return pd.concat(parts)


@pytest.mark.parametrize("block", [1 << 16, 50, 7])
def test_blocks_equal_one_call(spark, block):
    p = panel(3, {"a": 400, "b": 133, "c": 51, "d": 20})
    df = spark.createDataFrame(p).repartition(5)
    got = {r.line: r for r in regression.hac(df, "line", "at", "y", ["x", "z"], block=block).collect()}
    assert set(got) == set("abcd")
    for line, q in p.groupby("line"):
        beta, t = K.hac_ols(q.y.to_numpy(), q[["x", "z"]].to_numpy())
        u = q.y - beta[0] - q[["x", "z"]].to_numpy() @ beta[1:]
        r = got[line]
        assert r.n == len(q) and np.allclose(r.beta, beta, rtol=1e-8) and np.allclose(r.t, t, rtol=1e-8)
        assert math.isclose(r.r2, 1 - (u**2).sum() / ((q.y - q.y.mean()) ** 2).sum(), rel_tol=1e-8) and math.isclose(r.s, u.std(ddof=1), rel_tol=1e-8)


def test_nulls_short_lines_and_dependent_columns(spark):
    p = panel(5, {"a": 60})
    rows = [("a", int(r.at), float(r.y), float(r.x), float(r.z)) for r in p.itertuples()]
    rows += [("a", 1000, None, 1.0, 1.0), ("short", 1, 1.0, 1.0, 2.0), ("flat", 1, 1.0, 2.0, 4.0), ("flat", 2, 1.5, 3.0, 6.0), ("flat", 3, 0.0, 4.0, 8.0), ("flat", 4, 0.0, 5.0, 10.0), ("flat", 5, 2.0, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "line string, at long, y double, x double, z double")
    got = {r.line: r for r in regression.hac(df, "line", "at", "y", ["x", "z"]).collect()}
    assert np.allclose(got["a"].t, K.hac_ols(p.y.to_numpy(), p[["x", "z"]].to_numpy())[1])
    assert (got["short"].n, got["short"].beta, got["short"].t) == (1, None, None)
    assert (got["flat"].n, got["flat"].t) == (5, None)
    assert regression.hac(df.where("line = 'none'"), "line", "at", "y", ["x", "z"]).collect() == []


def test_a_line_dealt_over_tasks(spark):
    """Two million rows of one line: no task has it, and the figures are those of one call."""
    n = 2_000_000
    noise = lambda seed: (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) / (1 << 20) - 0.5)
    df = spark.range(n, numPartitions=8).select(F.lit("one").alias("line"), F.col("id").alias("at"), noise(1).alias("x"), (0.3 * noise(1) + noise(2) + 0.4 * F.pmod(F.col("id"), F.lit(17)) / 17).alias("y"))
    got = regression.hac(df, "line", "at", "y", ["x"]).first()
    p = df.orderBy("at").toPandas()
    beta, t = K.hac_ols(p.y.to_numpy(), p[["x"]].to_numpy())
    assert got.n == n and np.allclose(got.beta, beta, rtol=1e-7) and np.allclose(got.t, t, rtol=1e-6)


def test_both_ways_agree(spark):
    df = spark.createDataFrame(panel(9, {"a": 300, "b": 3, "c": 90}))
    one, blocks = (regression.fitted(df, "line", "at", "y", ["x", "z"], short=s).toPandas().set_index("line") for s in (1000, 10))
    assert list(one.columns) == list(blocks.columns)
    for line in "abc":
        for c in ("beta", "t", "r2", "s"):
            x, y = one.loc[line, c], blocks.loc[line, c]
            assert (x is None or x != x) == (y is None or y != y) if not isinstance(x, (list, np.ndarray)) else np.allclose(x, y)
