from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelloom.functions import columns as C
from panelloom.operators import kernels as K
from panelloom.operators import series as S


def panel(spark, values, symbol="a"):
    day = dt.date(2020, 1, 1)
    return spark.createDataFrame([(symbol, day + dt.timedelta(i), v) for i, v in enumerate(values)], "symbol string, date date, v double")


def column(df, name="x"):
    return [r[name] for r in df.orderBy("date").collect()]


def test_strict_and_padded_returns(spark):
    df = panel(spark, [1.0, None, 2.0])
    w = S.ordered(["symbol"], "date")
    assert column(df.withColumn("x", S.simple_return("v", w))) == [None, None, None]
    assert column(df.withColumn("x", S.simple_return("v", w, fill="pad"))) == [None, 0.0, 1.0]


def test_full_windows_only(spark):
    df = panel(spark, [1.0, 2.0, 3.0, 4.0])
    got = column(df.withColumn("x", S.rolling_mean("v", S.trailing(["symbol"], "date", 3), 3)))
    assert got == [None, None, 2.0, 3.0]


def test_flat_window_has_no_sharpe(spark):
    got = column(panel(spark, [0.0, 0.0, 0.0]).withColumn("x", S.rolling_sharpe("v", S.trailing(["symbol"], "date", 3), 3)))
    assert got == [None, None, None]


def test_ewm_matches_pandas(spark):
    v = [0.5, None, 1.5, -2.0, 0.25]
    df = panel(spark, v).withColumn("pos", F.row_number().over(S.ordered(["symbol"], "date")))
    got = column(df.withColumn("x", S.ewm_mean("v", "pos", 2, S.upto(["symbol"], "date"))))
    assert np.allclose(got, pd.Series(v, dtype=float).ewm(halflife=2).mean())


def test_corrected_moments_match_pandas(spark):
    v = [0.1, 0.4, -0.3, 2.0, 0.0, 0.7]
    r = panel(spark, v).agg(S.corrected_skew("v").alias("s"), S.corrected_kurtosis("v").alias("k")).first()
    assert np.allclose([r.s, r.k], [pd.Series(v).skew(), pd.Series(v).kurt()])


@pytest.mark.parametrize("strict", [True, False])
def test_as_of_ignores_the_future(spark, strict):
    left, right = panel(spark, [1.0] * 4).drop("v"), panel(spark, [10.0, None, 30.0, 40.0])
    got = column(S.as_of(left, right, ["symbol"], "date", "v", strict, "x"))
    assert got == ([None, 10.0, 10.0, 30.0] if strict else [10.0, 10.0, 30.0, 40.0])
    more = right.unionAll(panel(spark, [None, None, None, None, 99.0]))
    assert column(S.as_of(left, more, ["symbol"], "date", "v", strict, "x")) == got


def test_scalar_edges(spark):
    df = spark.createDataFrame([(None, "{'k': 1}"), (float("nan"), 'x {"k": 2.5} y'), (0.4, "K -> -3e1"), (9.0, "none")], "v double, t string")
    assert [r[0] for r in df.select(C.clip("v", 0, 1)).collect()][0] is None
    assert [r[0] for r in df.select(C.finite_or_zero("v")).collect()] == [0.0, 0.0, 0.4, 9.0]
    assert [r[0] for r in df.select(C.axis_value("t", "k")).collect()] == [1.0, 2.5, -30.0, None]
    assert [r[0] for r in df.select(C.correlation_scale("v")).collect()][:2] == [1.0, 1.0]
    with pytest.raises(Exception, match="not a number"):
        spark.createDataFrame([("n/a",)], "s string").select(C.sentinel_double("s")).collect()


def test_positions_count_every_row(spark):
    got = C.positions(spark.range(1000).repartition(7), "id").orderBy("id").collect()
    assert [r.pos for r in got] == list(range(1000))


def test_weights_are_weights():
    r = np.random.default_rng(1).normal(0, 0.01, (300, 5))
    r[:, 3] = 0.5 * r[:, 0] + 0.5 * r[:, 3]
    for w in (K.risk_parity(r), K.posterior_weights(r, np.full(5, 0.2), np.eye(5)[:1], np.array([0.001]))):
        assert abs(w.sum() - 1) < 1e-9 and (w >= -1e-12).all()


def test_minimax_of_matching_pennies():
    mix, value = K.minimax(np.array([[1.0, -1.0], [-1.0, 1.0]]))
    assert np.allclose(mix, 0.5) and abs(value) < 1e-12


def test_frontier_is_no_worse_than_a_grid():
    rng = np.random.default_rng(3)
    cov, mu = np.cov(rng.normal(size=(50, 3)).T), np.array([0.1, 0.2, 0.3])
    w, ok = K.frontier_point(mu, cov, 0.2)
    grid = [(a, 1 - 2 * a, a) for a in np.linspace(0, 0.5, 501)]
    assert ok and w @ cov @ w <= min(np.array(g) @ cov @ np.array(g) for g in grid) + 1e-9
    assert not K.frontier_point(mu, cov, 0.5)[1]


def test_jump_path_is_cheapest():
    rng = np.random.default_rng(4)
    e = rng.random((7, 2))
    import itertools

    cost = lambda p: sum(e[i, s] for i, s in enumerate(p)) + 0.3 * sum(a != b for a, b in zip(p, p[1:]))
    best = min(cost(p) for p in itertools.product((0, 1), repeat=7))
    assert abs(cost(K.cheapest_path(e, 0.3)) - best) < 1e-12


def test_absorption_rises_with_a_common_factor():
    rng = np.random.default_rng(5)
    alone = rng.normal(0, 0.01, (120, 20))
    joint = rng.normal(0, 0.01, (120, 1)) + rng.normal(0, 0.0005, (120, 20))
    assert K.absorption(joint) > K.absorption(alone) + 0.2


def test_turbulence_sees_a_shock():
    rng = np.random.default_rng(6)
    past = rng.normal(0, 0.01, (100, 5))
    assert K.turbulence(past, np.full(5, 0.1)) > 5 * np.median([K.turbulence(past, x) for x in past])


def test_signed_rank_tail_is_exact():
    w, p = K.signed_rank_tail(np.array([1.0, 2.0, 3.0]))
    assert (w, p) == (6.0, 0.125)


def test_block_length_bounds():
    assert K.block_length(np.arange(20.0)) == 5
    assert 1 <= K.block_length(np.random.default_rng(0).normal(size=500)) <= 67


def test_bootstrap_has_a_thousand_replicates_and_both_tails(spark, sf_dir):
    from panelloom.plans import kernel_queries

    rows = kernel_queries.bootstrap(spark, sf_dir).collect()
    assert rows and all(r.n_boot == 1000 for r in rows)
    # a failed replicate counts in both tails, a zero too; the others in one
    assert all(1 + 1 / 1001 <= r.p + r.p_lower + 1e-9 and min(r.p, r.p_lower) >= 1 / 1001 for r in rows)
    assert all(abs(x * 1001 - round(x * 1001)) < 1e-6 for r in rows for x in (r.p, r.p_lower))


def test_turbulence_absorption_and_paths_are_whole(spark, sf_dir, monkeypatch):
    from panelloom.operators import kernels as K
    from panelloom.plans import kernel_queries as Q
    from panelloom.sources import panels as P

    import pandas as pd

    w = pd.DataFrame(np.random.default_rng(3).normal(0, 0.01, (290, 4)), index=pd.bdate_range("2020-01-01", periods=290).date, columns=list("abcd"))
    long = [(s, d, float(w.at[d, s])) for d in w.index for s in w.columns]
    monkeypatch.setattr(P, "returns", lambda spark, sf_dir: spark.createDataFrame(long, "symbol string, date date, r double"))
    x, dates = w.to_numpy(), list(w.index)
    got = {r.date: r.turbulence for r in Q.turbulence(spark, sf_dir).collect()}
    assert sorted(got) == dates[252:]
    assert all(abs(got[dates[i]] - K.turbulence(x[i - 252 : i], x[i])) < 1e-6 for i in range(252, len(x), 17))
    got = {r.date: r.absorption for r in Q.absorption(spark, sf_dir).collect()}
    assert sorted(got) == dates[251:]
    assert all(abs(got[dates[i]] - K.absorption(x[(e := i - (i - 251) % 5) - 251 : e + 1])) < 1e-9 for i in range(251, len(x), 7))
    assert Q.paths(spark, sf_dir).select("path").distinct().count() == 10_000


def test_correlation_of_constants_is_unknown(spark):
    third = (0.1 + 0.2 + 0.3) / 3, (0.3 + 0.2 + 0.1) / 3  # one mean, summed in two orders
    rows = [("a", 1.0, 2.0), ("a", 1.0, 3.0), ("b", 1.0, 2.0), ("c", 1.0, None), ("c", None, 2.0), ("d", third[0], third[0]), ("d", third[1], third[1]), ("e", 1.0, 2.0), ("e", 2.0, 5.0), ("e", 4.0, 3.0), ("e", 99.0, None)]
    df = spark.createDataFrame(rows, "k string, x double, y double").groupBy("k").agg(C.correlation("x", "y").alias("c"))
    got = {r.k: (r.c, r.scale) for r in df.withColumn("scale", C.correlation_scale(F.abs("c"))).collect()}
    assert third[0] != third[1] and got["c"] == (None, 1.0)
    assert all(np.isnan(got[k][0]) and got[k][1] == 1.0 for k in "abd")
    assert abs(got["e"][0] - np.corrcoef([1, 2, 4], [2, 5, 3])[0, 1]) < 1e-12


def test_a_panel_is_compared_with_itself_and_not_with_a_second_run(spark, sf_dir, monkeypatch):
    import random

    from panelloom.plans import relational_queries as Q
    from panelloom.sources import panels as P

    # as means over shuffled rows do, a close differs in its last digits from run to run
    noisy = F.udf(lambda: 1 + random.SystemRandom().random() * 1e-12, "double").asNondeterministic()
    days = [("a", dt.date(2020, 1, 1) + dt.timedelta(i)) for i in range(60)]
    monkeypatch.setattr(P, "px_line", lambda spark, sf_dir: spark.createDataFrame(days, "symbol string, date date").withColumn("close", noisy()))
    assert [(r.symbol, r.cells, r.changed) for r in Q.revision_diff(spark, sf_dir).collect()] == [("a", 60, 2)]
