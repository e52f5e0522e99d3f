"""Kernels against brute force and plain loops, and the queries that have no statement against their kernels."""

from __future__ import annotations

import itertools
import math
import time

import numpy as np
import pandas as pd
import pytest

from panelloom.operators import kernels as K
from panelloom.plans import decision_queries, kernel_queries, registry
from panelloom.sources import panels

RNG = np.random.default_rng(0)


def series(n, rho=0.6, seed=0):
    rng, x = np.random.default_rng(seed), np.zeros(n)
    for i in range(1, n):
        x[i] = rho * x[i - 1] + rng.normal()
    return x


def plain_lags(z):
    n, m = len(z), sum(z) / len(z)
    if n < 4:
        return 1
    g0 = sum((v - m) ** 2 for v in z) / n
    if g0 <= 0:
        return 1
    g1 = sum((z[i] - m) * (z[i - 1] - m) for i in range(1, n)) / (n - 1)
    rho = max(-0.97, min(0.97, g1 / g0))
    alpha = 4 * rho**2 / ((1 - rho) ** 2 * (1 + rho) ** 2)
    return max(1, min(math.floor(1.1447 * (alpha * n) ** (1 / 3)), n // 4))


@pytest.mark.parametrize("n,rho", [(3, 0.5), (40, 0.0), (200, 0.9), (500, -0.4), (900, 0.99)])
def test_bandwidth_and_long_run_variance(n, rho):
    z = series(n, rho)
    lags = K.plug_in_lags(z)
    assert lags == plain_lags(z.tolist())
    m = z.mean()
    total = sum((v - m) ** 2 for v in z) / n
    for k in range(1, min(lags, n - 1) + 1):
        total += 2 * (1 - k / (lags + 1)) * sum((z[i] - m) * (z[i - k] - m) for i in range(k, n)) / (n - k)
    assert math.isclose(K.hac_variance(z, lags), max(total, 0.0), rel_tol=1e-9)


def test_rolling_sharpe_like_pandas():
    r = series(400, 0.2, 5) * 0.01
    r[100:180] = 0.002
    w = pd.Series(r).rolling(50)
    want = (w.mean() / w.std() * np.sqrt(252)).to_numpy()[49:]
    got = K.rolling_sharpe(r, 50)
    flat = np.array([np.ptp(r[i : i + 50]) == 0 for i in range(351)])
    assert np.isnan(got[flat]).all() and np.allclose(got[~flat], want[~flat], rtol=1e-7)


def plain_block(x):
    n, m = len(x), sum(x) / len(x)
    z = [v - m for v in x]
    cov = lambda k: sum(z[i] * z[i - k] for i in range(k, n)) / (n - k)
    run = max(5, math.ceil(math.sqrt(math.log10(n))))
    most = min(n - 2, math.ceil(math.sqrt(n)) + run)
    rho = [cov(k) / cov(0) for k in range(1, most + 1)]
    limit = 2 * math.sqrt(math.log10(n) / n)
    lag = next((j for j in range(most - run + 1) if all(abs(r) < limit for r in rho[j : j + run])), most - run)
    wide = min(2 * lag, most)
    g, s = 0.0, cov(0)
    for k in range(1, wide + 1):
        w = 1.0 if k / wide <= 0.5 else 2 * (1 - k / wide)
        g += 2 * w * k * cov(k)
        s += 2 * w * cov(k)
    if s <= 0 or g == 0:
        return 1
    b = (2 * g * g / (4 / 3 * s * s)) ** (1 / 3) * n ** (1 / 3)
    return min(max(round(b), 1), math.ceil(min(3 * math.sqrt(n), n / 3)))


@pytest.mark.parametrize("seed", range(8))
def test_block_length(seed):
    x = series(150 + 90 * seed, 0.1 * seed, seed)
    assert K.block_length(x) == plain_block(x.tolist())
    assert K.block_length(x[:20]) == 5 and K.block_length(np.ones(50)) == 1


def test_resamples_repeat_by_seed_and_centre_on_the_null():
    """Under an iid null about one in twenty series is rejected at five per cent."""
    rejected, runs = 0, 60
    for s in range(runs):
        r = np.random.default_rng(s).normal(0, 0.01, 400)
        got = K.resampled_stability(r, np.arange(99), K.block_length(r), 60)
        rejected += ((got <= 0) | ~np.isfinite(got)).sum() + 1 <= 0.05 * 100
    assert rejected <= 9
    assert (K.resampled_stability(r, np.array([3, 4]), 5, 60) == K.resampled_stability(r, np.array([3, 4]), 5, 60)).all()


def covariance(n, seed):
    a = np.random.default_rng(seed).normal(size=(n, n + 3))
    return a @ a.T / n


def supports(n):
    for k in range(1, n + 1):
        yield from (list(c) for c in itertools.combinations(range(n), k))


@pytest.mark.parametrize("seed", range(6))
def test_long_only_against_all_supports(seed):
    n, cov, mu = 5, covariance(5, seed), np.random.default_rng(seed + 50).normal(size=5)
    best = -np.inf
    for i in supports(n):
        k = len(i)
        kkt = np.block([[2.0 * cov[np.ix_(i, i)], np.ones((k, 1))], [np.ones((1, k)), np.zeros((1, 1))]])
        w = np.zeros(n)
        w[i] = np.linalg.solve(kkt, np.append(mu[i], 1.0))[:k]
        if (w >= -1e-12).all():
            best = max(best, mu @ w - w @ cov @ w)
    w = K.long_only(mu, cov, 2.0)
    assert (w >= 0).all() and abs(w.sum() - 1) < 1e-9 and abs(mu @ w - w @ cov @ w - best) < 1e-8


@pytest.mark.parametrize("seed", range(6))
def test_frontier_against_all_supports(seed):
    n, cov, mu = 4, covariance(4, seed), np.random.default_rng(seed + 90).normal(size=4)
    for target in np.linspace(mu.min(), mu.max(), 5):
        best = np.inf
        for i in supports(n):
            a = np.vstack([np.ones(len(i)), mu[i]])
            kkt = np.block([[cov[np.ix_(i, i)], a.T], [a, np.zeros((2, 2))]])
            v = np.linalg.lstsq(kkt, np.r_[np.zeros(len(i)), 1, target], rcond=None)[0][: len(i)]
            if (v >= -1e-10).all() and abs(v.sum() - 1) < 1e-8 and abs(mu[i] @ v - target) < 1e-8:
                best = min(best, v @ cov[np.ix_(i, i)] @ v)
        w, ok = K.frontier_point(mu, cov, float(target))
        assert ok and abs(w @ cov @ w - best) < 1e-7
    assert not K.frontier_point(mu, cov, float(mu.max()) + 1)[1]


def test_many_assets_take_little_time():
    n = 60
    cov, mu = covariance(n, 1), RNG.normal(size=n)
    began = time.process_time()
    K.long_only(mu, cov, 3.0)
    assert K.frontier_point(mu, cov, float(mu.mean()))[1]
    K.minimax(RNG.normal(size=(30, 20)))
    assert time.process_time() - began < 10


@pytest.mark.parametrize("seed", range(10))
def test_minimax_meets_the_other_player(seed):
    a = np.random.default_rng(seed).normal(size=(8, 3))
    p, v = K.minimax(a)
    q, u = K.minimax(-a.T)
    assert abs(v + u) < 1e-9 and (p @ a >= v - 1e-9).all() and (a @ q <= v + 1e-9).all() and abs(p.sum() - 1) < 1e-9
    assert K.minimax(np.array([[1.0, 2.0], [0.0, 5.0]]))[1] >= 1


def test_cheapest_path_against_all_paths():
    for seed in range(20):
        e = np.random.default_rng(seed).random((7, 3))
        cost = lambda p: sum(e[i, s] for i, s in enumerate(p)) + 0.4 * sum(x != y for x, y in zip(p, p[1:]))  # noqa: E731, B023
        best = min(itertools.product(range(3), repeat=7), key=cost)
        assert abs(cost(K.cheapest_path(e, 0.4).tolist()) - cost(best)) < 1e-12


def test_jump_model_finds_two_regimes_and_the_feature_that_tells_them_apart():
    rng = np.random.default_rng(4)
    state = np.repeat([0, 1, 0, 1], 150)
    x = np.column_stack([state * 3.0 + rng.normal(size=600), rng.normal(size=600), rng.normal(size=600)])
    path, centre, weight = K.jump_model(x, 20.0, budget=1.2)
    names = K.state_names(path, centre)
    assert (names == np.where(state == 1, "bull", "bear")).mean() > 0.97
    assert weight[0] > 0.95 and abs(np.linalg.norm(weight) - 1) < 1e-6 and weight.sum() <= 1.2 + 1e-6
    assert (K.state_names(path, centre, gap=100.0) == "neutral").all()
    assert (K.jump_model(np.ones((10, 2)), 1.0)[0] >= 0).all()


def test_signed_ranks_against_all_signs():
    d = np.array([0.5, -1.0, 2.0, 2.0, -0.2, 3.0])
    a = np.abs(d)
    rank = pd.Series(a).rank().to_numpy()
    w = rank[d > 0].sum()
    tail = np.mean([sum(r for r, s in zip(rank, signs) if s) >= w for signs in itertools.product([0, 1], repeat=len(d))])
    assert K.signed_rank_tail(d) == (w, tail)


def test_expanding_rank_like_pandas():
    x = np.round(RNG.normal(size=80), 1)
    assert np.allclose(K.expanding_rank(x), pd.Series(x).expanding().rank())


def test_pinned_and_momentum_weights():
    r = RNG.normal(0.001, 0.01, (300, 4))
    w = K.pinned_parity(r, np.array([np.nan, 0.25, np.nan, np.nan]))
    assert w[1] == 0.25 and abs(w.sum() - 1) < 1e-9
    with pytest.raises(ValueError):
        K.pinned_parity(r, np.array([1.0, np.nan, np.nan, np.nan]))
    r[:, 0], r[:, 2] = -0.001, -0.002
    m = K.momentum_parity(r, 252, 3)
    assert m[0] == m[2] == 0 and abs(m.sum() - 1) < 1e-9
    assert K.momentum_parity(-np.abs(r), 252, 3).tolist() == [0, 0, 0, 1]
    only = -np.abs(r)
    only[:, 1] *= -1
    assert K.momentum_parity(only, 252, 3).tolist() == [0, 1, 0, 0]


def test_separation_tells_classes_apart():
    y = np.repeat([1, 0], 40)
    x = RNG.normal(size=(80, 2))
    noise = K.separation(x, y, [("fit", 0)] + [("perm", s) for s in range(60)])
    p = (1 + (np.abs(noise[1:] - 0.5) >= abs(noise[0] - 0.5)).sum()) / 61
    x[:, 0] += 3 * y
    clear = K.separation(x, y, [("fit", 0), ("boot", 1), ("perm", 2)])
    assert p > 0.02 and clear[0] > 0.95 and clear[1] > 0.9 and clear[2] < 0.8
    score = np.array([0.1, 0.4, 0.4, 0.9])
    assert K.rank_auc(score, np.array([0, 1, 0, 1])) == np.mean([1, 0.5, 1, 1])


# ---------------------------------------------------------------- queries without a statement


@pytest.fixture(scope="module")
def wide(spark, sf_dir):
    r = panels.returns(spark, sf_dir.replace("0.001", "0.01")).where("r is not null").toPandas()
    return r.pivot(index="date", columns="symbol", values="r").sort_index().dropna()


@pytest.fixture(scope="module")
def larger(sf_dir):
    return sf_dir.replace("0.001", "0.01")


def run(spark, name, sf_dir):
    return registry.QUERIES[name](spark, sf_dir).toPandas()


@pytest.mark.parametrize("name,size,weigh", [
    ("q_k5_risk_parity", 252, lambda x, names: K.risk_parity(x)),
    ("q_k6_pinned", 252, lambda x, names: K.pinned_parity(x, np.array([0.25 if n == "NO" else np.nan for n in names]))),
    ("q_k9_momentum", 316, lambda x, names: K.momentum_parity(x, 252, names.index("NO"))),
])
def test_walk_forward_weights(spark, larger, wide, name, size, weigh):
    got = run(spark, name, larger)
    ends = [i for i in range(len(wide)) if i >= size - 1 and i % 60 == 0]
    want = {(wide.index[i], s): w for i in ends for s, w in zip(wide.columns, weigh(wide.to_numpy()[i - size + 1 : i], list(wide.columns)))}
    assert {(r.date, r.symbol) for r in got.itertuples()} == set(want)
    assert all(abs(want[r.date, r.symbol] - r.weight) < 1e-9 for r in got.itertuples())


def test_annual_weights(spark, larger, wide):
    got = run(spark, "q_k11_annual", larger)
    years = [d.year for d in wide.index]
    ends = [i for i in range(len(wide)) if (i == 0 or years[i] != years[i - 1]) and i >= 189]
    want = {(wide.index[i], s): w for i in ends for s, w in zip(wide.columns, K.risk_parity(wide.to_numpy()[max(0, i - 756) : i]))}
    assert {(r.date, r.symbol) for r in got.itertuples()} == set(want)
    assert all(abs(want[r.date, r.symbol] - r.weight) < 1e-9 for r in got.itertuples())


def test_absorption_and_turbulence(spark, larger, wide):
    x = wide.to_numpy()
    got = run(spark, "q_w30_turbulence", larger)
    want = {wide.index[i]: K.turbulence(x[i - 252 : i], x[i]) for i in range(252, len(x))}
    assert len(got) == len(want) and all(math.isclose(want[r.date], r.turbulence, rel_tol=1e-9) for r in got.itertuples())
    got = run(spark, "q_w29_absorption", larger)
    want = {wide.index[i]: K.absorption(x[j - 251 : j + 1]) for i in range(251, len(x)) for j in [i - (i - 251) % 5]}
    assert len(got) == len(want) and all(math.isclose(want[r.date], r.absorption, rel_tol=1e-9) for r in got.itertuples())


def test_bootstrap_of_one_symbol(spark, sf_dir):
    got = run(spark, "q_k2_bootstrap", sf_dir).set_index("symbol")
    r = panels.returns(spark, sf_dir).where("r is not null and symbol = 'NO'").orderBy("date").toPandas().r.to_numpy()
    draws = K.resampled_stability(r, np.arange(1000), K.block_length(r), 252)
    bad = ~np.isfinite(draws)
    assert got.n_boot.eq(1000).all()
    assert math.isclose(got.p["NO"], ((bad | (draws <= 0)).sum() + 1) / 1001) and math.isclose(got.p_lower["NO"], ((bad | (draws >= 0)).sum() + 1) / 1001)


def test_frontier_and_game(spark, larger):
    f = run(spark, "q_k27_frontier", larger)
    assert f.feasible.all() and len(f) == 360 and (f.groupby("k").weight.sum() - 1).abs().max() < 1e-7
    v = f.groupby("k").variance.first()
    assert v.idxmin() not in (0, 59) or v.is_monotonic_increasing or v.is_monotonic_decreasing
    g = run(spark, "q_k18_minimax", larger)
    assert abs(g.weight.sum() - 1) < 1e-9


def test_jump_states_and_labels(spark, sf_dir):
    s = run(spark, "q_k21_jump_states", sf_dir)
    assert set(s.state) <= {0, 1} and s.groupby("symbol").size().min() > 100
    lab = run(spark, "q_k25_labels", sf_dir)
    assert set(lab.label) <= {"bull", "bear", "neutral"} and (lab.label[lab.n_before < 504] == "neutral").all()


def test_paths_repeat_the_panel(spark, sf_dir):
    got = run(spark, "q_k17_paths", sf_dir)
    months = {tuple(x) for x in panels.macro(spark, sf_dir).select("d", "t", "q").toPandas().itertuples(index=False)}
    assert got.path.nunique() == 10_000 and len(got) == 60_000
    assert all(tuple(x) in months for x in got[["d", "t", "q"]].head(2000).itertuples(index=False))


def test_posterior_and_ranks(spark, larger):
    p = run(spark, "q_k7_posterior", larger)
    assert (p.groupby("date").weight.sum() - 1).abs().max() < 1e-8 and (p.weight >= -1e-12).all()
    s = run(spark, "q_a35_signed_rank", larger)
    assert s.p.between(0, 1).all()


def test_certification_is_the_same_in_chunks(spark):
    rng = np.random.default_rng(2)
    rows = pd.DataFrame({"g": ["a"] * 60, "x": rng.normal(size=60), "z": rng.normal(size=60), "y": np.repeat([1, 0], 30)})
    rows.loc[rows.y == 1, "x"] += 2
    df = spark.createDataFrame(rows)
    one = decision_queries.certify(df, ["g"], ["x", "z"], "y", 20, 40, 7).toPandas()
    two = decision_queries.certify(df, ["g"], ["x", "z"], "y", 20, 40, 61).toPandas()
    pd.testing.assert_frame_equal(one, two)
    assert one.auc[0] > 0.8 and one.perm_p[0] < 0.1 and one.ci_low[0] <= one.auc[0]


def test_long_run_kernel_queries_agree(spark, sf_dir):
    assert kernel_queries.long_run_sql("x").count("FROM x") == 1


def test_sliding_median_with_gaps_and_ties():
    rng = np.random.default_rng(8)
    x = rng.integers(0, 6, 300).astype(float)
    x[rng.random(300) < 0.2] = np.nan
    got = K.sliding_median(x, 20, 5)
    for i in range(300):
        known = x[max(0, i - 19) : i + 1]
        known = known[~np.isnan(known)]
        assert np.isnan(got[i]) if len(known) < 5 else got[i] == np.median(known)


def test_robust_scores_in_blocks(spark):
    """Blocks of any size give the scores of a whole line."""
    from datetime import date, timedelta

    from panelloom.operators import quality

    rng = np.random.default_rng(9)
    rows = [(s, date(2020, 1, 1) + timedelta(days=i), None if rng.random() < 0.1 else float(rng.integers(-4, 5))) for s in "ab" for i in range(120)]
    df = spark.createDataFrame(rows, "symbol string, date date, r double")
    for block in (1000, 16, 7):
        got = {(r.symbol, r.date): r.z for r in quality.with_robust_z(df, window=10, least=4, block=block).collect()}
        assert len(got) == len(rows)
        for s in "ab":
            x = np.array([np.nan if v is None else v for k, _, v in rows if k == s])
            for (_, d, _), z in zip([r for r in rows if r[0] == s], K.robust_scores(x, 10, 4)):
                assert (got[s, d] is None) == bool(np.isnan(z)) and (np.isnan(z) or abs(got[s, d] - z) < 1e-12)
