"""Searches, replayed steps and tests of pairs against plain versions."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelloom.functions import columns as C
from panelloom.functions import prompts as T
from panelloom.operators import kernels as K
from panelloom.operators import search
from panelloom.plans import kernel_queries, registry, replay_queries, search_queries

assert replay_queries
LARGER = "/root/testdata/sf0.01"


def plain_loop(seed, levers, score, dry, most):
    """One change at a time."""
    best, value, reverts, out = seed, score(seed)["value"], 0, [("seed", "KEEP")]
    pending = search.changes(best, levers)
    while pending and reverts < dry and len(out) <= most:
        k, v = pending.pop(0)
        got = score(best | {k: v})
        if got["value"] is not None and (value is None or got["value"] > value) and got["passed"]:
            best, value, reverts = best | {k: v}, got["value"], 0
            pending = search.changes(best, levers)
            out.append((f"{k}={v}", "KEEP"))
        else:
            reverts += 1
            out.append((f"{k}={v}", "REVERT"))
    return best, out


@pytest.mark.parametrize("seed", range(12))
@pytest.mark.parametrize("dry,most", [(3, 1000), (50, 1000), (50, 7), (1, 1000)])
def test_search_like_one_change_at_a_time(seed, dry, most):
    rng = np.random.default_rng(seed)
    levers = {"a": (1, 2, 3), "b": (10, 20), "c": (None, -1)}
    table = {k: {"value": None if rng.random() < 0.1 else float(rng.normal()), "passed": bool(rng.random() < 0.7)} for k in itertools.product((0, 1, 2, 3), (0, 10, 20), (None, -1))}
    score = lambda s: table[s["a"], s["b"], s["c"]]
    start = {"a": 0, "b": 0, "c": None}
    best, ledger = search.keep_or_revert(start, levers, lambda many: [dict(score(s)) for s in many], dry, most)
    want, steps = plain_loop(start, levers, score, dry, most)
    assert best == want
    assert [("seed" if e["lever"] is None else f"{e['lever']}={e['to']}", e["decision"]) for e in ledger] == steps


def test_search_needs_a_bound():
    with pytest.raises(ValueError):
        search.keep_or_revert({"a": 0}, {"a": (1,)}, lambda s: [], 0)


@pytest.mark.parametrize("df", [1, 2, 3, 4, 7, 30, 101])
def test_student_against_its_density(df):
    x = np.linspace(-400, 1.3, 4_000_001)
    c = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi)
    below = np.trapezoid(c * (1 + x * x / df) ** (-(df + 1) / 2), x)
    assert math.isclose(1 - K.student_tail(1.3, df), below, abs_tol=2e-3 if df < 2 else 1e-5)
    assert math.isclose(K.student_tail(-1.3, df), 1 - K.student_tail(1.3, df), rel_tol=1e-12)
    assert math.isclose(K.student_tail(K.student_quantile(0.975, df), df), 0.025, rel_tol=1e-9)


def test_known_quantiles():
    assert math.isclose(K.student_quantile(0.975, 1), 12.7062047, rel_tol=1e-7)
    assert math.isclose(K.student_quantile(0.975, 10), 2.2281389, rel_tol=1e-7)
    assert math.isnan(K.student_tail(1.0, 0)) and math.isnan(K.student_quantile(0.9, 0))


def test_sign_tail(spark):
    cases = [(k, n) for n in (1, 2, 7, 30, 200) for k in (0, 1, n // 2, n)]
    got = spark.createDataFrame(cases, "k long, n long").select("k", "n", C.sign_tail("k", "n").alias("p")).collect()
    for r in got:
        want = sum(math.comb(r.n, j) for j in range(r.k, r.n + 1)) / 2**r.n
        assert math.isclose(r.p, want, rel_tol=1e-9)


def test_mean_correlation_like_pandas():
    x = np.random.default_rng(1).normal(size=(80, 3)) @ np.array([[1, 0.5, 0.2], [0, 1, 0.4], [0, 0, 1]])
    c = pd.DataFrame(x).ewm(halflife=10).corr().loc[79].to_numpy()
    assert math.isclose(K.mean_correlation(x, 10), c[np.triu_indices(3, 1)].mean(), rel_tol=1e-9)
    assert math.isnan(K.mean_correlation(x[:1], 10)) and math.isnan(K.mean_correlation(np.ones((9, 2)), 10))


@pytest.mark.parametrize("penalty", [0.0, 0.3, 1.0, 50.0])
def test_two_states_against_all_paths(penalty):
    for seed in range(20):
        e = np.random.default_rng(seed).integers(0, 4, (7, 2)).astype(float)
        cost = lambda p: sum(e[i, s] for i, s in enumerate(p)) + penalty * sum(a != b for a, b in itertools.pairwise(p))
        assert cost(K.cheapest_path(e, penalty)) == min(map(cost, itertools.product((0, 1), repeat=7)))


def test_numbers_as_text(spark):
    values = [0.0, 1.0, -0.5, 0.125, 4078.125, 123456.7, 999999.7, 1234567.0, 2.514e6, 0.00012345678, 0.000012345, -0.001, 100.0, 0.1]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", T.general_text("v").alias("g"), T.rounded_text("v", 2).alias("r")).collect()
    for r in got:
        assert r.g == f"{r.v:g}", r.v
        if abs(r.v) < 1e6:
            assert r.r == str(round(r.v, 2)), r.v


def test_replies_and_marks(spark):
    replies = [None, "", "{}", "[1]", 'x {"growth": 1e-1, "policy": "0.5", "inflation": false} y', '{"growth": {"a": 1}}', "{ {", '{"growth": 2} and {"growth": 3}']
    got = [r.m for r in spark.createDataFrame([(v,) for v in replies], "v string").select(T.object_loadings("v").alias("m")).collect()]
    assert got == [None, None, {}, None, {"growth": 0.1}, {}, None, None]
    marks = [("overlay", '{"walk_forward": false}', True), ("blend", '{"walk_forward": false}', False), ("blend", '{"requires_future": 1}', True), ("blend", None, False), (None, '{"requires_future": false}', False), ("axes", "not json", False)]
    got = spark.createDataFrame(marks, "kind string, value string, want boolean").select("want", T.look_ahead("kind", F.lit("p"), "value").isNotNull().alias("got")).collect()
    assert all(r.want == r.got for r in got)


@pytest.fixture(scope="module")
def wide(spark):
    r = search_queries._returns(spark, LARGER).toPandas()
    return r.pivot(index="date", columns="symbol", values="r").sort_index().dropna()


def test_walk_forward(spark, wide):
    got = registry.QUERIES["q_k10_walk_forward"](spark, LARGER).toPandas()
    quarter = np.array([(d.year, (d.month - 1) // 3) for d in wide.index])
    first = [i for i in range(len(wide)) if not i or tuple(quarter[i]) != tuple(quarter[i - 1])]
    names, x = list(wide.columns), wide.to_numpy()
    want = {}
    for i in first:
        for name, rule in search_queries.RULES.items() if i >= 60 else ():
            for s, w in zip(names, rule(x[max(0, i - 756) : i], names), strict=True):
                want[name, wide.index[i], s] = w
    assert len(got) == len(want)
    assert all(math.isclose(want[r.strategy, r.date, r.symbol], r.weight, rel_tol=1e-6, abs_tol=1e-7) for r in got.itertuples())


def test_a_rule_that_fails_gives_no_targets(spark, wide):
    def bad(x, names):
        raise ValueError("no")

    r = search_queries._returns(spark, LARGER)
    windows = kernel_queries.windows_of(r, 100, 400)
    got = search_queries.targets_of(windows, {"bad": bad, "none": lambda x, n: np.zeros(len(n)), "equal": search_queries.RULES["equal"]}, 60).toPandas()
    assert set(got.strategy) == {"equal"}
    assert search_queries.targets_of(windows, search_queries.RULES, 100).count() == 0


def test_game_cannot_be_beaten(spark):
    got = registry.QUERIES["q_k19_game"](spark, LARGER).toPandas()
    part = lambda k: got[got.kind == k].set_index("name").value
    assert math.isclose(part("mix").sum(), 1, abs_tol=1e-9) and math.isclose(part("asset").sum(), 1, abs_tol=1e-9) and math.isclose(part("regime").sum(), 1, abs_tol=1e-9)
    z = search_queries.regime_months(spark, LARGER).select("month", "regime")
    r = search_queries._returns(spark, LARGER).withColumn("month", F.trunc("date", "MM")).join(z, "month").toPandas()
    mean = r.groupby(["symbol", "regime"]).r.mean().unstack() * 252
    pay = {n: sum(w / sum(ws) * mean.loc[a] for a, w in zip(search_queries._ASSETS, ws, strict=True)) for n, ws in search_queries._MIXES.items()}
    a = pd.DataFrame(pay).T
    value = part("value").iloc[0]
    share = part("mix").reindex(a.index)
    assert math.isclose((share @ a).min(), value, rel_tol=1e-6, abs_tol=1e-9)
    # no grid point of pairs of mixes does better in its worst regime
    for (_, p), (_, q) in itertools.combinations(a.iterrows(), 2):
        assert all((t * p + (1 - t) * q).min() <= value + 1e-9 for t in np.linspace(0, 1, 51))


def test_blend_scores(spark):
    lines = search_queries._lines(spark, LARGER)
    settings = [search_queries._BLEND_SEED, search_queries._BLEND_SEED | {"blend": 0.2, "conviction": 0.5, "exposure": 0.8}]
    got = search_queries.blend_scores(lines, settings)
    p = lines.toPandas().sort_values("date")
    for s, g in zip(settings, got, strict=True):
        k = s["blend"] * s["conviction"]
        r = s["exposure"] * (k * p["view"] + (1 - k) * p["base"]) + (1 - s["exposure"]) * p["cash"]
        x = r - p["cash"]
        e = (1 + r).cumprod()
        assert math.isclose(g["value"], x.mean() / x.std() * math.sqrt(252), rel_tol=1e-7)
        assert math.isclose(g["maxdd"], (e / np.maximum(1, e.cummax()) - 1).min(), rel_tol=1e-7)


def test_caps(spark, wide):
    """Labels, buckets, exposures and scores against plain loops."""
    r = search_queries._returns(spark, LARGER)
    buckets = search_queries.monthly_buckets(r, (126,)).toPandas()
    x = wide.to_numpy()
    month = pd.to_datetime(pd.Series(wide.index)).dt.to_period("M")
    first = np.flatnonzero(np.r_[True, month.to_numpy()[1:] != month.to_numpy()[:-1]])
    for kind, at in (("absorption", lambda i: K.absorption(x[i - 125 : i + 1]) if i >= 125 and (i - 125) % 5 == 0 else np.nan), ("turbulence", lambda i: K.turbulence(x[i - 126 : i], x[i]) if i >= 126 else np.nan)):
        v = pd.Series([at(i) for i in range(len(x))]).ffill()
        rank, n = v.expanding().rank(), v.expanding().count()
        b = np.floor(rank / n * 3).clip(upper=2).where((n >= 252) & rank.notna(), 1).astype(int).shift(1).fillna(1).astype(int)
        want = {month[i].to_timestamp().date(): int(b[i]) for i in first}
        got = buckets[buckets.signal == kind].set_index("month").bucket.to_dict()
        assert got == want
    days = r.groupBy("date").agg(*(F.max(F.when(F.col("symbol") == s, F.col("r"))).alias(c) for s, c in (("AF", "line"), ("NO", "cash")))).dropna()
    days = days.withColumn("month", F.trunc("date", "MM")).withColumn("control", F.lit(0.7))
    labels = spark.createDataFrame([(50.0, pd.Timestamp(m.start_time).date(), ("bull", "bear", "neutral")[i % 3]) for i, m in enumerate(month.unique())], "lam double, month date, regime string")
    own = search_queries.monthly_buckets(r, (252,))
    settings = [search_queries._CAP_SEED, search_queries._CAP_SEED | {"arm": -0.02, "scale": 0.9}]
    got = search_queries.cap_scores((days, labels, own), settings)
    p = days.toPandas().sort_values("date").reset_index(drop=True)
    lab, buck = labels.toPandas().set_index("month").regime, own.toPandas().query("signal == 'absorption'").set_index("month").bucket
    for s, g in zip(settings, got, strict=True):
        cap = np.array([max(s["floor"], min(1.0, search_queries._LIMITS[lab[m]][buck.get(m, 1)] * s["scale"])) for m in p.month])
        level = np.r_[1.0, (1 + p.line).cumprod()]
        late = (level / np.maximum.accumulate(level) - 1)[:-1]
        e = cap if s["arm"] is None else np.where(late < s["arm"], cap, 1.0)
        y = e * p.line + (1 - e) * p.cash
        inside = (p.date >= search_queries._DEV[0]) & (p.date <= search_queries._DEV[1])
        curve = np.r_[1.0, (1 + y[inside]).cumprod()]
        anchor, last = p.date[~inside & (p.date < search_queries._DEV[0])].max(), p.date[inside].max()
        assert math.isclose(g["maxdd"], (curve / np.maximum.accumulate(curve) - 1).min(), rel_tol=1e-7)
        assert math.isclose(g["cagr"], curve[-1] ** (365.25 / (last - anchor).days) - 1, rel_tol=1e-7)
        assert math.isclose(g["value"], g["cagr"] / abs(g["maxdd"]), rel_tol=1e-9)


def plain_regime(x, penalty, gap=0.5, margin=0.0, kappa=None):
    """A jump model and its latest label, state by state and row by row."""
    sd = x.std(axis=0)
    z = (x - x.mean(axis=0)) / np.where(sd < 1e-8, 1.0, sd)
    n, w = len(z), np.ones(z.shape[1])

    def walk(cost):
        best, came = [list(cost[0])], []
        for t in range(1, n):
            row, back = [], []
            for s in (0, 1):
                move = best[-1][1 - s] + penalty
                stay = best[-1][s] <= move
                back.append(s if stay else 1 - s)
                row.append(cost[t, s] + (best[-1][s] if stay else move))
            best.append(row), came.append(back)
        path = [int(np.argmin(best[-1]))]
        for back in reversed(came):
            path.append(back[path[-1]])
        return np.array(path[::-1])

    cost_of = lambda c: np.stack([0.5 * ((z - c[s]) ** 2 * w).sum(axis=1) for s in (0, 1)], axis=1)

    def assign(c):
        cost, c = cost_of(c), c.copy()
        path = walk(cost)
        for s in (0, 1):
            if s not in path:
                c[s] = z[int(np.argmax(cost[np.arange(n), path]))]
                cost = cost_of(c)
                path = walk(cost)
        return c, path, cost[np.arange(n), path].sum() + penalty * (np.diff(path) != 0).sum()

    order = np.argsort(z[:, 0], kind="stable")
    c, path, _ = assign(z[[order[int(0.25 * n)], order[int(0.75 * n)]]])
    last = math.inf
    for _ in range(30):
        c, path, value = assign(np.array([z[path == s].mean(axis=0) if (path == s).any() else c[s] for s in (0, 1)]))
        if abs(last - value) < 1e-6:
            break
        last = value
    near = [((z[-1] - c[s]) ** 2 * w).sum() for s in (0, 1)]
    if abs(near[0] - near[1]) < margin or abs(c[0, 0] - c[1, 0]) < gap:
        return "neutral"
    return "bull" if (near[1] < near[0]) == (c[1, 0] > c[0, 0]) else "bear"


def features_of(p):
    """The three features of a frame (date, level) by pandas."""
    r = np.log(p.level).diff()
    w = lambda s: s.ewm(halflife=21).mean()
    return pd.DataFrame({"date": p.date, "a": w(r), "b": np.sqrt(w(r**2)), "c": np.sqrt(w(r.where(r < 0, 0.0) ** 2))}).dropna()


def test_labels_of_months(spark):
    line = search_queries.P.px_index(spark, LARGER).where("symbol = 'AF'").select("date", "level")
    got = search_queries.monthly_labels(line.where("date < '1998-06-01'"), (50.0, 5.0)).toPandas()
    v = features_of(line.toPandas().sort_values("date").reset_index(drop=True))
    seen = set()
    for lam in (50.0, 5.0):
        mine = got[got.lam == lam].set_index("month").regime.to_dict()
        assert len(mine) > 40
        for m, label in sorted(mine.items())[::9]:
            x = v[v.date < m][["a", "b", "c"]].to_numpy()
            assert label == (plain_regime(x, lam) if len(x) >= 504 else "neutral"), (lam, m)
            seen.add(label)
    assert len(seen) > 1


def test_labels_of_years(spark):
    got = registry.QUERIES["q_k25_labels"](spark, LARGER).toPandas()
    px = search_queries.P.px_index(spark, LARGER).toPandas().sort_values("date")
    for s in ("AF", "NO"):
        v = features_of(px[px.symbol == s].reset_index(drop=True))
        for r in got[got.symbol == s].itertuples():
            x = v[v.date < r.date][["a", "b", "c"]].to_numpy()
            assert len(x) == r.n_before
            assert r.label == (plain_regime(x, 50.0) if len(x) >= 504 else "neutral")


def test_guards_of_labels():
    rng = np.random.default_rng(4)
    apart = np.repeat([0.0, 3.0, 0.0, 3.0], 60)[:, None] * [1, -1, 0] + rng.normal(0, 0.3, (240, 3))
    assert K.latest_regime(apart, 20.0) == plain_regime(apart, 20.0) == "bull"
    assert K.latest_regime(-apart, 20.0) == "bear"
    assert K.latest_regime(apart, 20.0, gap=5.0) == plain_regime(apart, 20.0, gap=5.0) == "neutral"  # states too close for that gap
    assert K.latest_regime(apart, 20.0, margin=1e6) == "neutral"
    level = rng.normal(0, 1, (240, 3)) * [1e-12, 1, 1]
    assert K.latest_regime(level, 20.0) == plain_regime(level, 20.0) == "neutral"
    # the last row lies nearer to the other state than the path says: the nearest centroid decides
    turned = apart.copy()
    turned[-1] = apart[0]
    path, centre, _ = K.jump_model(turned, 20.0)
    assert path[-1] == path[-2] and K.latest_regime(turned, 20.0) == "bear"


def test_ladder_with_two_factors(spark, wide):
    r = search_queries._returns(spark, LARGER)
    f = r.groupBy("date").agg(*(F.max(F.when(F.col("symbol") == s, F.col("r"))).alias(s.lower()) for s in ("NO", "RF"))).dropna()
    got = search_queries.ladder(r.where("symbol = 'AF'").select(F.col("symbol").alias("rung"), "date", "r"), f).toPandas().iloc[0]
    p = r.where("symbol = 'AF'").join(f, "date").toPandas().sort_values("date")
    design = np.column_stack([np.ones(len(p)), p[["no", "rf"]]])
    beta, *_ = np.linalg.lstsq(design, p.r, rcond=None)
    u = p.r - design @ beta
    assert got.n == len(p) and math.isclose(got.alpha_ann, beta[0] * 252, rel_tol=1e-6) and math.isclose(got.r2, 1 - (u**2).sum() / ((p.r - p.r.mean()) ** 2).sum(), rel_tol=1e-6)


def test_intervals_of_pairs(spark, sf_dir):
    got = registry.QUERIES["q_a35_t_interval"](spark, LARGER).toPandas()
    s = replay_queries.P.scores(spark, LARGER).toPandas().dropna()
    d = (s.pit - s.nonpit).groupby(s.user_id)
    for r in got.itertuples():
        x = d.get_group(r.user_id).to_numpy()
        if len(x) < 2:
            assert math.isnan(r.t_p)
            continue
        se = x.std(ddof=1) / math.sqrt(len(x))
        assert math.isclose(r.t_stat, x.mean() / se, rel_tol=1e-7)
        assert math.isclose(r.t_p, K.student_tail(x.mean() / se, len(x) - 1), rel_tol=1e-7)
        assert math.isclose(r.ci_high - r.ci_low, 2 * K.student_quantile(0.975, len(x) - 1) * se, rel_tol=1e-7)


@pytest.mark.parametrize("name", ["q_k33_search", "q_k34_selection"])
def test_ledgers(spark, name):
    got = registry.QUERIES[name](spark, LARGER).toPandas().sort_values("iteration")
    value = got.columns[list(got.columns).index("passed") - 1] if name == "q_k34_selection" else "appraisal"
    best = got[value].iloc[0]
    for r in got.iloc[1:].itertuples():
        v = getattr(r, value)
        assert (r.decision == "KEEP") == bool(r.passed and (v > best or math.isnan(best)))
        best = v if r.decision == "KEEP" else best
