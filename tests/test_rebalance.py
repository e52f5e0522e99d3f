"""General rebalancing against a plain loop: gaps, unknown weights, rules and block sizes."""

from __future__ import annotations

import math
import random
from datetime import date, timedelta

import numpy as np
import pytest

from panelloom.operators import rebalance


def made(seed, days=90, lines=4):
    draw = random.Random(seed)
    level = {f"s{i}": 100.0 for i in range(lines)}
    prices, targets = [], []
    for d in range(days):
        at = date(2020, 1, 1) + timedelta(days=d)
        for s in level:
            level[s] *= 1 + draw.gauss(0, 0.02)
            if draw.random() < 0.75 and not (s == "s3" and d < 20):
                prices.append((s, at, level[s] if draw.random() < 0.97 else None))
        if d % 3 == 1:
            targets += [("often", at, s, draw.choice([None, draw.uniform(-0.2, 0.6)])) for s in level]
        if d % 30 == 5:
            targets += [("rare", at, s, 0.25) for s in level if s != "s2"]
    targets += [("once", date(2020, 1, 4), "s0", 1.0), ("never", date(1999, 1, 1), "s0", 1.0), ("often", date(2020, 1, 5), "unknown", 0.5)]
    return prices, targets


def plain(prices, targets, cash=10_000.0, ordered=False):
    lines, days = sorted({p[0] for p in prices}), sorted({p[1] for p in prices})
    price = {(s, d): v for s, d, v in prices}
    rules, out = sorted({t[0] for t in targets}), {}
    for rule in rules:
        money, units, last = cash, dict.fromkeys(lines, 0.0), {}
        want = {}
        for r, d, s, w in targets:
            if r == rule:
                want.setdefault(d, {})[s] = w
        for d in days:
            last |= {s: price[s, d] for s in lines if price.get((s, d)) is not None}
            value = money + sum(units[s] * last.get(s, 0) for s in lines)
            for s in lines:
                if want.get(d, {}).get(s) is not None and price.get((s, d)) is not None:
                    pay = want[d][s] * value - units[s] * last[s]
                    if ordered and pay > 0:
                        pay = min(pay, max(money, 0.0))
                    units[s] += pay / last[s]
                    money -= pay
            out[rule, d] = (money, money + sum(units[s] * last.get(s, 0) for s in lines))
    return out


@pytest.mark.parametrize(("fills", "block"), [("exact", 64), ("exact", 1), ("exact", 7), ("ordered", 64)])
def test_simulation_equals_a_plain_loop(spark, fills, block):
    prices, targets = made(block)
    got = rebalance.simulated(spark.createDataFrame(prices, "symbol string, date date, price double"), spark.createDataFrame(targets, "rule string, date date, symbol string, weight double"), fills=fills, block=block).collect()
    expected = plain(prices, targets, ordered=fills == "ordered")
    assert {(r.rule, r.date) for r in got} == set(expected) and len(got) == len(expected)
    for r in got:
        assert math.isclose(r.cash, expected[r.rule, r.date][0], rel_tol=1e-9, abs_tol=1e-6)
        assert math.isclose(r.wealth, expected[r.rule, r.date][1], rel_tol=1e-9, abs_tol=1e-6)


def test_maps_compose():
    rng = np.random.default_rng(1)
    maps = [rebalance.rebalance_map(rng.choice([np.nan, 0.3], 3), rng.choice([np.nan, 2.0], 3), np.full(3, 2.0)) for _ in range(6)]
    state = np.array([100.0, 1.0, 2.0, 3.0])
    step = state
    for m in maps:
        step = m @ step
        assert math.isclose(step[0] + 2.0 * step[1:].sum(), 112.0)  # prices stand still, so does wealth
    assert np.allclose(np.linalg.multi_dot(maps[::-1]) @ state, step)


def test_no_targets(spark):
    prices = spark.createDataFrame([("a", date(2020, 1, 1), 1.0)], "symbol string, date date, price double")
    none = spark.createDataFrame([], "rule string, date date, symbol string, weight double")
    assert rebalance.simulated(prices, none).collect() == []
