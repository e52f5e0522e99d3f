"""Edge cases of the row gate, evidence, indexes, loadings and gates."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelloom.functions import columns as C
from panelloom.operators import contracts
from panelloom.operators import kernels as K
from panelloom.plans import contract_queries, registry

ROW = {
    "schema": "portfolio_metrics.reader.v2", "portfolio_id": "p", "return_basis": "b", "window_label": "w", "start": "2020-01-01", "end": "2020-12-31", "n_obs": "250", "periods_per_year": "252",
    "cash_benchmark_id": "c", "currency_basis": "USD", "source": "s", "row_kind": "performance_only",
}
MONTH = {**{k: v for k, v in ROW.items() if k != "row_kind"}, "schema": "monthly_returns.reader.v1", "periods_per_year": "12", "end": "2020-01-31", "n_obs": "21", "year": "2020", "month": "1", "monthly_return": "0.01"}


@pytest.mark.parametrize(
    ("row", "violation"),
    [
        (ROW, None), (MONTH, None), ({}, "schema"), ({**ROW, "Jensen_x": "1", "source": None}, "label"), ({**ROW, "source": "NaN"}, "provenance"), ({**ROW, "end": "2019-12-31"}, "period"), ({**ROW, "start": "soon"}, "period"),
        ({**ROW, "end": "2020-01-01"}, None), ({**ROW, "n_obs": "-3"}, "n_obs"), ({**ROW, "periods_per_year": "12"}, "basis"), ({**ROW, "schema": "crisis_metrics.boundary_anchored.v1"}, "unknown"),
        ({**MONTH, "year": "twenty"}, "month"), ({**MONTH, "month": "0"}, "month"), ({**MONTH, "monthly_return": "inf"}, "return"), ({**MONTH, "end": "2020-02-01"}, "window"), ({**MONTH, "n_obs": "32"}, "days"), ({**MONTH, "year": "2019", "month": "2", "n_obs": "29"}, "window"),
        ({**ROW, "row_kind": "full", "raw_market_model_beta": "1"}, "attribution_window"), ({**ROW, "raw_market_model_beta": "1"}, "attributed_kind"), ({**ROW, "weather": "fine"}, "unknown"),
        ({**ROW, "row_kind": "full", "raw_market_model_start": "2020-01-01", "raw_market_model_end": "2020-12-31", "raw_market_model_n_obs": "250"}, None),
    ],
)
def test_report_rows(spark, row, violation):
    df = spark.createDataFrame([(row,)], "row map<string,string>")
    assert df.select(contracts.report_violation(F.col("row"))).first()[0] == violation


def test_loadings_are_whole_or_nothing(spark):
    five = '{"inflation": 2, "growth": -3, "credit_stress": 0.5, "policy": "0.1", "risk_appetite": 0}'
    rows = [(five,), ("",), (None,), (five.replace('"growth": -3, ', ""),), ("inflation: 1, growth: 1, credit_stress: 1, policy: 1, risk_appetite: -1",)]
    got = [r[0] for r in spark.createDataFrame(rows, "t string").select(contracts.loadings(F.col("t"), C.axis_value)).collect()]
    assert got[0] == {"inflation": 1.0, "growth": -1.0, "credit_stress": 0.5, "policy": 0.1, "risk_appetite": 0.0}
    assert got[1:4] == [None, None, None] and got[4]["risk_appetite"] == -1.0


def test_stability_of_one_row_is_zero(spark):
    one = spark.createDataFrame([(1, 1, dict.fromkeys(contracts.AXES, 0.5)), (2, 1, None)], "k int, at int, l map<string,double>")
    [r] = contracts.loading_stability(one, ["k"], "at", "l").collect()
    assert (r.k, r.n, r.mean_std, r.mean_mac) == (1, 1, 0.0, 0.0)


def test_indexes(spark):
    labels = spark.createDataFrame([("a", 1, "2020-01-02"), ("a", 2, "2020-01-01"), ("b", 1, None), ("c", 1, "2020-01-01T00:00:00+02:00"), ("d", 1, "2020-01-01 10:00:00"), ("d", 2, "2020-01-01 11:00:00")], "k string, o int, l string")
    lines = spark.createDataFrame([(x,) for x in "abcde"], "k string")
    got = {r.k: (r.n, r.fault) for r in contracts.index_faults(labels, lines, "k", "l", "o").collect()}
    assert got == {"a": (2, "order"), "b": (1, "null"), "c": (1, "zone"), "d": (2, None), "e": (0, "empty")}


def test_gates_fail_on_unknown_inputs(spark):
    good = (3.0, 1.0, 0.1, 0.01, 0.01, 0.5, 0.4, -0.2, -0.3)
    names = ["t", "appraisal", "ssr", "ssr_p", "premium", "calmar", "base_calmar", "maxdd", "base_maxdd"]
    gate_of = {"t": "skill", "appraisal": "skill", "ssr": "stability", "ssr_p": "stability", "premium": "recall"}
    rows = [good] + [tuple(bad if j == i else v for j, v in enumerate(good)) for i in range(9) for bad in (None, float("nan"), float("inf"))]
    got = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).coalesce(1).select(*contracts.gate_verdict()).collect()
    assert got[0].passed and got[0].first_failure is None
    for k, r in enumerate(got[1:]):
        assert not r.passed and r.first_failure.startswith(gate_of.get(names[k // 3], "risk_shape")), names[k // 3]
    weak = spark.createDataFrame([(1.0, *good[1:])], ", ".join(f"{n} double" for n in names))
    assert not weak.select(*contracts.gate_verdict()).first().skill and weak.select(*contracts.gate_verdict(relative=True)).first().skill


def test_verdicts_on_real_statistics(spark, sf_dir):
    got = registry.QUERIES["q_k4_verdicts"](spark, sf_dir).toPandas()
    assert set(got["mode"]) == {"absolute", "relative"} and len(got) == 2 * got.symbol.nunique()
    r = contract_queries.P.returns(spark, sf_dir).toPandas().sort_values("date")
    wide = r.pivot(index="date", columns="symbol", values="r")
    for x in got[got["mode"] == "absolute"].itertuples():
        p = wide[[x.symbol, "NO"]].dropna()
        beta, t = K.hac_ols(p[x.symbol].to_numpy(), p[["NO"]].to_numpy())
        assert math.isclose(x.t, t[0], rel_tol=1e-6)
        assert math.isclose(x.ssr, K.path_stability(r[(r.symbol == x.symbol) & r.r.notna()].r.to_numpy())[0], rel_tol=1e-6)
        level = r[r.symbol == x.symbol].level.to_numpy()
        assert math.isclose(x.maxdd, (level / np.maximum.accumulate(level) - 1).min(), rel_tol=1e-9)
        assert x.skill == (x.t > 2) and x.stability == (x.ssr_p < 0.05 and x.ssr > 0) and x.recall == (abs(x.premium) <= 0.05)
        assert x.passed == (x.skill and x.stability and x.recall and x.risk_shape) == (x.first_failure is None)


def test_full_rows(spark, sf_dir):
    got = registry.QUERIES["q_k43_full_rows"](spark, sf_dir).toPandas()
    assert (got.n_boot == 1000).all() and got.ssr_p.between(1 / 1001, 1).all() and len(got) == 5
    for x in got.itertuples():
        assert x.stable == (x.ssr_p < 0.05 and x.ssr > 0)


def test_seeded_rows(spark, sf_dir):
    got = registry.QUERIES["q_o18_positions"](spark, sf_dir).toPandas().sort_values("pos")
    orders = contract_queries.P.table(spark, sf_dir, "orders").toPandas().sort_values("o_orderkey").o_orderkey.to_numpy()
    drawn = np.sort(np.random.default_rng(0).choice(len(orders), 50, replace=False))
    assert got.pos.tolist() == drawn.tolist() and got.o_orderkey.tolist() == orders[drawn].tolist()


def test_evidence_is_judged_before_it_is_sorted(spark, sf_dir):
    df = contract_queries.evidence_faults(spark, sf_dir)
    nodes, seen = [df._jdf.queryExecution().optimizedPlan()], []
    while nodes:
        node = nodes.pop()
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
        if node.nodeName() == "Window":
            seen.append({c.split("#")[0] for c in node.children().apply(0).output().mkString(" ").split()})
    assert len(seen) == 2 and set().union(*seen) <= {"user_id", "variant", "rebalance_date", "event_id", "fault", "_back", "_again", "_w0"}


def test_coverage_of_null_keys(spark, sf_dir, monkeypatch):
    import datetime as dt

    rows = [(32 * 31 + 20, dt.datetime(2024, 1, 2), None, "view", 1.0), (32 * 31 + 21, dt.datetime(2024, 1, 2), None, "click", 1.0), (32 * 31 + 22, dt.datetime(2024, 1, 15), 1, "view", 1.0), (32 * 31 + 23, dt.datetime(2024, 1, 2), 2, "purchase", 1.0)]
    monkeypatch.setattr(contract_queries.P, "table", lambda spark, sf_dir, name: spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"))
    got = sorted((r.user_id or 0, r.variant, r.fault) for r in contract_queries.evidence_faults(spark, sf_dir).collect())
    assert got == [(1, "pit", "unexpected"), (2, "nonpit_diagnostic", "missing"), (2, "pit", "missing")]
