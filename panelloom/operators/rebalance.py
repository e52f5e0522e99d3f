"""Rebalancing to any targets, with missing prices and one cash account.

What is held after a rebalance is a linear map of what was held before: the
portfolio's value is the cash plus the units at the last known prices, a line with a
target and a price is set to its share of that value, any other line keeps its
units, and the cash takes the rest.  Maps compose, so blocks of rebalances are
multiplied on their own, their products are run through once, and each block then
yields its own states: a scan over dates whose groups are blocks, not histories.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import series as S

#: Rebalances in a block of the scan.
BLOCK = 64


def rebalance_map(weight: np.ndarray, price: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Matrix from (cash, units) to (cash, units): lines with a weight and a price are traded, the others kept."""
    worth = np.r_[1.0, np.where(np.isnan(last), 0.0, last)]
    traded = ~np.isnan(weight) & ~np.isnan(price)
    m = np.diag(np.r_[0.0, (~traded).astype(float)])
    m[1:][traded] = (weight[traded] / price[traded])[:, None] * worth
    m[0] = worth - worth[1:] @ m[1:]
    return m


def ordered_fill(state: np.ndarray, weight: np.ndarray, price: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The same rebalance with orders filled line by line: a buy takes no more than the cash that is there."""
    out = state.copy()
    worth = np.where(np.isnan(last), 0.0, last)
    value = out[0] + worth @ out[1:]
    for i in np.flatnonzero(~np.isnan(weight) & ~np.isnan(price)):
        want = weight[i] * value - out[1 + i] * price[i]
        pay = min(want, max(out[0], 0.0)) if want > 0 else want
        out[1 + i] += pay / price[i]
        out[0] -= pay
    return out


def _arrays(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(np.array(v, dtype=float) for v in (row.weights, row.prices, row.lasts))


def held(orders: DataFrame, init_cash: float, fills: str, block: int) -> DataFrame:
    """(rule, date, state) after every rebalance of orders (rule, date, weights, prices, lasts: arrays by line)."""
    schema = "rule string, date date, state array<double>"

    if fills == "ordered":

        def one_by_one(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf, state, out = pdf.sort_values("date"), None, []
            for r in pdf.itertuples():
                w, p, last = _arrays(r)
                state = ordered_fill(np.r_[init_cash, np.zeros(len(w))] if state is None else state, w, p, last)
                out.append(state.tolist())
            return pd.DataFrame({"rule": pdf.rule, "date": pdf.date, "state": out})

        return orders.groupBy("rule").applyInPandas(one_by_one, schema)  # a minimum of cash is no linear map: one strategy's dates

    numbered = orders.withColumn("block", F.floor((F.row_number().over(Window.partitionBy("rule").orderBy("date")) - 1) / block))

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        m = None
        for r in pdf.sort_values("date").itertuples():
            step = rebalance_map(*_arrays(r))
            m = step if m is None else step @ m
        return pd.DataFrame({"rule": [pdf.rule.iloc[0]], "block": [pdf.block.iloc[0]], "map": [m.ravel().tolist()]})

    def starts(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        n = int(round(len(pdf["map"].iloc[0]) ** 0.5))
        state, out = np.r_[init_cash, np.zeros(n - 1)], []
        for m in pdf["map"]:
            out.append(state.tolist())
            state = np.array(m).reshape(n, n) @ state
        return pd.DataFrame({"rule": pdf.rule, "block": pdf.block, "start": out})

    def states(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, state, out = pdf.sort_values("date"), np.array(pdf.start.iloc[0], dtype=float), []
        for r in pdf.itertuples():
            state = rebalance_map(*_arrays(r)) @ state
            out.append(state.tolist())
        return pd.DataFrame({"rule": pdf.rule, "date": pdf.date, "state": out})

    maps = numbered.groupBy("rule", "block").applyInPandas(product, "rule string, block long, map array<double>")
    first = maps.groupBy("rule").applyInPandas(starts, "rule string, block long, start array<double>")  # a row a block
    return numbered.join(first, ["rule", "block"]).groupBy("rule", "block").applyInPandas(states, schema)


def simulated(prices: DataFrame, targets: DataFrame, init_cash: float = 10_000.0, fills: str = "exact", block: int = BLOCK) -> DataFrame:
    """(rule, date, cash, wealth) on every date of prices (symbol, date, price) for targets (rule, date, symbol, weight).

    A missing price or weight means no order: the line keeps its units and counts at
    its last known price.  Weights need not add up to one; the rest is cash, which
    shorts or lines that cannot be sold may make negative.  A target's date without
    any session is left out, and so is a symbol without prices.  Before its first
    rebalance a rule holds its cash.  ``fills="ordered"`` fills orders by symbol, each
    buy limited by the cash then left.
    """
    lines = prices.select("symbol").distinct()  # the lines of one panel
    calendar = prices.select("date").distinct()
    grid = calendar.crossJoin(F.broadcast(lines)).join(prices, ["date", "symbol"], "left")
    grid = grid.withColumn("last", F.last("price", ignorenulls=True).over(S.upto(["symbol"], "date")))
    rules = targets.select("rule").distinct()
    when = targets.select("rule", "date").distinct()
    asked = when.join(grid, "date").join(targets, ["rule", "date", "symbol"], "left")
    by_line = F.sort_array(F.collect_list(F.struct("symbol", "weight", "price", "last")))
    orders = asked.groupBy("rule", "date").agg(by_line.alias("o")).select("rule", "date", F.col("o.symbol").alias("names"), F.col("o.weight").alias("weights"), F.col("o.price").alias("prices"), F.col("o.last").alias("lasts"))
    state = held(orders, init_cash, fills, block).join(orders.select("rule", "date", "names"), ["rule", "date"])
    own = state.select("rule", "date", F.col("state")[0].alias("cash"), F.map_from_arrays("names", F.slice("state", 2, F.size("names"))).alias("units"))
    days = calendar.crossJoin(F.broadcast(rules))  # a row a session and rule
    last = S.as_of(days, own.select("rule", "date", F.struct("cash", "units").alias("s")), ["rule"], "date", "s", False, "s")
    worth = grid.groupBy("date").agg(F.map_from_entries(F.collect_list(F.struct("symbol", "last"))).alias("lasts"))
    value = F.aggregate(F.map_entries("s.units"), F.lit(0.0), lambda a, e: a + F.coalesce(e["value"] * F.col("lasts")[e["key"]], F.lit(0.0)))
    cash = F.coalesce("s.cash", F.lit(float(init_cash)))
    return last.join(worth, "date").select("rule", "date", cash.alias("cash"), (cash + F.coalesce(value, F.lit(0.0))).alias("wealth"))
