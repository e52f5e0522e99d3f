"""Functions that SQL calls by name: reducers of a line, table functions over partitioned tables, and rules.

``register(spark)`` makes all of them known to a session.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import kernels as K


def _line(at: pd.Series, x: pd.Series) -> np.ndarray:
    """The known values of a line in order of time; an aggregate's rows come in any order."""
    v = x.to_numpy(dtype=float)[np.argsort(at.to_numpy(), kind="stable")]
    return v[np.isfinite(v)]


# ---------------------------------------------------------------- reducers of one line


@F.pandas_udf(T.DoubleType())
def stability_ratio(at: pd.Series, r: pd.Series) -> float:
    """Mean of the rolling Sharpe path of returns over its long-run deviation; null below ten points of the path."""
    value = K.path_stability(_line(at, r))[0]
    return float(value) if np.isfinite(value) else None


@F.pandas_udf(T.DoubleType())
def long_run_variance(at: pd.Series, x: pd.Series) -> float:
    """Long-run variance at the plug-in bandwidth; null for an empty line."""
    z = _line(at, x)
    return K.hac_variance(z, K.plug_in_lags(z)) if len(z) else None


@F.pandas_udf(T.LongType())
def plug_in_bandwidth(at: pd.Series, x: pd.Series) -> int:
    return K.plug_in_lags(_line(at, x))


@F.pandas_udf(T.LongType())
def block_length(at: pd.Series, x: pd.Series) -> int:
    """Automatic block length of a resample."""
    return K.block_length(_line(at, x))


# ---------------------------------------------------------------- table functions


@F.udtf(returnType="line string, check string, passed boolean, detail string")
class LineChecks:
    """Checks of each line of a table (line, date, value), partitioned by line and ordered by date, in one pass and constant memory.

    rows: ``LEAST`` at least; dates: strictly increasing; values: all known and finite; positive: all above zero; gap: the longest silence is ``GAP`` days at the most.
    """

    LEAST, GAP = 252, 5

    def __init__(self) -> None:
        self.line, self.last = None, None
        self.rows = self.back = self.unknown = self.low = self.gap = 0

    def eval(self, row: Row) -> None:
        self.line, at, x = row[0], row[1], row[2]
        self.rows += 1
        known = x is not None and np.isfinite(x)
        self.unknown += not known
        self.low += bool(known and x <= 0)
        if at is None or (self.last is not None and at <= self.last):
            self.back += 1
        elif self.last is not None:
            self.gap = max(self.gap, (at - self.last).days)
        self.last = at if at is not None else self.last

    def terminate(self) -> Iterator[tuple]:
        if not self.rows:
            return
        yield self.line, "rows", self.rows >= self.LEAST, str(self.rows)
        yield self.line, "dates", self.back == 0, str(self.back)
        yield self.line, "values", self.unknown == 0, str(self.unknown)
        yield self.line, "positive", self.low == 0, str(self.low)
        yield self.line, "gap", self.gap <= self.GAP, str(self.gap)


def equal(x: np.ndarray) -> np.ndarray:
    return np.full(x.shape[1], 1 / x.shape[1])


def inverse_volatility(x: np.ndarray) -> np.ndarray:
    risk = 1 / x.std(axis=0, ddof=1)
    return risk / risk.sum()


#: Weight rules by name: a window of returns, dates by lines, gives a weight a line.
WEIGHT_RULES: dict[str, Callable[[np.ndarray], np.ndarray]] = {"equal": equal, "inverse_volatility": inverse_volatility, "parity": K.risk_parity}


@F.udtf(returnType="decided date, line string, weight double")
class RuleWeights:
    """Weights of one decision date from a table (decided, date, line, r) partitioned by decided, ordered by date and line, and a rule's name.

    The decision's own date is left out of the window.  A rule that raises or gives
    unknown weights gives null ones: the caller holds what it held.
    """

    def __init__(self) -> None:
        self.rule, self.decided, self.cells = "", None, []

    def eval(self, row: Row, rule: str) -> None:
        self.rule, self.decided = rule, row[0]
        if row[1] < row[0]:
            self.cells.append((row[1], row[2], row[3]))

    def terminate(self) -> Iterator[tuple]:
        if not self.cells:
            return
        w = pd.DataFrame(self.cells, columns=["date", "line", "r"]).pivot(index="date", columns="line", values="r").sort_index()
        try:
            weights = WEIGHT_RULES[self.rule](w.to_numpy())
        except (ArithmeticError, ValueError, np.linalg.LinAlgError):
            weights = np.full(w.shape[1], np.nan)
        for line, v in zip(w.columns, weights):
            yield self.decided, line, float(v) if np.isfinite(v) else None


# ---------------------------------------------------------------- rules as SQL

#: Functions of columns by name; NaN and null compare as false.
SQL_RULES = {
    "regime_of": """(inflation DOUBLE, credit DOUBLE, growth DOUBLE) RETURNS STRING RETURN CASE
        WHEN inflation > 1 AND NOT isnan(inflation) THEN 'inflation'
        WHEN (credit > 1 AND NOT isnan(credit)) OR (growth < -1.5 AND NOT isnan(growth)) THEN 'recession' ELSE 'normal' END""",
    "guarded_tilt": "(raw DOUBLE, p DOUBLE) RETURNS DOUBLE RETURN raw * (1 - CASE WHEN p IS NULL THEN NULL ELSE greatest(0D, least(1D, p)) END)",
}


def register(spark: SparkSession) -> None:
    for f in (stability_ratio, long_run_variance, plug_in_bandwidth, block_length):
        spark.udf.register(f.__name__, f)
    spark.udtf.register("line_checks", LineChecks)
    spark.udtf.register("rule_weights", RuleWeights)
    for name, body in SQL_RULES.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
