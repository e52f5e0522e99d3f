"""Regressions with a long-run covariance that need no line in one task.

Rows are ranged by line and date and numbered.  Sums of products give the
coefficients of every line; residuals are then read in blocks of ``BLOCK`` numbers,
each with the ``lags`` rows before it, and lagged cross products are added up over
blocks.  What meets in one place is a row of sums a line.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import numbered
from . import kernels as K

BLOCK = 1 << 16
#: A line of so many rows at the most is fitted in one call; the result is the same.
SHORT = 1 << 20


def hac(rows: DataFrame, key: str, at: str, y: str, names: list[str], lags: int = 5, block: int = BLOCK) -> DataFrame:
    """(key, n, beta, t, r2, s) of y on an intercept and names: coefficients and Bartlett sandwich t values (arrays, intercept first), share explained, and the residuals' sample deviation.

    Rows with a null are left out; dates of a line are distinct.  A line with no more
    rows than coefficients, or with dependent columns, has null results.
    """
    k = len(names) + 1
    rows = rows.select(key, at, F.col(y).cast("double").alias("_y"), *(F.col(c).cast("double").alias(c) for c in names)).dropna()
    x = [F.lit(1.0), *(F.col(c) for c in names)]
    v = [*x, F.col("_y")]
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    sums = rows.groupBy(key).agg(F.count("*").alias("n"), F.array(*(F.sum(v[i] * v[j]) for i, j in pairs)).alias("sums"))

    def gram(s: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        m = np.zeros((k + 1, k + 1))
        for (i, j), value in zip(pairs, s):
            m[i, j] = m[j, i] = value
        return m[:k, :k], m[:k, k], m[k, k]

    def solve(batches):
        for pdf in batches:
            beta = []
            for n, s in zip(pdf.n, pdf.sums):
                a, b, _ = gram(s)
                ok = n > k and np.linalg.matrix_rank(a) == k
                beta.append(np.linalg.solve(a, b).tolist() if ok else None)
            yield pdf.assign(beta=beta)

    kind = rows.schema[key].dataType.simpleString()
    fitted = sums.mapInPandas(solve, f"`{key}` {kind}, n long, sums array<double>, beta array<double>")
    order = numbered(rows, [key, at])
    residual = F.col("_y") - F.aggregate(F.zip_with("beta", F.array(*x), lambda b, c: b * c), F.lit(0.0), lambda a, p: a + p)
    u = order.join(fitted.select(key, "beta"), key).where("beta is not null").select(key, "pos", residual.alias("_e"), *names)
    own = F.floor(F.col("pos") / block)
    dealt = u.withColumn("_block", F.explode(F.sequence(own, F.floor((F.col("pos") + lags) / block))))

    def products(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        lo, pos, line = int(pdf["_block"].iloc[0]) * block, pdf.pos.to_numpy(), pd.factorize(pdf[key])[0]
        names_at = pdf[key].to_numpy()
        g = np.column_stack([np.ones(len(pdf)), pdf[names]]) * pdf["_e"].to_numpy()[:, None]
        mine, out = pos >= lo, []
        for step in range(lags + 1):
            later, earlier = np.arange(step, len(g)), np.arange(0, len(g) - step)
            ok = mine[later] & (line[later] == line[earlier])  # numbers have no holes within a line
            for code in np.unique(line[later[ok]]):
                pick = ok & (line[later] == code)
                m = g[later[pick]].T @ g[earlier[pick]]
                out.append((names_at[np.argmax(line == code)], step, m.ravel().tolist(), float((pdf["_e"].to_numpy()[later[pick]] ** 2).sum())))
        return pd.DataFrame(out, columns=[key, "lag", "m", "ss"])

    part = dealt.groupBy("_block").applyInPandas(products, f"`{key}` {kind}, lag int, m array<double>, ss double")
    meat = part.groupBy(key, "lag").agg(F.array(*(F.sum(F.col("m")[i]) for i in range(k * k))).alias("m"), F.sum("ss").alias("ss"))
    per_line = meat.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("lag", "m", "ss"))).alias("meat"))  # a row a lag

    def finish(batches):
        for pdf in batches:
            t, r2, s = [], [], []
            for n, sums_, beta, meat_ in zip(pdf.n, pdf.sums, pdf.beta, pdf.meat):
                if beta is None or meat_ is None:
                    t.append(None), r2.append(None), s.append(None)
                    continue
                a, b, yy = gram(sums_)
                inner = np.zeros((k, k))
                for r in meat_:
                    m, lag = np.array(r["m"]).reshape(k, k), r["lag"]
                    inner += m if lag == 0 else (1 - lag / (lags + 1)) * (m + m.T)
                inv = np.linalg.inv(a)
                t.append((np.array(beta) / np.sqrt(np.diag(inv @ inner @ inv))).tolist())
                left, spread = meat_[0]["ss"], yy - b[0] ** 2 / n
                r2.append(1 - left / spread if spread > 0 else None)
                s.append(np.sqrt(left / (n - 1)))
            yield pd.DataFrame({key: pdf[key], "n": pdf.n, "beta": pdf.beta, "t": t, "r2": r2, "s": s})

    return fitted.join(per_line, key, "left").mapInPandas(finish, f"`{key}` {kind}, n long, beta array<double>, t array<double>, r2 double, s double")


def _in_one_call(rows: DataFrame, key: str, at: str, y: str, names: list[str], lags: int) -> DataFrame:
    """The columns of ``hac``, a kernel call a line."""
    kind = rows.schema[key].dataType.simpleString()
    rows = rows.select(key, at, F.col(y).cast("double").alias("_y"), *(F.col(c).cast("double").alias(c) for c in names)).dropna()

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(at)
        v, x = pdf["_y"].to_numpy(), pdf[names].to_numpy()
        row = {key: [pdf[key].iloc[0]], "n": [len(v)], "beta": [None], "t": [None], "r2": [None], "s": [None]}
        full = np.column_stack([np.ones(len(v)), x])
        if len(v) > len(names) + 1 and np.linalg.matrix_rank(full.T @ full) == full.shape[1]:
            beta, t = K.hac_ols(v, x, lags)
            left, spread = float(((v - full @ beta) ** 2).sum()), float(((v - v.mean()) ** 2).sum())
            row |= {"beta": [beta.tolist()], "t": [t.tolist()], "r2": [1 - left / spread if spread > 0 else None], "s": [np.sqrt(left / (len(v) - 1))]}
        return pd.DataFrame(row)

    return rows.groupBy(key).applyInPandas(fit, f"`{key}` {kind}, n long, beta array<double>, t array<double>, r2 double, s double")


def fitted(rows: DataFrame, key: str, at: str, y: str, names: list[str], lags: int = 5, short: int = SHORT) -> DataFrame:
    """The columns of ``hac``: in one call a line where the longest has ``short`` rows at the most, in blocks beyond."""
    longest = rows.groupBy(key).count().agg(F.max("count")).first()[0] or 0  # one number
    return (_in_one_call if longest <= short else hac)(rows, key, at, y, names, lags)
