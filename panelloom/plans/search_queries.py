"""Walk-forward targets of several rules, the simulated game, the ladder of rungs and the searches over settings."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import kernels as K
from ..operators import regression
from ..operators import series as S
from ..operators.search import keep_or_revert
from ..sources import panels as P
from ..sources.panels import with_panels
from ..sources.scratch import new_folder
from .decision_queries import _ASSETS, _MIXES, _returns
from .kernel_queries import sessions_of, slid
from .registry import query, rounded
from .relational_queries import regime_months

AT = "date"

# ---------------------------------------------------------------- walk-forward targets

Weigh = Callable[[np.ndarray, list[str]], np.ndarray]


def targets_of(windows: DataFrame, rules: dict[str, Weigh], least: int) -> DataFrame:
    """(strategy, date, symbol, weight) of every window (end, date, symbol, r), whose last date is the rebalance and the rows before it the history.

    Below ``least`` rows of history there are no targets.  A rule that raises or gives weights
    without a sum gives none either, so its last targets stay in force.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        w = pdf.pivot(index="date", columns="symbol", values="r").sort_index()
        x, names, out = w.to_numpy()[:-1], list(w.columns), []
        for name, rule in rules.items() if len(x) >= least else ():
            try:
                got = np.asarray(rule(x, names), float)
            except (ArithmeticError, ValueError, IndexError, np.linalg.LinAlgError):
                continue
            if got.sum() != 0:
                out.append(pd.DataFrame({"strategy": name, "date": w.index[-1], "symbol": names, "weight": got}))
        return pd.concat(out) if out else pd.DataFrame({c: pd.Series(dtype=object) for c in ("strategy", "date", "symbol", "weight")})

    return windows.groupBy("end").applyInPandas(one, "strategy string, date date, symbol string, weight double")


RULES: dict[str, Weigh] = {
    "equal": lambda x, names: np.full(len(names), 1 / len(names)),
    "parity": lambda x, names: K.risk_parity(x),
    "pinned": lambda x, names: K.pinned_parity(x, np.array([0.25 if n == "NO" else np.nan for n in names])),
    "momentum": lambda x, names: K.momentum_parity(x, 252, names.index("NO")),
    "long_only": lambda x, names: K.long_only(x.mean(axis=0), K.shrunk_covariance(x), 2.5),
}


@query("q_k10_walk_forward")
def walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five weight rules at the first session of every quarter on up to 756 sessions strictly before it, 60 at least."""
    r = _returns(spark, sf_dir)
    days = sessions_of(r)
    first = days.withColumn("n", F.row_number().over(Window.partitionBy(F.trunc(AT, "quarter")).orderBy(AT))).where("n = 1").select(F.col("pos").alias("end"))
    inside = days.join(F.broadcast(first), F.col("pos").between(F.col("end") - 756, F.col("end")))  # a date a quarter
    return targets_of(r.join(inside.select("end", AT), AT), RULES, 60)


# ---------------------------------------------------------------- the simulated game


@query("q_k19_game")
def game(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asset weights of the mixture of eight fixed mixes that does best in its worst regime, that mixture, and the shares of the regimes on 10,000 paths of the last 12 months (kind, name, value).

    The shares do not enter the game.
    """
    z = regime_months(spark, sf_dir)
    r = P.returns(spark, sf_dir).where(F.col("r").isNotNull() & F.col("symbol").isin(*_ASSETS)).withColumn("month", F.trunc(AT, "MM"))
    mean = r.join(z.select("month", "regime"), "month").groupBy("symbol", "regime").agg((F.avg("r") * 252).alias("ann"))
    mix = spark.createDataFrame([(n, a, w / sum(ws)) for n, ws in _MIXES.items() for a, w in zip(_ASSETS, ws, strict=True)], "name string, symbol string, w double")
    payoff = mean.join(F.broadcast(mix), "symbol").groupBy("name", "regime").agg(F.sum(F.col("w") * F.col("ann")).alias("pay"))

    def play(pdf: pd.DataFrame) -> pd.DataFrame:
        a = pdf.pivot(index="name", columns="regime", values="pay").fillna(0).sort_index()
        share, value = K.minimax(a.to_numpy())
        return pd.DataFrame({"kind": ["mix"] * len(a) + ["value"], "name": [*a.index, "worst regime"], "value": [*share, value]})

    won = payoff.groupBy(F.lit(1).alias("_g")).applyInPandas(play, "kind string, name string, value double")  # mixes times regimes
    weights = won.where("kind = 'mix'").join(F.broadcast(mix), "name").groupBy("symbol").agg(F.sum(F.col("value") * F.col("w")).alias("value"))
    return won.unionAll(weights.select(F.lit("asset").alias("kind"), F.col("symbol").alias("name"), "value")).unionAll(_simulated(spark, z))


def _simulated(spark: SparkSession, z: DataFrame, n_paths: int = 10_000, horizon: int = 3, block: int = 3, months: int = 12) -> DataFrame:
    """Share of each regime among all points of the paths; starts come from a hash of path and block."""
    last = z.orderBy(F.desc("month")).limit(months)  # the last months
    pos = last.select((F.row_number().over(Window.orderBy("month")) - 1).alias("pos"), "regime")
    size = last.agg(F.count("*").alias("n"))
    tile = spark.range(n_paths).crossJoin(F.broadcast(size)).select(F.col("id").alias("path"), "n", F.explode(F.sequence(F.lit(0), F.lit(-(-horizon // block) - 1))).alias("b"))
    step = tile.withColumn("s", F.pmod(F.xxhash64("path", "b"), F.col("n") - block + 1)).select("b", "s", F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("k"))
    point = step.where(F.col("b") * block + F.col("k") < horizon).select((F.col("s") + F.col("k")).alias("pos")).join(F.broadcast(pos), "pos")
    return point.groupBy("regime").agg(F.count("*").alias("n")).select(F.lit("regime").alias("kind"), F.col("regime").alias("name"), (F.col("n") / (n_paths * horizon)).alias("value"))


# ---------------------------------------------------------------- least-cost states


@query(
    "q_k22_states",
    with_panels("ret").replace("WITH ", "WITH RECURSIVE ", 1)
    + """, zz AS (SELECT symbol, date, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i, (r - avg(r) OVER (PARTITION BY symbol)) / stddev_samp(r) OVER (PARTITION BY symbol) AS z FROM ret WHERE r IS NOT NULL),
    e AS MATERIALIZED (SELECT symbol, date, i, pow(z - 0.5, 2) / 2 AS e0, pow(z + 0.5, 2) / 2 AS e1 FROM zz),
    f AS MATERIALIZED (SELECT symbol, i, e0 AS c0, e1 AS c1, 0 AS b0, 0 AS b1 FROM e WHERE i = 1
      UNION ALL SELECT e.symbol, e.i, e.e0 + least(c0, c1 + 1.0), e.e1 + least(c1, c0 + 1.0), CASE WHEN c0 <= c1 + 1.0 THEN 0 ELSE 1 END, CASE WHEN c1 <= c0 + 1.0 THEN 1 ELSE 0 END FROM f JOIN e ON e.symbol = f.symbol AND e.i = f.i + 1),
    b AS (SELECT symbol, i, CASE WHEN c0 <= c1 THEN 0 ELSE 1 END AS state FROM f WHERE (symbol, i) IN (SELECT (symbol, max(i)) FROM e GROUP BY symbol)
      UNION ALL SELECT f.symbol, f.i - 1, CASE WHEN b.state = 0 THEN b0 ELSE b1 END FROM b JOIN f ON f.symbol = b.symbol AND f.i = b.i WHERE b.i > 1)
    SELECT symbol, date, CAST(state AS BIGINT) AS state FROM b JOIN e USING (symbol, i)""",
)
def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two states half a deviation above and below the mean, on the path of least squared distance plus one a jump, of every line."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        z = pdf.z.to_numpy()
        return pd.DataFrame({"symbol": pdf.symbol, "date": pdf.date, "state": K.cheapest_path(np.stack([(z - 0.5) ** 2, (z + 0.5) ** 2], axis=1) / 2, 1.0)})

    own = Window.partitionBy("symbol")
    z = P.returns(spark, sf_dir).where("r is not null").select("symbol", AT, ((F.col("r") - F.avg("r").over(own)) / F.stddev_samp("r").over(own)).alias("z"))
    return z.groupBy("symbol").applyInPandas(one, "symbol string, date date, state long")


# ---------------------------------------------------------------- ladder of rungs

_RUNGS = {"AF": "HRP_ONLY", "AO": "HRP_BL_FIXED", "NF": "HRP_BL_AI_PIT", "RF": "HRP_BL_AI_NONPIT", "RO": "OVERLAY_CONTROL"}  # fixed values, in the ladder's order
_DIAGNOSTIC = "HRP_BL_AI_NONPIT"


def ladder(returns: DataFrame, factors: DataFrame) -> DataFrame:
    """(rung, n, appraisal, alpha_ann, t_alpha_hac, r2, idio_vol_ann, calmar, max_drawdown) of every rung's returns (rung, date, r) against its own factors (date, one column each) on their common dates."""
    names = [c for c in factors.columns if c != AT]
    rows = returns.join(factors, AT)
    idio = F.col("s") * F.sqrt(F.lit(252.0))
    alpha, t = F.col("beta")[0] * 252, F.col("t")[0]
    fit = regression.fitted(rows, "rung", AT, "r", names).select(
        "rung", "n", F.when(idio >= 1e-8, alpha / idio).alias("appraisal"), alpha.alias("alpha_ann"), t.alias("t_alpha_hac"), "r2", idio.alias("idio_vol_ann")
    )
    w = S.upto(["rung"], AT)
    curve = rows.select("rung", AT, F.product(1 + F.col("r")).over(w).alias("e")).withColumn("fall", F.col("e") / F.max("e").over(w) - 1)
    shape = curve.groupBy("rung").agg(F.min("fall").alias("max_drawdown"), (F.max_by("e", AT) / F.min_by("e", AT)).alias("growth"), F.greatest(F.datediff(F.max(AT), F.min(AT)), F.lit(1)).alias("days"))
    calmar = F.when(F.col("max_drawdown") < 0, (F.pow("growth", 365.25 / F.col("days")) - 1) / F.abs("max_drawdown"))
    got = fit.join(shape, "rung").select(*fit.columns, calmar.alias("calmar"), "max_drawdown")
    return got.select(*(F.coalesce(c, F.lit(float("nan"))).alias(c) if k == "double" else F.col(c) for c, k in got.dtypes))


@query(
    "q_k32_ladder",
    with_panels("ret")
    + ", rungs(symbol, rung, pos) AS (VALUES " + ", ".join(f"('{s}', '{r}', {i})" for i, (s, r) in enumerate(_RUNGS.items())) + ")"
    + """, y AS (SELECT rung, pos, a.date, a.r AS y, b.r AS x FROM ret a JOIN rungs USING (symbol) JOIN ret b ON a.date = b.date AND b.symbol = 'NO' WHERE a.r IS NOT NULL AND b.r IS NOT NULL),
    f AS (SELECT rung, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, regr_r2(y, x) AS r2, count(*) AS n, sum(x) AS sx, sum(x * x) AS sxx FROM y GROUP BY 1),
    u AS (SELECT rung, row_number() OVER (PARTITION BY rung ORDER BY date) AS i, y - a - b * x AS u, (y - a - b * x) * x AS v FROM y JOIN f USING (rung)),
    s AS (SELECT p.rung, sum(CASE WHEN k = 0 THEN 1 ELSE 2 * (1 - k / 6.0) END * p.u * q.u) AS uu, sum(CASE WHEN k = 0 THEN 1 ELSE (1 - k / 6.0) END * (p.u * q.v + CASE WHEN k = 0 THEN 0 ELSE p.v * q.u END)) AS uv, sum(CASE WHEN k = 0 THEN 1 ELSE 2 * (1 - k / 6.0) END * p.v * q.v) AS vv
      FROM u p, range(0, 6) t(k) JOIN u q ON q.rung = p.rung AND q.i = p.i - k GROUP BY 1),
    i AS (SELECT rung, stddev_samp(u) * sqrt(252) AS idio FROM u GROUP BY 1),
    c AS (SELECT rung, date, product(1 + y) OVER (PARTITION BY rung ORDER BY date) AS e FROM y), d AS (SELECT *, e / max(e) OVER (PARTITION BY rung ORDER BY date) - 1 AS dd FROM c),
    w AS (SELECT rung, min(dd) AS fall, pow(arg_max(e, date) / arg_min(e, date), 365.25 / date_diff('day', min(date), max(date))) - 1 AS growth FROM d GROUP BY 1),
    t AS (SELECT rung, n, a * 252 / idio AS appraisal, a * 252 AS alpha_ann, a / sqrt((sxx * sxx * uu - 2 * sx * sxx * uv + sx * sx * vv) / pow(n * sxx - sx * sx, 2)) AS t, r2, idio, growth / abs(fall) AS calmar, fall FROM f JOIN s USING (rung) JOIN i USING (rung) JOIN w USING (rung))
    SELECT rung, n, round(appraisal, 5) AS appraisal, round(alpha_ann, 6) AS alpha_ann, round(t, 5) AS t_alpha_hac, round(r2, 6) AS r2, round(idio, 6) AS idio_vol_ann, round(calmar, 5) AS calmar, round(fall, 6) AS max_drawdown,
      rung <> 'HRP_BL_AI_NONPIT' AS deployable, CASE rung WHEN 'HRP_BL_AI_PIT' THEN round(appraisal - (SELECT appraisal FROM t WHERE rung = 'HRP_BL_FIXED'), 5) END AS over_fixed, CASE rung WHEN 'HRP_BL_AI_PIT' THEN round(appraisal - (SELECT appraisal FROM t WHERE rung = 'OVERLAY_CONTROL'), 5) END AS over_control FROM t""",
)
def rungs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Skill and risk shape of five rungs against a factor, what the view adds over the fixed one and over the control, and which rungs may be deployed."""
    r = P.returns(spark, sf_dir).where("r is not null").select("symbol", AT, "r")
    t = ladder(r.where(F.col("symbol").isin(*_RUNGS)).select(C.mapped("symbol", _RUNGS).alias("rung"), AT, "r"), r.where("symbol = 'NO'").select(AT, F.col("r").alias("no")))
    of = lambda name: F.max(F.when(F.col("rung") == name, F.col("appraisal")))
    base = t.agg(of("HRP_BL_FIXED").alias("_fixed"), of("OVERLAY_CONTROL").alias("_control"))  # one row
    view = F.col("rung") == "HRP_BL_AI_PIT"
    t = t.crossJoin(F.broadcast(base))
    return t.select(
        "rung", "n", *(F.round(c, d).alias(c) for c, d in (("appraisal", 5), ("alpha_ann", 6), ("t_alpha_hac", 5), ("r2", 6), ("idio_vol_ann", 6), ("calmar", 5), ("max_drawdown", 6))),
        (F.col("rung") != _DIAGNOSTIC).alias("deployable"), F.when(view, F.round(F.col("appraisal") - F.col("_fixed"), 5)).alias("over_fixed"), F.when(view, F.round(F.col("appraisal") - F.col("_control"), 5)).alias("over_control"),
    )


# ---------------------------------------------------------------- searches over settings


def saved(df: DataFrame, spark: SparkSession) -> DataFrame:
    """A table that the rounds of a search read again."""
    path = new_folder(spark, "search")
    df.write.parquet(path)
    return spark.read.parquet(path)


def _numbers(row, names: tuple[str, ...]) -> dict:
    """Values of a row; what is no finite number is None."""
    return {n: None if row[n] is None or not np.isfinite(row[n]) else float(row[n]) for n in names}


_LEVERS = {"blend": (0.20, 0.25, 0.35, 0.40), "conviction": (0.5, 0.75), "exposure": (0.8,)}


def blend_scores(lines: DataFrame, settings: list[dict]) -> list[dict]:
    """Appraisal, drawdown and gates of every setting on daily lines (date, base, view, cash, control): one job for all of them."""
    spark = lines.sparkSession
    rows = spark.createDataFrame([(i, float(s["blend"]), float(s["conviction"]), float(s["exposure"])) for i, s in enumerate(settings)], "i long, blend double, conviction double, exposure double")
    share = F.col("blend") * F.col("conviction")
    risky = share * F.col("view") + (1 - share) * F.col("base")
    x = lines.crossJoin(F.broadcast(rows)).select("i", AT, "cash", (F.col("exposure") * risky + (1 - F.col("exposure")) * F.col("cash")).alias("r"), "base", "control")  # settings of a round
    w = S.upto(["i"], AT)
    x = x.withColumns({"e": F.product(1 + F.col("r")).over(w), "b": F.product(1 + F.col("base")).over(w)})
    x = x.withColumns({"fall": F.col("e") / F.greatest(F.lit(1.0), F.max("e").over(w)) - 1, "base_fall": F.col("b") / F.greatest(F.lit(1.0), F.max("b").over(w)) - 1})
    ratio = lambda c: F.avg(F.col(c) - F.col("cash")) / F.nullif(F.stddev_samp(F.col(c) - F.col("cash")), F.lit(0.0)) * F.sqrt(F.lit(252.0))
    got = x.groupBy("i").agg(ratio("r").alias("value"), ratio("control").alias("control"), F.min("fall").alias("maxdd"), F.min("base_fall").alias("base_maxdd")).orderBy("i").collect()  # a row a setting
    out = []
    for row in got:
        n = _numbers(row, ("value", "control", "maxdd", "base_maxdd"))
        ok = None not in n.values() and n["maxdd"] >= n["base_maxdd"] - 0.05 and n["value"] > n["control"]
        out.append({"value": n["value"], "maxdd": n["maxdd"], "passed": ok})
    return out


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = P.returns(spark, sf_dir).where("r is not null")
    pick = lambda s, c: F.max(F.when(F.col("symbol") == s, F.col("r"))).alias(c)
    return r.groupBy(AT).agg(pick("AF", "base"), pick("RF", "view"), pick("NO", "cash"), pick("AO", "control")).dropna()


_BLEND_SEED = {"blend": 0.30, "conviction": 1.0, "exposure": 1.0}


@query("q_k33_search")
def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger of the search over the blend of two lines: a change must beat the best appraisal, pass the drawdown gate and beat a control line."""
    lines = saved(_lines(spark, sf_dir), spark)
    _, ledger = keep_or_revert(_BLEND_SEED, _LEVERS, lambda settings: blend_scores(lines, settings), dry=8)
    return spark.createDataFrame([(e["iteration"], e["lever"], e["to"], e["value"], e["maxdd"], e["passed"], e["decision"]) for e in ledger], "iteration long, lever string, value string, appraisal double, maxdd double, passed boolean, decision string")


# ---------------------------------------------------------------- regime and crowding caps

_LIMITS = {"bull": (1.0, 0.9, 0.8), "neutral": (1.0, 0.9, 0.8), "bear": (1.0, 0.8, 0.5)}
_CAP_SEED = {"lam": 50.0, "signal": "absorption", "window": 252, "scale": 1.0, "floor": 0.4, "arm": None}
_CAP_LEVERS = {"lam": (20.0, 100.0), "window": (126, 504), "signal": ("turbulence", "absorption"), "scale": (0.9, 1.1, 1.2, 1.3), "floor": (0.5, 0.3), "arm": (None, -0.02, -0.03, -0.04, -0.05)}
_BUDGET, _DRY, _MOST = 0.035, 12, 60
# the values above are fixed; the window below lies in the years of the tables
_DEV = (date(1996, 1, 2), date(1999, 6, 30))


def monthly_labels(line: DataFrame, penalties: tuple[float, ...]) -> DataFrame:
    """(lam, month, regime): the jump model's label on the rows (date, level) strictly before the first session of every month, neutral below 504 of them or where its states are close.

    The line is copied once a penalty; every month reads a prefix of it, so what is shuffled grows with the line alone.
    """
    f = S.jump_features(line.withColumn("k", F.lit(1)), ["k"], AT, "level")  # one line

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        month = pd.to_datetime(pdf.date).dt.to_period("M").dt.to_timestamp().dt.date.to_numpy()
        at = np.flatnonzero(np.r_[True, month[1:] != month[:-1]])
        lam = float(pdf.lam.iloc[0])
        return pd.DataFrame({"lam": lam, "month": month[at], "regime": K.walked_regimes(pdf[["a", "b", "c"]].to_numpy(), at.tolist(), lam)})

    copies = f.withColumn("lam", F.explode(F.array(*(F.lit(float(x)) for x in penalties))))
    return copies.groupBy("lam").applyInPandas(run, "lam double, month date, regime string")


def monthly_buckets(r: DataFrame, windows: tuple[int, ...]) -> DataFrame:
    """(signal, window, month, bucket): third of its own history in which the crowding signal of the session before a month's first one lies; the middle one for fewer than 252 values."""
    parts = []
    for size in windows:
        absorbed = slid(r, size, 5, size - 1, K.absorption)
        turbulent = slid(r, size + 1, 1, 0, lambda x: K.turbulence(x[:-1], x[-1]))
        parts += [absorbed.select(F.lit("absorption").alias("signal"), F.lit(size).alias("window"), AT, "value"), turbulent.select(F.lit("turbulence").alias("signal"), F.lit(size).alias("window"), AT, "value")]
    got = parts[0]
    for p in parts[1:]:
        got = got.unionAll(p)
    # every session, so that the fifth ones are carried forward
    days = sessions_of(r).select(AT)
    kinds = got.select("signal", "window").distinct()
    grid = days.crossJoin(F.broadcast(kinds)).join(got, ["signal", "window", AT], "left")  # six signals
    upto = Window.partitionBy("signal", "window").orderBy(AT).rowsBetween(Window.unboundedPreceding, 0)
    known = grid.withColumn("value", F.last(F.when(~F.isnan("value"), F.col("value")), ignorenulls=True).over(upto))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        v = pdf.value.to_numpy(float)
        have = ~np.isnan(v)
        bucket = np.ones(len(v), np.int64)
        rank, n = K.expanding_rank(v[have]), np.arange(1, have.sum() + 1)
        bucket[have] = np.where(n >= 252, np.minimum(np.floor(rank / n * 3), 2), 1)
        late = np.r_[1, bucket[:-1]]
        month = pd.to_datetime(pdf.date).dt.to_period("M").dt.to_timestamp().dt.date
        first = np.r_[True, month.to_numpy()[1:] != month.to_numpy()[:-1]]
        return pd.DataFrame({"signal": pdf.signal, "window": pdf.window, "month": month, "bucket": late})[first]

    return known.groupBy("signal", "window").applyInPandas(one, "signal string, window int, month date, bucket long")


def monthly_control(r: DataFrame) -> DataFrame:
    """(month, control): exposure by the weighted correlation of the risky lines over 252 sessions strictly before a month's first one."""
    days = sessions_of(r)
    first = days.withColumn("n", F.row_number().over(Window.partitionBy(F.trunc(AT, "MM")).orderBy(AT))).where("n = 1").select(F.trunc(AT, "MM").alias("month"), F.col("pos").alias("end"))
    inside = days.join(F.broadcast(first), (F.col("pos") < F.col("end")) & (F.col("pos") >= F.col("end") - 252))  # a date a month

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        w = pdf.pivot(index="date", columns="symbol", values="r").sort_index()
        return pd.DataFrame({"month": [pdf.month.iloc[0]], "c": [K.mean_correlation(w.to_numpy(), 10.0)]})

    c = r.where("symbol in ('AF', 'NF', 'RF')").join(inside.select("month", AT), AT).groupBy("month").applyInPandas(one, "month date, c double")
    scale = F.when(F.col("c").isNull() | F.isnan("c"), 1.0).otherwise(C.correlation_scale("c"))
    return c.select("month", C.clip(scale, 0.4, 1.0).alias("control"))


def cap_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sessions, labels, buckets): sessions (date, month, line, cash, control) of the priced line, and what its caps are looked up by."""
    r = saved(_returns(spark, sf_dir), spark)
    windows = (int(_CAP_SEED["window"]), *_CAP_LEVERS["window"])
    line = P.px_index(spark, sf_dir).where("symbol = 'AF'").select(AT, "level")
    labels = saved(monthly_labels(line, (float(_CAP_SEED["lam"]), *_CAP_LEVERS["lam"])), spark)
    buckets = saved(monthly_buckets(r, windows), spark)
    pick = lambda s, c: F.max(F.when(F.col("symbol") == s, F.col("r"))).alias(c)
    days = r.groupBy(AT).agg(pick("AF", "line"), pick("NO", "cash")).dropna().withColumn("month", F.trunc(AT, "MM"))
    return saved(days.join(monthly_control(r), "month", "left").na.fill(1.0, ["control"]), spark), labels, buckets


def exposures(inputs: tuple[DataFrame, DataFrame, DataFrame], settings: list[dict]) -> DataFrame:
    """(i, date, line, cash, control, target, exposure) of every setting: the cap of regime and crowding, in force while the line's last fall was below the arming level."""
    days, labels, buckets = inputs
    spark = days.sparkSession
    kinds = "i long, lam double, signal string, window int, scale double, floor double, arm double"
    rows = spark.createDataFrame([(i, s["lam"], s["signal"], s["window"], s["scale"], s["floor"], s["arm"]) for i, s in enumerate(settings)], kinds)
    table = spark.createDataFrame([(k, b, v) for k, row in _LIMITS.items() for b, v in enumerate(row)], "regime string, bucket long, limit double")
    months = days.select("month").distinct().crossJoin(F.broadcast(rows))  # months times settings of a round
    months = months.join(labels, ["lam", "month"], "left").join(buckets, ["signal", "window", "month"], "left").na.fill({"regime": "neutral", "bucket": 1})
    months = months.join(F.broadcast(table), ["regime", "bucket"])
    target = F.greatest(F.col("floor"), F.least(F.lit(1.0), F.col("limit") * F.col("scale")))
    w = S.upto(["i"], AT)
    x = days.join(months.select("i", "month", "arm", target.alias("target")), "month")
    x = x.withColumn("e", F.product(1 + F.col("line")).over(w))
    x = x.withColumn("fall", F.col("e") / F.greatest(F.lit(1.0), F.max("e").over(w)) - 1)
    x = x.withColumn("late", F.coalesce(F.lag("fall").over(S.ordered(["i"], AT)), F.lit(0.0)))
    held = F.when(F.col("arm").isNull() | (F.col("late") < F.col("arm")), F.col("target")).otherwise(1.0)
    return x.select("i", AT, "line", "cash", "control", "target", held.alias("exposure"))


def development(x: DataFrame, value: str) -> DataFrame:
    """(i, cagr, maxdd, n) of the returns of a column within the development window, from the session before it."""
    w = S.upto(["i"], AT)
    anchor = x.groupBy("i").agg(F.max(F.when(F.col(AT) < _DEV[0], F.col(AT))).alias("anchor"))
    d = x.where(F.col(AT).between(*_DEV)).withColumn("e", F.product(1 + F.col(value)).over(w))
    d = d.withColumn("fall", F.col("e") / F.greatest(F.lit(1.0), F.max("e").over(w)) - 1)
    g = d.groupBy("i").agg(F.max_by("e", AT).alias("growth"), F.max(AT).alias("last"), F.min("fall").alias("maxdd"), F.count("*").alias("n")).join(anchor, "i")
    return g.select("i", (F.pow("growth", 365.25 / F.datediff("last", "anchor")) - 1).alias("cagr"), "maxdd", "n")


def cap_scores(inputs: tuple[DataFrame, DataFrame, DataFrame], settings: list[dict]) -> list[dict]:
    """Development growth, fall and ratio of every setting with the gates: growth at most a budget below the bare line's, and no deeper fall than the control's."""
    x = exposures(inputs, settings)
    mixed = lambda e: F.col(e) * F.col("line") + (1 - F.col(e)) * F.col("cash")
    x = x.withColumns({"capped": mixed("exposure"), "steady": mixed("control")})
    bare, control = development(x, "line"), development(x, "steady")
    m = development(x, "capped").join(bare.select("i", F.col("cagr").alias("line_cagr")), "i").join(control.select("i", F.col("maxdd").alias("control_maxdd")), "i")
    by = {r["i"]: r for r in m.collect()}  # a row a setting
    out = []
    for i in range(len(settings)):
        n = _numbers(by[i], ("cagr", "maxdd", "line_cagr", "control_maxdd")) if i in by else dict.fromkeys(("cagr", "maxdd", "line_cagr", "control_maxdd"))
        known = None not in n.values()
        ratio = n["cagr"] / abs(n["maxdd"]) if known and n["maxdd"] < 0 else None
        ok = known and n["cagr"] >= n["line_cagr"] - _BUDGET and n["maxdd"] >= n["control_maxdd"]
        out.append({"value": ratio, "cagr": n["cagr"], "maxdd": n["maxdd"], "passed": ok})
    return out


def select_caps(inputs: tuple[DataFrame, DataFrame, DataFrame]) -> tuple[dict, list[dict]]:
    return keep_or_revert(_CAP_SEED, _CAP_LEVERS, lambda settings: cap_scores(inputs, settings), _DRY, _MOST)


@query("q_k34_selection")
def selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger of the search over regime and crowding caps; sessions after the development window cannot change it."""
    _, ledger = select_caps(cap_inputs(spark, sf_dir))
    rows = [(e["iteration"], e["lever"], e["to"], e["cagr"], e["maxdd"], e["value"], e["passed"], e["decision"]) for e in ledger]
    return spark.createDataFrame(rows, "iteration long, lever string, value string, dev_cagr double, dev_maxdd double, dev_calmar double, passed boolean, decision string")


@query("q_k35_stream")
def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target exposure of the chosen caps on every session, with the exposure they hold and the control's."""
    inputs = cap_inputs(spark, sf_dir)
    best, _ = select_caps(inputs)
    return exposures(inputs, [best]).select(AT, F.col("target").alias("target_exposure"), "exposure", F.col("control").alias("control_exposure"))
