"""Functions called by name from Spark SQL, each beside the plain statement for the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import named
from ..operators import series as S
from ..sources import panels as P
from ..sources.panels import with_panels
from .kernel_queries import _PATH, windows_of
from .registry import ORACLES, query, rounded
from .relational_queries import macro_scores

KEYS, AT = ["symbol"], "date"


def _by_name(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """Spark SQL over tables given by name, with this library's functions."""
    named.register(spark)
    return spark.sql(sql, **tables)


@query(
    "q_fn_reducers",
    with_panels("ret") + _PATH + " SELECT symbol, round(avg(path.s) / sqrt(any_value(lr.v)), 5) AS ssr, round(any_value(lr.v), 5) AS lr_var, any_value(lr.lags) AS lags FROM path JOIN lr USING (symbol) WHERE s IS NOT NULL GROUP BY symbol",
)
def reducers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stability ratio, long-run variance and bandwidth of each line as aggregates of a statement."""
    path = P.returns(spark, sf_dir).select("symbol", AT, "r", S.rolling_sharpe("r", S.trailing(KEYS, AT, 252), 252).alias("s"))
    got = _by_name(spark, "SELECT symbol, stability_ratio(date, r) AS ssr, long_run_variance(date, s) AS lr_var, plug_in_bandwidth(date, s) AS lags FROM {path} GROUP BY symbol", path=path)
    return rounded(got, 5)


@query(
    "q_k1_block_length",
    with_panels("ret")
    + """, z AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i, r - avg(r) OVER (PARTITION BY symbol) AS z FROM ret WHERE r IS NOT NULL),
    s AS (SELECT symbol, count(*) AS n, greatest(5, CAST(ceil(sqrt(log10(count(*)))) AS BIGINT)) AS run FROM z GROUP BY 1),
    b AS (SELECT symbol, n, run, least(n - 2, CAST(ceil(sqrt(n)) AS BIGINT) + run) AS most FROM s WHERE n >= 30),
    c AS (SELECT a.symbol, k, any_value(n) AS n, any_value(run) AS run, any_value(most) AS most, avg(a.z * o.z) AS g FROM z a JOIN b USING (symbol), LATERAL (SELECT unnest(range(0, most + 1)) AS k) t JOIN z o ON o.symbol = a.symbol AND o.i = a.i - k GROUP BY 1, 2),
    q AS (SELECT *, abs(g) < 2 * sqrt(log10(n) / n) * first_value(g) OVER (PARTITION BY symbol ORDER BY k) AS quiet FROM c),
    calm AS (SELECT symbol, min(k) - 1 AS at FROM (SELECT symbol, k, run, min(quiet::INT) OVER w AS quiet, count(*) OVER w AS m FROM q WHERE k > 0 WINDOW w AS (PARTITION BY symbol ORDER BY k ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) WHERE quiet = 1 AND m = run GROUP BY 1),
    wide AS (SELECT b.*, least(2 * coalesce(calm.at, most - run), most) AS width FROM b LEFT JOIN calm USING (symbol)),
    f AS (SELECT symbol, sum(CASE WHEN k = 0 THEN g END) + 2 * sum(CASE WHEN k > 0 AND k <= width THEN least(1, 2 * (1 - k / greatest(width, 1)::DOUBLE)) * g ELSE 0 END) AS power,
        sum(CASE WHEN k > 0 AND k <= width THEN k * least(1, 2 * (1 - k / greatest(width, 1)::DOUBLE)) * g ELSE 0 END) AS slope FROM c JOIN wide USING (symbol) GROUP BY 1)
    SELECT s.symbol, CAST(CASE WHEN s.n < 30 THEN greatest(1, s.n // 4) WHEN power <= 0 OR slope = 0 THEN 1
        ELSE greatest(1, least(ceil(least(3 * sqrt(s.n), s.n / 3.0)), round_even(pow(6 * slope * slope / (power * power) * s.n, 1.0 / 3), 0))) END AS BIGINT) AS block FROM s LEFT JOIN f USING (symbol)""",
)
def block_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The automatic block length of every line, as an aggregate called by name."""
    return _by_name(spark, "SELECT symbol, block_length(date, r) AS block FROM {r} GROUP BY symbol", r=P.returns(spark, sf_dir).where("r is not null"))


_CHECKS = {"rows": ("n >= 252", "n"), "dates": ("back = 0", "back"), "values": ("unknown = 0", "unknown"), "positive": ("low = 0", "low"), "gap": ("gap <= 5", "gap")}


@query(
    "q_fn_line_checks",
    with_panels("ord")
    + """, g AS (SELECT *, lag(date) OVER (PARTITION BY symbol ORDER BY date) AS p FROM ord),
    s AS (SELECT symbol AS line, count(*) AS n, count(*) FILTER (WHERE date <= p) AS back, count(*) FILTER (WHERE close IS NULL) AS unknown, count(*) FILTER (WHERE close <= 0) AS low, coalesce(max(date - p), 0) AS gap FROM g GROUP BY 1) """
    + " UNION ALL ".join(f'SELECT line, \'{name}\' AS "check", {rule} AS passed, CAST({value} AS VARCHAR) AS detail FROM s' for name, (rule, value) in _CHECKS.items()),
)
def line_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of every line by a table function over a partitioned table."""
    return _by_name(spark, "SELECT * FROM line_checks(TABLE(SELECT symbol, date, close FROM {px}) PARTITION BY symbol ORDER BY date)", px=P.px_orders(spark, sf_dir))


@query(
    "q_fn_rule_weights",
    with_panels("ret")
    + """, d AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS pos FROM (SELECT date FROM ret WHERE r IS NOT NULL GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT symbol) FROM ret))),
    e AS (SELECT date AS decided, pos FROM d WHERE pos % 60 = 0 AND pos >= 251),
    v AS (SELECT decided, symbol, 1 / stddev_samp(r) AS w FROM e JOIN d ON d.pos BETWEEN e.pos - 251 AND e.pos - 1 JOIN ret ON ret.date = d.date GROUP BY 1, 2)
    SELECT rule, decided, symbol AS line, round(CASE rule WHEN 'equal' THEN 1.0 / count(*) OVER w ELSE v.w / sum(v.w) OVER w END, 6) AS weight FROM v, (VALUES ('equal'), ('inverse_volatility')) t(rule) WINDOW w AS (PARTITION BY rule, decided)""",
)
def rule_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two weight rules by name at every 60th session on the 251 sessions before it."""
    r = P.returns(spark, sf_dir).where("r is not null").select("symbol", AT, "r")
    w = windows_of(r, 252, 60)
    w = w.join(w.groupBy("end").agg(F.max(AT).alias("decided")), "end")
    one = lambda rule: _by_name(spark, f"SELECT '{rule}' AS rule, * FROM rule_weights(TABLE(SELECT decided, date, symbol, r FROM {{w}}) PARTITION BY decided ORDER BY (date, symbol), '{rule}')", w=w)
    return rounded(one("equal").unionByName(one("inverse_volatility")))


@query("q_fn_regime_rule", ORACLES["q_f12_regimes"])
def regime_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule of regimes as a function of SQL."""
    return _by_name(spark, "SELECT month, regime_of(z_d, z_t, z_q) AS regime FROM {z}", z=macro_scores(spark, sf_dir))
