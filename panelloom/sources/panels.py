"""Long-form panels derived from the star-schema tables.

``px_line`` plays the price panel (one symbol for each return flag and line
status), ``px_index`` a damped level series of it, ``px_brand`` a wide universe,
``px_orders`` a panel with missing sessions, ``macro`` three monthly series and
``scores`` paired daily scores.  Scans read only the columns named here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def px_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, date, open, high, low, close, volume."""
    u = F.col("l_extendedprice") / F.col("l_quantity")
    first = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", u.alias("u"))
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.concat("l_returnflag", "l_linestatus").alias("symbol"), F.to_date("l_shipdate").alias("date"))
        .agg(F.min_by(u, first).alias("open"), F.max(u).alias("high"), F.min(u).alias("low"), F.avg(u).alias("close"), F.sum("l_quantity").alias("volume"))
    )


def px_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol (brand), date, close."""
    line = table(spark, sf_dir, "lineitem").select("l_partkey", F.to_date("l_shipdate").alias("date"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("u"))
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("symbol"))
    return line.join(part, "l_partkey").groupBy("symbol", "date").agg(F.avg("u").alias("close"))


def px_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol (priority), date, close: a calendar with missing sessions."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("symbol"), F.to_date("o_orderdate").alias("date")).agg(F.avg("o_totalprice").alias("close"))


def px_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, date, level: 100 times the product of 1 + 0.01 (close / mean close - 1)."""
    own = Window.partitionBy("symbol")
    step = 0.01 * (F.col("close") / F.avg("close").over(own) - 1)
    upto = own.orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return px_line(spark, sf_dir).select("symbol", "date", step.alias("g")).select("symbol", "date", (100 * F.product(1 + F.col("g")).over(upto)).alias("level"))


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, date, level, r of the index panel."""
    w = Window.partitionBy("symbol").orderBy("date")
    return px_index(spark, sf_dir).withColumn("r", F.col("level") / F.lag("level").over(w) - 1)


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    """month (first day), d, t, q: monthly means of discount, tax and quantity."""
    return table(spark, sf_dir, "lineitem").groupBy(F.trunc("l_shipdate", "MM").alias("month")).agg(F.avg("l_discount").alias("d"), F.avg("l_tax").alias("t"), F.avg("l_quantity").alias("q"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, day, pit, nonpit: mean scaled values of two event types; null where one is missing."""
    s = F.col("value") / (1 + F.abs("value"))
    return (
        table(spark, sf_dir, "events")
        .where(F.col("event_type").isin("view", "click"))
        .groupBy("user_id", F.to_date("ts").alias("day"))
        .agg(F.avg(F.when(F.col("event_type") == "view", s)).alias("pit"), F.avg(F.when(F.col("event_type") == "click", s)).alias("nonpit"))
    )


#: The same panels as DuckDB common table expressions.
SQL = {
    "px": """px AS (SELECT concat(l_returnflag, l_linestatus) AS symbol, CAST(l_shipdate AS DATE) AS date,
        first(l_extendedprice / l_quantity ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice / l_quantity) AS open,
        max(l_extendedprice / l_quantity) AS high, min(l_extendedprice / l_quantity) AS low,
        avg(l_extendedprice / l_quantity) AS close, sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2)""",
    "brand": """brand AS (SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS date, avg(l_extendedprice / l_quantity) AS close
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)""",
    "ord": """ord AS (SELECT o_orderpriority AS symbol, CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS close FROM orders GROUP BY 1, 2)""",
    "idx": """steps AS (SELECT symbol, date, 0.01 * (close / avg(close) OVER (PARTITION BY symbol) - 1) AS g FROM px),
        idx AS (SELECT symbol, date, 100 * product(1 + g) OVER (PARTITION BY symbol ORDER BY date) AS level FROM steps)""",
    "ret": """ret AS (SELECT symbol, date, level, level / lag(level) OVER (PARTITION BY symbol ORDER BY date) - 1 AS r FROM idx)""",
    "macro": """macro AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, avg(l_discount) AS d, avg(l_tax) AS t, avg(l_quantity) AS q FROM lineitem GROUP BY 1)""",
    "scores": """scores AS (SELECT user_id, CAST(ts AS DATE) AS day,
        avg(value / (1 + abs(value))) FILTER (WHERE event_type = 'view') AS pit, avg(value / (1 + abs(value))) FILTER (WHERE event_type = 'click') AS nonpit
        FROM events WHERE event_type IN ('view', 'click') GROUP BY 1, 2)""",
}
_NEEDS = {"idx": ["px"], "ret": ["px", "idx"]}


def with_panels(*names: str) -> str:
    """The WITH clause for the named panels and those they rest on."""
    order: list[str] = []
    for n in names:
        for x in [*_NEEDS.get(n, []), n]:
            if x not in order:
                order.append(x)
    return "WITH " + ",\n".join(SQL[x] for x in order)
