"""Structured Streaming over the events table; each job equals its batch form once the input is drained."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.registry import query
from ..sources.scratch import new_folder


def _drained(spark: SparkSession, sf_dir: str, build) -> DataFrame:
    """Run a streaming job over the table's file until it is drained; every batch is written as Parquet by the executors, and the last one read."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "false").parquet(sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    folder, out, done = new_folder(spark, "stream"), build(source), []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch-{number}")
        done.append(number)

    run = out.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/batch-{max(done)}") if done else spark.createDataFrame([], out.schema)


def daily(events: DataFrame) -> DataFrame:
    w = F.window("ts", "1 day")
    return events.withWatermark("ts", "1 day").groupBy(w, "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.to_date("window.start").alias("day"), "event_type", "n", "total")


def sliding(events: DataFrame) -> DataFrame:
    w = F.window("ts", "5 days", "1 day")
    return events.withWatermark("ts", "1 day").groupBy(w).agg(F.count("*").alias("n")).select(F.to_date("window.start").alias("first_day"), "n")


def sessions(events: DataFrame) -> DataFrame:
    w = F.session_window("ts", "30 minutes")
    return events.withWatermark("ts", "1 day").groupBy(w, "user_id").agg(F.count("*").alias("n")).select("user_id", F.unix_micros("session_window.start").alias("start_us"), F.unix_micros("session_window.end").alias("end_us"), "n")


@query("q_stream_daily", "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drained(spark, sf_dir, daily)


@query("q_stream_sliding", "SELECT first_day, count(*) AS n FROM (SELECT CAST(ts AS DATE) - CAST(k AS INTEGER) AS first_day FROM events, range(0, 5) t(k)) GROUP BY 1")
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drained(spark, sf_dir, sliding)


@query(
    "q_stream_sessions",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 30 MINUTE) AS end_us, count(*) AS n FROM s GROUP BY user_id, k""",
)
def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of half an hour of silence, with their bounds."""
    return _drained(spark, sf_dir, sessions)
