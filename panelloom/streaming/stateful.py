"""Streams in append mode: closed windows, an interval join, distinct keys of bounded age, and labels held by key.

A row is written once, when the watermark says that nothing can change it any more;
state that the watermark has passed is dropped.  So each result equals a batch
statement over the rows whose time the watermark ``max(ts) - DELAY`` has passed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..plans import relational_queries as R
from ..plans.registry import ORACLES, query, rounded
from ..sources import panels as P
from ..sources.scratch import new_folder

DELAY = "1 day"
STALE_DAYS = 3
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def run_append(out: DataFrame, folder: str) -> StreamingQuery:
    """Drain what is there into Parquet files under ``folder``; a later call with the same folder goes on from there."""
    run = out.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/rows").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return run


def written_rows(spark: SparkSession, out: DataFrame, folder: str) -> DataFrame:
    return spark.read.schema(out.schema).parquet(f"{folder}/rows")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = P.table(spark, sf_dir, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "false").parquet(sf_dir)
    return source.withColumn("ts", F.col("ts").cast("timestamp"))


def _drained(spark: SparkSession, sf_dir: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    folder, out = new_folder(spark, "append"), build(events(spark, sf_dir))
    run_append(out, folder)
    return written_rows(spark, out, folder)


# ---------------------------------------------------------------- closed windows


def closed_days(rows: DataFrame) -> DataFrame:
    """Counts and totals of days that are over; an open day is withheld, a row later than the watermark is left out."""
    w = F.window("ts", "1 day")
    return rows.withWatermark("ts", DELAY).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.to_date("window.start").alias("day"), "event_type", "n", "total")


def closed_sessions(rows: DataFrame) -> DataFrame:
    """Sessions of half an hour of silence that no row within the delay can extend."""
    w = F.session_window("ts", "30 minutes")
    return rows.withWatermark("ts", DELAY).groupBy(w, "user_id").agg(F.count("*").alias("n")).select("user_id", F.unix_micros("session_window.start").alias("start_us"), F.unix_micros("session_window.end").alias("end_us"), "n")


_CLOSED = "(SELECT max(ts) - INTERVAL 1 DAY FROM events)"


@query("q_stream_closed_days", f"SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= {_CLOSED} GROUP BY 1, 2")
def stream_closed_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drained(spark, sf_dir, closed_days)


@query(
    "q_stream_closed_sessions",
    f"""WITH g AS (SELECT user_id, ts, CASE WHEN ts <= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 30 MINUTE) AS end_us, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 30 MINUTE <= {_CLOSED}""",
)
def stream_closed_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drained(spark, sf_dir, closed_sessions)


# ---------------------------------------------------------------- interval join


def recent_pairs(left: DataFrame, right: DataFrame, days: int = STALE_DAYS) -> DataFrame:
    """Every left row with the right rows of its user at or before it and no older than ``days``; the bound lets Spark drop both sides' state behind the watermark."""
    x = left.select("user_id", F.col("event_id").alias("left_id"), F.col("ts").alias("at")).withWatermark("at", DELAY)
    y = right.select(F.col("user_id").alias("right_user"), F.col("ts").alias("seen"), F.col("event_id").alias("right_id"), F.col("value").alias("right_value")).withWatermark("seen", DELAY)
    near = (F.col("user_id") == F.col("right_user")) & (F.col("seen") <= F.col("at")) & (F.col("seen") >= F.col("at") - F.expr(f"INTERVAL {days} DAYS"))
    return x.join(y, near).select("left_id", "at", "seen", "right_id", "right_value")


def latest_of(pairs: DataFrame) -> DataFrame:
    """The as-of value of every left row that has one: the latest right row, of several at one time the one with the greatest id."""
    return pairs.groupBy("left_id").agg(F.max_by("right_value", F.struct("seen", "right_id")).alias("value"), F.max(F.struct("seen", "right_id"))["right_id"].alias("right_id"), F.count("*").alias("fresh"))


@query(
    "q_stream_interval_join",
    f"""SELECT l.event_id AS left_id, arg_max(r.value, (r.ts, r.event_id)) AS value, arg_max(r.event_id, (r.ts, r.event_id)) AS right_id, count(*) AS fresh
    FROM events l JOIN events r ON r.user_id = l.user_id AND r.ts <= l.ts AND r.ts >= l.ts - INTERVAL {STALE_DAYS} DAY WHERE l.event_type = 'purchase' AND r.event_type = 'view' GROUP BY 1""",
)
def stream_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last view before every purchase that is at most three days old, from two streams."""
    folder = new_folder(spark, "append")
    out = recent_pairs(events(spark, sf_dir).where("event_type = 'purchase'"), events(spark, sf_dir).where("event_type = 'view'"))
    run_append(out, folder)
    return latest_of(written_rows(spark, out, folder))


# ---------------------------------------------------------------- distinct keys


def first_of_each(rows: DataFrame, *keys: str) -> DataFrame:
    """The keys of rows whose like was not seen within the delay; a key's state goes when the watermark passes it."""
    return rows.withWatermark("ts", DELAY).dropDuplicatesWithinWatermark(list(keys)).select(*keys)


@query("q_stream_distinct", "SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day FROM events")
def stream_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence keys (user, kind, day) once each: repeats of a key lie within a day, which is the bound of the state."""
    return _drained(spark, sf_dir, lambda e: first_of_each(e.withColumn("day", F.to_date("ts")), "user_id", "event_type", "day"))


# ---------------------------------------------------------------- keyed state


class LastLabel(StatefulProcessor):
    """Carries a key's last label forward in event time.

    Rows wait in a map state until the watermark passes them, so that labels and
    values may arrive in any order within the delay; a timer at the earliest waiting
    time wakes the key.  Only the waiting rows and one label are kept.  At equal
    times the label counts first, of several labels the greatest; values before any
    label have none; repeated values stay rows of their own.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.label = handle.getValueState("label", "label string")
        self.waiting = handle.getMapState("waiting", "at long", "label string, xs array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        had = {k[0] for k in self.waiting.keys()} if self.waiting.exists() else set()
        for pdf in rows:
            at = pdf["ts"].astype("datetime64[ms]").astype("int64")
            for t, part in pdf.groupby(at):
                label, xs = self.waiting.getValue((t,)) if t in had else (None, [])
                labels = part["label"].dropna()
                self.waiting.updateValue((t,), (labels.max() if len(labels) else label, [*xs, *part["x"].dropna().tolist()]))
                had.add(t)
        self._wake(had)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        label = self.label.get()[0] if self.label.exists() else None
        out, left = [], set()
        for (t,), (new, xs) in sorted(self.waiting.iterator()):
            if t > passed:
                left.add(t)
                continue
            label = new or label
            out += [(key[0], pd.Timestamp(t, unit="ms"), label, x) for x in xs]
            self.waiting.removeKey((t,))
        if label is not None:
            self.label.update((label,))
        self._wake(left)
        yield pd.DataFrame(out, columns=["key", "ts", "label", "x"])

    def _wake(self, waiting: set[int]) -> None:
        first = min(waiting, default=None)
        for old in list(self.handle.listTimers()):
            if old != first:
                self.handle.deleteTimer(old)
        if first is not None:
            self.handle.registerTimer(first)

    def close(self) -> None:
        pass


def carried(rows: DataFrame) -> DataFrame:
    """(key, ts, label, x) of every value row of (key, ts, label, x), with the last label at or before it; rows leave when the watermark has passed them."""
    late = rows.withWatermark("ts", DELAY)
    return late.groupBy("key").transformWithStateInPandas(LastLabel(), "key string, ts timestamp, label string, x double", "Append", "EventTime")


class with_rocks:  # noqa: N801
    """User-defined state lives in the RocksDB store; the session's own choice comes back afterwards."""

    NAME = "spark.sql.streaming.stateStore.providerClass"

    def __init__(self, spark: SparkSession):
        self.conf = spark.conf

    def __enter__(self) -> None:
        self.was = self.conf.get(self.NAME, None)
        self.conf.set(self.NAME, _ROCKS)

    def __exit__(self, *_: object) -> None:
        self.conf.unset(self.NAME) if self.was is None else self.conf.set(self.NAME, self.was)


@query("q_stream_label_state", ORACLES["q_j12_label_ffill"])
def stream_label_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean return by symbol and regime: months' labels and sessions' returns are two kinds of rows of one stream, and the label is held by symbol.

    A closing row a month after the last one makes the watermark pass all others.
    """
    px = P.returns(spark, sf_dir).where("r is not null").select(F.col("symbol").alias("key"), F.col("date").cast("timestamp").alias("ts"), F.lit(None).cast("string").alias("label"), F.col("r").alias("x"))
    months = R.regime_months(spark, sf_dir).select(F.col("month").cast("timestamp").alias("ts"), F.col("regime").alias("label"))
    marks = months.crossJoin(F.broadcast(px.select("key").distinct())).select("key", "ts", "label", F.lit(None).cast("double").alias("x"))  # a row a month and symbol
    folder = new_folder(spark, "append")
    px.unionByName(marks).write.mode("append").parquet(f"{folder}/input")
    spark.read.parquet(f"{folder}/input").agg(F.lit("").alias("key"), (F.max("ts") + F.expr("INTERVAL 1 MONTH")).alias("ts"), F.lit("end").alias("label"), F.lit(None).cast("double").alias("x")).write.parquet(f"{folder}/end")
    schema = px.schema
    with with_rocks(spark):
        out = carried(spark.readStream.schema(schema).parquet(f"{folder}/input"))
        run_append(out, folder)
        spark.read.schema(schema).parquet(f"{folder}/end").write.mode("append").parquet(f"{folder}/input")
        run_append(out, folder)
    got = written_rows(spark, out, folder)
    return rounded(got.groupBy(F.col("key").alias("symbol"), F.col("label").alias("regime")).agg(F.count("*").alias("n"), (F.avg("x") * 252).alias("ann")))
