"""Append-mode streams fed file by file: late rows, open periods, state that goes, labels that stay."""

from __future__ import annotations

import json
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from panelloom.streaming import stateful as T

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"
DAY = datetime(2024, 1, 1)


def at(days, hours=0.0):
    return DAY + timedelta(days=days, hours=hours)


class Feed:
    """A folder that grows by one file at a time, and a stream over it that is drained after each."""

    def __init__(self, spark, tmp_path, build, schema=SCHEMA):
        self.spark, self.folder, self.schema = spark, str(tmp_path), schema
        spark.createDataFrame([], schema).write.parquet(f"{self.folder}/in")
        self.out = build(spark.readStream.schema(schema).parquet(f"{self.folder}/in"))
        self.n = 0

    def push(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        self.run = T.run_append(self.out, self.folder)
        return Counter(tuple(r) for r in T.written_rows(self.spark, self.out, self.folder).collect())

    def state_rows(self):
        return sum(o["numRowsTotal"] for o in json.loads(self.run.lastProgress.json)["stateOperators"])


def test_a_day_leaves_once_and_late_rows_go(spark, tmp_path):
    feed = Feed(spark, tmp_path, T.closed_days)
    day = lambda d: at(d).date()
    assert feed.push([(1, at(0, 1), 1, "a", 1.0), (2, at(0, 2), 1, "a", 2.0), (3, at(1, 1), 1, "a", 4.0)]) == {}  # nothing is a day behind
    assert feed.push([(4, at(2, 3), 1, "a", 8.0)]) == {(day(0), "a", 2, 3.0): 1}
    late = feed.push([(5, at(0, 5), 1, "a", 100.0), (6, at(1, 23), 1, "a", 16.0)])  # the first is behind the watermark, the second is not
    assert late == {(day(0), "a", 2, 3.0): 1}
    assert feed.push([(7, at(9), 1, "b", 1.0)]) == {(day(0), "a", 2, 3.0): 1, (day(1), "a", 2, 20.0): 1, (day(2), "a", 1, 8.0): 1}
    assert feed.state_rows() == 1  # the open day


def test_a_session_leaves_when_no_row_can_extend_it(spark, tmp_path):
    feed = Feed(spark, tmp_path, T.closed_sessions)
    us = lambda t: int((t - datetime(1970, 1, 1)).total_seconds() * 1e6)
    assert feed.push([(1, at(0, 1), 7, "a", 1.0), (2, at(0, 1.25), 7, "a", 1.0)]) == {}
    assert feed.push([(3, at(0, 1.5), 7, "a", 1.0), (4, at(3), 7, "a", 1.0)]) == {(7, us(at(0, 1)), us(at(0, 2)), 3): 1}
    assert feed.state_rows() == 1


def test_pairs_within_three_days(spark, tmp_path):
    feed = Feed(spark, tmp_path, lambda e: T.recent_pairs(e.where("event_type = 'purchase'"), e.where("event_type = 'view'")))
    rows = [(1, at(0), 1, "view", 1.0), (2, at(2), 1, "view", 2.0), (3, at(3), 1, "purchase", 0.0), (4, at(3), 2, "purchase", 0.0), (5, at(3), 1, "view", 3.0), (6, at(2, -1), None, "view", 1.0), (7, at(3), None, "purchase", 1.0)]
    got = feed.push(rows)
    assert {(r[0], r[3]) for r in got} == {(3, 1), (3, 2), (3, 5)}  # exactly three days old counts
    assert {(r[0], r[3]) for r in feed.push([(8, at(3, 1), 1, "purchase", 0.0)])} == {(3, 1), (3, 2), (3, 5), (8, 2), (8, 5)}
    feed.push([(9, at(20), 5, "view", 1.0), (10, at(20), 5, "purchase", 1.0)])
    before = feed.state_rows()
    after = feed.push([(11, at(3, 2), 1, "purchase", 0.0)])  # behind both watermarks
    assert not any(r[0] == 11 for r in after)
    assert before <= 2  # what was bounded out is gone
    best = {r.left_id: (r.value, r.right_id, r.fresh) for r in T.latest_of(T.written_rows(spark, feed.out, feed.folder)).collect()}
    assert best == {3: (3.0, 5, 3), 8: (3.0, 5, 2), 10: (1.0, 9, 1)}


def test_distinct_keys_of_bounded_age(spark, tmp_path):
    feed = Feed(spark, tmp_path, lambda e: T.first_of_each(e, "user_id", "event_type"))
    assert feed.push([(1, at(0), 1, "a", 1.0), (2, at(0, 1), 1, "a", 2.0), (3, at(0, 1), 1, "b", 2.0)]) == {(1, "a"): 1, (1, "b"): 1}
    assert feed.push([(4, at(0, 3), 1, "a", 1.0)]) == {(1, "a"): 1, (1, "b"): 1}  # within the bound, in another batch
    assert feed.state_rows() == 2
    feed.push([(5, at(9), 9, "z", 1.0)])
    assert feed.state_rows() == 1  # old keys are forgotten
    assert feed.push([(6, at(9), 1, "a", 1.0)])[(1, "a")] == 2


def test_labels_are_carried_in_event_time(spark, tmp_path):
    schema = "key string, ts timestamp, label string, x double"
    with T.with_rocks(spark):
        feed = Feed(spark, tmp_path, T.carried, schema)
        assert feed.push([("k", at(5), None, 5.0), ("k", at(1), "one", None), ("k", at(0), None, 0.0), ("j", at(2), None, 2.0)]) == {("k", at(0), None, 0.0): 1, ("j", at(2), None, 2.0): 1}  # the value at day 5 waits
        got = feed.push([("k", at(5), "five", None), ("k", at(5), None, 5.0), ("k", at(4, 12), "four", None), ("j", at(8), None, 8.0), ("k", at(20), None, 20.0)])
        expected = {("k", at(0), None, 0.0): 1, ("k", at(5), "five", 5.0): 2, ("j", at(2), None, 2.0): 1, ("j", at(8), None, 8.0): 1}
        assert got == expected
        got = feed.push([("k", at(40), None, 40.0), ("k", at(3), "late", None)])
        assert got == {**expected, ("k", at(20), "five", 20.0): 1}


def test_order_of_arrival_does_not_matter(spark, tmp_path_factory):
    schema = "key string, ts timestamp, label string, x double"
    rows = [("k", at(d), f"l{d}" if d % 3 == 0 else None, None if d % 3 == 0 else float(d)) for d in range(12)]
    end = [("", at(90), None, None)]
    with T.with_rocks(spark):
        found = []
        for cut in (rows, rows[::-1]):
            feed = Feed(spark, tmp_path_factory.mktemp("feed"), T.carried, schema)
            feed.push(cut)
            found.append(feed.push(end))
    assert found[0] == found[1]
    assert {(t.day, label, x) for _, t, label, x in found[0]} == {(d + 1, f"l{d - d % 3}", float(d)) for d in range(12) if d % 3}


@pytest.mark.parametrize("name", ["closed_days", "closed_sessions"])
def test_empty_stream(spark, tmp_path, name):
    assert Feed(spark, tmp_path, getattr(T, name)).push([]) == {}
