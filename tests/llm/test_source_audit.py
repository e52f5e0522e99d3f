"""The source audit against plain integers, for any number of seats and shards."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from panelloom.llm import source_audit as A

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
FIELDS = "text string, lang string, source string"


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t)


def plain(rows, least_docs=3, top=200):
    docs = [tuple(x or "" for x in r) for r in rows]
    held, count = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        terms = [lower(t) for t in TERM.findall(text)]
        held[lang].update(set(terms))
        count[lang, source].update(terms)
    out = set()
    for lang in {d[1] for d in docs}:
        kept = sorted(t for t, k in held[lang].items() if k >= least_docs)
        sources = sorted({d[2] for d in docs if d[1] == lang}, key=str.encode)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}
        p = {s: share(count[lang, s]) for s in sources}
        base = share(sum((count[lang, s] for s in sources), Counter()))
        f = lambda x, y: (x - y) * (x - y) // y
        for s in sources:
            lists = {
                "pair": [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s],
                "term": [(f(p[s][t], base[t]), t) for t in kept if count[lang, s][t] and p[s][t] > base[t]],
            }
            for part, items in lists.items():
                items = sorted(items, key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, t, v, i + 1) for i, (v, t) in enumerate(items) if part == "pair" or i < top}
    return out


def got(df):
    rows = df.select("lang", "source", "part", "item", "value", "rank").collect()
    assert len({(r.lang, r.source, r.part, r.item) for r in rows}) == len(rows)
    return {tuple(r) for r in rows}


def made(n, sources, seed):
    draw = random.Random(seed)
    words = ["alpha", "Beta", "BETA", "straße", "Straße", "日本", "é", "x", "É", "z9z", "a-b", "\U0001f600", "zz", "�"] + [f"w{chr(97 + i)}" for i in range(20)]
    rows = [(" ".join(draw.choices(words, k=draw.randrange(0, 12))), draw.choice(["en", "de", None]), draw.choice(sources)) for _ in range(n)]
    return rows + rows[:5] + [(None, "en", None), ("", "fr", "s1"), (None, "fr", "s2"), ("only here", "it", "s1"), ("long " * 30_000, "en", "s1")]


@pytest.mark.parametrize(("sources", "seat", "shard", "top"), [(1, 16, 8192, 200), (2, 1, 3, 3), (5, 1, 7, 4), (6, 2, 2, 1), (9, 2, 5, 200), (7, 3, 1000, 5), (12, 16, 4, 2)])
def test_any_seats_and_shards(spark, sources, seat, shard, top):
    rows = made(120, [f"s{i}" for i in range(1, sources + 1)], sources)
    df = spark.createDataFrame(rows, FIELDS)
    assert got(A.divergence(df, top=top, shard=shard, seat=seat)) == plain(rows, top=top)


def test_every_two_seats_meet_once(spark):
    from pyspark.sql import functions as F

    for n in (2, 4, 6, 10):
        df = spark.range(n).withColumnRenamed("id", "seat").crossJoin(spark.range(n - 1).withColumnRenamed("id", "turn"))
        rows = df.select("seat", "turn", A.partner(F.col("seat"), F.col("turn"), F.lit(n)).cast("int").alias("other")).collect()
        other = {(r.turn, r.seat): r.other for r in rows}
        assert all(other[t, o] == s and o != s for (t, s), o in other.items())
        assert len({frozenset((s, o)) for (_, s), o in other.items()}) == n * (n - 1) // 2


def test_shares_are_exact():
    draw = np.random.default_rng(2)
    for total in (1, 7, 10**9 + 7, 9 * 10**15 - 1):
        n = draw.integers(0, total, 50)
        assert A.share(n, total).tolist() == [1 + 10**9 * (int(k) + 1) // total for k in n]


def test_vectors_come_back():
    for at, n in (([], []), ([0], [5]), ([0, 3, 70_000], [1, 2**40, 3])):
        x, y = A.unpack(A.pack(np.array(at, np.int64), np.array(n, np.int64)))
        assert (x.tolist(), y.tolist()) == (at, n)


def test_empty_tables_and_other_columns(spark):
    empty = spark.createDataFrame([], FIELDS)
    assert A.divergence(empty).collect() == []
    rows = made(30, ["s1", "s2"], 4)
    odd = spark.createDataFrame([(*r, {"k": 1}, 2, "x") for r in rows], FIELDS + ", n map<string,int>, `a.b` int, term string")
    assert got(A.divergence(odd)) == plain(rows)


def test_statement(spark, tmp_path):
    rows = made(100, ["s1", "s2", "s3"], 8)
    df = spark.createDataFrame(rows, FIELDS)
    path = str(tmp_path / "documents")
    df.coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/*.parquet')")
    assert {tuple(r) for r in con.execute(f"SELECT lang, source, part, item, value, rank FROM ({A.ORACLE})").fetchall()} == plain(rows) == got(A.divergence(df))
