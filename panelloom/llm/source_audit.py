"""How far the sources of a language differ, term by term: a systolic tournament of count vectors.

Terms are counted where the texts are and summed by (lang, source, term); a
language keeps the terms of at least ``LEAST_DOCS`` of its documents.  Its kept
terms are dealt by hash to shards of about ``SHARD`` terms, numbered there in
order of their UTF-8 bytes, and every (lang, source) group has one compressed
vector (term numbers, counts) a shard, empty ones included.

Groups of a language sit ``SEAT`` to a seat.  A shard of a seat is one run of rows
of one sorted shuffle: its own vectors come first and stay, then the language's
vector, then the vectors of the other seats in the rounds of a round-robin
tournament by the circle method (every two seats meet once in all rounds, the
lower or the higher one travels by turns).  A meeting evaluates both directions
over the union of two vectors; terms that neither has add a closed form.  So a
task holds the vectors of one seat and one visitor, and one job does all rounds.
Partial sums of shards are added by Spark.  At the language's vector every
resident keeps a heap of its ``TOP`` terms of the shard; the heaps are merged by rank.

All arithmetic is on integers: shares are floors of a long division digit by digit,
exact while a group has under 9 * 10**15 terms.

Null text, lang and source are ''; every row is a document, repeated ones count
again; ties in value go to the smaller item in UTF-8 bytes.  A language without
kept terms has pairs of value 0 and no terms; an empty table gives no rows.  Other
columns are not read.  Terms are told apart inside one block by 64 bits, and by
their text afterwards.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrays import Block, blocks, ranges, word_hashes, words
from .buckets import within
from .shared_store import Scratch

LEAST_DOCS = 3
TOP = 200
UNIT = 1_000_000_000
SHARD = 8192
SEAT = 16
#: Rows of a table of languages that may be broadcast.
LANGUAGES = 100_000

_INK = np.zeros(256, bool)
_INK[128:] = True
_INK[ord("A") : ord("Z") + 1] = _INK[ord("a") : ord("z") + 1] = True
_SMALL = np.arange(256, dtype=np.uint8)
_SMALL[ord("A") : ord("Z") + 1] += 32


# ---------------------------------------------------------------- counting


def _groups(rows: pa.RecordBatch) -> tuple[np.ndarray, pa.Array, pa.Array]:
    """Group number of each row, and the lang and source of each group."""
    lang, source = (pc.fill_null(rows.column(c), "").dictionary_encode() for c in ("lang", "source"))
    n = len(source.dictionary)
    seen, code = np.unique(lang.indices.to_numpy().astype(np.int64) * n + source.indices.to_numpy(), return_inverse=True)
    return code, lang.dictionary.take(pa.array(seen // n)), source.dictionary.take(pa.array(seen % n))


def count_block(block: Block) -> pa.RecordBatch:
    """(lang, source, term, n, docs) of one block."""
    code, lang, source = _groups(block.rows)
    block.data = _SMALL[block.data]
    lo, hi, row = words(block, _INK[block.data])
    _, first, term = np.unique(word_hashes(block, lo, hi), return_index=True, return_inverse=True)
    both, n = np.unique(term * len(block) + row, return_counts=True)
    group = both // len(block) * len(lang) + code[both % len(block)]  # sorted by term only
    group, where = np.unique(group, return_inverse=True)
    total = np.bincount(where, n, len(group)).astype(np.int64)
    docs = np.bincount(where, minlength=len(group)).astype(np.int64)
    at, g = first[group // len(lang)], pa.array(group % len(lang))
    size = hi[at] - lo[at]
    flat = block.data[ranges(lo[at], size)] if len(at) else np.zeros(0, np.uint8)
    text = pa.StringArray.from_buffers(len(at), pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.py_buffer(flat.tobytes()))
    return pa.RecordBatch.from_arrays([lang.take(g), source.take(g), text, pa.array(total), pa.array(docs)], ["lang", "source", "term", "n", "docs"])


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of a term in a group, and the group's documents that hold it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            got = count_block(b)
            for lo in range(0, got.num_rows, 20_000):
                yield got.slice(lo, 20_000)

    counted = docs.select("lang", "source", "text").mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


# ---------------------------------------------------------------- arithmetic


def share(n: np.ndarray, total: int) -> np.ndarray:
    """1 + floor(UNIT * (n + 1) / total), nine decimal digits by long division in three steps."""
    rest, out = np.asarray(n, np.int64) + 1, np.zeros(np.shape(n), np.int64)
    for step in range(4):
        out = out * (1000 if step else 1) + rest // total
        rest = rest % total * 1000
    return out + 1


def excess(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


# ---------------------------------------------------------------- vectors


def pack(at: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted term numbers and their counts, compressed."""
    return zlib.compress(np.diff(at, prepend=0).astype("<u4").tobytes() + n.astype("<i8").tobytes(), 1)


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(blob)
    n = len(raw) // 12
    return np.cumsum(np.frombuffer(raw, "<u4", n).astype(np.int64)), np.frombuffer(raw, "<i8", n, 4 * n)


class Vector:
    """One group's shares in one shard: sorted term numbers, their shares, and the share of a term that it lacks."""

    def __init__(self, source: str, blob: bytes, tokens: int, kept: int):
        self.source, (self.at, n) = source, unpack(blob)
        total = max(1, tokens + kept)
        self.p, self.rest = share(n, total), int(share(np.zeros(1, np.int64), total)[0])


def meet(a: Vector, b: Vector, terms: int) -> tuple[int, int]:
    """Sum of the excess of a over b, and of b over a, over all terms of the shard."""
    union = np.union1d(a.at, b.at)
    p, q = np.full(len(union), a.rest), np.full(len(union), b.rest)
    p[np.searchsorted(union, a.at)] = a.p
    q[np.searchsorted(union, b.at)] = b.p
    lack, x, y = terms - len(union), np.int64(a.rest), np.int64(b.rest)
    return int(excess(p, q).sum()) + lack * int(excess(x, y)), int(excess(q, p).sum()) + lack * int(excess(y, x))


def best_terms(own: Vector, base: Vector, terms: list[str], top: int) -> list[tuple[int, str]]:
    """The group's ``top`` terms above the language's share, greatest excess first; equal ones by term, which is the order of the numbers."""
    q = base.p[np.searchsorted(base.at, own.at)]
    over = np.flatnonzero(own.p > q)
    value = excess(own.p[over], q[over])
    if len(over) > top:
        keep = value >= np.partition(value, len(value) - top)[len(value) - top]
        over, value = over[keep], value[keep]
    return [(-v, terms[t]) for v, t in heapq.nsmallest(top, zip((-value).tolist(), own.at[over].tolist()))]


_ROUND = ["lang", "source", "part", "item", "value"]


def tournament(batches: Iterable[pa.RecordBatch], top: int = TOP) -> Iterator[pa.RecordBatch]:
    """(lang, source, part, item, value) of rows sorted by (lang, shard, seat, round, source): residents, then the language, then visitors."""
    here, residents = None, []
    for batch in batches:
        out: list[tuple[str, str, str, str, int]] = []
        for r in batch.to_pylist():
            if here != (r["lang"], r["shard"], r["seat"]):
                here, residents = (r["lang"], r["shard"], r["seat"]), []
            v = Vector(r["source"], r["blob"], r["tokens"], r["kept"])
            if r["round"] == 0:
                terms = zlib.decompress(r["terms"]).decode().split("\n")
                for own in residents:
                    out += [(r["lang"], own.source, "term", t, x) for x, t in best_terms(own, v, terms, top)]
                continue
            for other in residents:
                x, y = meet(other, v, r["shard_terms"])
                out += [(r["lang"], other.source, "pair", v.source, x), (r["lang"], v.source, "pair", other.source, y)]
            if r["round"] < 0:
                residents.append(v)
        for lo in range(0, len(out), 20_000):
            part = list(zip(*out[lo : lo + 20_000]))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in part[:4]), pa.array(part[4], pa.int64())], _ROUND)


def partner(seat: Column, turn: Column, seats: Column) -> Column:
    """Who a seat meets in a round from 0 of an even number of seats: all but the last stand in a circle."""
    ring = seats - 1
    across = F.pmod(turn - seat, ring)
    return F.when(seat == ring, F.pmod(turn * (seats / 2).cast("long"), ring)).when(across == seat, ring).otherwise(across)


def _packed(vectors: DataFrame) -> DataFrame:
    """Lists of (number, count) as blobs, and terms, where there are any, compressed as well."""
    keys = [c for c in vectors.columns if c not in ("pairs", "terms")]
    texts = ["terms"] if "terms" in vectors.columns else []

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = batch.column("pairs")
            cut, inner = pairs.offsets.to_numpy(), pairs.values
            at, n = (pc.struct_field(inner, k).to_numpy() for k in ("at", "n"))
            blob = [pack(at[lo:hi], n[lo:hi]) for lo, hi in zip(cut, cut[1:])]
            said = [pa.array([zlib.compress(t.encode(), 1) for t in batch.column(c).to_pylist()], pa.binary()) for c in texts]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(blob, pa.binary()), *said], [*keys, "blob", *texts])

    return vectors.mapInArrow(run, ", ".join([*(f"`{k}` {vectors.schema[k].dataType.simpleString()}" for k in keys), "blob binary", *(f"{c} binary" for c in texts)]))


def divergence(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP, shard: int = SHARD, seat: int = SEAT) -> DataFrame:
    """(lang, source, part, item, value, rank): every other source of the language (``pair``), and the group's terms above the language's share, ``top`` at the most (``term``)."""
    scratch = Scratch(docs.sparkSession)
    docs = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    counts = scratch.keep(term_counts(docs), "counts")
    known = scratch.keep(counts.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs"), "known")
    by_source = Window.partitionBy("lang").orderBy("source")  # sources of a language
    groups = scratch.keep(docs.select("lang", "source").distinct().withColumn("g", F.row_number().over(by_source) - 1), "groups")
    sizes = known.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("lang_tokens"))
    langs = groups.groupBy("lang").agg(F.count("*").alias("sources")).join(sizes, "lang", "left").na.fill(0)
    langs = langs.withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("kept") / shard))).withColumn("seats", F.ceil(F.col("sources") / seat))
    langs = within(scratch.keep(langs, "langs"), LANGUAGES)

    number = F.row_number().over(Window.partitionBy("lang", "shard").orderBy("term")) - 1  # about ``shard`` terms
    dealt = known.join(langs.select("lang", "shards"), "lang").withColumn("shard", F.pmod(F.xxhash64("term"), "shards"))
    book = scratch.keep(dealt.select("lang", "shard", number.cast("long").alias("at"), "term", "n"), "book")
    mine = counts.select("lang", "source", "term", "n").join(book.drop("n"), ["lang", "term"])
    pair = F.sort_array(F.collect_list(F.struct("at", "n"))).alias("pairs")
    own = scratch.keep(_packed(mine.groupBy("lang", "source", "shard").agg(pair, F.sum("n").alias("part_tokens"))), "own")

    tokens = own.groupBy("lang", "source").agg(F.sum("part_tokens").alias("tokens"))
    cells = groups.join(tokens, ["lang", "source"], "left").join(langs, "lang").withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shards") - 1)))
    terms = within(scratch.keep(book.groupBy("lang", "shard").agg(F.count("*").alias("shard_terms")), "terms"), LANGUAGES)
    nothing = F.lit(pack(np.zeros(0, np.int64), np.zeros(0, np.int64)))
    resident = cells.join(own, ["lang", "source", "shard"], "left").join(terms, ["lang", "shard"], "left").select(
        "lang", "shard", F.pmod("g", "seats").alias("seat"), "source", F.coalesce("tokens", F.lit(0)).alias("tokens"), "kept", "seats",
        F.coalesce("shard_terms", F.lit(0)).alias("shard_terms"), F.coalesce("blob", nothing).alias("blob"),
    )
    resident = scratch.keep(resident, "resident")

    even = F.col("seats") + F.pmod("seats", F.lit(2))
    turns = resident.where("seats > 1").withColumn("even", even).withColumn("round", F.explode(F.sequence(F.lit(1).cast("long"), F.col("even") - 1)))
    host = partner(F.col("seat"), F.col("round") - 1, F.col("even"))
    travels = (F.col("seat") < F.col("host")) == (F.pmod(F.col("seat") + F.col("host"), F.lit(2)) == 0)
    visitors = turns.withColumn("host", host).where((F.col("host") < F.col("seats")) & travels)
    listed = book.groupBy("lang", "shard").agg(F.sort_array(F.collect_list(F.struct("at", "n", "term"))).alias("pairs"))
    whole = _packed(listed.select("lang", "shard", F.array_join("pairs.term", "\n").alias("terms"), "pairs")).join(langs, "lang")
    whole = whole.withColumn("seat", F.explode(F.sequence(F.lit(0).cast("long"), F.col("seats") - 1)))

    no = F.lit(None).cast("binary")
    row = lambda seat, turn, source, tokens, terms: ["lang", "shard", F.col(seat).cast("long").alias("seat"), turn.cast("long").alias("round"), source.alias("source"), F.col(tokens).alias("tokens"), "kept", "shard_terms", "blob", terms.alias("terms")]
    rows = resident.select(*row("seat", F.lit(-1), F.col("source"), "tokens", no)).unionByName(visitors.select(*row("host", F.col("round"), F.col("source"), "tokens", no)))
    rows = rows.unionByName(whole.withColumn("shard_terms", F.lit(0).cast("long")).select(*row("seat", F.lit(0), F.lit(""), "lang_tokens", F.col("terms"))))
    played = rows.repartition("lang", "shard", "seat").sortWithinPartitions("lang", "shard", "seat", "round", "source")
    found = scratch.keep(played.mapInArrow(lambda batches: tournament(batches, top), "lang string, source string, part string, item string, value long"), "found")

    met = found.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    ranked = lambda df: df.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")))
    return ranked(met).unionByName(ranked(found.where("part = 'term'")).where(F.col("rank") <= top))


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


_TERMS = "regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
#: DuckDB's statement for the same rows.
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, lang, source, translate(unnest({_TERMS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT k) >= {LEAST_DOCS}),
size AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM d),
own AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
total AS (SELECT lang, source, sum(n)::HUGEINT AS total FROM own GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n, 1 + ({UNIT}::HUGEINT * (coalesce(o.n, 0) + 1)) // (coalesce(t.total, 0) + s.v) AS p,
    1 + ({UNIT}::HUGEINT * (k.n + 1)) // (s.total + s.v) AS base
    FROM grp g JOIN kept k USING (lang) JOIN size s USING (lang) LEFT JOIN total t USING (lang, source) LEFT JOIN own o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pair x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - base) * (p - base) // base)::BIGINT AS value FROM p WHERE n > 0 AND p > base)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)) WHERE part = 'pair' OR rank <= {TOP}"""
