"""Near-duplicate classes by DartMinHash.

A document is the multiset of its five-word shingles (fewer than five words: one
shingle of all of them); a shingle's weight is its count.  Every shingle owns the
strip of the (weight, rank) plane below its weight; the strip is cut into regions,
[0, 1), [1, 2), [2, 4), [4, 8) ... along the weight and cells of bounded area along
the rank, into which darts fall by hashing alone.  So a weight w costs log w regions,
and two documents see the same darts where both have weight.  All darts of rank
below t / weight are read off; each is hashed to one of the signature's coordinates,
which keeps its earliest dart.  A coordinate that stays empty makes its document
read twice as far.  Two documents agree in a coordinate with probability equal to
their weighted Jaccard similarity.

Joining: documents of equal multisets (128-bit digests) share one node.  The
signature is cut into bands; nodes that share a band bucket become one class if
they are similar, decided on the 64-bit hashes of all shingles (see ``buckets``).
The probability that a pair of similarity 0.8 shares none of the 20 bands is 0.0004.

Null and empty texts have no shingle and are classes of their own.  Rows that share
an id count as one document when classes are formed.  Rows with a null id are
documents of their own, told apart by their text; they count as larger than all
others, and a class without any id has a null class id.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import Block, blocks, mix, prefix, ranges, spans, word_hashes, words
from .buckets import Judge, classed, known, linked, named, nodes_of, within
from .shared_store import Scratch

N_WORDS, SIMILAR = 5, 0.8
BANDS, ROWS = 20, 5
K = BANDS * ROWS
DARTS = K * math.log(K) + 2 * K
COLUMNS, FEW = 8192, 512
BLOCK = 1 << 18
#: Edges of the rank cells below 1; from there on every cell is one unit wide.
LOW_EDGES = (0.0, 4.0**-6, 4.0**-5, 4.0**-4, 4.0**-3, 4.0**-2, 4.0**-1, 1.0)
_CELL = np.uint64(0xC2B2AE3D27D4EB4F)
_DART = np.uint64(0x165667B19E3779F9)
_REGION = np.uint64(0x9E3779B97F4A7C15)


def weights(b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle hash, weight) of the distinct shingles of every document, by row and hash."""
    lo, hi, row = words(b)
    h = word_hashes(b, lo, hi)
    first = np.searchsorted(row, np.arange(len(b) + 1))
    size = np.diff(first)
    n = np.where(size >= N_WORDS, size - N_WORDS + 1, np.minimum(size, 1))
    doc = np.repeat(np.arange(len(b)), n)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n) + first[doc]
    shingle = mix(spans(prefix(h), at, np.minimum(at + N_WORDS, first[doc + 1])))
    order = np.lexsort((shingle, doc))
    d, s = doc[order], shingle[order]
    begin = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (s[1:] != s[:-1])][: len(d)])
    return d[begin], s[begin], np.diff(np.r_[begin, len(d)])


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def _throw(seed: np.ndarray, own: np.ndarray, low: np.ndarray, wide: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Darts (region, scaled rank, id) of the given cells: a Poisson number in each, placed by hash."""
    start = mix(seed ^ (cell.astype(np.uint64) + np.uint64(1)) * _CELL)
    u, p = _unit(start), np.exp(-wide)
    total, out, k = p.copy(), [], 0
    live = np.flatnonzero(u >= total)
    while len(live):
        k += 1
        dart = mix(start[live] + np.uint64(k) * _DART)
        out.append((own[live], low[live] + wide[live] * _unit(mix(dart)), dart))
        p = p * wide / k
        total = total + p
        live = live[u[live] >= total[live]] if k < 20 else live[:0]
    if not out:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def darts(seed: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(region, scaled rank, id) of all darts of scaled rank below reach, for regions of one unit of area a unit of scaled rank."""
    out = []
    for i, (a, z) in enumerate(zip(LOW_EDGES, LOW_EDGES[1:])):
        at = np.flatnonzero(reach > a)
        out.append(_throw(seed[at], at, np.full(len(at), a), np.full(len(at), z - a), np.full(len(at), i)))
    more = np.maximum(0, np.ceil(reach).astype(np.int64) - 1)
    if more.any():
        at = np.repeat(np.arange(len(seed)), more)
        low = 1 + np.arange(len(at)) - np.repeat(np.cumsum(more) - more, more)
        out.append(_throw(seed[at], at, low.astype(np.float64), np.ones(len(at)), low + len(LOW_EDGES)))
    own, rank, dart = (np.concatenate(x) for x in zip(*out, strict=True))
    near = rank < reach[own]
    return own[near], rank[near], dart[near]


def signatures(row: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """n x K earliest darts, and which rows have a signature (those with any weight)."""
    total = np.bincount(row, weight, minlength=n)
    # regions along the weight: [0, 1), then [2 ** (i - 1), 2 ** i) for i from 1 on
    count = 1 + np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64)
    item = np.repeat(np.arange(len(row)), count)
    step = ranges(np.zeros(len(row), np.int64), count)
    tall = np.where(step > 0, 2.0 ** (step - 1), 1.0)
    seed = np.where(step > 0, mix(shingle[item] + step.astype(np.uint64) * _REGION), shingle[item])
    own_row = row[item]
    sig, have = np.zeros((n, K), np.uint64), total > 0
    todo, scale = have.copy(), 1.0
    while todo.any():
        pick = np.flatnonzero(todo[own_row])
        reach = scale * DARTS / total[own_row[pick]] * tall[pick]
        own, rank, dart = darts(seed[pick], reach)
        own = pick[own]
        height = np.where(step[own] > 0, tall[own] * (1 + _unit(mix(dart ^ _REGION))), 0)
        own, rank, dart = (x[height < weight[item[own]]] for x in (own, rank / tall[own], dart))
        slot = own_row[own] * K + (dart % np.uint64(K)).astype(np.int64)
        order = np.lexsort((dart, rank, slot))
        slot, dart = slot[order], dart[order]
        first = np.r_[True, slot[1:] != slot[:-1]][: len(slot)]
        sig.reshape(-1)[slot[first]] = dart[first]
        todo &= ~(np.bincount(slot[first] // K, minlength=n) == K)
        scale *= 2
    return sig, have


def digest(row: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent order-free hashes of each row's multiset."""
    out = []
    at = np.searchsorted(row, np.arange(n + 1))
    for salt in (_CELL, _DART):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(mix(shingle + salt) + weight.astype(np.uint64)), dtype=np.uint64)])
        out.append(mix(sums[at[1:]] - sums[at[:-1]] + np.diff(at).astype(np.uint64)))
    return out[0], out[1]


def sketch(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(doc, alt, own, d1, d2, bands) of every row; own is a hash of the text, d1, d2 and bands are null for rows without a shingle."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "_text", BLOCK):
            row, shingle, weight = weights(b)
            sig, have = signatures(row, shingle, weight, len(b))
            d1, d2 = digest(row, shingle, weight, len(b))
            band = np.zeros((len(b), BANDS), np.uint64)
            for i in range(BANDS):
                for j in range(ROWS):
                    band[:, i] = mix(band[:, i] * np.uint64(31) + sig[:, i * ROWS + j] + np.uint64(i))
            size = np.where(have, BANDS, 0)
            flat = pa.array(band[have].view(np.int64).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)], pa.int32()), flat)
            none = ~have
            yield pa.RecordBatch.from_arrays(
                [*(b.rows.column(c) for c in ("doc", "alt", "own")), pa.array(d1.view(np.int64), mask=none), pa.array(d2.view(np.int64), mask=none), lists], ["doc", "alt", "own", "d1", "d2", "bands"]
            )

    rows = docs.select(*named(text, key), F.xxhash64(F.col(text)).alias("own"), F.col(text).alias("_text"))
    return rows.mapInArrow(run, "doc long, alt long, own long, d1 long, d2 long, bands array<long>")


def elements(docs: DataFrame, wanted: DataFrame, text: str, key: str) -> DataFrame:
    """(node, elems) of the wanted (node, doc, alt, d1, d2): the sorted 64-bit hashes of all units of weight of one text of each node."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[int] = set()
        for b in blocks(batches, "_text", BLOCK):
            row, shingle, weight = weights(b)
            d1, d2 = digest(row, shingle, weight, len(b))
            right = (d1.view(np.int64) == b.rows.column("d1").to_numpy()) & (d2.view(np.int64) == b.rows.column("d2").to_numpy())
            unit = mix(np.repeat(shingle, weight) + ranges(np.zeros(len(weight), np.int64), weight).astype(np.uint64) * _REGION)
            cut = np.searchsorted(np.repeat(row, weight), np.arange(len(b) + 1))
            nodes, out = [], []
            for i, node in enumerate(b.rows.column("node").to_pylist()):
                if right[i] and node not in given:  # a text that is repeated, or another text of the id
                    given.add(node)
                    nodes.append(node)
                    out.append(np.sort(unit[cut[i] : cut[i + 1]]).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(out, pa.binary())], ["node", "elems"])

    rows = docs.select(*named(text, key), F.col(text).alias("_text")).join(wanted, ["doc", "alt"])
    return rows.select("node", "d1", "d2", "_text").mapInArrow(run, "node long, elems binary")


# ---------------------------------------------------------------- comparing nodes


def similarity(x: np.ndarray, y: np.ndarray) -> float:
    """Weighted Jaccard similarity from sorted weight units."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0.0
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    common = int((y[at] == x).sum())
    return common / (len(x) + len(y) - common)


def judge(least: float) -> Judge:
    """Pairs of similarity ``least`` or more; where many are asked for, their common units are counted first."""

    def of(content: dict[str, list], left: np.ndarray, right: np.ndarray, asked: np.ndarray) -> tuple[Iterable[tuple[int, int]], Callable[[int, int], bool]]:
        units = [np.frombuffer(x, np.uint64) for x in content["elems"]]
        size = np.array([len(u) for u in units])
        a, b = size[left][:, None], size[right]
        near = asked & (np.minimum(a, b) >= least * np.maximum(a, b))
        if near.sum() > FEW:
            common = common_units(units, left, right)
            near &= common + 1 >= least * (a + b - common - 1)
        i, j = np.nonzero(near)
        return zip(left[i].tolist(), right[j].tolist(), strict=True), lambda p, q: similarity(units[p], units[q]) >= least

    return of


def common_units(units: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Units in common of all left and right texts, by products of 0/1 tables."""
    owner = np.repeat(np.arange(len(units)), [len(u) for u in units])
    if not len(owner):
        return np.zeros((len(left), len(right)), np.float32)
    _, unit, n = np.unique(np.concatenate(units), return_inverse=True, return_counts=True)
    rank = np.cumsum(n > 1) - 1
    owner, unit = owner[n[unit] > 1], rank[unit[n[unit] > 1]]
    order = np.argsort(unit, kind="stable")
    owner, unit = owner[order], unit[order]
    common = np.zeros((len(left), len(right)), np.float32)
    width = int(unit[-1]) + 1 if len(unit) else 0
    for lo in range(0, width, COLUMNS):
        x, y = np.searchsorted(unit, [lo, lo + COLUMNS])
        table = np.zeros((len(units), min(COLUMNS, width - lo)), np.float32)
        table[owner[x:y], unit[x:y] - lo] = 1
        common += table[left] @ table[right].T
    return common


# ---------------------------------------------------------------- classes


def row_classes(spark: SparkSession, docs: DataFrame, text: str = "text", key: str = "doc_id", least: float = SIMILAR) -> DataFrame:
    """(doc, alt, own, lead) of every row: lead is the smallest (doc, alt) of its class, null for rows without a shingle."""
    scratch = Scratch(spark)
    rows = scratch.keep(sketch(docs, text, key), "sketches")
    nodes = nodes_of(scratch, rows, ["bands"])
    band = nodes.select("node", F.posexplode("bands").alias("band", "hash"))
    size = band.groupBy("band", "hash").agg(F.count("*").alias("n"), F.min("node").alias("a")).where("n > 1")
    members = band.join(scratch.keep(size, "buckets"), ["band", "hash"]).withColumns({"probe": F.lit(True), "lead_probe": F.lit(True)})
    members = scratch.keep(members, "members")
    wanted = nodes.select("node", "at.doc", "at.alt", "d1", "d2").join(members.select("node").distinct(), "node")
    content = scratch.keep(elements(docs, within(scratch.keep(wanted, "wanted")), text, key), "elements")
    links = linked(scratch, members, ["band", "hash"], content, judge(least))
    out = classed(scratch, rows, nodes, links)
    scratch.drop("members", "buckets", "wanted", "elements")
    return out.drop("node")


def near_classes(spark: SparkSession, docs: DataFrame, text: str = "text", key: str = "doc_id", least: float = SIMILAR) -> DataFrame:
    """(key, class_id) for every row: the smallest id of its class."""
    rows = row_classes(spark, docs, text, key, least).withColumn("_class", F.coalesce("lead.doc", "doc"))
    return rows.select(known("doc").alias(key), known("_class").alias("class_id"))


def one_of_each(spark: SparkSession, docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of each class: that of the smallest id; of rows that share that id, the one whose text has the smallest hash.

    Classes of rows without an id keep one row each.  Which rows go is decided on
    ids; the texts pass once.
    """
    plain = [f"c{i}" for i in range(len(docs.columns))]  # columns by position: any name and type will do
    at = dict(zip(docs.columns, plain, strict=True))
    names, docs, text, key = docs.columns, docs.toDF(*plain), at[text], at[key]
    scratch = Scratch(spark)
    rows = scratch.keep(row_classes(spark, docs, text, key), "classes")
    leads = F.col("lead").isNull() | ((F.col("doc") == F.col("lead.doc")) & (F.col("alt") == F.col("lead.alt")))
    gone = scratch.keep(rows.where(~leads).select("doc", "alt").distinct(), "gone")
    again = rows.where(leads).groupBy("doc", "alt").agg(F.count("*").alias("n"), F.min("own").alias("own")).where("n > 1")
    again = scratch.keep(again.select("doc", "alt", "own"), "again")
    ids = [c.alias(f"_{n}") for c, n in zip(named(text, key), ("doc", "alt"), strict=True)]
    full = docs.select(*ids, F.xxhash64(F.col(text)).alias("_own"), F.struct(*plain).alias("_row"))
    on = lambda t: (F.col("_doc") == t["doc"]) & (F.col("_alt") == t["alt"])
    away = scratch.keep(gone.unionAll(again.select("doc", "alt")), "away")
    once = full.join(within(away), on(away), "left_anti").select("_row.*")
    if not again.isEmpty():
        # few rows as a rule: an id that occurs more than once; of equal texts the row that reads smallest
        twice = full.join(within(again), on(again) & (F.col("_own") == again["own"]), "left_semi")
        once = once.unionByName(twice.groupBy("_doc", "_alt").agg(F.min_by("_row", F.to_json("_row")).alias("_row")).select("_row.*"))
    return once.toDF(*names)


def op3_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"))
