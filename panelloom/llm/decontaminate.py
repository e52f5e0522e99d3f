"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Words are lowered runs of letters, digits and bytes above 0x7F.  An alignment scores
MATCH, MISS or GAP a word and is divided by the item's best possible score; pairs of
``LEAST`` or more are leaks, and every such pair is found:

From one matched word of an alignment to the next, a item words and b text words on,
the score gains MATCH less the words passed over, which is above zero only for a and
b of 1 or 2.  A leak has to gain more than nothing, so it holds a pair of words that
stand 1 or 2 apart in the item and in the text.  These pairs are the n-grams.  A word
starts one step, which gains MATCH at the most; so an item may do without the pairs
that start at some of its words, as long as MATCH times their number is less than
what a leak must gain.  The pairs in most documents are left out, about two fifths of
an item; those that are left are its seeds.

Pairs of the items are counted in all documents, then seeds are looked up there, each
time through a bit table of the grams (a prefilter whose false hits a join removes).
Documents with a seed meet their texts again, and the words that an alignment around
a seed can reach are cut out item by item; those with too few words in common to
reach ``LEAST`` in any order are left out, the others are aligned word by word.

An item of fewer than ``SHORT`` words would be found in very many texts; it matches
documents that consist of its words and nothing else.  Null and empty texts or items
never match.  Rows with a null id are documents of their own, told apart by their
text.  Repeated rows give one result for each (document, item): the best alignment,
the first among equals.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrays import Block, blocks, mix, prefix, spans, word_hashes, words
from .buckets import known, named, within
from .shared_store import Scratch

LEAST, SHORT, APART = 0.4, 3, (1, 2)
MATCH, MISS, GAP = 2, -1, -1
LEAST_BITS, MOST_BITS, PROBES = 23, 30, 2
BROADCAST_WORDS = 500_000
BLOCK = 1 << 18


def _ink(b: Block) -> np.ndarray:
    d = b.data
    return (d >= 128) | ((d >= 97) & (d <= 122)) | ((d >= 48) & (d <= 57))


def word_values(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of the block and the word offset of each row."""
    lo, hi, row = words(b, _ink(b))
    return word_hashes(b, lo, hi), np.searchsorted(row, np.arange(len(b) + 1))


def pair_values(values: np.ndarray, apart: int) -> np.ndarray:
    """The gram of every word and the one ``apart`` words on, in that order; how far they stand apart does not matter."""
    first, second = values[: max(0, len(values) - apart)], values[apart:]
    return mix(first ^ (mix(second) >> np.uint64(1)))


def whole_value(values: np.ndarray) -> np.ndarray:
    """The one gram of a text of fewer than SHORT words."""
    n = len(values)
    return mix(spans(prefix(values), np.zeros(1, np.int64), np.full(1, n)) ^ np.uint64(0x9FB21C651E98DF25 + n))


def item_rows(benchmark: DataFrame, text: str = "text", key: str = "item_id") -> DataFrame:
    """(item_id, n, words, grams, at): word hashes of every item, its grams, and the word that each starts at."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "_text", BLOCK):
            v, offs = word_values(b)
            ids, size, own, grams, at = [], [], [], [], []
            for i, k in enumerate(b.rows.column("item_id").to_pylist()):
                w = v[offs[i] : offs[i + 1]]
                if len(w):
                    ids.append(k)
                    size.append(len(w))
                    own.append(w.tobytes())
                    g = [pair_values(w, d) for d in APART] if len(w) >= SHORT else [whole_value(w)]
                    grams.append(np.concatenate(g).view(np.int64).tolist())
                    at.append(np.concatenate([np.arange(len(x)) for x in g]).tolist())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(size, pa.int32()), pa.array(own, pa.binary()), pa.array(grams, pa.list_(pa.int64())), pa.array(at, pa.list_(pa.int32()))], ["item_id", "n", "words", "grams", "at"]
            )

    rows = benchmark.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("item_id"), F.lower(text).alias("_text"))
    return rows.mapInArrow(run, "item_id long, n int, words binary, grams array<long>, at array<int>")


def _probes(grams: np.ndarray, wide: int) -> list[np.ndarray]:
    """The places of grams in a table of 2 ** wide bits."""
    return [(x >> np.uint64(64 - wide)).astype(np.int64) for x in (grams, mix(grams))][:PROBES]


def bit_table(grams: DataFrame, n: int) -> np.ndarray:
    """Bits of all grams (gram), at the places that their hashes name."""
    wide = min(MOST_BITS, max(LEAST_BITS, (32 * n - 1).bit_length()))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << (wide - 3), np.uint8)
        for batch in batches:
            for slot in _probes(batch.column("gram").to_numpy().view(np.uint64), wide):
                np.bitwise_or.at(bits, slot >> 3, np.uint8(1) << (slot & 7).astype(np.uint8))
        if bits.any():
            yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary())], ["bits"])

    bits = np.zeros(1 << (wide - 3), np.uint8)
    for r in grams.select("gram").distinct().coalesce(4).mapInArrow(run, "bits binary").toLocalIterator():
        bits |= np.frombuffer(r.bits, np.uint8)
    return bits


def _hits(b: Block, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, word of the row, gram) of the pairs, or whole short texts, of a block that may be in the table."""
    v, offs = word_values(b)
    size, wide = np.diff(offs), (len(table) * 8 - 1).bit_length()
    row = np.repeat(np.arange(len(b)), size)
    at, grams = [], []
    for d in APART:
        g = pair_values(v, d)
        inside = row[: len(g)] == row[d : d + len(g)]
        at.append(np.flatnonzero(inside))
        grams.append(g[inside])
    short = np.flatnonzero((size > 0) & (size < SHORT))
    at.append(offs[short])
    grams.append(np.array([whole_value(v[offs[i] : offs[i + 1]])[0] for i in short], np.uint64))
    at, grams = np.concatenate(at), np.concatenate(grams)
    for k in range(PROBES):
        slot = _probes(grams, wide)[k]
        ok = (table[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
        at, grams = at[ok], grams[ok]
    return row[at], at - offs[row[at]], grams.view(np.int64)


def document_counts(docs: DataFrame, grams: DataFrame, n: int, text: str) -> DataFrame:
    """(gram, docs): in how many documents each gram of the table, and some others, occur."""
    spread = docs.sparkSession.sparkContext.broadcast(bit_table(grams, n))  # MOST_BITS bits at the most

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "_text", BLOCK):
            row, _, g = _hits(b, spread.value)
            key, gram = np.unique(g, return_inverse=True)
            each = np.unique(gram * len(b) + row) // max(1, len(b))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.bincount(each, minlength=len(key)))], ["gram", "docs"])

    return docs.select(F.lower(text).alias("_text")).mapInArrow(run, "gram long, docs long").groupBy("gram").agg(F.sum("docs").alias("docs"))


def seeds_of(items: DataFrame, counts: DataFrame, least: float) -> DataFrame:
    """(gram, item_id): the grams of every item without those that start at its commonest words, as many as a leak cannot live on."""
    each = items.select("item_id", "n", F.explode(F.arrays_zip("grams", "at")).alias("g")).select("item_id", "n", F.col("g.grams").alias("gram"), F.col("g.at").alias("at"))
    cost = each.join(counts, "gram", "left").groupBy("item_id", "n", "at").agg(F.sum(F.coalesce("docs", F.lit(0))).alias("cost"), F.collect_set("gram").alias("grams"))
    spare = F.greatest(F.lit(0), F.ceil((least * F.col("n") * MATCH - MATCH) / MATCH - 1e-9) - 1)  # MATCH * spare < what a leak gains
    common = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("cost"), "at"))  # the words of an item
    kept = cost.withColumn("k", common).where(F.col("k") > F.when(F.col("n") < SHORT, 0).otherwise(spare))
    return kept.select(F.explode("grams").alias("gram"), "item_id").distinct()


def seed_hits(docs: DataFrame, seeds: DataFrame, n: int, text: str, key: str) -> DataFrame:
    """(doc, alt, pos, gram) of every seed, and some others, in the documents."""
    spread = docs.sparkSession.sparkContext.broadcast(bit_table(seeds, n))  # MOST_BITS bits at the most

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "_text", BLOCK):
            row, pos, g = _hits(b, spread.value)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.rows.column("doc").take(take), b.rows.column("alt").take(take), pa.array(pos), pa.array(g)], ["doc", "alt", "pos", "gram"])

    return docs.select(*named(text, key), F.lower(text).alias("_text")).mapInArrow(run, "doc long, alt long, pos long, gram long")


def regions(found: DataFrame, least: float) -> DataFrame:
    """(doc, alt, item_id, start, words): the stretches of texts (doc, alt, _text, seeds: array of (item_id, n, pos)) that an alignment through a seed can reach.

    A leak of n item words spans at most ``MATCH * (1 - least) * n`` text words besides the n.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "_text", BLOCK):
            v, offs = word_values(b)
            rows, items, starts, parts = [], [], [], []
            for i, hits in enumerate(b.rows.column("seeds").to_pylist()):
                size = int(offs[i + 1] - offs[i])
                by_item: dict[tuple[int, int], list[int]] = {}
                for h in hits:
                    by_item.setdefault((h["item_id"], h["n"]), []).append(h["pos"])
                for (item, n), at in by_item.items():
                    reach = int(np.ceil(n * (1 + MATCH * (1 - least)))) + 2
                    at = np.unique(at)
                    cut = np.flatnonzero(np.diff(at) > 2 * reach) + 1
                    for run_of in np.split(at, cut):
                        lo, hi = max(0, int(run_of[0]) - reach), min(size, int(run_of[-1]) + reach)
                        if lo < hi:
                            rows.append(i), items.append(item), starts.append(lo), parts.append(v[offs[i] + lo : offs[i] + hi].tobytes())
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.rows.column("doc").take(take), b.rows.column("alt").take(take), pa.array(items, pa.int64()), pa.array(starts, pa.int64()), pa.array(parts, pa.binary())], ["doc", "alt", "item_id", "start", "words"])

    return found.select("doc", "alt", "_text", "seeds").mapInArrow(run, "doc long, alt long, item_id long, start long, words binary")


def smith_waterman(text: np.ndarray, size: np.ndarray, item: np.ndarray, item_size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(best local score, position after its last text word) for a batch of padded pairs, one text word a step."""
    n, width = item.shape
    lane = np.arange(width)
    inside = lane < item_size[:, None]
    h = np.zeros((n, width + 1), np.int32)
    best, end = np.zeros(n, np.int32), np.zeros(n, np.int64)
    for j in range(text.shape[1]):
        live = j < size
        score = np.where((text[:, j][:, None] == item) & inside, MATCH, MISS)
        up = np.maximum(h[:, :-1] + score, h[:, 1:] + GAP)
        up = np.maximum(up, 0)
        # gaps along the item: a running maximum of scores freed of their own gap costs
        up = np.maximum.accumulate(up - GAP * lane, axis=1) + GAP * lane
        h[:, 1:] = np.where(live[:, None] & inside, np.maximum(up, 0), 0)
        top = h.max(axis=1)
        better = top > best
        best[better], end[better] = top[better], j + 1
    return best, end


def enough(batches: Iterable[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """The (region, item) rows whose common words, matched without a gap, would score ``least`` or more."""
    for batch in batches:
        ok, tables = [], {}
        for k, x, y in zip(batch.column("item_id").to_pylist(), batch.column("words").to_pylist(), batch.column("item_words").to_pylist(), strict=True):
            word, n = tables[k, y] if (k, y) in tables else tables.setdefault((k, y), np.unique(np.frombuffer(y, np.uint64), return_counts=True))
            text = np.frombuffer(x, np.uint64)
            at = np.minimum(np.searchsorted(word, text), len(word) - 1)
            seen = np.bincount(at[word[at] == text], minlength=len(word))
            ok.append(np.minimum(seen, n).sum() >= least * n.sum() - 1e-6)
        yield batch.filter(pa.array(ok, pa.bool_()))


def align(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Score of each (region, item) row."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            w = [np.frombuffer(x, np.uint64) for x in part.column("words").to_pylist()]
            q = [np.frombuffer(x, np.uint64) for x in part.column("item_words").to_pylist()]
            # long regions are cut into overlapping pieces: an alignment above the least score spans at most three item lengths
            owner, piece, base = [], [], []
            for i, (x, y) in enumerate(zip(w, q, strict=True)):
                step = max(64, 3 * len(y))
                for s in range(0, max(1, len(x) - step), step):
                    owner.append(i)
                    piece.append(x[s : s + 2 * step])
                    base.append(s)
            best, first = np.zeros(len(w)), np.zeros(len(w), np.int64)
            order = np.argsort([len(p) for p in piece], kind="stable")
            for k in range(0, len(order), 256):
                mine = order[k : k + 256]
                n, m = np.array([len(piece[i]) for i in mine]), np.array([len(q[owner[i]]) for i in mine])
                t, u = np.zeros((len(mine), n.max()), np.uint64), np.zeros((len(mine), m.max()), np.uint64)
                for z, i in enumerate(mine):
                    t[z, : n[z]], u[z, : m[z]] = piece[i], q[owner[i]]
                got, end = smith_waterman(t, n, u, m)
                for z, i in enumerate(mine):
                    o, s = owner[i], got[z] / (MATCH * m[z])
                    if s > best[o]:
                        best[o], first[o] = s, base[i] + end[z]
            start = part.column("start").to_numpy()
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc", "alt", "item_id")), pa.array(best), pa.array(start + first)], ["doc", "alt", "item_id", "score", "end_word"])


def leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", least: float = LEAST) -> DataFrame:
    """(doc, alt, item_id, score, end_word): every document with a passage that aligns with a test item; doc is the id, NO_ID for null (see ``buckets.named``)."""
    scratch = Scratch(spark)
    items = scratch.keep(item_rows(benchmark), "items")
    total, grams = items.agg(F.sum("n"), F.sum(F.size("grams"))).first()
    near = F.broadcast if (total or 0) <= BROADCAST_WORDS else (lambda df: df)  # a larger benchmark is joined by shuffling
    counts = document_counts(docs, items.select(F.explode("grams").alias("gram")), grams or 1, text)
    seeds = scratch.keep(seeds_of(items, counts, least), "seeds")
    hits = seed_hits(docs, seeds, grams or 1, text, key).join(near(seeds), "gram").join(near(items.select("item_id", "n")), "item_id")
    by_text = scratch.keep(hits.groupBy("doc", "alt").agg(F.collect_set(F.struct("item_id", "n", "pos")).alias("seeds")), "by_text")  # the seeds of one text
    met = docs.select(*named(text, key), F.lower(text).alias("_text")).join(by_text, ["doc", "alt"])
    rows = scratch.keep(regions(met, least), "regions").join(near(items.select("item_id", F.col("words").alias("item_words"))), "item_id")
    at = ["doc", "alt", "start"]
    scored = rows.select(*at, "words", "item_id", "item_words").mapInArrow(lambda batches: align(enough(batches, least)), "doc long, alt long, item_id long, score double, end_word long")
    best = scored.where(F.col("score") >= least).groupBy("doc", "alt", "item_id").agg(F.max(F.struct("score", (-F.col("end_word")).alias("e"))).alias("b"))
    return best.select("doc", "alt", "item_id", F.col("b.score").alias("score"), (-F.col("b.e")).alias("end_word"))


def without_leaks(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of documents without a leak; rows that share an id go together."""
    plain = [f"c{i}" for i in range(len(docs.columns))]  # columns by position: any name will do
    at = dict(zip(docs.columns, plain, strict=True))
    names, docs, text, key = docs.columns, docs.toDF(*plain), at[text], at[key]
    bad = Scratch(spark).keep(leaks(spark, docs, benchmark, text, key).select("doc", "alt").distinct(), "leaks")
    doc, alt = named(text, key)
    rows = docs.select(doc.alias("_doc"), alt.alias("_alt"), *plain)
    return rows.join(within(bad), (F.col("_doc") == bad["doc"]) & (F.col("_alt") == bad["alt"]), "left_anti").select(*plain).toDF(*names)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(known("doc").alias("doc_id"), "item_id", "score", "end_word")
