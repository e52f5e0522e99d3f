"""Cross-tokenizer alignment: which tokens of two tokenizers end together.

A block of documents is encoded by both tokenizers; the byte intervals of their
tokens are two DuckDB tables in memory, and one statement a stretch aligns them:
an ASOF join finds for every B token the A token that its last byte lies in, a
range join the document, a window sum numbers the groups between common ends.  A
stretch is cut only where tokens of both end, so long documents go through in parts
of about ``STRETCH`` bytes and nothing is spilled.

Linked pairs are counted by document and written; Spark sums the partial counts of
all documents.  Two linked tokens end together, so one's bytes end the other's: the
number of different pairs is at most the sum of the lengths of both vocabularies'
tokens (``pair_bound``), about half a million, and the merged counts are broadcast on
the strength of that bound.

Texts that are null, empty, or that either tokenizer does not give back byte by byte
have no tokens: all counts 0 and an empty digest.  Repeated rows and ids count again.
Tokens that end together are one A and one B token, so links are as many as groups.
"""

from __future__ import annotations

import copy
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, piece_codec
from .arrays import Block, blocks, ranges
from .pretokens import Vocabulary, vocabulary
from .shared_store import Scratch

BLOCK = 1 << 20
STRETCH = 1 << 20
#: Documents are entered once for every 2 ** BIN bytes that they reach into, so that the range join has a key.
BIN = 12

_LINKS = """
SELECT d.row, l.a_id, l.b_id, l.hi
FROM (SELECT b.id AS b_id, b.hi, a.id AS a_id, a.hi AS a_hi FROM b ASOF JOIN a ON b.hi > a.lo) l JOIN d ON l.hi >> {bits} = d.bin AND d.lo < l.hi AND l.hi <= d.hi
WHERE l.a_hi = l.hi""".format(bits=BIN)
_PAIRS = "SELECT row, a_id, b_id, count(*) AS n FROM link GROUP BY ALL ORDER BY row, a_id, b_id"
#: Tokens of one side in order, with the number of common ends before each: the group it is in.
_GROUPS = "SELECT t.id, count(link.hi) OVER (ORDER BY t.lo ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cut FROM {side} t LEFT JOIN link ON link.hi = t.hi ORDER BY t.lo"
_COMMA, _BAR, _SEMICOLON = b",|;"


@lru_cache(1)
def _decimals(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Decimal digits of 0 .. n - 1, each with a byte behind it, their offsets and their lengths with that byte."""
    said = [b"%d," % i for i in range(n)]
    size = np.array([len(x) for x in said], np.int64)
    return np.frombuffer(b"".join(said), np.uint8), np.cumsum(size) - size, size


def written_groups(a: pa.Table, b: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of both sides, merged by group, as text with a mark behind each, and where each token's text begins."""
    key = np.concatenate([x.column("cut").to_numpy() * 2 + side for side, x in enumerate((a, b))])
    order = np.argsort(key, kind="stable")  # two sorted runs: one merge
    key, ids = key[order], np.concatenate([x.column("id").to_numpy() for x in (a, b)])[order]
    flat, offs, size = _decimals(1 << 17 if not len(ids) or ids.max() < 1 << 17 else int(ids.max()) + 1)
    size = size[ids]
    text, ends = flat[ranges(offs[ids], size)], np.cumsum(size)
    step = np.diff(key, append=-1)
    text[ends - 1] = np.where(step == 0, _COMMA, np.where((step == 1) & (key % 2 == 0), _BAR, _SEMICOLON))
    return text, np.concatenate([[0], ends])


def pair_bound(v: Vocabulary, p: piece_codec.Pieces) -> int:
    """Most pairs of tokens of which one's bytes end the other's: a token has as many endings as bytes, and one token for each (byte pieces: two)."""
    return 2 * int(v.token_len.sum() + p.token_len.sum())


def both_tokens(v: Vocabulary, p: piece_codec.Pieces, block: Block) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """Ids, interval ends and row offsets of both tokenizers over space + text of the rows that both give back, laid end to end; the end of each row there; which rows these are."""
    some = np.flatnonzero(np.diff(block.offs))
    data = np.insert(block.data, block.offs[some], 32)
    spaced = Block(block.rows, data, block.offs + np.searchsorted(some, np.arange(len(block) + 1)))
    a_ids, a_offs = bpe_codec.encode_block(v, spaced)
    b_ids, b_offs, _, _ = piece_codec.encode_block(p, block)
    a_raw, a_cut = bpe_codec.decode_ids(v, a_ids, a_offs)
    size = p.token_len[b_ids]
    b_raw, b_cut = p.token_flat[ranges(p.token_off[b_ids], size)], np.concatenate([[0], np.cumsum(size)])[b_offs]
    same = lambda raw, cut, i: np.array_equal(raw[cut[i] : cut[i + 1]], data[spaced.offs[i] : spaced.offs[i + 1]])
    good = np.zeros(len(block), bool)
    good[some] = [same(a_raw, a_cut, i) and same(b_raw, b_cut, i) for i in some.tolist()]
    sides = []
    for ids, offs, size in ((a_ids, a_offs, v.token_len[a_ids]), (b_ids, b_offs, size)):
        count = np.where(good, np.diff(offs), 0)
        at = ranges(offs[:-1], count)
        sides.append((ids[at], np.cumsum(size[at]), np.concatenate([[0], np.cumsum(count)])))
    return sides, np.cumsum(np.where(good, np.diff(spaced.offs), 0)), good


def stretches(a_end: np.ndarray, b_end: np.ndarray, most: int = STRETCH) -> Iterator[tuple[int, int]]:
    """Byte ranges of about ``most`` bytes whose ends are ends of both."""
    if not len(a_end):
        return
    common, lo = np.intersect1d(a_end, b_end, assume_unique=True), 0
    while lo < common[-1]:
        i = int(np.searchsorted(common, lo + most, side="right")) - 1
        hi = int(common[i]) if i >= 0 and common[i] > lo else int(common[np.searchsorted(common, lo, side="right")])
        yield lo, hi
        lo = hi


def _table(ids: np.ndarray, end: np.ndarray, lo: int, hi: int) -> pa.Table:
    """Intervals within a byte range, counted from its start."""
    i, j = np.searchsorted(end, lo, side="right"), np.searchsorted(end, hi, side="right")
    stop = (end[i:j] - lo).astype(np.int32)
    return pa.table({"id": pa.array(ids[i:j], pa.int32()), "lo": np.concatenate([[0], stop])[:-1].astype(np.int32), "hi": stop})


def align_block(con, v: Vocabulary, p: piece_codec.Pieces, block: Block, most: int = STRETCH) -> pa.RecordBatch:
    """(n_a, n_b, n_groups, groups_sha256, a_ids, b_ids, counts): the alignment of each row, and its linked pairs with their numbers of links."""
    (a, b), ends, good = both_tokens(v, p, block)
    starts = np.concatenate([[0], ends])[:-1]
    sha = [hashlib.sha256() for _ in range(len(block))]
    tokens = np.concatenate([[0], np.cumsum(np.diff(a[2]) + np.diff(b[2]))])
    pairs, done = [], 0
    for lo, hi in stretches(a[1], b[1], most):
        ta, tb = _table(a[0], a[1], lo, hi), _table(b[0], b[1], lo, hi)
        rows = np.flatnonzero((starts < hi) & (ends > lo) & good)
        con.register("a", ta), con.register("b", tb)
        begin, end = np.maximum(starts[rows] - lo, 0), np.minimum(ends[rows], hi) - lo
        first = begin >> BIN
        bins = (end >> BIN) - first + 1
        spread = {"row": np.repeat(rows, bins), "lo": np.repeat(begin, bins), "hi": np.repeat(end, bins), "bin": ranges(first, bins)}
        con.register("d", pa.table({k: x.astype(np.int32) for k, x in spread.items()}))
        con.execute(f"CREATE OR REPLACE TEMP TABLE link AS {_LINKS}")
        pairs.append(con.sql(_PAIRS).to_arrow_table())
        flat, offs = written_groups(*(con.sql(_GROUPS.format(side=x)).to_arrow_table() for x in "ab"))
        n = len(offs) - 1
        for r in rows.tolist():
            x, y = (min(max(int(t) - done, 0), n) for t in (tokens[r], tokens[r + 1]))
            last = tokens[r + 1] - done <= n
            sha[r].update(flat[offs[x] : offs[y] - (1 if last else 0)])  # the last group of a document ends without a mark
        done += n
    table = pa.concat_tables(pairs).sort_by([("row", "ascending"), ("a_id", "ascending"), ("b_id", "ascending")]) if pairs else None
    row = table.column("row").to_numpy() if table else np.zeros(0, np.int64)
    offs = pa.array(np.searchsorted(row, np.arange(len(block) + 1)), pa.int32())
    lists = [pa.ListArray.from_arrays(offs, pa.array(table.column(c).to_numpy() if table else [], t)) for c, t in (("a_id", pa.int32()), ("b_id", pa.int32()), ("n", pa.int64()))]
    links = np.concatenate([[0], np.cumsum(table.column("n").to_numpy())]) if table else np.zeros(1, np.int64)
    digest = [s.hexdigest() if ok else "" for s, ok in zip(sha, good)]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.diff(a[2])), pa.array(np.diff(b[2])), pa.array(np.diff(links[offs.to_numpy()])), pa.array(digest, pa.string()), *lists],
        ["n_a", "n_b", "n_groups", "groups_sha256", "a_ids", "b_ids", "counts"],
    )


_COLUMNS = "n_a long, n_b long, n_groups long, groups_sha256 string, a_ids array<int>, b_ids array<int>, counts array<long>"


def aligned(docs: DataFrame, a_path: str, b_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(_key, and the columns of ``align_block``) of every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        v, p = copy.copy(vocabulary(a_path)), piece_codec.pieces(b_path)
        v.special = b""  # its string in a text is plain text
        with duckdb.connect(":memory:", config={"threads": 1, "temp_directory": "", "preserve_insertion_order": True}) as con:
            for b in blocks(batches, "_text", BLOCK):
                got = align_block(con, v, p, b)
                yield pa.RecordBatch.from_arrays([b.rows.column("_key"), *got.columns], ["_key", *got.schema.names])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(docs[f"`{key}`"].alias("_key"), docs[f"`{text}`"].alias("_text")).mapInArrow(run, f"_key {kind}, {_COLUMNS}")


def pair_counts(rows: DataFrame) -> DataFrame:
    """(a_id, b_id, n): links of every pair over all rows."""
    each = rows.select(F.explode(F.arrays_zip("a_ids", "b_ids", "counts")).alias("e"))
    return each.groupBy(F.col("e.a_ids").alias("a_id"), F.col("e.b_ids").alias("b_id")).agg(F.sum("e.counts").alias("n"))


def links(docs: DataFrame, a_path: str, b_path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    rows = scratch.keep(aligned(docs, a_path, b_path, text, key), "rows")
    counts = scratch.keep(pair_counts(rows), "counts")
    if counts.count() > (most := pair_bound(vocabulary(a_path), piece_codec.pieces(b_path))):
        raise ValueError(f"more than {most} pairs: the tables are not those of these tokenizers")
    got = counts.toArrow().combine_chunks()
    a, b, n = (got.column(c).to_numpy().astype(np.int64) for c in ("a_id", "b_id", "n"))
    best = np.zeros(int(b.max(initial=0)) + 1, np.int64)
    np.maximum.at(best, b, n)
    order = np.argsort(a << 32 | b)
    held = spark.sparkContext.broadcast(((a << 32 | b)[order], n[order], (n == best[b])[order]))  # pair_bound rows at the most

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, total, top = held.value
        for batch in batches:
            cut = batch.column("a_ids").offsets.to_numpy()
            x, y, k = (batch.column(c).values.to_numpy()[: cut[-1]].astype(np.int64) for c in ("a_ids", "b_ids", "counts"))
            at = np.searchsorted(pair, x << 32 | y)
            sums = [np.diff(np.concatenate([[0], np.cumsum(s)])[cut]) for s in (k * top[at] if len(at) else k, k * total[at] if len(at) else k)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_key", "n_a", "n_b", "n_groups", "n_groups")), pa.array(sums[0]), pa.array(sums[1]), batch.column("groups_sha256")], names)

    names = ["_key", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    kind = docs.schema[key].dataType.simpleString()
    out = rows.mapInArrow(run, f"_key {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")
    return out.withColumnRenamed("_key", key)


def op13_token_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return links(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
