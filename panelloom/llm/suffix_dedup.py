"""Removal of repeated byte strings with a hash-compared suffix sort.

Every document is cut into segments around seeds (see ``repeats``).  Segments
equal to one of a smaller document are covered outright.  Of the others, only
those that meet a differing segment at the same seed go on: their bytes travel
to the seed's bucket, where the suffixes that begin at the same distance from
the seed are merge-sorted.  A comparison finds the common extension of two
suffixes by binary search over prefix polynomial hashes, so it takes
log2(target) steps; equal neighbours are then verified byte by byte.  Seeds with
more than ``repeats.HOT`` differing segments (a line in very many documents)
would make one group large; their windows are compared through a 96-bit hash
exchange, which deals equal windows, not seeds, to tasks.

A byte is removed if some ``target``-byte string over it also starts in a
document with a smaller id; strings are judged on the input and matches never
cross documents.  Null and empty texts have no bytes.  A null id counts as
larger than all others; rows of one id never cover each other.  One output row
per input row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import _BYTES, Block, blocks, byte_prefix, mix, powers, ranges
from .repeats import (
    BYTES, COVERED, KEYS, OPEN, OPEN_HOT, PARCEL, REPLY, WINDOW, Answers, Deal, Sender, Units, add_windows, answer_rows, covered_units, deal_for, dealt, exchange, judge_keys, of_named,
    pack, prepared, reply_batch, send_segments, tags_of, unpack_all,
)
from .shared_store import Scratch

BLOCK = 1 << 18
#: Bytes of a seed in a target of 50, in proportion in others.  Shorter ones occur in unrelated texts, the more of them the more text there is.
SEED = 32


def byte_units(b: Block) -> Units:
    return Units(_BYTES[0][b.data], b.offs)


# ---------------------------------------------------------------- the suffix sort


class Suffixes:
    """Suffixes of one buffer, compared on their first ``most`` bytes."""

    def __init__(self, buf: np.ndarray, most: int):
        self.buf, self.most = buf, most
        self.pre = byte_prefix(buf)
        self.inv = powers(0, len(self.pre), True)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes a and b, by binary search over prefix hashes."""
        lo, hi = np.zeros(len(a), np.int64), np.full(len(a), self.most)
        while len(a) and (lo < hi).any():
            mid = (lo + hi + 1) >> 1
            same = (self.pre[a + mid] - self.pre[a]) * self.inv[a] == (self.pre[b + mid] - self.pre[b]) * self.inv[b]
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo

    def compare(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1."""
        n = self.common(a, b)
        end = n >= self.most
        at = np.where(end, 0, n)
        return np.where(end, 0, np.sign(self.buf[a + at].astype(np.int16) - self.buf[b + at].astype(np.int16)))

    def sort(self, pos: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Merge sort of pos inside its groups, all groups in step; begin and end bound each item's group.

        In each round every item finds its place in the neighbouring run by
        binary search with ``compare``.
        """
        n, width = len(pos), 1
        perm, here = np.arange(n), np.arange(n)
        widest = int((end - begin).max()) if n else 0
        while width < widest:
            run = (here - begin) // width
            odd = (run & 1) == 1
            base = begin + (run >> 1) * 2 * width
            lo = np.where(odd, base, np.minimum(base + width, end))
            hi = np.minimum(lo + width, end)
            a, b = lo.copy(), hi.copy()
            live = np.flatnonzero(a < b)
            while len(live):
                mid = (a[live] + b[live]) >> 1
                c = self.compare(pos[perm[mid]], pos[perm[live]])
                right = (c < 0) | ((c == 0) & odd[live])
                a[live] = np.where(right, mid + 1, a[live])
                b[live] = np.where(right, b[live], mid)
                live = live[a[live] < b[live]]
            own = here - np.where(odd, base + width, base)
            moved = np.empty_like(perm)
            moved[base + own + (a - lo)] = perm
            perm = moved
            width *= 2
        return perm

    def equal_neighbours(self, a: np.ndarray, b: np.ndarray, chunk: int = 50_000) -> tuple[np.ndarray, np.ndarray]:
        """(equal by hash, equal by bytes)."""
        said, seen = self.common(a, b) >= self.most, np.zeros(len(a), bool)
        at = np.flatnonzero(said)
        span = np.arange(self.most)
        for i in range(0, len(at), chunk):
            k = at[i : i + chunk]
            seen[k] = (self.buf[a[k][:, None] + span] == self.buf[b[k][:, None] + span]).all(axis=1)
        return said, seen


def classes(buf: np.ndarray, pos: np.ndarray, group: np.ndarray, target: int) -> np.ndarray:
    """A number for each item; items of one group have the same number if and only if their windows are the same bytes."""
    n = len(pos)
    if not n:
        return np.zeros(0, np.int64)
    order = np.argsort(group, kind="stable")
    g = group[order]
    first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    size = np.diff(np.r_[first, n])
    s = Suffixes(buf, target)
    perm = s.sort(pos[order], np.repeat(first, size), np.repeat(first + size, size))
    order = order[perm]
    p, g = pos[order], group[order]
    said, seen = s.equal_neighbours(p[:-1], p[1:])
    same = (g[1:] == g[:-1]) & seen
    out = np.empty(n, np.int64)
    out[order] = np.cumsum(np.r_[0, ~same])
    for bad in np.unique(g[1:][(said != seen) & (g[1:] == g[:-1])]):  # a hash collision: that group by its bytes
        names: dict[bytes, int] = {}
        for i in np.flatnonzero(group == bad):
            out[i] = n + names.setdefault(buf[pos[i] : pos[i] + target].tobytes(), int(i))
    return out


# ---------------------------------------------------------------- open segments


def send_open(docs: DataFrame, replies: DataFrame, deal: Deal, target: int) -> DataFrame:
    """The bytes of open segments for their seed's bucket (kind BYTES), and the windows of hot ones by their hash."""

    def run(table: pa.Table, said: pa.Table) -> pa.Table:
        answers = Answers(said, (OPEN, OPEN_HOT))
        out, rows, parcels = Sender(deal, WINDOW), [], []
        for b in blocks(of_named(table, answers)[0].to_batches(), "_text", BLOCK):
            doc, tag = tags_of(b.rows)
            r, lo, ext, key = answers.of(OPEN, doc, tag, b.offs)
            owner = deal.shelf(deal.of_keys(key))
            order = np.argsort(owner, kind="stable")
            owner = owner[order]
            for x, y in _runs(owner):
                k = order[x:y]
                size = ext[k] % (target + 1) + target - 1
                parcels.append((int(owner[x]), pack(key[k], doc[r[k]], tag[r[k]], lo[k] - b.offs[r[k]], ext[k]), b.data[ranges(lo[k], size)].tobytes()))
            if answers.at[OPEN_HOT]:
                for made in add_windows(out, b, byte_units(b), answers, (OPEN_HOT,), target):
                    rows += made
        rows += out.flush()
        columns = [[p[0] for p in parcels] + [r[0] for r in rows], [BYTES] * len(parcels) + [r[1] for r in rows], [p[1] for p in parcels] + [r[2] for r in rows], [p[2] for p in parcels] + [None] * len(rows)]
        kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["owner", "kind", "blob", "body"])

    open_ones = replies.where(F.col("kind").isin(OPEN, OPEN_HOT))
    # all columns, as the last step has them: Spark then deals the texts once for both
    return docs.groupBy("_owner").cogroup(open_ones.groupBy("owner")).applyInArrow(run, PARCEL)


def _runs(sorted_values: np.ndarray) -> Iterator[tuple[int, int]]:
    if len(sorted_values):
        cut = np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]])
        yield from zip(cut.tolist(), [*cut[1:].tolist(), len(sorted_values)], strict=True)


def judge_open(deal: Deal, target: int):
    def run(table: pa.Table) -> pa.Table:
        if table.column("owner")[0].as_py() >= deal.n:
            return table.select(["owner", "kind", "blob"])
        kind = table.column("kind").to_numpy()
        rows = judge_keys(table.column("blob").filter(pa.array(kind == KEYS)), deal, False, WINDOW)
        parcels = table.filter(pa.array(kind == BYTES))
        rows += judge_bytes(parcels.column("blob"), b"".join(parcels.column("body").to_pylist()), deal, target)
        return pa.Table.from_batches([reply_batch(rows)])

    return run


def judge_bytes(blobs: pa.ChunkedArray, body: bytes, deal: Deal, target: int) -> list[tuple[int, int, bytes]]:
    """Answers for the windows of the segments in body that also start in a smaller document."""
    key, doc, tag, start, ext = unpack_all(blobs, 5)
    doc, start, ext = (x.view(np.int64) for x in (doc, start, ext))
    buf = np.frombuffer(body, np.uint8)
    rel, count = ext // (target + 1), ext % (target + 1)
    size = count + target - 1
    at = np.cumsum(size) - size
    seg = np.repeat(np.arange(len(key)), count)
    shift = ranges(np.zeros(len(key), np.int64), count)
    pos = at[seg] + shift
    # a group: the suffixes at one distance from one seed
    _, group = np.unique(mix(key[seg] * np.uint64(64) + (rel[seg] - shift).astype(np.uint64)), return_inverse=True)
    groups = int(group.max()) + 1 if len(group) else 0
    low, high = np.full(groups, np.iinfo(np.int64).max), np.full(groups, np.iinfo(np.int64).min)
    np.minimum.at(low, group, doc[seg])
    np.maximum.at(high, group, doc[seg])
    keep = np.flatnonzero((low < high)[group])  # several documents
    name = classes(buf, pos[keep], group[keep], target)
    _, name = np.unique(name, return_inverse=True)
    least = np.full(int(name.max()) + 1 if len(name) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, name, doc[seg[keep]])
    hit = keep[doc[seg[keep]] > least[name]]
    s = seg[hit]
    first = np.flatnonzero(np.r_[True, (hit[1:] != hit[:-1] + 1) | (s[1:] != s[:-1])][: len(hit)])  # windows that follow one another are one answer
    s = s[first]
    return answer_rows(deal, WINDOW, doc[s], tag[s], start[s] + shift[hit[first]], np.diff(np.r_[first, len(hit)]))


# ---------------------------------------------------------------- the operator


def dedup_bytes(docs: DataFrame, target: int = 50, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, n_removed, span_starts, span_ends, kept): the removed runs and the remaining bytes."""
    deal = deal_for(docs, text)
    scratch = Scratch(docs.sparkSession)
    rows = prepared(scratch, docs, deal, text, key)
    seed = max(1, target * SEED // 50)
    first = scratch.keep(exchange(send_segments(rows, deal, byte_units, target, seed, BLOCK), deal, True, COVERED), "seeds")
    second = dealt(dealt(send_open(rows, first, deal, target), deal, target).groupBy("owner").applyInArrow(judge_open(deal, target), REPLY), deal)
    kind = docs.schema[key].dataType.simpleString()

    def run(table: pa.Table, said: pa.Table) -> pa.Table:
        answers = Answers(said, (COVERED, WINDOW))
        few, rest = of_named(table, answers)
        ids, kept, starts, ends = rest.column("_key").to_pylist(), [], [], []
        for t in rest.column("_text").to_pylist():
            kept.append((t or "").encode())
            starts.append([])
            ends.append([])
        for b in blocks(few.to_batches(), "_text", BLOCK):
            drop = covered_units(b, b.offs, answers, target)
            for i in range(len(b)):
                gone = np.concatenate([[0], drop[b.offs[i] : b.offs[i + 1]].view(np.int8), [0]])
                edge = np.diff(gone)
                starts.append(np.flatnonzero(edge == 1).tolist())
                ends.append(np.flatnonzero(edge == -1).tolist())
                kept.append(b.data[b.offs[i] : b.offs[i + 1]][gone[1:-1] == 0].tobytes())
            ids += b.rows.column("_key").to_pylist()
        cut = [sum(e) - sum(s) for s, e in zip(starts, ends, strict=True)]
        return pa.table(
            [
                pa.array(ids, table.schema.field("_key").type), pa.array([len(k) + c for k, c in zip(kept, cut, strict=True)], pa.int64()), pa.array(cut, pa.int64()),
                pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), pa.array(kept, pa.binary()),
            ],
            [key, "n_bytes", "n_removed", "span_starts", "span_ends", "kept"],
        )

    said = first.where(F.col("kind") == COVERED).unionAll(second)
    schema = f"`{key}` {kind}, n_bytes long, n_removed long, span_starts array<long>, span_ends array<long>, kept binary"
    return rows.groupBy("_owner").cogroup(said.groupBy("owner")).applyInArrow(run, schema)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("span_starts").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
