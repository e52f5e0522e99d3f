"""Find every window of a fixed length that also starts in a document with a smaller id.

Shared by the byte and the word operator; a *unit* is a byte or a word.  Work
moves between tasks as packed arrays in two kinds of shuffle:

1. **Seeds.**  Every window of ``target`` units has one seed, a gram of ``seed``
   units that the window's content alone places (``seeds_of``).  Windows that
   follow one another mostly share it, so a document falls into *segments*: a
   seed and the run of windows that chose it.  Equal windows have equal seeds at equal
   offsets, so only segments meeting at the same seed hash can hold equal
   windows.  A segment equal to one in a smaller document is covered whole.
   Where one seed has differing segments, the first document of each stays
   *open*; a seed of one document alone is done.
2. **Windows.**  Open segments alone are extended to full windows, which are
   compared one by one; or first to longer grams around the seed, level by level.

Before each shuffle a task keeps only the smallest document of each key, as all
others of it are answered on the spot.  So a key held by a third of all
documents reaches its task once per flush, not once per document.  Buckets of
keys and of documents are sized by the bytes of the table.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import Block, blocks, mix, prefix, ranges, sliding_argmin, spans
from .buckets import NO_ID, within
from .shared_store import Scratch

FLUSH = 500_000
HOT = 64
LEAST_GRAM = 8
KEYS, COVERED, OPEN, OPEN_HOT, WINDOW, BYTES = range(-1, 5)
REPLY = "owner long, kind int, blob binary"
PARCEL = REPLY + ", body binary"
BUCKET_BYTES, LEAST_BUCKETS, SHELVES = 16 << 20, 127, 4096


def pack(*columns: np.ndarray) -> bytes:
    """Columns of non-negative 64-bit numbers by byte planes, leading zero planes left out."""
    n = len(columns[0])
    parts = [np.array([n], np.int64).tobytes()]
    for c in columns:
        c = np.ascontiguousarray(c).view(np.uint64)
        wide = (int(c.max()).bit_length() + 7) // 8 if n else 0
        parts += [bytes([wide]), np.ascontiguousarray(c.view(np.uint8).reshape(n, 8)[:, :wide].T).tobytes()]
    return b"".join(parts)


def unpack(blob: bytes, n_columns: int) -> list[np.ndarray]:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    at, out = 8, []
    for _ in range(n_columns):
        wide = blob[at]
        c = np.zeros((n, 8), np.uint8)
        c[:, :wide] = np.frombuffer(blob, np.uint8, wide * n, at + 1).reshape(wide, n).T
        out.append(c.view(np.uint64).ravel())
        at += 1 + wide * n
    return out


def unpack_all(column: pa.ChunkedArray | pa.Array, n_columns: int) -> list[np.ndarray]:
    got = [unpack(b, n_columns) for b in column.to_pylist()]
    if not got:
        return [np.zeros(0, np.uint64) for _ in range(n_columns)]
    return [np.concatenate(c) for c in zip(*got, strict=True)]


def scatter(owner: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """(owner, packed columns) for every owner."""
    if not len(owner):
        return
    order = np.argsort(owner, kind="stable")
    owner = owner[order]
    cut = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    for lo, hi in zip(cut, [*cut[1:], len(owner)], strict=True):
        yield int(owner[lo]), pack(*(c[order[lo:hi]] for c in columns))


def reply_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["owner", "kind", "blob"]
    )


@dataclass(frozen=True)
class Deal:
    """n buckets of keys, and n of documents after them, in shelves of ``width``.

    With a width of one a row is sent to its bucket.  Else it is sent to its shelf,
    named by the shelf's first bucket, and from there to its bucket (``dealt``):
    a flush makes one parcel a shelf, and a shelf's task one a bucket of it, so
    neither falls apart into parcels of a row or two.
    """

    n: int
    width: int

    def shelf(self, owner: np.ndarray) -> np.ndarray:
        first = np.where(owner >= self.n, self.n, 0)
        return first + (owner - first) // self.width * self.width

    def of_keys(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) % np.uint64(self.n)).astype(np.int64)

    def of_docs(self, doc: np.ndarray, tag: np.ndarray) -> np.ndarray:
        return self.n + np.mod(doc.astype(np.int64) ^ tag.astype(np.int64), self.n)


def deal_for(docs: DataFrame, text: str) -> Deal:
    """A prime number of buckets that keeps each near BUCKET_BYTES of text, LEAST_BUCKETS at least; above SHELVES, as many shelves as buckets in each."""
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n = max(LEAST_BUCKETS, total // BUCKET_BYTES)
    while any(n % k == 0 for k in range(2, int(n**0.5) + 1)):
        n += 1
    return Deal(int(n), 1 if n <= SHELVES else math.isqrt(n))


def dealt(sent: DataFrame, deal: Deal, target: int = 0, most: int = FLUSH) -> DataFrame:
    """What was sent to shelves, in parcels of one bucket; ``most`` rows (64 bytes of a body count as one) are held at once.

    A parcel of kind BYTES has a body: the segments of its rows one after the other.
    """
    if deal.width == 1:
        return sent
    with_body = "body" in sent.columns

    def parcels(kind: int, held: list[tuple[bytes, bytes | None]]) -> Iterator[tuple[int, int, bytes, bytes | None]]:
        columns = [np.concatenate(c) for c in zip(*(unpack(blob, 6 if kind == KEYS else 5) for blob, _ in held), strict=True)]
        owner = deal.of_keys(columns[0]) if kind in (KEYS, BYTES) else deal.of_docs(columns[0], columns[1])
        if kind != BYTES:
            for to, blob in scatter(owner, columns):
                yield to, kind, blob, None
            return
        body = np.frombuffer(b"".join(b for _, b in held), np.uint8)
        size = columns[4].view(np.int64) % (target + 1) + target - 1
        at = np.cumsum(size) - size
        order = np.argsort(owner, kind="stable")
        cut = np.flatnonzero(np.r_[True, owner[order][1:] != owner[order][:-1]])
        for lo, hi in zip(cut, [*cut[1:], len(order)], strict=True):
            k = order[lo:hi]
            yield int(owner[k[0]]), kind, pack(*(c[k] for c in columns)), body[ranges(at[k], size[k])].tobytes()

    def flush(held: dict[int, list[tuple[bytes, bytes | None]]]) -> pa.RecordBatch:
        rows = [r for kind in sorted(held) for r in parcels(kind, held[kind])]
        columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int32(), pa.binary(), pa.binary()))]
        names = ["owner", "kind", "blob", "body"]
        return pa.RecordBatch.from_arrays(columns if with_body else columns[:3], names if with_body else names[:3])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for b in batches:
            bodies = b.column("body").to_pylist() if with_body else [None] * len(b)
            for kind, blob, body in zip(b.column("kind").to_pylist(), b.column("blob").to_pylist(), bodies, strict=True):
                rows = int(np.frombuffer(blob, np.int64, 1)[0])
                if rows:
                    held.setdefault(kind, []).append((blob, body))
                size += rows + len(body or b"") // 64
                if size >= most:
                    yield flush(held)
                    held, size = {}, 0
        yield flush(held)

    first = F.when(F.col("owner") >= deal.n, F.lit(deal.n)).otherwise(0)
    shelf = (first + F.floor((F.col("owner") - first) / deal.width) * deal.width).alias("_shelf")
    return sent.repartition(shelf).mapInArrow(run, PARCEL if with_body else REPLY)


# ---------------------------------------------------------------- segments


@dataclass
class Units:
    """The units of a block: their hashes, and the unit offset of each document."""

    values: np.ndarray
    offs: np.ndarray


@dataclass
class Segments:
    row: np.ndarray
    seed: np.ndarray  # unit position in the block
    lo: np.ndarray  # first window start
    count: np.ndarray  # windows
    key: np.ndarray  # of the seed: 48 bits
    body: np.ndarray  # of the segment and the seed's place in it


def seeds_of(u: Units, pre: np.ndarray, starts: np.ndarray, target: int, seed: int) -> np.ndarray:
    """Position of the seed of each window, from the place of the window's least gram of ``short`` units (leftmost on ties).

    That place modulo the number of places that a seed has in a window is the
    seed's.  While a window moves on, it stays where it is until it leaves the
    window, so long seeds part a text into fewer segments than if the least gram of
    ``seed`` units were taken; seeds of under half a window are just that gram.
    """
    places = target - seed + 1
    least = min(LEAST_GRAM, seed)
    short = least + (seed - least) % places
    at = np.arange(len(u.values) - short + 1)
    best = sliding_argmin(mix(spans(pre, at, at + short)), target - short + 1)[starts]
    return starts + (best - starts) % places


def segments(u: Units, target: int, seed: int, body_bits: int = 40) -> Segments:
    n = len(u.values)
    none = np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(u.offs) - 1), np.diff(u.offs))
    starts = np.arange(max(0, n - target + 1))
    starts = starts[row[: len(starts)] == row[target - 1 :]] if len(starts) else starts
    if not len(starts):
        return Segments(none, none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    pre = prefix(u.values)
    best = seeds_of(u, pre, starts, target, seed)
    first = np.flatnonzero(np.r_[True, (best[1:] != best[:-1]) | (row[starts[1:]] != row[starts[:-1]])])
    lo, at = starts[first], best[first]
    count = starts[np.r_[first[1:], len(starts)] - 1] - lo + 1
    place = (at - lo).astype(np.uint64) << np.uint64(32) | count.astype(np.uint64)
    body = mix(spans(pre, lo, lo + count - 1 + target) ^ mix(place)) >> np.uint64(64 - body_bits)
    return Segments(row[lo], at, lo, count, mix(spans(pre, at, at + seed)) >> np.uint64(16), body)


# ---------------------------------------------------------------- the exchange


def settle(key: np.ndarray, body: np.ndarray, doc: np.ndarray, opens: bool) -> tuple[np.ndarray, np.ndarray]:
    """(order, verdict in that order): COVERED, OPEN, OPEN_HOT, or -1 for nothing to say."""
    order = np.argsort(key)
    verdict = np.full(len(key), -1)
    if len(key) < 2:
        return order, verdict
    same = key[order[1:]] == key[order[:-1]]
    shared = np.flatnonzero(np.r_[False, same] | np.r_[same, False])  # a lone key says nothing
    if not len(shared):
        return order, verdict
    mine = order[shared]
    mine = mine[np.lexsort((doc[mine], body[mine], key[mine]))]
    order[shared] = mine
    key, body, doc = key[mine], body[mine], doc[mine]
    new_key = np.r_[True, key[1:] != key[:-1]]
    new = new_key | np.r_[True, body[1:] != body[:-1]]
    least = doc[np.flatnonzero(new)][np.cumsum(new) - 1]
    said = np.where(doc > least, COVERED, -1)
    if opens:
        top = np.flatnonzero(new_key)
        several = np.minimum.reduceat(doc, top) < np.maximum.reduceat(doc, top)
        bodies = np.add.reduceat(new.astype(np.int64), top)
        of = np.cumsum(new_key) - 1
        said[(said < 0) & (several & (bodies > 1))[of]] = OPEN
        said[(said == OPEN) & (bodies > HOT)[of]] = OPEN_HOT
    verdict[shared] = said
    return order, verdict


def survivors(key: np.ndarray, told: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, whether the key has several documents, whether the row is of the key's smallest one), in that order; told: others had it."""
    order = np.lexsort((doc, key))
    key, told, doc = key[order], told[order], doc[order]
    if not len(key):
        return order, np.zeros(0, bool), np.zeros(0, bool)
    new = np.r_[True, key[1:] != key[:-1]]
    top, of = np.flatnonzero(new), np.cumsum(new) - 1
    last = np.r_[top[1:], len(key)] - 1
    several = (doc[top] < doc[last]) | (np.maximum.reduceat(told, top) > 0)
    return order, several[of], doc == doc[top][of]


class Sender:
    """Gathers (key, body, doc, tag, pos, ext) of a task and flushes them: keys to their buckets, local answers to their documents.

    ext is the number of windows from pos on, and above it the seed's distance.
    Key rows have owner < n and kind -1; answers carry owner n + document bucket.
    An answer's blob holds doc, tag, pos, ext and, for open segments, the key.
    With ``answer`` OPEN the body says whether other documents had the key, and only
    the smallest document's rows travel; the others are known to survive.
    """

    def __init__(self, deal: Deal, answer: int):
        self.deal, self.answer, self.held, self.size = deal, answer, [], 0

    def add(self, *columns: np.ndarray) -> Iterator[list[tuple[int, int, bytes]]]:
        self.held.append(columns)
        self.size += len(columns[0])
        if self.size >= FLUSH:
            yield self.flush()

    def flush(self) -> list[tuple[int, int, bytes]]:
        if not self.size:
            return []
        key, body, doc, tag, pos, ext = (np.concatenate(c) for c in zip(*self.held, strict=True))
        self.held, self.size = [], 0
        if self.answer == OPEN:
            order, several, least = survivors(key, body, doc)
            hit = several & ~least
            body = body.copy()
            body[order] = several
        else:
            order, verdict = settle(key, body, doc, False)
            hit = verdict == COVERED
        mine, rest = np.sort(order[hit]), np.sort(order[~hit])  # by document again, so that numbers of documents compress
        rows = answer_rows(self.deal, self.answer, doc[mine], tag[mine], pos[mine], ext[mine])
        for owner, blob in scatter(self.deal.shelf(self.deal.of_keys(key[rest])), [c[rest] for c in (key, body, doc, tag, pos, ext)]):
            rows.append((owner, KEYS, blob))
        return rows


def answer_rows(deal: Deal, kind: int, doc: np.ndarray, tag: np.ndarray, pos: np.ndarray, ext: np.ndarray, key: np.ndarray | None = None) -> list[tuple[int, int, bytes]]:
    key = np.zeros(len(doc), np.uint64) if key is None else key
    return [(to, kind, blob) for to, blob in scatter(deal.shelf(deal.of_docs(doc, tag)), [doc, tag, pos, ext, key])]


def judge_keys(blobs: pa.ChunkedArray, deal: Deal, opens: bool, answer: int) -> list[tuple[int, int, bytes]]:
    key, body, doc, tag, pos, ext = unpack_all(blobs, 6)
    doc = doc.view(np.int64)
    if answer == OPEN:
        order, several, _ = survivors(key, body, doc)
        m = np.sort(order[several])
        return answer_rows(deal, OPEN, doc[m], tag[m], pos[m], ext[m])
    order, verdict = settle(key, body, doc, opens)
    rows = []
    for kind in (COVERED, OPEN, OPEN_HOT):
        m = np.sort(order[verdict == kind])
        rows += answer_rows(deal, answer if kind == COVERED else kind, doc[m], tag[m], pos[m], ext[m], key[m] if kind == OPEN else None)
    return rows


def exchange(sent: DataFrame, deal: Deal, opens: bool, answer: int) -> DataFrame:
    """Answers for documents, from what the senders sent; answers given on the spot pass through."""

    def run(table: pa.Table) -> pa.Table:
        if table.column("owner")[0].as_py() >= deal.n:
            return table
        return pa.Table.from_batches([reply_batch(judge_keys(table.column("blob"), deal, opens, answer))])

    return dealt(dealt(sent, deal).groupBy("owner").applyInArrow(run, REPLY), deal)


# ---------------------------------------------------------------- documents and their answers


def prepared(scratch: Scratch, docs: DataFrame, deal: Deal, text: str, key: str) -> DataFrame:
    """key, text, _doc (null ids last), _tag and _owner, the document bucket.

    The tag tells texts of one id apart: 0 where an id has one text, else 63 bits of
    the text's hash.  Null ids share one id, so all of them have it.
    """
    own = F.xxhash64(F.col(text)).bitwiseAND((1 << 63) - 1)
    several = docs.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("long").alias("_id")).agg(F.min(own).alias("lo"), F.max(own).alias("hi")).where("lo <> hi")
    several = scratch.keep(several.select("_id"), "several")
    rows = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.col(key).cast("long").alias("_id"), own.alias("_own"))
    rows = rows.withColumn("_more", F.lit(False)) if several.isEmpty() else rows.join(within(several.withColumn("_more", F.lit(True))), "_id", "left")
    tag = F.when(F.col("_id").isNull() | F.col("_more"), F.col("_own")).otherwise(F.lit(0))
    rows = rows.select("_key", "_text", F.coalesce("_id", F.lit(NO_ID)).alias("_doc"), tag.alias("_tag"))
    return rows.withColumn("_owner", F.pmod(F.col("_doc").bitwiseXOR(F.col("_tag")), F.lit(deal.n)) + deal.n)


def tags_of(rows: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(rows.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("_doc", "_tag"))


def send_segments(docs: DataFrame, deal: Deal, units: Callable[[Block], Units], target: int, seed: int, most: int, answer: int = COVERED) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Sender(deal, answer)
        for b in blocks(batches, "_text", most):
            u = units(b)
            s = segments(u, target, seed)
            doc, tag = tags_of(b.rows)
            for rows in out.add(s.key, np.zeros_like(s.body) if answer == OPEN else s.body, doc[s.row], tag[s.row], s.lo - u.offs[s.row], (s.seed - s.lo) * (target + 1) + s.count):
                yield reply_batch(rows)
        yield reply_batch(out.flush())

    return docs.select("_text", "_doc", "_tag").mapInArrow(run, REPLY)


class Answers:
    """Answers of one document bucket, found by document."""

    def __init__(self, table: pa.Table, kinds: tuple[int, ...]):
        kind = table.column("kind").to_numpy()
        self.columns: dict[int, list[np.ndarray]] = {}
        self.at: dict[int, dict[tuple[int, int], tuple[int, int]]] = {}
        for k in kinds:
            doc, tag, *rest = unpack_all(table.column("blob").filter(pa.array(kind == k)), 5)
            order = np.lexsort((tag, doc))
            doc, tag = doc[order], tag[order]
            cut = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])]) if len(doc) else order
            ends = [*cut[1:].tolist(), len(doc)]
            self.at[k] = {x: (lo, hi) for x, lo, hi in zip(zip(doc[cut].view(np.int64).tolist(), tag[cut].tolist()), cut.tolist(), ends)}
            self.columns[k] = [c[order].view(np.int64) for c in rest]

    def named(self) -> set[tuple[int, int]]:
        return {x for at in self.at.values() for x in at}

    def of(self, kind: int, doc: np.ndarray, tag: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, pos in the block, ext, key) of the answers of this kind for a block's documents, whose units begin at offs."""
        at = [self.at[kind].get(x, (0, 0)) for x in zip(doc.tolist(), tag.tolist())]
        lo, size = np.array([a for a, _ in at], np.int64), np.array([b - a for a, b in at], np.int64)
        pick = ranges(lo, size)
        row = np.repeat(np.arange(len(doc)), size)
        pos, ext, key = (c[pick] for c in self.columns[kind])
        return row, pos + offs[row], ext, key


def window_keys(u: Units, starts: np.ndarray, target: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 48-bit hashes of each window."""
    a = mix(spans(prefix(u.values), starts, starts + target))
    b = mix(spans(prefix(mix(u.values), 1), starts, starts + target, 1))
    return a >> np.uint64(16), b >> np.uint64(16)


def of_named(docs: pa.Table, answers: Answers) -> tuple[pa.Table, pa.Table]:
    """Rows that have answers, and the others."""
    named = answers.named()
    has = np.array([x in named for x in zip(docs.column("_doc").to_pylist(), docs.column("_tag").to_pylist(), strict=True)], bool)
    return docs.filter(pa.array(has)), docs.filter(pa.array(~has))


def add_windows(out: Sender, b: Block, u: Units, answers: Answers, kinds: tuple[int, ...], target: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Give the sender every window of the open segments of these kinds."""
    doc, tag = tags_of(b.rows)
    got = [answers.of(k, doc, tag, u.offs) for k in kinds]
    row, lo, ext = (np.concatenate(c) for c in list(zip(*got, strict=True))[:3])
    count = ext % (target + 1)
    start, row = ranges(lo, count), np.repeat(row, count)
    if len(start):
        k1, k2 = window_keys(u, start, target)
        yield from out.add(k1, k2, doc[row], tag[row], start - u.offs[row], np.ones(len(row), np.int64))


def send_longer(docs: DataFrame, replies: DataFrame, deal: Deal, units: Callable[[Block], Units], target: int, seed: int, size: int, most: int) -> DataFrame:
    """The grams of ``size`` units around the surviving ones of ``seed`` units, as far inside each window as there is room.

    Windows that follow one another mostly share the gram that has the seed in its
    middle; where the window ends before that, it is the window's first or last one.
    """

    def run(table: pa.Table, said: pa.Table) -> pa.Table:
        answers = Answers(said, (OPEN,))
        out, rows = Sender(deal, OPEN), []
        for b in blocks(of_named(table, answers)[0].to_batches(), "_text", most):
            u = units(b)
            doc, tag = tags_of(b.rows)
            row, lo, ext, _ = answers.of(OPEN, doc, tag, u.offs)
            count = ext % (target + 1)
            segment = np.repeat(np.arange(len(row)), count)
            start = ranges(lo, count)
            at = np.clip((lo + ext // (target + 1) - (size - seed) // 2)[segment], start, start + target - size)
            first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (segment[1:] != segment[:-1])][: len(at)])
            if len(first):
                own, g, s = row[segment[first]], at[first], start[first]
                key = mix(spans(prefix(u.values), g, g + size)) >> np.uint64(16)
                for r in out.add(key, np.zeros(len(key), np.uint64), doc[own], tag[own], s - u.offs[own], (g - s) * (target + 1) + np.diff(np.r_[first, len(at)])):
                    rows += r
        return pa.Table.from_batches([reply_batch(rows + out.flush())])

    return docs.select("_text", "_doc", "_tag", "_owner").groupBy("_owner").cogroup(replies.where(F.col("kind") == OPEN).groupBy("owner")).applyInArrow(run, REPLY)


def send_windows(docs: DataFrame, replies: DataFrame, deal: Deal, units: Callable[[Block], Units], target: int, most: int, kinds: tuple[int, ...]) -> DataFrame:
    """Windows of the open segments, to be compared one by one."""

    def run(table: pa.Table, said: pa.Table) -> pa.Table:
        answers = Answers(said, kinds)
        out, rows = Sender(deal, WINDOW), []
        for b in blocks(of_named(table, answers)[0].to_batches(), "_text", most):
            for r in add_windows(out, b, units(b), answers, kinds, target):
                rows += r
        return pa.Table.from_batches([reply_batch(rows + out.flush())])

    open_ones = replies.where(F.col("kind").isin(*kinds))
    # all columns, as the last step has them: Spark then deals the texts once for both
    return docs.groupBy("_owner").cogroup(open_ones.groupBy("owner")).applyInArrow(run, REPLY)


def covered_units(b: Block, offs: np.ndarray, answers: Answers, target: int, kinds: tuple[int, ...] = (COVERED, WINDOW)) -> np.ndarray:
    """Mask of the block's units (documents begin at offs) covered by windows that start in a smaller document."""
    doc, tag = tags_of(b.rows)
    edge = np.zeros(int(offs[-1]) + 1, np.int64)
    for kind in kinds:
        _, lo, ext, _ = answers.of(kind, doc, tag, offs)
        np.add.at(edge, lo, 1)
        np.add.at(edge, lo + ext % (target + 1) - 1 + target, -1)
    return np.cumsum(edge)[:-1] > 0
