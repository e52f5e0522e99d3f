"""Flat-array views of Arrow text batches, and span hashes on them.

A *block* is a run of whole documents laid end to end in one byte array.  Every
operator here works block by block, so a task's memory follows the block size
(plus the longest single document), never the partition or a group.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 2 << 20


@dataclass
class Block:
    """Documents of one block: ``data[offs[i]:offs[i + 1]]`` is the UTF-8 text of row i (null: empty)."""

    rows: pa.RecordBatch
    data: np.ndarray
    offs: np.ndarray

    def __len__(self) -> int:
        return len(self.offs) - 1

    def doc_of(self, pos: np.ndarray) -> np.ndarray:
        """Row of each byte position."""
        return np.searchsorted(self.offs, pos, side="right") - 1


def flat_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    _, offsets, data = column.buffers()
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def blocks(batches: Iterable[pa.RecordBatch], text: str = "text", most: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut batches into blocks of about ``most`` bytes; a longer document is a block of its own."""
    for batch in batches:
        data, offs = flat_text(batch.column(batch.schema.get_field_index(text)))
        n, lo = len(offs) - 1, 0
        while lo < n:
            hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, side="right")) - 1)
            yield Block(batch.slice(lo, hi - lo), data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
            lo = hi


# ---------------------------------------------------------------- hashing

_BASES = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F))
_BYTES = [np.random.default_rng(s).integers(1, 1 << 63, 256, dtype=np.uint64) for s in (7, 8)]
_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = np.asarray(x, np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def powers(which: int, n: int, inverse: bool = False) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, or the powers of its inverse."""
    have = _POWERS.get((which, inverse))
    if have is None or len(have) < n:
        base = int(_BASES[which])
        base = pow(base, -1, 1 << 64) if inverse else base
        size = 1 << max(10, (n - 1).bit_length())
        out = np.ones(size, np.uint64)
        k, step = 1, base
        while k < size:
            out[k : 2 * k] = out[:k] * np.uint64(step)
            k, step = 2 * k, step * step % (1 << 64)
        have = out
        if size <= 1 << 23:  # longer ones are rare; they are not kept
            _POWERS[which, inverse] = have
    return have[:n]


def prefix(values: np.ndarray, which: int = 0) -> np.ndarray:
    """Prefix polynomial hashes: entry i covers values[:i]."""
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(which, len(values)), out=out[1:])
    return out


def byte_prefix(data: np.ndarray, which: int = 0) -> np.ndarray:
    return prefix(_BYTES[which][data], which)


def spans(pre: np.ndarray, lo: np.ndarray, hi: np.ndarray, which: int = 0) -> np.ndarray:
    """Hash of each span [lo, hi) from prefix hashes, independent of where it stands (not mixed)."""
    return (pre[hi] - pre[lo]) * powers(which, len(pre), True)[lo]


def words(block: Block, ink: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the runs of bytes in ink (all but 0x20 and 0x09-0x0D); runs never cross documents."""
    d = block.data
    if ink is None:
        ink = (d != 32) & ((d < 9) | (d > 13))
    edge = np.zeros(len(d) + 1, bool)
    edge[block.offs] = True
    before = np.zeros(len(d) + 1, bool)
    before[1:] = ink
    after = np.zeros(len(d) + 1, bool)
    after[:-1] = ink
    lo = np.flatnonzero(after & (~before | edge))
    hi = np.flatnonzero(before & (~after | edge))
    return lo, hi, block.doc_of(lo)


def word_hashes(block: Block, lo: np.ndarray, hi: np.ndarray, which: int = 0) -> np.ndarray:
    return mix(spans(byte_prefix(block.data, which), lo, hi, which) + (hi - lo).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))


def window_hashes(values: np.ndarray, n: int, which: int = 0) -> np.ndarray:
    """Hash of values[i:i+n] for every i; windows may cross documents, callers mask those."""
    if len(values) < n:
        return np.zeros(0, np.uint64)
    pre = prefix(values, which)
    lo = np.arange(len(values) - n + 1)
    return mix(spans(pre, lo, lo + n, which))


def sliding_argmin(values: np.ndarray, n: int) -> np.ndarray:
    """Position of the least of values[i:i+n], for every i, by doubling.

    Values are compared on the bits that a position leaves free; ties go to the left.
    """
    low = np.uint64((1 << len(values).bit_length()) - 1)
    best, width = (values & ~low) | np.arange(len(values), dtype=np.uint64), 1
    while width < n:
        step = min(width, n - width)
        best = np.minimum(best[:-step], best[step:])
        width += step
    return (best & low).astype(np.int64)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Concatenation of arange(s, s + c)."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(total)
