"""Token counts by compiled finite-state transducers.

Two deterministic transducers run one after the other.

* The *splitter* reads character classes and marks where pre-tokens start.  Its
  thirteen states fit a small table, so a text is cut into chunks of equal
  length, the state map of every chunk (exit state for each entry state) is
  computed for all chunks in step, and a parallel prefix scan composes the maps
  into the entry state of every chunk.  A second pass over all chunks then marks
  the starts.
* The *counter* reads the bytes of a pre-token.  A prefix has exactly one last
  token, so a state need only hold, for each suffix that some token could still
  extend, the token before it and the count there.  States are determinised when
  first met; every transition is annotated with the change of the token count.
  All distinct pre-tokens of a block run in step, one byte a step.

Each pre-token starts the counter anew, so the counts of a document are the sum
over its pre-tokens: the last scan is a prefix sum.

Null and empty texts have zero bytes and zero tokens.  One output row per input
row; repeated rows give repeated results.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .arrays import Block, blocks
from .pretokens import LETTER, NUMBER, OTHER, SPACE, WHITE, Vocabulary, char_classes, code_points, distinct, piece_cuts, special_spans, vocabulary

BLOCK = 1 << 18
CHUNK = 128

# ---------------------------------------------------------------- the splitter

# symbols: the five classes of pretokens.py, then characters that contractions tell apart; + CUT where a piece begins
APOS, SINGLE, R, V, L, E = 5, 6, 7, 8, 9, 10
CUT = 11
START, LET, NUM, OTH, SP1, WN1, RUN_SP, RUN_WN, AP, AP_R, AP_V, AP_L, DONE = range(13)
THIS, PREV = 16, 32  # annotations: this character starts a pre-token; the one before did


def _letter(sym: int) -> bool:
    return sym == LETTER or sym >= SINGLE


def _fresh(sym: int) -> int:
    """A pre-token that starts with this symbol."""
    if _letter(sym):
        return LET | THIS
    return {OTHER: OTH, NUMBER: NUM, SPACE: SP1, WHITE: WN1, APOS: AP}[sym] | THIS


def _joined(sym: int) -> int:
    """A non-white symbol after the space that leads its pre-token."""
    return LET if _letter(sym) else NUM if sym == NUMBER else OTH


def _step(state: int, sym: int) -> int:
    if sym >= CUT:
        return _fresh(sym - CUT) | (PREV if state in (AP_R, AP_V, AP_L) else 0)
    white = sym in (SPACE, WHITE)
    if state == LET and _letter(sym) or state == NUM and sym == NUMBER:
        return state
    if state == OTH and sym in (OTHER, APOS):
        return OTH
    if state in (SP1, WN1, RUN_SP, RUN_WN) and white:
        return RUN_SP if sym == SPACE else RUN_WN
    if state == SP1:
        return _joined(sym)
    if state == RUN_SP:
        return _joined(sym) | PREV
    if state == RUN_WN:
        return _fresh(sym) | PREV
    if state == AP:
        if sym in (OTHER, APOS):
            return OTH
        if (to := {SINGLE: DONE, R: AP_R, V: AP_V, L: AP_L}.get(sym)) is not None:
            return to
    if state in (AP_R, AP_V, AP_L):
        if sym == (L if state == AP_L else E):
            return DONE
        return (LET if _letter(sym) else _fresh(sym)) | PREV
    return _fresh(sym)


@lru_cache(1)
def splitter() -> np.ndarray:
    """Flat table: entry ``symbol * 16 + state`` holds the next state and its annotations."""
    table = np.zeros((2 * CUT, 16), np.uint8)
    for sym in range(2 * CUT):
        for state in range(13):
            table[sym, state] = _step(state, sym)
    return table.ravel()


def symbols_of(cps: np.ndarray, cut: np.ndarray) -> np.ndarray:
    s = char_classes()[cps]
    small = cps < 128
    named = np.zeros(128, np.uint8)
    for chars, sym in (("'", APOS), ("stmd", SINGLE), ("r", R), ("v", V), ("l", L), ("e", E)):
        for ch in chars:
            named[ord(ch)] = sym
    own = named[np.where(small, cps, 0)]
    return np.where(own > 0, own, s) + np.uint8(CUT) * cut


def compose(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """State map of a chunk followed by another, row by row."""
    return np.take_along_axis(then, first, axis=1)


def prefix_scan(maps: np.ndarray) -> np.ndarray:
    """Inclusive parallel prefix scan under compose: log2(chunks) rounds over all chunks at once."""
    out, step = maps, 1
    while step < len(out):
        out = np.concatenate([out[:step], compose(out[:-step], out[step:])])
        step *= 2
    return out


def split_starts(cps: np.ndarray, cut: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Which characters start a pre-token."""
    n = len(cps)
    table = splitter()
    lanes = -(-(n + 1) // chunk)
    sym = np.full(lanes * chunk, CUT + LETTER, np.uint16)
    sym[:n] = symbols_of(cps, cut)
    sym = np.ascontiguousarray(sym.reshape(lanes, chunk).T) * np.uint16(16)
    state = np.broadcast_to(np.arange(13, dtype=np.uint8), (lanes, 13))
    for j in range(chunk):
        state = table[sym[j][:, None] + state] & 15
    through = prefix_scan(state.astype(np.int64))
    enter = np.concatenate([[START], through[:-1, START]]).astype(np.uint8)
    marks = np.empty((chunk, lanes), np.uint8)
    for j in range(chunk):
        got = table[sym[j] + enter]
        marks[j], enter = got, got & 15
    flat = marks.T.ravel()
    start = (flat[:n] & THIS) > 0
    start |= (flat[1 : n + 1] & PREV) > 0
    return start


# ---------------------------------------------------------------- the counter


class Counter:
    """The determinised counting transducer, compiled as far as texts have needed it.

    ``most`` bounds its memory: a larger table is dropped between blocks and
    compiled anew, which changes no result.
    """

    def __init__(self, v: Vocabulary, most: int = 700_000):
        self.v, self.most = v, most
        self.rank = dict(zip(v.pair_keys.tolist(), v.pair_rank.tolist(), strict=True))
        self.token = {b: i for i, b in enumerate(v.bytes) if i != v.special_id and b}
        self.open = {b[:k] for b in self.token for k in range(1, len(b))}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self) -> None:
        self.states: list[tuple] = [(b"", ((-1, 0),))]
        self.number: dict[tuple, int] = {self.states[0]: 0}
        self.next: dict[int, int] = {}
        self.pairs.clear()

    def spell(self, raw: bytes) -> list[int]:
        """Merges of one short string, lowest rank first; only for compiling."""
        ids = [int(self.v.byte_id[b]) for b in raw]
        while len(ids) > 1:
            ranks = [self.rank.get(a * self.v.n + b, 1 << 60) for a, b in zip(ids, ids[1:])]
            k = min(range(len(ranks)), key=ranks.__getitem__)
            if ranks[k] == 1 << 60:
                break
            ids[k : k + 2] = [int(self.v.merged[ranks[k]])]
        return ids

    def stable(self, a: int, b: int) -> bool:
        """Do two adjacent tokens stay as they are?"""
        if (got := self.pairs.get((a, b))) is None:
            got = self.pairs[a, b] = self.spell(self.v.bytes[a] + self.v.bytes[b]) == [a, b]
        return got

    def compile(self, key: int) -> int:
        """Transition of state key >> 8 under byte key & 255: the next state, 16 bits on, and the count's change plus 32768."""
        tail, held = self.states[key >> 8]
        grown = tail + bytes([key & 255])
        lengths = [k for k in range(len(tail), -1, -1) if k == 0 or k == len(tail) or tail[len(tail) - k :] in self.open]
        at = dict(zip(lengths, held, strict=True))
        for k in lengths:
            last, lag = at[k]
            new = self.token.get(grown[len(tail) - k :])
            if new is not None and (last < 0 or self.stable(last, new)):
                break
        else:
            raise ValueError("the merge table has no single last token here")
        delta = lag + 1
        start = next((i for i in range(len(grown)) if grown[i:] in self.open), len(grown))
        tail = grown[start:]
        kept = tuple((at[k - 1][0], at[k - 1][1] - delta) for k in range(len(tail), 0, -1) if tail[len(tail) - k :] in self.open)
        state = (tail, (*kept, (new, 0)))
        if (to := self.number.get(state)) is None:
            to = self.number[state] = len(self.states)
            self.states.append(state)
        self.next[key] = out = to << 16 | delta + 32768
        return out

    def counts(self, data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Tokens of each span."""
        if len(self.next) > self.most:
            self.reset()
        size = hi - lo
        order = np.argsort(-size, kind="stable")
        lo, size = lo[order], size[order]
        state, total = np.zeros(len(lo), np.int64), np.zeros(len(lo), np.int64)
        get, build = self.next.get, self.compile
        for j in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -j, side="left"))  # those longer than j
            key = state[:n] << 8 | data[lo[:n] + j]
            if n > 1:
                few, inverse = np.unique(key, return_inverse=True)
                step = np.array([get(k) or build(k) for k in few.tolist()], np.int64)[inverse]
            else:
                k = int(key[0])
                step = np.array([get(k) or build(k)], np.int64)
            state[:n] = step >> 16
            total[:n] += (step & 65535) - 32768
        out = np.empty_like(total)
        out[order] = total
        return out


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(vocabulary(path))


def count_block(c: Counter, block: Block) -> np.ndarray:
    """Tokens of each document of the block."""
    special = c.v.special
    cps, at = code_points(block)
    found = special_spans(block, special)
    cut, inside = piece_cuts(block, at, special, found)
    lo = at[split_starts(cps, cut) & ~inside]
    if not len(lo):
        return np.zeros(len(block), np.int64)
    hi = np.append(lo[1:], len(block.data))
    own = np.isin(lo, found)
    first, inverse = distinct(block, lo, hi)
    size = np.where(own[first], 0, (hi - lo)[first])
    per = c.counts(block.data, lo[first], lo[first] + size)
    per[own[first]] = 1
    scan = np.concatenate([[0], np.cumsum(per[inverse])])
    return np.diff(scan[np.searchsorted(lo, block.offs)])


def token_counts(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id", limit: int = 1024) -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) for every row."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(path)
        for b in blocks(batches, text, BLOCK):
            n = count_block(c, b)
            yield pa.RecordBatch.from_arrays([b.rows.column(key), pa.array(np.diff(b.offs)), pa.array(n), pa.array(n > limit)], [key, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
