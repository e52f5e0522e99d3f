"""Offset-preserving SentencePiece BPE encoding and decoding.

A text is first normalised: at every position the longest key of the model's
compiled character map is replaced (no key: one character stays), spaces become
U+2581 and a leading one is put in front.  Every normalised character carries the
bytes of the original text that it stands for, so that each piece is projected to
a span of original bytes.

Merging is by strings: of all adjacent pieces of a text whose concatenation is a
piece, the best score merges, the leftmost on ties.  Where two characters stand
side by side in no piece at all, no merge can reach across, so a text falls apart
into short independent words and each distinct word of a block is merged once, all
words together in rounds over one flat array.  A piece that no better or equal
piece extends is merged at all its places of a word in one round; others one place
a round.  A word of more than ``LONG`` characters goes through a heap in place of
rounds, with the same result, so that time stays near-linear.

Characters outside the vocabulary become byte pieces; the last one of a character
carries its span, those before it are empty spans, as the library has it.  A null
text is empty, an empty one has no ids.  One output row per input row, repeated
rows and ids included; extra columns are ignored.  Words are told apart inside one
block by 64 bits.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .arrays import Block, blocks, mix, prefix, ranges, spans
from .pretokens import code_points

SPACE_MARK = 0x2581
BLOCK = 1 << 18
LONG = 128
_NONE = np.int64(1) << 60


class CharMap:
    """The compiled character map of a model: a double array of units, whose leaves point to replacement strings."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").astype(np.int64)
        self.texts = blob[4 + size :]

    def longest(self, data: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Length in bytes of the longest key that starts at each position and ends by its end (0: none), and where its text starts."""
        units = self.units
        jump = lambda u: (u >> 10) << ((u & 512) >> 6)
        length, leaf = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        live = np.arange(len(at))
        node = np.full(len(at), jump(units[0]))
        step = 0
        while len(live):
            ok = at[live] + step < end[live]
            live, node = live[ok], node[ok]
            c = data[at[live] + step].astype(np.int64)
            node = node ^ c
            u = units[node]
            ok = (u & 0x800000FF) == c
            live, node, u = live[ok], node[ok] ^ jump(u[ok]), u[ok]
            step += 1
            done = (u >> 8) & 1 == 1
            length[live[done]] = step
            leaf[live[done]] = units[node[done]] & 0x7FFFFFFF
        return length, leaf

    def text(self, at: int) -> str:
        return self.texts[at : self.texts.index(b"\0", at)].decode()


class Pieces:
    """Tables of a SentencePiece BPE model with byte fallback."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, kinds = model.normalizer_spec, proto.ModelProto.SentencePiece
        if model.trainer_spec.model_type != 2 or not model.trainer_spec.byte_fallback or not norm.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("a BPE model with byte fallback and escaped white space is needed")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in model.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.map = CharMap(norm.precompiled_charsmap) if norm.precompiled_charsmap else None
        self.dummy, self.squeeze = norm.add_dummy_prefix, norm.remove_extra_whitespaces
        self.n = len(model.pieces)
        texts = [p.piece for p in model.pieces]
        normal = {p.piece: i for i, p in enumerate(model.pieces) if p.type == kinds.NORMAL}
        score = np.array([p.score for p in model.pieces], np.float64)
        self.rank = np.unique(-score, return_inverse=True)[1].astype(np.int64)
        self.byte_id = np.zeros(256, np.int64)
        for i, p in enumerate(model.pieces):
            if p.type == kinds.BYTE:
                self.byte_id[int(p.piece[3:5], 16)] = i
        self.char_id = np.full(0x110000, -1, np.int64)
        left, right, whole, beside = [], [], [], set()
        for s, i in normal.items():
            if len(s) == 1:
                self.char_id[ord(s)] = i
            beside.update(zip(s, s[1:]))
            for k in range(1, len(s)):
                if (a := normal.get(s[:k])) is not None and (b := normal.get(s[k:])) is not None:
                    left.append(a), right.append(b), whole.append(i)
        if any(self.char_id[ord(c)] < 0 for pair in beside for c in pair):
            raise ValueError("every character of a piece has to be a piece")
        left, right, whole = (np.array(x, np.int64) for x in (left, right, whole))
        order = np.argsort(left * self.n + right)
        self.pair_keys, self.pair_piece = (left * self.n + right)[order], whole[order]
        self.safe = np.ones(self.n, bool)
        for part in (left, right):
            self.safe[part[self.rank[whole] <= self.rank[part]]] = False
        self.beside = np.sort(np.array([ord(a) << 21 | ord(b) for a, b in beside], np.int64))
        shown = [b"" if p.type == kinds.CONTROL else bytes([int(p.piece[3:5], 16)]) if p.type == kinds.BYTE else t.replace("▁", " ").encode() for p, t in zip(model.pieces, texts)]
        shown[model.trainer_spec.unk_id] = model.trainer_spec.unk_surface.encode()
        self.token_len = np.array([len(b) for b in shown], np.int64)
        self.token_off = np.concatenate([[0], np.cumsum(self.token_len)])
        self.token_flat = np.frombuffer(b"".join(shown), np.uint8)
        self.is_byte = np.array([p.type == kinds.BYTE for p in model.pieces])
        self.silent = np.array([p.type == kinds.CONTROL for p in model.pieces])
        self.spaced = np.array([p.type == kinds.NORMAL and t.startswith("▁") for p, t in zip(model.pieces, texts)])
        self.decimal = np.array([str(i) for i in range(self.n)], object)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece of two adjacent ones, -1 where there is none."""
        key = left * self.n + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (left >= 0) & (right >= 0), self.pair_piece[at], -1)


@lru_cache(4)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _mapped(p: Pieces, block: Block, cps: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Characters after the character map, with the start of the original bytes of each; one that is replaced by nothing leaves -1."""
    length, leaf = p.map.longest(block.data, at, block.offs[block.doc_of(at) + 1])
    hit = np.flatnonzero(length > 0)
    # a key of several characters covers the matches that start inside it
    width = np.searchsorted(at, at[hit] + length[hit]) - hit
    covered, until = np.zeros(len(at), bool), 0
    for i, k in zip(hit[width > 1].tolist(), width[width > 1].tolist()):
        if i >= until:
            until = i + k
            covered[i + 1 : until] = True
    hit = hit[~covered[hit]]
    text = {k: np.array([ord(c) for c in p.map.text(k)] or [-1], np.int64) for k in np.unique(leaf[hit]).tolist()}
    room = np.where(covered, 0, 1)
    room[hit] = [len(text[k]) for k in leaf[hit].tolist()]
    source = np.repeat(np.arange(len(at)), room)
    out = cps[source]
    if len(hit):
        out[ranges((np.cumsum(room) - room)[hit], room[hit])] = np.concatenate([text[k] for k in leaf[hit].tolist()])
    return out, at[source]


def normalise(p: Pieces, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(characters, original start and end of each in the block's bytes, row of each).

    A character ends where the next one starts, so what was taken out belongs to the one before it.
    """
    cps, lo = code_points(block)
    cps = cps.astype(np.int64)
    if p.map:
        cps, lo = _mapped(p, block, cps, lo)
    row = block.doc_of(lo)
    start = block.offs[:-1].copy()
    if p.squeeze:
        rows, first = np.unique(row[cps != 32], return_index=True)
        start[rows] = lo[cps != 32][first]
    if p.map:
        cps, lo, row = cps[cps >= 0], lo[cps >= 0], row[cps >= 0]
    if p.squeeze:
        space = cps == 32
        keep = ~(space & np.r_[True, space[:-1] | (row[1:] != row[:-1])][: len(space)])  # no space at the start or after another
        cps, lo, row = cps[keep], lo[keep], row[keep]
    cps = np.where(cps == 32, SPACE_MARK, cps)
    last = np.r_[row[1:] != row[:-1], True][: len(row)]
    hi = np.where(last, block.offs[row + 1], np.append(lo[1:], 0)[: len(lo)])
    if p.squeeze:
        ink = np.flatnonzero(cps != SPACE_MARK)
        at = np.searchsorted(ink, np.arange(len(cps)))
        keep = np.append(row[ink], -1)[at] == row  # no marks at the end
        cps, lo, hi, row = cps[keep], lo[keep], hi[keep], row[keep]
    if p.dummy:
        rows = np.unique(row) if p.squeeze else np.flatnonzero(np.diff(block.offs))
        first = np.searchsorted(row, rows)
        cps, lo, hi, row = np.insert(cps, first, SPACE_MARK), np.insert(lo, first, start[rows]), np.insert(hi, first, start[rows]), np.insert(row, first, rows)
    return cps, lo, hi, row


def _by_heap(p: Pieces, sym: list[int]) -> list[tuple[int, int]]:
    """(piece, characters) of one long word: best score first, leftmost on ties."""
    n = len(sym)
    size, after, before = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, int, int, int]] = []
    a = np.array(sym, np.int64)
    whole = p.merged(a[:-1], a[1:])
    for i in np.flatnonzero(whole >= 0).tolist():
        heap.append((int(p.rank[whole[i]]), i, sym[i], sym[i + 1], int(whole[i])))
    heapq.heapify(heap)
    pairs = dict(zip(p.pair_keys.tolist(), p.pair_piece.tolist())) if heap else {}

    def look(i: int) -> None:
        j = after[i]
        if j < n and sym[i] >= 0 and sym[j] >= 0 and (w := pairs.get(sym[i] * p.n + sym[j])) is not None:
            heapq.heappush(heap, (int(p.rank[w]), i, sym[i], sym[j], w))

    while heap:
        _, i, x, y, w = heapq.heappop(heap)
        j = after[i]
        if size[i] == 0 or j >= n or sym[i] != x or sym[j] != y:
            continue
        sym[i], size[i] = w, size[i] + size[j]
        size[j] = 0
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        if before[i] >= 0:
            look(before[i])
        look(i)
    return [(sym[i], size[i]) for i in range(n) if size[i]]


def merge_words(p: Pieces, symbols: np.ndarray, word: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of all words in one array, the characters of each piece, and the pieces of each word."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    width = np.bincount(word, minlength=n_words)
    for w in np.flatnonzero(width > LONG).tolist():
        lo = int(np.searchsorted(word, w))
        got = _by_heap(p, symbols[lo : lo + int(width[w])].tolist())
        out.append((np.array([x for x, _ in got], np.int64), np.array([k for _, k in got], np.int64), np.full(len(got), w)))
    short = (width <= LONG)[word]
    symbols, word = symbols[short], word[short]
    size = np.ones(len(symbols), np.int64)
    made = np.full(len(symbols), -1, np.int64)
    if len(symbols) > 1:
        same = word[:-1] == word[1:]
        made[:-1][same] = p.merged(symbols[:-1][same], symbols[1:][same])
    while len(symbols):
        rank = np.where(made >= 0, p.rank[made], _NONE)
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        count = np.diff(np.r_[first, len(word)])
        least = np.minimum.reduceat(rank, first)
        live = np.repeat(least < _NONE, count)
        if not live.all():
            out.append((symbols[~live], size[~live], word[~live]))
            least = np.repeat(least, count)[live]
            symbols, size, word, rank, made = symbols[live], size[live], word[live], rank[live], made[live]
        else:
            least = np.repeat(least, count)
        if not len(symbols):
            break
        at = np.flatnonzero(rank == least)
        # runs of adjacent hits: every second one merges, from the left; a piece that a better one may extend merges at its first place only
        run = np.cumsum(np.r_[True, (np.diff(at) != 1) | (word[at[1:]] != word[at[:-1]])])
        begin = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        lead = np.r_[True, word[at[1:]] != word[at[:-1]]]
        bold = np.minimum.reduceat(p.safe[made[at]], np.flatnonzero(lead))[np.cumsum(lead) - 1]
        at = at[lead | (bold & ((np.arange(len(at)) - begin[run - 1]) % 2 == 0))]
        symbols[at] = made[at]
        size[at] += size[at + 1]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        fresh = np.zeros(len(symbols), bool)
        fresh[at] = True
        back = at[at > 0] - 1
        back = np.where(keep[back], back, back - 1)
        fresh[back[back >= 0]] = True
        symbols, size, word, made, fresh = symbols[keep], size[keep], word[keep], made[keep], fresh[keep]
        look = np.flatnonzero(fresh)
        made[look] = -1
        look = look[look + 1 < len(word)]
        look = look[word[look] == word[look + 1]]
        made[look] = p.merged(symbols[look], symbols[look + 1])
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(n_words, np.int64)
    s, k, w = (np.concatenate(x) for x in zip(*out))
    order = np.argsort(w, kind="stable")
    return s[order], k[order], np.bincount(w, minlength=n_words)


def encode_block(p: Pieces, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, offset of each row's ids, start and end of each id's span in the block's bytes)."""
    cps, lo, hi, row = normalise(p, block)
    if not len(cps):
        none = np.zeros(0, np.int64)
        return none, np.zeros(len(block) + 1, np.int64), none, none
    key = cps[:-1] << 21 | cps[1:]
    at = np.minimum(np.searchsorted(p.beside, key), len(p.beside) - 1)
    begins = np.flatnonzero(np.r_[True, (p.beside[at] != key) | (row[1:] != row[:-1])])
    ends = np.r_[begins[1:], len(cps)]
    h = mix(spans(prefix(mix(cps.astype(np.uint64) + np.uint64(1))), begins, ends) + (ends - begins).astype(np.uint64))
    _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    size = (ends - begins)[first]
    symbols = p.char_id[cps[ranges(begins[first], size)]]
    ids, wide, count = merge_words(p, symbols, np.repeat(np.arange(len(first)), size), len(first))
    offs = np.cumsum(count) - count
    pick = ranges(offs[inverse], count[inverse])
    ids, wide = ids[pick], wide[pick]
    stop = np.cumsum(wide)
    start = stop - wide
    begin, end = lo[start], hi[stop - 1]
    unknown = np.flatnonzero(ids < 0)
    if len(unknown):
        seen = cps[start[unknown]]
        room = np.ones(len(ids), np.int64)
        room[unknown] = 1 + (seen > 0x7F) + (seen > 0x7FF) + (seen > 0xFFFF)
        raw = np.frombuffer(seen.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)
        spot = np.cumsum(room) - room
        ids, begin, end, start = (np.repeat(x, room) for x in (ids, begin, end, start))
        where = ranges(spot[unknown], room[unknown])
        ids[where] = p.byte_id[raw]
        inner = np.ones(len(where), bool)
        inner[np.cumsum(room[unknown]) - 1] = False
        end[where[inner]] = begin[where[inner]]
    per = np.searchsorted(row[start], np.arange(len(block) + 1))
    return ids, per, begin, end


def decode_ids(p: Pieces, ids: np.ndarray, offs: np.ndarray) -> list[str]:
    """The text of each row's ids: marks are spaces, one space in front goes, bytes that are no UTF-8 become U+FFFD each."""
    size = p.token_len[ids].copy()
    begin = p.token_off[ids].copy()
    loud = np.flatnonzero(~p.silent[ids]) if p.dummy or p.squeeze else np.zeros(0, np.int64)
    lead = np.searchsorted(loud, offs[:-1])
    lead = loud[lead[(lead < len(loud))]] if len(loud) else loud
    lead = np.unique(lead)
    lead = lead[p.spaced[ids[lead]]]
    size[lead] -= 1
    begin[lead] += 1
    raw = p.token_flat[ranges(begin, size)].tobytes()
    ends = np.concatenate([[0], np.cumsum(size)])
    cut, quiet = ends[offs].tolist(), np.flatnonzero(p.silent[ids])
    out = []
    for i in range(len(cut) - 1):
        inner = ends[quiet[np.searchsorted(quiet, offs[i]) : np.searchsorted(quiet, offs[i + 1])]].tolist() if len(quiet) else []  # bytes do not join across control pieces
        edges = [cut[i], *inner, cut[i + 1]]
        out.append("".join(_shown(raw[a:b]) for a, b in zip(edges, edges[1:])))
    return out


def _shown(part: bytes) -> str:
    try:
        return part.decode()
    except UnicodeDecodeError:
        return _patched(part)


def _patched(part: bytes) -> str:
    out, at = [], 0
    while at < len(part):
        try:
            out.append(part[at:].decode())
            break
        except UnicodeDecodeError as e:
            out.append(part[at : at + e.start].decode() + "�")
            at += e.start + 1
    return "".join(out)


def encode_columns(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, ids array<int>, and starts and ends array<int>: the bytes of the original text that each id stands for."""
    kept = [f"_k{i}" for i in range(len(keep))]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for b in blocks(batches, "_text", BLOCK):
            ids, offs, lo, hi = encode_block(p, b)
            base = np.repeat(b.offs[:-1], np.diff(offs))
            lists = [pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(x, pa.int32())) for x in (ids, lo - base, hi - base)]
            yield pa.RecordBatch.from_arrays([*(b.rows.column(k) for k in kept), *lists], [*kept, "ids", "starts", "ends"])

    schema = ", ".join(f"`{k}` {docs.schema[c].dataType.simpleString()}" for k, c in zip(kept, keep))
    coded = docs.select(*(docs[f"`{c}`"].alias(k) for k, c in zip(kept, keep)), docs[f"`{text}`"].alias("_text")).mapInArrow(run, f"{schema}, ids array<int>, starts array<int>, ends array<int>")
    return coded.toDF(*keep, "ids", "starts", "ends")


def digests(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256, n_bytes, covered): the operator's ids and texts digested where they are made, the bytes of the text, and the bytes that its spans cover."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(path)
        for b in blocks(batches, text, BLOCK):
            ids, offs, lo, hi = encode_block(p, b)
            said = p.decimal[ids].tolist()
            sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
            covered = np.concatenate([[0], np.cumsum(hi - lo)])
            yield pa.RecordBatch.from_arrays(
                [
                    b.rows.column(key), pa.array(np.diff(offs), pa.int64()), pa.array([sha(",".join(said[offs[i] : offs[i + 1]])) for i in range(len(b))], pa.string()),
                    pa.array([sha(t) for t in decode_ids(p, ids, offs)], pa.string()), pa.array(np.diff(b.offs), pa.int64()), pa.array(np.diff(covered[offs]), pa.int64()),
                ],
                [key, "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes", "covered"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, n_bytes long, covered long")


def op11_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of piece_bpe_32k.model for every document, whose spans lie end to end over the whole text."""
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
