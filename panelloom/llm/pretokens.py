"""Byte-level pre-tokens of a block, and the vocabulary tables of byte_bpe_50k.json.

The library splits text with
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
after it has cut out the added token.  Whether a character starts a pre-token
depends on its own class and on its two neighbours, except after contractions,
so the whole rule is a handful of array comparisons.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np

from .arrays import Block, byte_prefix, mix, spans

OTHER, LETTER, NUMBER, SPACE, WHITE = range(5)
# fixed values: code points with the Unicode property White_Space other than U+0020
WHITE_SPACE = [9, 10, 11, 12, 13, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(1)
def char_classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[WHITE_SPACE] = WHITE
    out[32] = SPACE
    return out


def code_points(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the block and the byte position of each."""
    cps = np.frombuffer(block.data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
    return cps, np.flatnonzero((block.data & 0xC0) != 0x80)


def special_spans(block: Block, special: bytes) -> np.ndarray:
    """Byte positions where the added token stands inside one document."""
    raw, found, at = block.data.tobytes(), [], 0
    while special and (at := raw.find(special, at)) >= 0:
        i, j = block.doc_of(np.array([at, at + len(special) - 1]))
        if i == j:
            found.append(at)
            at += len(special)
        else:
            at += 1
    return np.array(found, np.int64)


def pretoken_starts(cps: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Which characters start a pre-token; cut marks the first character of each independent piece of text."""
    n = len(cps)
    if not n:
        return np.zeros(0, bool)
    c = char_classes()[cps]
    white = c >= SPACE
    start = np.ones(n, bool)
    p, q = c[:-1], c[1:]
    last = np.ones(n, bool)  # the last of its piece
    last[:-1] = cut[1:]
    inner = (p == q) & ~white[1:] | (p == SPACE) & ~white[1:]
    lone = np.zeros(n, bool)  # a white character that another text character follows
    lone[:-1] = ~white[1:]
    lone &= ~last
    inner |= white[:-1] & white[1:] & ~lone[1:]
    start[1:] = ~inner
    start |= cut
    # contractions: an apostrophe that starts a pre-token takes its letters with it
    for i in np.flatnonzero((cps == 39) & start):
        room = 1
        while room < 3 and i + room < n and not cut[i + room]:
            room += 1
        tail = "".join(map(chr, cps[i + 1 : i + room]))
        for piece in CONTRACTIONS:
            if tail.startswith(piece):
                start[i + 1 : i + 1 + len(piece)] = False
                if i + 1 + len(piece) < n:
                    start[i + 1 + len(piece)] |= cut[i + 1 + len(piece)] or c[i + 1 + len(piece)] == LETTER
                break
    return start


def piece_cuts(block: Block, at: np.ndarray, special: bytes, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks of the characters that begin a piece, and of those inside an added token."""
    edges = np.unique(np.concatenate([block.offs[:-1], found, found + len(special)]))
    cut = np.zeros(len(at) + 1, bool)
    cut[np.searchsorted(at, edges)] = True
    inside = np.zeros(len(at) + 1, bool)
    for k in range(1, len(special)):
        inside[np.searchsorted(at, found + k)] = True
    return cut[:-1], inside[:-1]


def pretokens(block: Block, special: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the block's pre-tokens, and which of them are the added token."""
    cps, at = code_points(block)
    found = special_spans(block, special)
    cut, inside = piece_cuts(block, at, special, found)
    lo = at[pretoken_starts(cps, cut) & ~inside]
    hi = np.append(lo[1:], len(block.data))[: len(lo)]
    return lo, hi, np.isin(lo, found)


def distinct(block: Block, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One index for each distinct span, and the distinct number of every span.

    Spans count as equal by a mixed 64-bit hash of bytes and length; within a
    block (some 10**6 spans) two different ones meet once in 10**7 blocks.
    """
    h = mix(spans(byte_prefix(block.data), lo, hi) + (hi - lo).astype(np.uint64))
    _, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    return first, inverse


class Vocabulary:
    """Merge table, byte values and token bytes, read from a tokenizers JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        if spec["pre_tokenizer"]["type"] != "ByteLevel" or model["type"] != "BPE":
            raise ValueError("a byte-level BPE file is needed")
        shown = [b for r in (range(33, 127), range(161, 173), range(174, 256)) for b in r]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.char = {**{chr(b): b for b in shown}, **{chr(256 + i): b for i, b in enumerate(hidden)}}
        self.added = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        if len(self.added) > 1:
            raise ValueError(f"one added token at the most is supported, the file has {len(self.added)}")
        self.special = next(iter(self.added), b"")
        self.special_id = self.added.get(self.special, -1)
        self.n = 1 + max([*vocab.values(), *self.added.values()])
        self.bytes: list[bytes] = [b""] * self.n
        for s, i in vocab.items():
            if s.encode() not in self.added:
                self.bytes[i] = bytes(self.char[ch] for ch in s)
        for s, i in self.added.items():
            self.bytes[i] = s
        self.byte_id = np.zeros(256, np.int64)
        for ch, b in self.char.items():
            self.byte_id[b] = vocab[ch]
        pairs = [(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        key = left * self.n + right
        order = np.argsort(key, kind="stable")
        self.pair_keys, self.pair_rank = key[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)  # by rank
        self.token_len = np.array([len(b) for b in self.bytes], np.int64)
        self.token_off = np.concatenate([[0], np.cumsum(self.token_len)])
        self.token_flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.decimal = np.array([str(i) for i in range(self.n)], object)


@lru_cache(4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)
