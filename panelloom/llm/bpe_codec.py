"""BPE encoding and decoding by batched merge rounds.

All distinct words of a block stand in one flat symbol array.  A round looks up
the rank of every adjacent pair by binary search over the sorted pair keys,
takes each word's lowest rank, and merges all its occurrences from the left.
Words without a further merge leave the array.  Only pairs next to a merge are
looked up again, so the work of a round follows the words still changing.

A null text is empty; empty texts have no ids.  Rows and their order of
repetition are kept: one output row per input row, extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .arrays import Block, blocks, ranges
from .pretokens import Vocabulary, distinct, pretokens, vocabulary

_NONE = np.int64(1) << 60
BLOCK = 1 << 18


def _ranks(v: Vocabulary, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    key = left * v.n + right
    at = np.minimum(np.searchsorted(v.pair_keys, key), len(v.pair_keys) - 1)
    return np.where(v.pair_keys[at] == key, v.pair_rank[at], _NONE)


def merge_rounds(v: Vocabulary, symbols: np.ndarray, word: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words in one array, and the number of ids of each word."""
    done_s, done_w = [], []
    rank = np.full(len(symbols), _NONE)
    if len(symbols) > 1:
        same = word[:-1] == word[1:]
        rank[:-1][same] = _ranks(v, symbols[:-1][same], symbols[1:][same])
    while len(symbols):
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        size = np.diff(np.r_[first, len(word)])
        least = np.minimum.reduceat(rank, first)
        live = np.repeat(least < _NONE, size)
        if not live.all():
            done_s.append(symbols[~live])
            done_w.append(word[~live])
            least = np.repeat(least, size)[live]
            symbols, word, rank = symbols[live], word[live], rank[live]
        else:
            least = np.repeat(least, size)
        if not len(symbols):
            break
        hit = rank == least
        at = np.flatnonzero(hit)
        # runs of adjacent hits (a a a): every second one merges, from the left
        run = np.cumsum(np.r_[True, (np.diff(at) != 1) | (word[at[1:]] != word[at[:-1]])])
        begin = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        at = at[(np.arange(len(at)) - begin[run - 1]) % 2 == 0]
        symbols[at] = v.merged[rank[at]]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        fresh = np.zeros(len(symbols), bool)
        fresh[at] = True
        before = at - 1
        before = before[before >= 0]
        before = np.where(keep[before], before, before - 1)
        fresh[before[before >= 0]] = True
        symbols, word, rank, fresh = symbols[keep], word[keep], rank[keep], fresh[keep]
        look = np.flatnonzero(fresh)
        rank[look] = _NONE
        look = look[look + 1 < len(word)]
        look = look[word[look] == word[look + 1]]
        rank[look] = _ranks(v, symbols[look], symbols[look + 1])
    s = np.concatenate(done_s) if done_s else np.zeros(0, np.int64)
    w = np.concatenate(done_w) if done_w else np.zeros(0, np.int64)
    order = np.argsort(w, kind="stable")
    return s[order], np.bincount(w, minlength=n_words)


def encode_block(v: Vocabulary, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of the block and the offset of each document's ids."""
    lo, hi, special = pretokens(block, v.special)
    if not len(lo):
        return np.zeros(0, np.int64), np.zeros(len(block) + 1, np.int64)
    first, inverse = distinct(block, lo, hi)
    size = (hi - lo)[first]
    own = special[first]
    size = np.where(own, 1, size)
    byte_at = ranges(lo[first], size)
    symbols = v.byte_id[block.data[byte_at]]
    word = np.repeat(np.arange(len(first)), size)
    symbols[own[word]] = v.special_id
    ids, count = merge_rounds(v, symbols, word, len(first))
    offs = np.cumsum(count) - count
    stream = ids[ranges(offs[inverse], count[inverse])]
    per = np.concatenate([[0], np.cumsum(count[inverse])])
    return stream, per[np.searchsorted(lo, block.offs)]


def decode_ids(v: Vocabulary, ids: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the ids laid end to end, and each document's offset in them."""
    size = v.token_len[ids]
    ends = np.concatenate([[0], np.cumsum(size)])
    return v.token_flat[ranges(v.token_off[ids], size)], ends[offs]


def encode_columns(docs: DataFrame, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns, ids array<int>, and exact: whether the decoded ids are the text (null: empty)."""
    kept = [f"k{i}" for i in range(len(keep))]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in blocks(batches, "_text", BLOCK):
            ids, offs = encode_block(v, b)
            raw, cut = decode_ids(v, ids, offs)
            exact = [np.array_equal(raw[cut[i] : cut[i + 1]], b.data[b.offs[i] : b.offs[i + 1]]) for i in range(len(b))]
            lists = pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(b.rows.column(k) for k in kept), lists, pa.array(exact, pa.bool_())], [*kept, "ids", "exact"])

    schema = ", ".join(f"{k} {docs.schema[c].dataType.simpleString()}" for k, c in zip(kept, keep))
    rows = docs.select(*(docs[f"`{c}`"].alias(k) for k, c in zip(kept, keep)), docs[f"`{text}`"].alias("_text"))
    return rows.mapInArrow(run, f"{schema}, ids array<int>, exact boolean").toDF(*keep, "ids", "exact")


def digests(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): the operator's ids and texts, digested where they are made."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in blocks(batches, text, BLOCK):
            ids, offs = encode_block(v, b)
            raw, cut = decode_ids(v, ids, offs)
            whole, said = raw.tobytes(), v.decimal[ids].tolist()
            ids_sha, text_sha = [], []
            for i in range(len(b)):
                ids_sha.append(hashlib.sha256(",".join(said[offs[i] : offs[i + 1]]).encode()).hexdigest())
                plain = whole[cut[i] : cut[i + 1]].decode("utf-8", "replace").encode()
                text_sha.append(hashlib.sha256(plain).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.rows.column(key), pa.array(np.diff(offs), pa.int64()), pa.array(ids_sha), pa.array(text_sha)],
                [key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
