"""Removal of repeated word windows by level-wise doubling.

Of every window of ``target`` words the gram of an eighth of its length with the
least hash is its seed, which windows that follow one another mostly share (see
``repeats``).  Grams that occur in more than one document survive; they alone are
extended to twice their length, as far inside each window as there is room, level by
level.  Those still repeated when the next length would pass the target become whole
windows, which are compared one by one.  Equal windows have equal grams at every
level, so none is lost; the loop also ends when no candidate survives.

Words are maximal runs of bytes other than space and 0x09-0x0D, unchanged.  A
word is removed if some window of ``target`` words over it also starts in a
document with a smaller id; windows are judged on the input.  Null and empty
texts have no words.  A null id counts as larger than all others; rows of one id
never cover each other.  One output row per input row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import Block, blocks, word_hashes, words
from .repeats import OPEN, WINDOW, Answers, Units, covered_units, deal_for, exchange, of_named, prepared, send_longer, send_segments, send_windows
from .shared_store import Scratch

BLOCK = 1 << 19


def word_units(b: Block) -> Units:
    lo, hi, row = words(b)
    return Units(word_hashes(b, lo, hi), np.searchsorted(row, np.arange(len(b) + 1)))


def dedup_words(docs: DataFrame, target: int = 50, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_words, n_removed, kept): kept holds the remaining words joined by one space."""
    deal = deal_for(docs, text)
    scratch = Scratch(docs.sparkSession)
    rows = prepared(scratch, docs, deal, text, key)
    size = -(-target // 8)
    alive = scratch.keep(exchange(send_segments(rows, deal, word_units, target, size, BLOCK, OPEN), deal, False, OPEN), f"level-{size}")
    while 2 * size < target and not alive.isEmpty():
        longer = exchange(send_longer(rows, alive, deal, word_units, target, size, 2 * size, BLOCK), deal, False, OPEN)
        size *= 2
        alive = scratch.keep(longer, f"level-{size}")
        scratch.drop(f"level-{size // 2}")
    said = exchange(send_windows(rows, alive, deal, word_units, target, BLOCK, (OPEN,)), deal, False, WINDOW)
    kind = docs.schema[key].dataType.simpleString()

    def run(table: pa.Table, said: pa.Table) -> pa.Table:
        answers = Answers(said, (WINDOW,))
        few, rest = of_named(table, answers)
        ids, total, gone, kept = [*rest.column("_key").to_pylist()], [], [], []
        for t in rest.column("_text").to_pylist():
            parts = (t or "").encode().split()
            total.append(len(parts))
            gone.append(0)
            kept.append(b" ".join(parts))
        for b in blocks(few.to_batches(), "_text", BLOCK):
            lo, hi, row = words(b)
            offs = np.searchsorted(row, np.arange(len(b) + 1))
            drop = covered_units(b, offs, answers, target, (WINDOW,))
            raw = b.data.tobytes()
            for i in range(len(b)):
                x, y = offs[i], offs[i + 1]
                keep = np.flatnonzero(~drop[x:y]) + x
                total.append(int(y - x))
                gone.append(int(y - x - len(keep)))
                kept.append(b" ".join(raw[p:q] for p, q in zip(lo[keep].tolist(), hi[keep].tolist(), strict=True)))
            ids += b.rows.column("_key").to_pylist()
        return pa.table([pa.array(ids, table.schema.field("_key").type), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], [key, "n_words", "n_removed", "kept"])

    return rows.groupBy("_owner").cogroup(said.groupBy("owner")).applyInArrow(run, f"`{key}` {kind}, n_words long, n_removed long, kept string")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_words(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
