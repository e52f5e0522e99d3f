"""Language identification by a byte convolutional network.

Bytes (ASCII letters lowered) are embedded; filters of several widths slide over
windows of a fixed length, each filter keeps its maximum over the window, and a
softmax layer turns the maxima into language probabilities.  Training is plain
numpy on the driver over the whole texts of a bounded sample of labelled documents
(about ``SAMPLE`` documents, chosen by a hash of their id).
Prediction covers every byte of every text: a document's probabilities are the
byte-weighted mean over its consecutive windows.

Null texts and texts without a letter give ``und`` with score 0; so does every
text if no labelled document exists.  Null ids are never learned from nor held
out.  One output row per input row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import blocks

WINDOW, EMBED, FILTERS, WIDTHS = 256, 8, 8, (2, 3, 4)
REACH = max(WIDTHS)
SAMPLE, STEPS, BATCH = 800, 700, 128
BLOCK = 1 << 18


@dataclass
class Net:
    langs: list[str]
    embed: np.ndarray  # 256 x EMBED; byte 0 pads and stays zero
    kernel: np.ndarray  # REACH * EMBED x filters, zero beyond a filter's width
    bias: np.ndarray
    out: np.ndarray
    shift: np.ndarray


def lowered(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def cut_windows(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows x WINDOW bytes padded with 0, row of each window, bytes in each window)."""
    size = np.diff(offs)
    per = -(-size // WINDOW)
    row = np.repeat(np.arange(len(size)), per)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)
    lo = offs[row] + nth * WINDOW
    n = np.minimum(offs[row + 1] - lo, WINDOW)
    at = np.arange(WINDOW)
    low = lowered(data)
    grid = np.where(at < n[:, None], low[np.minimum(lo[:, None] + at, max(0, len(data) - 1))], 0) if len(row) else np.zeros((0, WINDOW), np.uint8)
    return grid.astype(np.uint8), row, n


def _columns(net: Net, grid: np.ndarray) -> np.ndarray:
    """windows x WINDOW x REACH * EMBED inputs of the filters."""
    padded = np.zeros((len(grid), WINDOW + REACH - 1), np.uint8)
    padded[:, :WINDOW] = grid
    x = net.embed[padded]
    return np.concatenate([x[:, k : k + WINDOW] for k in range(REACH)], axis=2)


def forward(net: Net, grid: np.ndarray, chunk: int = 256) -> np.ndarray:
    """Language probabilities of each window."""
    best = np.empty((len(grid), len(net.bias)), np.float32)
    for i in range(0, len(grid), chunk):
        g = grid[i : i + chunk]
        z = _columns(net, g).reshape(-1, REACH * EMBED) @ net.kernel
        best[i : i + chunk] = z.reshape(len(g), WINDOW, -1).max(axis=1)
    logits = np.maximum(best + net.bias, 0) @ net.out + net.shift
    p = np.exp(logits - logits.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def train(grid: np.ndarray, label: np.ndarray, langs: list[str], steps: int = STEPS, seed: int = 5) -> Net:
    """Adam on the cross entropy, gradients through the maxima by hand."""
    rng = np.random.default_rng(seed)
    wide = FILTERS * len(WIDTHS)
    mask = np.zeros((REACH * EMBED, wide), np.float32)
    for k, w in enumerate(WIDTHS):
        mask[: w * EMBED, k * FILTERS : (k + 1) * FILTERS] = 1
    embed = rng.normal(0, 0.5, (256, EMBED)).astype(np.float32)
    embed[0] = 0
    net = Net(
        langs, embed, (rng.normal(0, 0.3, mask.shape) * mask).astype(np.float32), np.zeros(wide, np.float32),
        rng.normal(0, 0.3, (wide, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32),
    )
    names = ("embed", "kernel", "bias", "out", "shift")
    m = {k: np.zeros_like(getattr(net, k)) for k in names}
    v = {k: np.zeros_like(getattr(net, k)) for k in names}
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(grid), min(BATCH, len(grid)))
        g, y = grid[pick], label[pick]
        col = _columns(net, g)
        z = col @ net.kernel
        arg = z.argmax(axis=1)
        top = np.take_along_axis(z, arg[:, None], axis=1)[:, 0] + net.bias
        hid = np.maximum(top, 0)
        logits = hid @ net.out + net.shift
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p /= len(y)
        dtop = (p @ net.out.T) * (top > 0)
        seen = np.take_along_axis(col, arg[:, :, None], axis=1)  # batch x filter x inputs
        dcol = dtop[:, :, None] * net.kernel.T[None]
        dembed = np.zeros_like(net.embed)
        padded = np.zeros((len(g), WINDOW + REACH - 1), np.uint8)
        padded[:, :WINDOW] = g
        for k in range(REACH):
            np.add.at(dembed, np.take_along_axis(padded, arg + k, axis=1), dcol[:, :, k * EMBED : (k + 1) * EMBED])
        dembed[0] = 0
        grads = {"embed": dembed, "kernel": np.einsum("bf,bfi->if", dtop, seen) * mask, "bias": dtop.sum(0), "out": hid.T @ p + 1e-4 * net.out, "shift": p.sum(0)}
        rate = 0.01 * (1 - 0.9 * step / steps)
        for k in names:
            m[k] += 0.1 * (grads[k] - m[k])
            v[k] += 0.01 * (grads[k] ** 2 - v[k])
            getattr(net, k)[...] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)
    return net


def fold(key: str = "doc_id"):
    """crc32(id as text) mod 4 is 2."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE) -> Net:
    """Train on labelled rows outside the held-out fold.

    About ``sample`` documents are chosen by a hash of their id against a
    threshold that follows the number of labelled rows; all their windows reach the
    driver.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull() & ~fold(key))
    total = max(1, known.count())
    draw = F.pmod(F.xxhash64(F.lit("lang"), F.col(key)), F.lit(1 << 30))
    few = known.where(draw < int(min(1.0, sample / total) * (1 << 30))).select(F.col(lang).alias("lang"), F.col(text).alias("_text"))

    def pick(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "_text", BLOCK):
            grid, row, _ = cut_windows(b.data, b.offs)
            yield pa.RecordBatch.from_arrays([b.rows.column("lang").take(pa.array(row)), pa.array([w.tobytes() for w in grid], pa.binary())], ["lang", "window"])

    got = few.mapInArrow(pick, "lang string, window binary").toPandas().sort_values(["lang", "window"])
    langs = sorted(got.lang.unique()) if len(got) else ["und"]
    if not len(got):
        return train(np.zeros((1, WINDOW), np.uint8), np.zeros(1, np.int64), langs, steps=1)
    grid = np.frombuffer(b"".join(got.window), np.uint8).reshape(-1, WINDOW)
    return train(grid, np.searchsorted(langs, got.lang.to_numpy().astype(str)), langs)


def predict(docs: DataFrame, net: Net, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with lang_pred and score for every row."""
    names = np.array(net.langs, object)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "_text", BLOCK):
            grid, row, n = cut_windows(b.data, b.offs)
            p = np.zeros((len(b), len(names)))
            np.add.at(p, row, forward(net, grid) * n[:, None])
            p /= np.maximum(1, np.diff(b.offs))[:, None]
            best = p.argmax(axis=1)
            letter = b.rows.column("_letter").to_numpy(zero_copy_only=False).astype(bool)
            pred = np.where(letter, names[best], "und")
            score = np.where(letter & (pred != "und"), np.clip(p[np.arange(len(b)), best], 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*(b.rows.column(k) for k in keep), pa.array(pred, pa.string()), pa.array(score)], [*keep, "lang_pred", "score"])

    letter = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("_letter")
    schema = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    return docs.select(*keep, F.col(text).alias("_text"), letter).mapInArrow(run, f"{schema}, lang_pred string, score double")


def in_known_language(docs: DataFrame, net: Net, least: float = 0.3, text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows whose text is in a learned language with probability ``least`` or more; a missing label is filled in.

    Texts without a letter go, and mixtures in which no language leads.
    """
    plain = [f"c{i}" for i in range(len(docs.columns))]
    at = {c: p for c, p in zip(docs.columns, plain, strict=True)}
    seen = predict(docs.toDF(*plain), net, at[text], tuple(plain)).where((F.col("lang_pred") != "und") & (F.col("score") >= least))
    return seen.select(*(F.coalesce(p, "lang_pred").alias(c) if c == lang else F.col(p).alias(c) for c, p in at.items()))


def op5_language_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, fit(docs)).select("doc_id", fold().alias("held_out"), "lang_pred", "score")
