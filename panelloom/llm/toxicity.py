"""Toxicity scores from a counterfactually regularised linear classifier.

Features are the distinct lowered words of a text and the distinct beginnings
(four to six bytes) of its longer words, hashed to ``SIZE`` slots.  The loss is the
cross entropy of the labels plus a penalty on counterfactual pairs: in a labelled
text, identity terms are swapped for others of their group (a text without one
is given one), and the squared change of the score is added.  What is left of an
identity term's weight is what it shares with every term of its group; pairs of a
text with and without the term take that away too, so that a neutral mention of
a group does not raise a score.  The pairs of a step are made from every fourth
text of its batch and one group each, drawn anew in every epoch.

Training takes at most about ``SAMPLE`` labelled texts, chosen by a hash of the
id; scoring covers whole texts.  Null and empty texts have no feature and score
as the base rate.  Rows with a null id are neither learned from nor held out.
One output row per input row.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import Block, blocks, byte_prefix, mix, spans, word_hashes, words
from .language_cnn import fold

SIZE, SAMPLE, LEAST_Z, STARTS = 1 << 18, 8000, 4.0, (4, 5, 6)
EPOCHS, RIDGE, FAIR, THRESHOLD = 30, 2e-4, 4.0, 0.3
BLOCK = 1 << 18
# fixed values: identity terms by group, neutral words among them
GROUPS = [
    "person woman man girl boy trans transgender nonbinary female male".split(),
    "people women men girls boys gays lesbians immigrants refugees muslims jews christians hindus blacks whites asians".split(),
    "believer muslim jew jewish christian hindu buddhist atheist catholic".split(),
    "friend gay lesbian straight queer bisexual heterosexual homosexual".split(),
    "citizen black white asian african arab latino mexican chinese american european immigrant refugee".split(),
    "mensch frau mann mädchen junge muslim jude christ schwul lesbisch ausländer flüchtling".split(),
    "personne femme homme fille garçon musulman juif chrétien gay lesbienne immigré réfugié".split(),
    "persona mujer hombre niña niño musulmán judío cristiano gay lesbiana inmigrante refugiado".split(),
]


@dataclass
class Model:
    weights: np.ndarray
    bias: float


def slots(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of the distinct features of each text of the block."""
    d = b.data
    lo, hi, row = words(b, (d >= 128) | ((d >= 97) & (d <= 122)))
    pre = byte_prefix(d, 1)
    rows, hashes = [row], [word_hashes(b, lo, hi)]
    for n in STARTS:
        long = hi - lo > n
        rows.append(row[long])
        hashes.append(mix(spans(pre, lo[long], lo[long] + n, 1) + np.uint64(n)))
    key = np.unique(np.concatenate(rows) * SIZE + (np.concatenate(hashes) % np.uint64(SIZE)).astype(np.int64))
    return key // SIZE, key % SIZE


def slots_of(texts: list[str]) -> list[np.ndarray]:
    """Slots of each of a few short texts."""
    out = []
    for b in blocks([pa.RecordBatch.from_arrays([pa.array([t.lower() for t in texts], pa.string())], ["text"])]):
        row, slot = slots(b)
        out += [slot[row == i] for i in range(len(b))]
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def associated(rows: list[np.ndarray], label: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Slots whose share among the toxic texts differs from that among the others by LEAST_Z standard errors."""
    n1 = max(1.0, float(label.sum()))
    n0 = max(1.0, len(label) - n1)
    toxic = [r for r, y in zip(rows, label, strict=True) if y]
    a = np.bincount(np.concatenate(toxic), minlength=SIZE) if toxic else np.zeros(SIZE)
    share = df / max(1, len(rows))
    error = np.sqrt(np.maximum(share * (1 - share), 1e-9) * (1 / n1 + 1 / n0))
    return (df > 1) & (np.abs(a / n1 - (df - a) / n0) >= LEAST_Z * error)


def train(rows: list[np.ndarray], label: np.ndarray, epochs: int = EPOCHS, fair: float = FAIR, seed: int = 3) -> Model:
    """AdaGrad on cross entropy, ridge and the counterfactual penalty."""
    rng = np.random.default_rng(seed)
    df = np.bincount(np.concatenate(rows), minlength=SIZE) if rows else np.zeros(SIZE, np.int64)
    terms = [slots_of(g) for g in GROUPS]
    known = associated(rows, label, df)
    for g in terms:
        for t in g:
            known[t] = True
    rows = [r[known[r]] for r in rows]
    none = np.zeros(0, np.int64)
    names = [{int(s) for t in g for s in t} for g in terms]
    w, seen = np.zeros(SIZE), np.full(SIZE, 1e-2)
    base = (label.sum() + 0.5) / (len(label) + 1)
    bias, bias_seen = float(np.log(base / (1 - base))), 1e-2
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        for lo in range(0, len(order), 64):
            pick = order[lo : lo + 64]
            flat = np.concatenate([rows[i] for i in pick])
            owner = np.repeat(np.arange(len(pick)), [len(rows[i]) for i in pick])
            score = bias + np.bincount(owner, w[flat], minlength=len(pick))
            err = _sigmoid(score) - label[pick]
            grad = np.bincount(flat, err[owner], minlength=SIZE) / len(pick)
            # counterfactual pairs: the same text with one term of a group, and with another
            for i in range(0, len(pick), 4):
                g = int(rng.integers(len(terms)))
                held = next((k for k, n in enumerate(names) if n & set(rows[pick[i]].tolist())), g)
                a, b = rng.choice(len(terms[held]), 2, replace=False)
                one, other = terms[held][a], terms[held][b] if rng.random() < 0.5 else none
                rest = bias + w[[s for s in rows[pick[i]].tolist() if s not in names[held]]].sum()
                gap = w[one].sum() - w[other].sum()
                p1, p2 = _sigmoid(np.array([rest + w[one].sum(), rest + w[other].sum()]))
                # the penalty acts on the probability and, so that it never fades, on the score
                pull = fair * ((p1 - p2) + 0.1 * gap) / len(pick)
                np.add.at(grad, one, pull * (p1 * (1 - p1) + 0.1))
                np.add.at(grad, other, -pull * (p2 * (1 - p2) + 0.1))
            grad += RIDGE * w
            seen += grad * grad
            w -= 0.3 * grad / np.sqrt(seen)
            bias_seen += err.mean() ** 2
            bias -= 0.3 * err.mean() / np.sqrt(bias_seen)
    return Model(w.astype(np.float32), bias)


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Learn from labelled rows outside the held-out fold; of each, only its slots reach the driver."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~fold(key)).groupBy(F.col(key).alias("_k")).agg(F.max(label).alias("_y"))
    total = max(1, known.count())
    draw = F.pmod(F.xxhash64(F.lit("toxic"), F.col("_k")), F.lit(1 << 30))
    few = known.where(draw < int(min(1.0, sample / total) * (1 << 30)))
    joined = docs.select(F.col(key).alias("_k"), F.lower(text).alias("_text")).join(F.broadcast(few), "_k").select("_k", "_y", "_text")  # about ``sample`` ids

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "_text", BLOCK):
            row, slot = slots(b)
            cut = np.searchsorted(row, np.arange(len(b) + 1))
            raw = [slot[x:y].astype(np.uint32).tobytes() for x, y in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([b.rows.column("_k").cast(pa.int64()), b.rows.column("_y").cast(pa.int32()), pa.array(raw, pa.binary())], ["k", "y", "slots"])

    got = joined.mapInArrow(run, "k long, y int, slots binary").toPandas().sort_values(["k", "slots"])
    return train([np.frombuffer(s, np.uint32).astype(np.int64) for s in got.slots], got.y.to_numpy(np.float64))


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with score for every row."""
    spread = docs.sparkSession.sparkContext.broadcast(model)  # SIZE weights

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = spread.value
        for b in blocks(batches, "_text", BLOCK):
            row, slot = slots(b)
            p = _sigmoid(m.bias + np.bincount(row, m.weights[slot].astype(np.float64), minlength=len(b)))
            yield pa.RecordBatch.from_arrays([*(b.rows.column(k) for k in keep), pa.array(p)], [*keep, "score"])

    schema = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    return docs.select(*keep, F.lower(text).alias("_text")).mapInArrow(run, f"{schema}, score double")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = score(docs, fit(docs, labels))
    return found.select("doc_id", fold().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
