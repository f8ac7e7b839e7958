"""Quality classifier: logistic regression on hashed word 1- and 2-grams, trained by follow-the-regularised-leader.

A document's features are the relative frequencies (times SCALE) of its hashed tokens and token pairs. The
model is trained on the driver on a sample of at most PER_CLASS documents of each class, its intercept then moved to
the whole counts of the classes, and scored on executors as a sparse dot product over whole texts.

Edge cases: null and empty texts have no features and score by the intercept; repeated rows are scored each;
without labels of both classes every score is 0.5; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, held_out, mix64, text_or_empty
from .features import labelled_sample, tokens

PER_CLASS = 4000
BITS = 18
SCALE = 20.0


def slots(h: np.ndarray) -> np.ndarray:
    """Feature slots of a document's token hashes: tokens, then neighbouring pairs (all pairs of equals share a slot)."""
    h = h.astype(np.uint64)
    with np.errstate(over="ignore"):
        pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] + np.uint64(1)
    pairs[h[:-1] == h[1:]] = 0  # whatever the token, its repetition is one feature
    return (mix64(np.concatenate([h, pairs])) & np.uint64((1 << BITS) - 1)).astype(np.int64)


@dataclass
class Model:
    weights: np.ndarray  # float32
    intercept: float


def train(docs: list[np.ndarray], y: np.ndarray, counts: dict[int, int] | None = None, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02) -> Model:
    """Per-coordinate FTRL-proximal on the log loss, one document at a time."""
    n, z, g2 = 1 << BITS, np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    if not len(docs) or y.min() == y.max():
        return Model(np.zeros(n, np.float32), 0.0)
    feats = []
    for h in docs:
        s, c = np.unique(slots(h), return_counts=True)
        feats.append((np.append(s, n), np.append(c * (SCALE / max(1, c.sum())), 1.0)))
    share = np.array([len(y) / (2 * max(1, (y == k).sum())) for k in (0, 1)])  # both classes weigh alike

    def weight(s):
        zs = z[s]
        free = np.append(np.full(s.size - 1, l1), 0.0)  # the intercept isn't drawn to zero
        return np.where(np.abs(zs) > free, -(zs - np.sign(zs) * free) / ((beta + np.sqrt(g2[s])) / alpha + l2), 0.0)

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for i in order.permutation(len(feats)):
            s, x = feats[i]
            w = weight(s)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - y[i]) * x * share[y[i]]
            new = g2[s] + g * g
            z[s] += g - (np.sqrt(new) - np.sqrt(g2[s])) / alpha * w
            g2[s] = new
    w = weight(np.arange(n + 1))
    shift = np.log(max(1, counts.get(1, 0)) / max(1, counts.get(0, 0))) if counts else 0.0
    return Model(w[:n].astype(np.float32), float(w[n] + shift))


def scores(texts: list[str], model: Model) -> np.ndarray:
    hashed, out = tokens("marks"), np.empty(len(texts))
    for i, t in enumerate(texts):
        s = slots(hashed(t))
        out[i] = model.weights[s].sum() * (SCALE / s.size) if s.size else 0.0
    return 1 / (1 + np.exp(-np.clip(out + model.intercept, -30, 30)))


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""

    def run(batches):
        for b in chunks(batches):
            s = scores(b.column("text").to_pylist(), model)
            yield pa.record_batch([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), text_or_empty().alias("text")).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = PER_CLASS) -> Model:
    hashes, y, _, counts = labelled_sample(docs, labels, label, per_class, "marks")
    return train(hashes, y, counts)


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
