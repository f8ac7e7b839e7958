"""Toxicity: a convolutional text classifier on hashed word embeddings, trained in numpy.

A word's vector is the sum of the embeddings (of BUCKETS) that it and its first five and four letters hash to; buckets in
fewer than `min_df` training documents (one in 150 of a smaller sample, 3 at least) hold a zero vector. Filters of
widths 1, 2 and 3 slide over the text; each filter's maximum over the whole text, rectified, enters a logistic
layer. For scoring, each filter's part at each place is tabulated by bucket, so a text costs one table row a word.
A fifth of the sample is set aside: on it one global cut is found and placed at a score of 0.7, and a threshold for each language
(used for the `flagged` column only; language is no input of a score).

Edge cases: null and empty texts have no words and score by the bias; repeated rows are scored each; without labels
of both classes every score is 0; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, held_out, text_or_empty
from .features import labelled_sample, tokens

PER_CLASS = 4000
BUCKETS = 1 << 16
WIDTHS = (1, 2, 3)
DIM, FILTERS = 12, 8
CUT = 0.7
_PAD = max(WIDTHS)  # a text without words is a place too


@dataclass
class Model:
    table: np.ndarray  # buckets x sum(widths) x filters
    bias: np.ndarray  # widths x filters
    out: np.ndarray
    shift: float
    known: np.ndarray  # whether a bucket has an embedding
    thresholds: dict[str, float] = field(default_factory=dict)


def _buckets(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    """words x 3: the buckets of each word and of its first five and four letters, 0 where none is known."""
    b = _all(h).reshape(-1, 3)
    return np.where(known[b], b, 0)


def _all(h: np.ndarray) -> np.ndarray:
    return (h % np.uint32(BUCKETS - 1)).astype(np.int64) + 1


def _pooled(ids: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """The rectified maximum of each filter over the places from each text's start to its end; ids has _PAD zeros after each text."""
    g = table[ids[:, 0]]
    g += table[ids[:, 1]]
    g += table[ids[:, 2]]
    n, at, out = ids.shape[0] - _PAD, 0, []
    bounds = np.stack([starts, ends], 1).ravel()  # of the stretches, every second one is a text's; the others reach into its neighbour
    for i, w in enumerate(WIDTHS):
        z = g[:n, at]
        for j in range(1, w):
            z = z + g[j : n + j, at + j]
        out.append(np.maximum(np.maximum.reduceat(z, bounds, axis=0)[::2] + bias[i], 0))
        at += w
    return np.concatenate(out, 1)


def _lay(texts: list[np.ndarray], known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all words, and where each text begins and ends; a text without words has one place."""
    sizes = np.array([t.size // 3 + _PAD for t in texts])
    starts = np.cumsum(sizes) - sizes
    ids = np.zeros((sizes.sum() + _PAD, 3), np.int64)
    for s, t in zip(starts, texts, strict=True):
        ids[s : s + t.size // 3] = _buckets(t, known)
    return ids, starts, starts + np.array([max(1, t.size // 3) for t in texts])


def logits(texts: list[np.ndarray], m: Model) -> np.ndarray:
    if not texts:
        return np.zeros(0)
    ids, starts, ends = _lay(texts, m.known)
    return _pooled(ids, starts, ends, m.table, m.bias) @ m.out[:-1] + m.out[-1] + m.shift


def _best_cut(z: np.ndarray, y: np.ndarray, prior: np.ndarray) -> float:
    """The cut with the best F1 under the classes' whole counts; between two scores."""
    order = np.argsort(-z)
    z, y, w = z[order], y[order], prior[y[order]]
    tp, n = np.cumsum(w * y), np.cumsum(w)
    f1 = 2 * tp / (n + (w * y).sum())
    i = int(np.argmax(f1))
    return float((z[i] + (z[i + 1] if i + 1 < z.size else z[i] - 1)) / 2)


def train(docs: list[np.ndarray], y: np.ndarray, langs: list[str], counts: dict[int, int], epochs: int = 6, min_df: int = 40, rate: float = 0.1, decay: float = 1e-3) -> Model:
    rng = np.random.default_rng(11)
    spans = sum(WIDTHS)
    if not len(docs) or y.min() == y.max():
        return Model(np.zeros((BUCKETS, spans, FILTERS), np.float32), np.zeros((len(WIDTHS), FILTERS)), np.zeros(len(WIDTHS) * FILTERS + 1), -30.0, np.zeros(BUCKETS, bool))
    test = np.arange(len(docs)) % 5 == 4
    df = np.zeros(BUCKETS, np.int64)
    for d, t in zip(docs, test, strict=True):
        if not t:
            df[np.unique(_all(d))] += 1
    known = df >= max(3, min(min_df, len(docs) // 150))
    ids = [np.concatenate([_buckets(d, known), np.zeros((_PAD, 3), np.int64)]) for d in docs]
    emb = rng.normal(0, 0.05, (BUCKETS, DIM)).astype(np.float32) * known[:, None]
    conv = rng.normal(0, 0.3, (spans, DIM, FILTERS)).astype(np.float32)
    bias, out = np.zeros((len(WIDTHS), FILTERS)), np.append(rng.normal(0, 0.3, len(WIDTHS) * FILTERS), 0.0)
    ge, gc, gb, go = np.full(emb.shape, 1e-2, np.float32), np.full(conv.shape, 1e-2, np.float32), np.full(bias.shape, 1e-2), np.full(out.shape, 1e-2)
    share = np.array([len(y) / (2 * max(1, (y == k).sum())) for k in (0, 1)])
    places = np.cumsum([0, *WIDTHS])
    for epoch in range(epochs):
        for i in rng.permutation(np.flatnonzero(~test)):
            x = emb[ids[i]].sum(1)
            n = x.shape[0] - _PAD
            part = (x @ conv.transpose(1, 0, 2).reshape(DIM, -1)).reshape(-1, spans, FILTERS)
            pools, tops = [], []
            for k, w in enumerate(WIDTHS):
                z = sum(part[j : max(n, 1) + j, places[k] + j] for j in range(w))
                top = z.argmax(0)
                tops.append(top)
                pools.append(z[top, np.arange(FILTERS)] + bias[k])
            pool = np.concatenate(pools)
            act = np.append(np.maximum(pool, 0), 1.0)
            p = 1 / (1 + np.exp(-np.clip(act @ out, -30, 30)))
            g = (p - y[i]) * share[y[i]]
            dout = g * act + decay * out
            dact = (g * out[:-1] * (pool > 0)).reshape(len(WIDTHS), FILTERS)
            go += dout * dout
            out -= rate * dout / np.sqrt(go)
            if not dact.any():
                continue
            gb += dact * dact
            bias -= rate * dact / np.sqrt(gb)
            rows, grads = [], []
            dconv = np.zeros_like(conv)
            for k, w in enumerate(WIDTHS):
                for j in range(w):
                    at = tops[k] + j
                    dconv[places[k] + j] = x[at].T * dact[k]
                    rows.append(ids[i][at].ravel())
                    grads.append(np.repeat((conv[places[k] + j] * dact[k]).T, 3, axis=0))
            rows, grads = np.concatenate(rows), np.concatenate(grads)
            u, inv = np.unique(rows, return_inverse=True)
            de = np.zeros((u.size, DIM), np.float32)
            np.add.at(de, inv, grads)
            de[u == 0] = 0
            de += decay * emb[u]
            ge[u] += de * de
            emb[u] -= rate * de / np.sqrt(ge[u])
            gc += dconv * dconv
            conv -= rate * dconv / np.sqrt(gc)
    table = np.einsum("bd,sdf->bsf", emb, conv).astype(np.float32)
    model = Model(table, bias.astype(np.float32), out, 0.0, known)
    held = np.flatnonzero(test)
    z = logits([docs[i] for i in held], model)
    prior = np.array([counts.get(k, 0) / max(1, (y == k).sum()) for k in (0, 1)])
    cut = _best_cut(z, y[held], prior)
    model.shift = float(np.log(CUT / (1 - CUT)) - cut)
    for lang in set(langs):
        own = np.array([langs[i] == lang for i in held], bool)
        both = own.any() and 20 <= own.sum() and 0 < y[held][own].mean() < 1
        model.thresholds[lang] = float(1 / (1 + np.exp(-(_best_cut(z[own], y[held][own], prior) + model.shift)))) if both else CUT
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= 0.7), flagged (score at or above the language's threshold) of every row."""

    def run(batches):
        hashed = tokens("words")
        for b in chunks(batches, size=1 << 20):
            z = logits([hashed(t) for t in b.column("text").to_pylist()], model)
            s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            own = np.array([model.thresholds.get(x, CUT) for x in b.column("lang").to_pylist()])
            yield pa.record_batch([b.column("doc_id"), b.column("held_out"), pa.array(s), pa.array((s >= CUT).astype(np.int32)), pa.array(s >= own)], ["doc_id", "held_out", "score", "predicted", "flagged"])

    rows = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, flagged boolean")


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = PER_CLASS) -> Model:
    hashes, y, langs, counts = labelled_sample(docs, labels, label, per_class, "words")
    return train(hashes, y, langs, counts)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
