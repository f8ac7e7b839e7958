"""Hashed word tokens of whole texts, and bounded labelled samples for training."""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, materialise, text_or_empty
from .encoders import Pieces, cached, ids_bytes

_TOKEN = re.compile(r"\w+|[^\w\s]+")
_WORD = re.compile(r"\w+")


class HashedTokens:
    """Texts to arrays of 32-bit hashes. kind: `marks` keeps case and runs of marks, one hash a token; `words` lower-cases and drops marks, with three hashes a word: of itself and of its first five and four letters."""

    def __init__(self, kind: str):
        find = {"marks": _TOKEN.findall, "words": lambda s: [x for w in _WORD.findall(s.lower()) for x in (w, "5" + w[:5], "4" + w[:4])]}[kind]
        self.look = Pieces(lambda w: ids_bytes([crc32(t.encode("utf-8", "replace")) for t in find(w)]), 350_000).__getitem__

    def __call__(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.look, text.split())) if text else b"", "<u4")


def tokens(kind: str) -> HashedTokens:
    return cached(f"tokens {kind}", lambda: HashedTokens(kind))


MOST_BYTES = 48 << 20  # of text for each class


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, kind: str, most_bytes: int = MOST_BYTES) -> tuple[list[np.ndarray], np.ndarray, list[str], dict[int, int]]:
    """Token hashes, labels and languages of at most per_class documents and most_bytes of text of each class (one document at least), and the classes' whole counts.

    Only documents that aren't held out are used; which ones is fixed by a hash of their ids. A doc_id
    with several labels counts with the highest, null labels not at all; of rows that share a doc_id the one with the smallest hash of its text is taken.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    counts = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = None
    for y in (0, 1):
        part = known.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    rows = docs.select("doc_id", text_or_empty().alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"))
    rows = rows.join(F.broadcast(chosen), "doc_id")  # at most 2 * per_class rows are broadcast
    one = F.min_by(F.struct("text", "lang"), F.struct(F.xxhash64("text"), F.col("lang")))
    rows = materialise(rows.groupBy("doc_id", "y").agg(one.alias("d")).select("doc_id", "y", "d.text", "d.lang"), "labelled")
    sizes = rows.select("doc_id", "y", F.octet_length("text").alias("n")).collect()
    order = lambda r: (crc32(str(r.doc_id).encode()), r.doc_id)
    used, keep = {}, []
    for r in sorted(sizes, key=order):
        if used.setdefault(r.y, 0) == 0 or used[r.y] + r.n <= most_bytes:
            used[r.y] += r.n + 1
            keep.append(r.doc_id)
    if len(keep) < len(sizes):
        rows = rows.where(F.col("doc_id").isin(keep))

    def run(batches):
        import pyarrow as pa

        hashed = tokens(kind)
        for b in batches:
            yield pa.record_batch([b.column("doc_id"), b.column("y"), b.column("lang"), pa.array([hashed(t).tobytes() for t in b.column("text").to_pylist()], pa.binary())], ["doc_id", "y", "lang", "hashes"])

    got = rows.select("doc_id", "y", "lang", "text").mapInArrow(run, "doc_id long, y int, lang string, hashes binary").collect()
    got.sort(key=order)
    return [np.frombuffer(bytes(r.hashes), "<u4") for r in got], np.array([r.y for r in got], np.int64), [r.lang for r in got], counts
