"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Only the number of pieces of each length (at most `capacity` numbers) goes to the driver. There the
whole packing is planned on these counts: lengths above a third of the capacity stand at most two to a bin,
matched greedily (the longest with the longest partner that fits), then shorter ones go, longest first,
to the bin with the tightest gap. Alike bins form runs, so the plan is a few thousand rules of the form "pieces
of length L with ranks from a to b go to bins from s, k to a bin, from offset o". Each piece finds its rank among all of its length from
counts by input part, and its rule by binary search.

Edge cases: a null text is empty and holds the end id alone; repeated doc_ids are separate documents;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, materialise, text_or_empty
from .encoders import WordEncoder, cached, encoder, tokenizer_path

CAPACITY = 2048


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Rules (length, from_rank, to_rank, first_bin, per_bin, offset) and the number of bins."""
    left = np.zeros(capacity + 1, np.int64)
    for k, n in counts.items():
        left[k] = n
    used = np.zeros(capacity + 1, np.int64)
    rules: list[tuple[int, int, int, int, int, int]] = []
    gaps: list[tuple[int, int, int]] = []  # (gap, first_bin, bins)
    bins = 0

    def put(length: int, first: int, n_bins: int, per_bin: int, offset: int) -> None:
        n = n_bins * per_bin
        rules.append((length, int(used[length]), int(used[length]) + n, first, per_bin, offset))
        used[length] += n
        left[length] -= n

    third = capacity // 3
    for a in range(capacity, third, -1):
        b = min(a, capacity - a)
        while left[a]:
            while b > third and not left[b]:
                b -= 1
            pair = b > third and (b != a or left[a] > 1)
            n = int(left[a]) if not pair else int(left[a]) // 2 if a == b else int(min(left[a], left[b]))
            if pair and a == b:
                put(a, bins, n, 2, 0)
            else:
                put(a, bins, n, 1, 0)
                if pair:
                    put(b, bins, n, 1, a)
            gap = capacity - a - (b if pair else 0)
            if gap:
                gaps.append((gap, bins, n))
            bins += n
            if not pair:
                break
    gaps.sort()
    for s in range(third, 0, -1):
        # all gaps of s or more, tightest first; what is split or filled comes back
        keep = [g for g in gaps if g[0] < s]
        heap = [g for g in gaps if g[0] >= s] if left[s] else []
        if not heap:
            keep = gaps
        heapq.heapify(heap)
        while left[s]:
            if not heap:
                per = capacity // s
                n = -(-int(left[s]) // per)
                heap.append((capacity, bins, n))
                bins += n
            gap, first, n = heapq.heappop(heap)
            per = gap // s
            full = min(n, int(left[s]) // per)
            if full:
                put(s, first, full, per, capacity - gap)
                if gap - per * s:
                    keep.append((gap - per * s, first, full))
            if full < n:
                rest = int(left[s])
                if rest:
                    put(s, first + full, 1, rest, capacity - gap)
                    keep.append((gap - rest * s, first + full, 1))
                    full += 1
                if full < n:
                    keep.append((gap, first + full, n - full))
        gaps = keep + heap
    return rules, bins


def _pieces(encode, capacity: int, end_id: int):
    def run(batches):
        from pyspark import TaskContext

        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        end = np.array([end_id], "<u4").tobytes()
        for b in chunks(batches):
            rows = []
            for doc, ids in zip(b.column("doc_id").to_pylist(), encode(b.column("text")), strict=True):
                ids += end
                for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                    x = ids[at : at + 4 * capacity]
                    n = len(x) // 4
                    rows.append((doc, i, at // 4, n, zlib.crc32(x), int(seen[n])))
                    seen[n] += 1
            cols = list(zip(*rows, strict=True))
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.record_batch([pa.array([part] * len(rows), pa.int64()), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["part", "doc_id", "piece", "start", "length", "ids_crc32", "local_rank"])

    return run


def _assign(rules: list[tuple[int, int, int, int, int, int]]):
    table = np.array(sorted(rules), np.int64).reshape(-1, 6)

    def run(batches):
        cached("places", dict)  # lets go of the tokenizer's pieces
        lengths = table[:, 0]
        for b in batches:
            length, rank = (np.asarray(b.column(c)).astype(np.int64) for c in ("length", "rank"))
            at = np.zeros(length.size, np.int64)
            for n in np.unique(length):
                rows = np.flatnonzero(length == n)
                lo, hi = np.searchsorted(lengths, [n, n + 1])
                at[rows] = lo + np.searchsorted(table[lo:hi, 1], rank[rows], "right") - 1
            inside = rank - table[at, 1]
            sequence = table[at, 3] + inside // table[at, 4]
            offset = table[at, 5] + inside % table[at, 4] * length
            yield pa.record_batch([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row for each piece of each document with its place: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    rows = docs.select("doc_id", text_or_empty().alias("text"))
    pieces = materialise(rows.mapInArrow(_pieces(lambda texts: encoder(WordEncoder, tokenizer).encode(texts), capacity, end_id), "part long, doc_id long, piece int, start long, length long, ids_crc32 long, local_rank long"), "pieces")
    by_part = pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = by_part.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).drop("n")
    rules, _ = plan({r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}, capacity)
    ranked = pieces.join(before, ["part", "length"]).withColumn("rank", F.col("before") + F.col("local_rank"))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(_assign(rules), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def op4_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path("word_bpe_49k.json"))
