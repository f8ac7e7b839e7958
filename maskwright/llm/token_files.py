"""Token-id files: a concatenated id array per shard with Elias-Fano encoded document boundaries.

Documents are laid out in ascending doc_id order (null ids first). A shard is a row of a written table:
its ids as 16- or 32-bit little-endian integers, its documents' ids, and the ends of its documents as an
Elias-Fano sequence: low bits packed, high bits in unary, and for select a 32-bit count of the ones before
each 512-bit block. `part` and `local_start` place a shard; only one bound and one total for each part (at most
MAX_PARTS) go to the driver.

Edge cases: a null text is empty and holds the end id alone; repeated doc_ids are documents of their own, in
any order; other columns are ignored; an empty table makes no shard and no row.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, materialise, mix64, text_bytes, text_or_empty
from .encoders import ByteEncoder, encoder, tokenizer_path

PART_BYTES = 8 << 20  # of text
MAX_PARTS = 20_000
SHARD_IDS = 4 << 20

_HEAD = struct.Struct("<QQB")
_BLOCK = 512


def elias_fano(values: np.ndarray) -> bytes:
    """A non-decreasing sequence below 2**32 in about 2 + log2(last / n) bits an item."""
    v = np.asarray(values, np.uint64)
    n = v.size
    if not n:
        return _HEAD.pack(0, 0, 0)
    top = int(v[-1])
    if top >= 1 << 32 or (np.diff(v.astype(np.int64)) < 0).any():
        raise ValueError("values must not decrease and stay below 2**32")
    low = max(0, (top // n).bit_length() - 1)
    bits = (v[:, None] >> np.arange(low, dtype=np.uint64) & np.uint64(1)).astype(np.uint8)
    lows = np.packbits(bits.ravel(), bitorder="little").tobytes()
    size = -(-(n + (top >> low) + 1) // _BLOCK) * _BLOCK
    high = np.zeros(size, np.uint8)
    high[(v >> np.uint64(low)).astype(np.int64) + np.arange(n)] = 1
    before = np.concatenate([[0], np.cumsum(high.reshape(-1, _BLOCK).sum(1, dtype=np.int64))[:-1]]).astype("<u4")
    return _HEAD.pack(n, size, low) + lows + np.packbits(high, bitorder="little").tobytes() + before.tobytes()


class EliasFano:
    def __init__(self, blob: bytes):
        self.n, size, self.low = _HEAD.unpack_from(blob)
        at = _HEAD.size
        self.lows = np.frombuffer(blob, np.uint8, -(-self.n * self.low // 8), at)
        at += self.lows.size
        self.high = np.frombuffer(blob, np.uint8, size // 8, at)
        self.before = np.frombuffer(blob, "<u4", size // _BLOCK, at + size // 8)

    def get(self, index) -> np.ndarray:
        """The items at the given places, by select on the high bits."""
        i = np.atleast_1d(np.asarray(index, np.int64))
        if not i.size:
            return np.zeros(0, np.int64)
        if i.min() < 0 or i.max() >= self.n:
            raise IndexError("no such item")
        block = np.searchsorted(self.before, i, "right") - 1
        span = _BLOCK // 8
        rows = np.unpackbits(self.high.reshape(-1, span)[block], axis=1, bitorder="little")
        inside = (np.cumsum(rows, 1, dtype=np.int32) <= (i - self.before[block])[:, None]).sum(1)
        high = block * _BLOCK + inside - i
        low = np.zeros(i.size, np.int64)
        for b in range(self.low):
            at = i * self.low + b
            low |= (self.lows[at >> 3] >> (at & 7) & 1).astype(np.int64) << b
        return high << self.low | low


def id_bounds(docs: DataFrame, parts: int) -> np.ndarray:
    """At most MAX_PARTS - 1 doc_ids that cut the documents into parts of about as many rows; an id that many rows repeat stands there several times."""
    if parts < 2:
        return np.zeros(0, np.int64)
    cuts = docs.select(F.percentile_approx(F.col("doc_id").cast("long"), [i / parts for i in range(1, parts)], 20 * parts)).first()[0]
    return np.array(cuts or [], np.int64)


def part_of(ids: pa.Array, no: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The part of each document, in id order; the rows of an id that is several bounds are dealt to all parts between them. Null ids come first."""
    known = np.asarray(pc.fill_null(ids, -(1 << 63)), np.int64)
    low, high = np.searchsorted(bounds, known, "left"), np.searchsorted(bounds, known, "right")
    wide = high > low + 1
    return np.where(wide, low + (mix64(no.astype(np.uint64)) % np.maximum(1, high - low).astype(np.uint64)).astype(np.int64), low) * np.asarray(ids.is_valid(), np.int64)


def _ids(encode, width: str, bounds: np.ndarray):
    def run(batches):
        for b in chunks(batches):
            ids = [np.frombuffer(x, "<u4").astype(width).tobytes() for x in encode(b.column("text"))]
            part = part_of(b.column("doc_id"), np.asarray(b.column("no")), bounds)
            yield pa.record_batch([pa.array(part), b.column("doc_id"), pa.array(ids, pa.binary())], ["part", "doc_id", "ids"])

    return run


def _shards(end_id: int, width: str):
    item = np.dtype(width).itemsize
    end = np.array([end_id], width).tobytes()

    def run(batches):
        part, start, docs, blobs, ends, size = None, 0, [], [], [], 0

        def shard():
            row = (part, start, len(docs), size, b"".join(blobs), elias_fano(np.array(ends)), docs)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
            return pa.record_batch([pa.array([x], t) for x, t in zip(row, types, strict=True)], ["part", "local_start", "n_docs", "n_ids", "ids", "ends", "doc_ids"])

        for b in batches:
            for own, doc, ids in zip(*(b.column(c).to_pylist() for c in ("part", "doc_id", "ids")), strict=True):
                n = len(ids) // item + 1
                if docs and (size + n > SHARD_IDS or own != part):
                    yield shard()
                    start, docs, blobs, ends, size = start + size, [], [], [], 0
                if own != part:
                    part, start = own, 0
                docs.append(doc)
                blobs += (ids, end)
                size += n
                ends.append(size)
        if docs:
            yield shard()

    return run


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, vocabulary: int = 50_257) -> DataFrame:
    """Encodes every document where it is read and moves its ids, not its text, to its part; returns the written table of shards."""
    width = "<u2" if vocabulary <= 1 << 16 else "<u4"
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("no"), text_or_empty().alias("text"))
    parts = min(MAX_PARTS, max(1, -(-text_bytes(texts)[1] // PART_BYTES)))
    ids = texts.mapInArrow(_ids(lambda t: encoder(ByteEncoder, tokenizer).encode(t), width, id_bounds(texts, parts)), "part long, doc_id long, ids binary")
    ordered = ids.repartition(parts, "part").sortWithinPartitions("part", "doc_id")
    return materialise(ordered.mapInArrow(_shards(end_id, width), "part long, local_start long, n_docs long, n_ids long, ids binary, ends binary, doc_ids array<long>"), "token-files")


def with_starts(shards: DataFrame) -> DataFrame:
    """shards with `start`: ids in all shards before it."""
    totals = sorted(shards.groupBy("part").agg(F.sum("n_ids")).collect())
    starts, at = [], 0
    for part, n in totals:  # at most MAX_PARTS rows
        starts.append((part, at))
        at += n
    base = shards.sparkSession.createDataFrame(starts, "part long, base long")
    return shards.join(F.broadcast(base), "part").withColumn("start", F.col("base") + F.col("local_start"))


def documents_of(ids: bytes, ends: bytes, n: int) -> list[np.ndarray]:
    """The id arrays of a shard's documents, cut at the decoded boundaries."""
    cuts = EliasFano(ends).get(np.arange(n))
    width = len(ids) // int(cuts[-1]) if n else 2
    return np.split(np.frombuffer(ids, f"<u{width}"), cuts[:-1]) if n else []


def _read(batches):
    for b in batches:
        for start, n, ids, ends, docs in zip(*(b.column(c).to_pylist() for c in ("start", "n_docs", "ids", "ends", "doc_ids")), strict=True):
            parts = documents_of(ids, ends, n)
            sizes = np.array([p.size for p in parts])
            crc = [zlib.crc32(p.astype("<u4").tobytes()) for p in parts]
            yield pa.record_batch([pa.array(docs, pa.int64()), pa.array(start + np.cumsum(sizes) - sizes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_documents(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files."""
    return with_starts(shards).select("start", "n_docs", "ids", "ends", "doc_ids").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_token_files(spark, sf_dir: str) -> DataFrame:
    return read_documents(write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path("byte_bpe_50k.json")))
