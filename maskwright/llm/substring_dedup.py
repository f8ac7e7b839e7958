"""Removal of repeated word sequences: every word inside a window of `length` consecutive words that also starts anywhere else.

1. Windows of `length - period + 1` words are hashed only at the positions of a document that stand in a difference cover modulo `period`. Any two
   places are led to the cover by one common shift below `period`, so two equal windows of `length` words hold equal anchors at one common offset.
2. Anchors meet by hash. One that occurs once ends there: windows near it can only be repeated through other anchors. Each task tells those that
   repeat among its own texts apart first and sends one row for them, so an anchor of any number of places costs each batch of text one row.
3. Around each shared anchor the match is extended: all windows of `length` words that hold the anchor are hashed to 96 bits in the texts that
   have it, and meet by hash in the same way, whatever group they came from: a frequent anchor's windows are dealt over all tasks.
4. The windows that meet another are merged to stretches of each document, and their words are cut out.

Words are maximal runs of bytes other than 0x20 and 0x09 to 0x0D, compared as they are. A word's hash is a polynomial of its bytes (of BLAKE2 from LONG bytes on).
Two windows count as equal if 96 bits of hash agree (with 10^12 windows, a false pair has odds of about one in 100,000).

Memory: a block holds about ROWS_PER_BLOCK anchors or windows; a task holds FLUSH_BYTES of text, or one longer text with 24 bytes a word.

Edge cases: null and empty texts have no words; documents of fewer than `length` words lose nothing; rows that repeat a doc_id are documents of their own, also
when their texts are equal: then each is a copy of the other and loses all its words that stand in a window; null doc_ids are documents like others; all columns of the input
travel inside one struct, so no name of theirs can clash; an empty table gives an empty result. doc_ids are integers of up to 64 bits (another type is an error before any job starts).
"""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks, collect_garbage, materialise, mix64, text_bytes, tidy
from .suffix_dedup import _CUT, _PACKED, _block, _bucket, _by_document, _packed_table, _rows, _unpack, numbered

LENGTH = 35
ROWS_PER_BLOCK = 400_000
BUCKET_BYTES = 8 << 20
FLUSH_BYTES = 8 << 20
LONG = 1 << 16

#: perfect difference sets: every other residue is the difference of exactly one ordered pair
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}

_SPAN = 1 << 20
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SPACES = re.compile(rb"[\x20\x09-\x0D]")

_ANCHOR = (("ah", "<u8"), ("id", "<i8"), ("s0", "<i4"), ("many", "u1"))
_WINDOW = (("ah", "<u8"), ("rh", "<u4"), ("id", "<i8"), ("s0", "<i4"), ("many", "u1"))
_AT = (("id", "<i8"), ("s0", "<i4"))


def period_for(length: int) -> int:
    """The largest period that leaves an anchor two fifths of the window's words."""
    return max(p for p in COVERS if p <= max(1, 3 * length // 5))


# ------------------------------------------------------------ hashes

@functools.cache
def _powers(lane: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    up = np.full(_SPAN + 1, _BASES[lane], np.uint64)
    down = np.full(_SPAN + 1, pow(_BASES[lane], -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(up), np.cumprod(down), mix64(np.arange(1, 257, dtype=np.uint64) + np.uint64(1000 * lane))


def _spread(values: np.ndarray, begin: np.ndarray, end: np.ndarray, lane: int) -> np.ndarray:
    """Polynomial hashes of the stretches [begin, end) of at most _SPAN values."""
    up, down, _ = _powers(lane)
    with np.errstate(over="ignore"):
        prefix = np.zeros(values.size + 1, np.uint64)
        np.cumsum(values * up[: values.size], out=prefix[1:])
        return mix64((prefix[end] - prefix[begin]) * down[begin])


def window_keys(words: np.ndarray, length: int, lane: int = 0) -> np.ndarray:
    """The hash of every window of `length` words (words: their hashes), in order."""
    n, out = words.size - length + 1, []
    step = _SPAN // 2
    for at in range(0, max(0, n), step):
        part = words[at : at + step + length - 1]
        begin = np.arange(part.size - length + 1)
        out.append(_spread(part, begin, begin + length, lane))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _segments(raw: bytes):
    """Pieces of at most _SPAN bytes cut at white space; a longer word is a piece of its own."""
    at = 0
    while len(raw) - at > _SPAN:
        cut = max(raw.rfind(c, at, at + _SPAN) for c in (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c"))
        if cut < 0:
            found = _SPACES.search(raw, at + _SPAN)
            cut = found.start() if found else len(raw)
        yield raw[at:cut]
        at = cut + 1
    yield raw[at:]


def _word_bounds(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(flat.size + 2, np.int8)
    inside[1:-1] = ~_SPACE[flat]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def _hashed(raw: bytes, lanes: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Starts of the words of raw and their hashes in each lane."""
    if len(raw) > _SPAN:  # one word
        return np.zeros(1, np.int64), [np.array([_of_long(raw, k)], np.uint64) for k in range(lanes)]
    flat = np.frombuffer(raw, np.uint8)
    begin, end = _word_bounds(flat)
    keys = [_spread(_powers(k)[2][flat], begin, end, k) for k in range(lanes)]
    for i in np.flatnonzero(end - begin >= LONG):
        for k in range(lanes):
            keys[k][i] = _of_long(raw[begin[i] : end[i]], k)
    return begin, keys


def _of_long(word: bytes, lane: int) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8, person=b"lane%d" % lane).digest(), "little")


def grouped_words(texts: list[bytes], lanes: int):
    """(index of the first text, words of each text, their hashes in each lane), for groups of about _SPAN bytes of whole texts."""
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) < _SPAN):
            size += len(texts[to]) + 1
            to += 1
        if to == at + 1:
            parts = [_hashed(s, lanes)[1] for s in _segments(texts[at])]
            keys = [np.concatenate(k) for k in zip(*parts, strict=True)]
            yield at, np.array([keys[0].size]), keys
        else:
            begin, keys = _hashed(b"\n".join(texts[at:to]), lanes)
            ends = np.cumsum([len(t) + 1 for t in texts[at:to]])
            yield at, np.diff(np.searchsorted(begin, ends), prepend=0), keys
        at = to


def _utf8(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    return batch.column(name).cast(pa.binary()).to_pylist()


# ------------------------------------------------------------ what repeats in a task, and what is sent on

def _repeats(keys: list[np.ndarray], known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of the rows by keys, which of them (in that order) share their keys with another or a row of `known`, and which are the first of theirs."""
    order = np.lexsort(keys[::-1])
    first = np.ones(order.size, bool)
    if order.size:
        first[1:] = functools.reduce(np.logical_or, [(k := x[order])[1:] != k[:-1] for x in keys])
    group = np.cumsum(first) - 1
    several = np.bincount(group) > 1
    if known is not None and order.size:
        several |= np.bincount(group, weights=known[order]) > 0
    return order, several[group], first


def _own_and_sent(keys: list[np.ndarray], ids: np.ndarray, at: np.ndarray, blocks: int, layout, found) -> list[tuple]:
    """Packed rows: places that repeat in this batch (given by `found`), one row for each such key, and the places of all other keys."""
    order, several, first = _repeats(keys)
    one = several & first
    sent = order[~several | one]
    many = several[~several | one]
    keys = [k[sent] for k in keys]
    rows = _rows(0, _block(keys[0], blocks), [*keys, np.where(many, 0, ids[sent]), np.where(many, 0, at[sent]), many], layout)
    return rows + found(ids[order[several]], at[order[several]])


def _settle(layout, found):
    """Of a block of sent rows: the places whose key another place, or another task's several places, has too."""

    def run(table: pa.Table) -> pa.Table:
        tidy()
        kind, blobs = table.column("kind")[0].as_py(), table.column("data").to_pylist()
        if kind == 1:
            key = table.column("key")[0].as_py()
            return pa.table(*_packed_table([(1, key, b) for b in blobs]))
        *keys, ids, at, many = _unpack(blobs, layout)
        order, several, _ = _repeats(keys, many)
        mine = order[several & (many[order] == 0)]
        return pa.table(*_packed_table(found(ids[mine], at[mine])))

    return run


def _places(buckets: int):
    return lambda ids, at: _rows(1, _bucket(ids, buckets), [ids, at], _AT)


def _stretches(buckets: int, length: int):
    """Windows as stretches of words, neighbouring ones merged."""

    def found(ids, at):
        by = np.lexsort((at, ids))
        ids, at = ids[by], at[by]
        if not ids.size:
            return []
        head = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (at[1:] > at[:-1] + length)])
        tail = np.r_[head[1:], ids.size] - 1
        return _rows(1, _bucket(ids[head], buckets), [ids[head], at[head], at[tail] + length], _CUT)

    return found


# ------------------------------------------------------------ the two scans

def _flushed(batches, places, emit):
    """places(batch) yields (bytes of text, arrays); emit(arrays) gives packed rows, at every FLUSH_BYTES."""
    held, size = [], 0
    for b in chunks(batches, size=2 << 20):
        for n, arrays in places(b):
            size += n
            held.append(arrays)
            if size >= FLUSH_BYTES:
                yield pa.record_batch(*_packed_table(emit([np.concatenate(c) for c in zip(*held, strict=True)])))
                held, size = [], 0
    if held:
        yield pa.record_batch(*_packed_table(emit([np.concatenate(c) for c in zip(*held, strict=True)])))


def _anchors(length: int, blocks: int, buckets: int):
    period = period_for(length)
    inside = np.zeros(period, bool)
    inside[list(COVERS[period])] = True
    width = length - period + 1

    def places(batch):
        ids, texts = np.asarray(batch.column("_id")), _utf8(batch)
        for at, counts, (keys,) in grouped_words(texts, 1):
            doc = np.repeat(np.arange(counts.size), counts)
            pos = np.arange(doc.size) - (np.cumsum(counts) - counts)[doc]
            which = np.flatnonzero(inside[pos % period] & (pos + width <= counts[doc]) & (counts[doc] >= length))
            h = window_keys(keys, width)[which] if which.size else np.zeros(0, np.uint64)
            yield sum(map(len, texts[at : at + counts.size])), (h, ids[at + doc[which]], pos[which])

    def run(batches):
        return _flushed(batches, places, lambda c: _own_and_sent(c[:1], c[1], c[2], blocks, _ANCHOR, _places(buckets)))

    return run


def _windows(length: int, blocks: int, buckets: int):
    period = period_for(length)

    def places(batch):
        ids, texts, data = np.asarray(batch.column("_id")), _utf8(batch), batch.column("data").to_pylist()
        for at, counts, keys in grouped_words(texts, 2):
            begin = np.cumsum(counts) - counts
            shared = [np.unique(_unpack([d], _AT)[1]).astype(np.int64) for d in data[at : at + counts.size]]
            doc = np.repeat(np.arange(counts.size), [s.size for s in shared])
            pos = np.concatenate(shared)
            # the windows that hold an anchor start at most period - 1 words before it
            mark = np.zeros(int(counts.sum()) + 1, np.int64)
            np.add.at(mark, begin[doc] + np.maximum(pos - period + 1, 0), 1)
            np.add.at(mark, begin[doc] + np.maximum(np.minimum(pos, counts[doc] - length), -1) + 1, -1)
            start = np.flatnonzero(np.cumsum(mark)[:-1] > 0)
            d = np.searchsorted(begin, start, "right") - 1
            h = [window_keys(k, length, i)[start] if start.size else np.zeros(0, np.uint64) for i, k in enumerate(keys)]
            h[1] = (h[1] >> np.uint64(32)).astype(np.uint32)
            yield sum(map(len, texts[at : at + counts.size])), (*h, ids[at + d], start - begin[d])

    def run(batches):
        return _flushed(batches, places, lambda c: _own_and_sent(c[:2], c[2], c[3], blocks, _WINDOW, _stretches(buckets, length)))

    return run


def repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """_id and data (starts, then ends, in words, as 32-bit integers) of the documents of numbered() that have repeated words."""
    total = text_bytes(docs, "_text")[1]
    anchor_blocks = max(16, int(total / 25 / ROWS_PER_BLOCK))
    window_blocks = max(16, int(total / 12 / ROWS_PER_BLOCK))
    buckets = max(8, total // BUCKET_BYTES)
    rows = docs.select("_id", F.col("_text").alias("text"))
    sent = rows.mapInArrow(_anchors(length, anchor_blocks, buckets), _PACKED)
    shared = sent.groupBy("kind", "key").applyInArrow(_settle(_ANCHOR, _places(buckets)), _PACKED)
    shared = materialise(shared.select("key", "data").groupBy("key").applyInArrow(_by_document(_AT, False), "_id long, data binary"), "shared-anchors")
    collect_garbage(docs.sparkSession)
    near = rows.join(shared.hint("shuffle_hash"), "_id").mapInArrow(_windows(length, window_blocks, buckets), _PACKED)
    cuts = near.groupBy("kind", "key").applyInArrow(_settle(_WINDOW, _stretches(buckets, length)), _PACKED)
    return cuts.select("key", "data").groupBy("key").applyInArrow(_by_document(_CUT, True), "_id long, data binary")


def _kept(raw: bytes, data: bytes | None) -> tuple[int, int, bytes]:
    words = raw.split()  # at the same bytes as above
    if data is None:
        return len(words), 0, b" ".join(words)
    s, t = np.frombuffer(data, "<i4").reshape(2, -1).tolist()
    kept = [w for a, b in zip([0, *t], [*s, len(words)], strict=True) for w in words[a:b]]
    return len(words), len(words) - len(kept), b" ".join(kept)


def dedup(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """row (a struct of the input's columns), n_words, n_removed and kept (the remaining words joined by spaces, in UTF-8) of every row of docs."""
    if not isinstance(docs.schema["doc_id"].dataType, T.IntegralType):
        raise TypeError("doc_id must be an integer column")
    docs = numbered(docs)
    cuts = materialise(repeats(docs, length), "word-cuts")
    collect_garbage(docs.sparkSession)
    out = docs.join(cuts.withColumnRenamed("data", "_cuts").hint("shuffle_hash"), "_id", "left").select("row", F.col("_text").alias("text"), F.col("_cuts"))
    schema = out.select("row").schema.add("n_words", "long").add("n_removed", "long").add("kept", "binary")

    def run(batches):
        for b in chunks(batches):
            rows = [_kept(raw, data) for raw, data in zip(_utf8(b), b.column("_cuts").to_pylist(), strict=True)]
            words, removed, kept = zip(*rows, strict=True)
            yield pa.record_batch([b.column("row"), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], ["row", "n_words", "n_removed", "kept"])

    return out.mapInArrow(run, schema)


def op11_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("row.doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: the definition itself: all windows of whole texts, counted by their words
OP11_SQL = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents)
, s AS (SELECT r, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)
, h AS MATERIALIZED (SELECT r, i, sha256(array_to_string(w[i : i + 34], ' ')) AS h FROM s)
, m AS (SELECT h FROM h GROUP BY h HAVING count(*) > 1)
, p AS (SELECT DISTINCT r, unnest(range(i, i + 35)) AS i FROM h WHERE h IN (SELECT h FROM m))
, c AS (SELECT r, list(i) AS cut FROM p GROUP BY r)
, u AS (SELECT r, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS i FROM d)
, k AS (SELECT u.r, string_agg(x, ' ' ORDER BY u.i) AS kept FROM u LEFT JOIN p ON u.r = p.r AND u.i = p.i WHERE p.r IS NULL GROUP BY u.r)
SELECT doc_id, len(w) AS n_words, coalesce(len(cut), 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN c USING (r) LEFT JOIN k USING (r)
"""
