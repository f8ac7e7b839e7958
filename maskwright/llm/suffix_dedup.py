"""Removal of repeated byte strings: every byte inside a string of LENGTH bytes that also starts earlier.

"Earlier" is a smaller doc_id, or an earlier start in the same document. Sorting the suffixes of the whole
corpus would move about a hundred times its size, so suffixes are dealt into buckets first, and most of them are settled before any sort:

1. Each window of LENGTH bytes has an anchor, the position of the smallest hash of its GRAM-byte strings (the
   leftmost of equals). Equal windows have equal anchors at equal offsets. Neighbouring windows with one anchor are a run.
2. Runs are dealt out by the anchor's hash. An anchor hash that occurs once ends there. Of runs that are alike as a whole
   (128 bits of hash agree), all but the first are repeats; each task already merges those that it reads.
3. The first run of each kind that shares its anchor with other kinds is sent, with its bytes, to the suffix
   bucket of its anchor. A bucket's suffixes are sorted one bucket at a time: by their first COVER bytes, and ties by the ranks
   of a difference-cover sample of the bucket's positions, computed beforehand. Neighbours in suffix order with LENGTH common
   bytes are equal windows; all but the earliest are repeats.
4. The repeats of each document are merged and cut out.

Memory: a bucket holds about RUNS_PER_BLOCK runs, and no key adds more than one run of each kind from each batch a task reads.

Edge cases: null texts are empty; documents shorter than LENGTH lose nothing; rows that repeat a doc_id are documents
of their own, in the order of a hash of their text, except that rows equal in both are one document, reported each; a null doc_id comes before all
others; all columns of the input travel inside one struct, so no name of theirs can clash; an empty table gives an empty result.
Runs count as alike as a whole if 128 bits of hash agree; their bytes aren't compared.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, materialise, mix64, text_bytes, text_or_empty, tidy
from .encoders import cached

LENGTH = 100
GRAM = 28
COVER = 32
RUNS_PER_BLOCK = 400_000
BUCKET_BYTES = 8 << 20
FLUSH_BYTES = 12 << 20

_SPAN = 1 << 20
_LOW = np.uint64(_SPAN - 1)
_BASE = 0x9E3779B97F4A7C15 | 1


# ------------------------------------------------------------ packed columns

_RUN = (("ah", "<u8"), ("rh", "<u8"), ("id", "<i8"), ("s0", "<i4"), ("len", "u1"), ("off", "u1"))
_CUT = (("id", "<i8"), ("s0", "<i4"), ("to", "<i4"))


def _pack(columns, layout) -> bytes:
    import zstandard

    out = []
    for (name, kind), c in zip(layout, columns, strict=True):
        c = np.ascontiguousarray(c, kind)
        if name == "id" and c.size:
            c = np.diff(c, prepend=c.dtype.type(0))
        if name in ("ah", "rh"):  # bytes that don't compress; the rest by significance
            out.append(c.tobytes())
        else:
            out.append(c.view("u1").reshape(c.size, -1).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(out))


def _unpack(blobs: list[bytes], layout) -> list[np.ndarray]:
    import zstandard

    width = sum(np.dtype(k).itemsize for _, k in layout)
    cols: list[list[np.ndarray]] = [[] for _ in layout]
    for blob in blobs:
        raw = zstandard.ZstdDecompressor().decompress(blob)
        n, at = len(raw) // width, 0
        for col, (name, kind) in zip(cols, layout, strict=True):
            w = np.dtype(kind).itemsize
            part = np.frombuffer(raw, "u1", n * w, at)
            at += n * w
            if name not in ("ah", "rh"):
                part = np.ascontiguousarray(part.reshape(w, n).T).ravel()
            part = part.view(kind)
            col.append(np.cumsum(part) if name == "id" else part)
    return [np.concatenate(c) if c else np.zeros(0, k) for c, (_, k) in zip(cols, layout, strict=True)]


def _rows(kind: int, keys: np.ndarray, columns: list[np.ndarray], layout) -> list[tuple]:
    """One packed row for each key; rows inside stand in (id, s0) order."""
    if not keys.size:
        return []
    order = np.lexsort((columns[[n for n, _ in layout].index("s0")], columns[[n for n, _ in layout].index("id")], keys))
    keys, columns = keys[order], [c[order] for c in columns]
    cuts = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1))
    ends = np.append(cuts[1:], keys.size)
    return [(kind, int(keys[a]), _pack([c[a:b] for c in columns], layout)) for a, b in zip(cuts, ends, strict=True)]


_PACKED = "kind int, key long, data binary"


def _packed_table(rows: list[tuple]):
    return [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.binary())], ["kind", "key", "data"]


def _bucket(ids: np.ndarray, buckets: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix64(ids.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def _block(ah: np.ndarray, blocks: int) -> np.ndarray:
    return ((ah >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)


# ------------------------------------------------------------ 1. anchors and runs

@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.full(_SPAN + 1, _BASE, np.uint64)
        down = np.full(_SPAN + 1, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        return np.cumprod(up), np.cumprod(down), mix64(np.arange(1, 257, dtype=np.uint64))


def runs_of(flat: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of at most _SPAN bytes: anchor hash, run hash, first window, windows less one, anchor's offset in the first.

    valid[s] says whether the window at s lies inside one document.
    """
    n = flat.size
    up, down, code = _powers()
    empty = np.zeros(0, np.uint64)
    if n < LENGTH:
        return empty, empty, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(code[flat] * up[:n], out=prefix[1:])
        grams = mix64((prefix[GRAM:] - prefix[:-GRAM]) * down[: n - GRAM + 1])
        least = (grams & ~_LOW) | np.arange(grams.size, dtype=np.uint64)
        width, want = 1, LENGTH - GRAM + 1
        while 2 * width <= want:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < want:
            least = np.minimum(least[: least.size - (want - width)], least[want - width :])
        anchor = (least & _LOW).astype(np.int64)
        starts = np.flatnonzero(valid[: anchor.size])
        if not starts.size:
            return empty, empty, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        a = anchor[starts]
        first = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (starts[1:] != starts[:-1] + 1)])
        last = np.r_[first[1:], starts.size] - 1
        s0, s1, at = starts[first], starts[last], a[first]
        to = s1 + LENGTH
        body = (prefix[to] - prefix[s0]) * down[s0]
        rh = mix64(body + (((at - s0) << 8) | (s1 - s0)).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        return mix64(grams[at] ^ np.uint64(_BASE)), rh, s0, s1 - s0, at - s0  # the least hashes are small: mixed anew they spread evenly


def _batch_runs(ids: list[int], texts: list[bytes]):
    """Runs of whole documents; a long document is cut into spans that overlap by a window."""
    group, size = [], 0

    def flush():
        flat = np.frombuffer(b"".join(t for _, _, t in group), np.uint8)
        ends = np.cumsum([len(t) for _, _, t in group])
        begin = ends - [len(t) for _, _, t in group]
        valid = np.ones(flat.size, bool)
        for e, b in zip(ends, begin, strict=True):
            valid[max(b, e - LENGTH + 1) : e] = False
        ah, rh, s0, n, off = runs_of(flat, valid)
        which = np.searchsorted(ends, s0, "right")
        return [ah, rh, np.array([i for i, _, _ in group], np.int64)[which], s0 - begin[which] + np.array([o for _, o, _ in group], np.int64)[which], n, off]

    for i, t in zip(ids, texts, strict=True):
        step = _SPAN - LENGTH
        for at in range(0, max(1, len(t) - LENGTH + 1), step):
            part = t[at : at + step + LENGTH - 1]
            if len(part) < LENGTH:
                continue
            if size + len(part) > _SPAN and group:
                yield flush()
                group, size = [], 0
            group.append((i, at, part))
            size += len(part)
    if group:
        yield flush()


def _first_of_kind(cols: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The columns sorted by (ah, rh, id, s0), and which rows are the first of their kind (ah, rh)."""
    order = np.lexsort((cols[3], cols[2], cols[1], cols[0]))
    cols = [c[order] for c in cols]
    first = np.ones(order.size, bool)
    first[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])
    return cols, first


def _cuts(cols: list[np.ndarray], which: np.ndarray, buckets: int) -> list[tuple]:
    """Packed rows of the stretches [s0, to) of whole runs."""
    i, s, n = cols[2][which], cols[3][which].astype(np.int64), cols[4][which].astype(np.int64)
    return _rows(1, _bucket(i, buckets), [i, s, s + n + LENGTH], _CUT)


def _scan(blocks: int, buckets: int):
    def run(batches):
        cached("runs", dict)  # lets go of other caches
        held, size = [], 0

        def flush():
            cols, first = _first_of_kind([np.concatenate(c) for c in zip(*held, strict=True)])
            rows = _cuts(cols, ~first, buckets)
            cols = [c[first] for c in cols]
            return pa.record_batch(*_packed_table(rows + _rows(0, _block(cols[0], blocks), cols, _RUN)))

        for b in chunks(batches, size=2 << 20):
            texts = [t.encode() for t in b.column("text").to_pylist()]
            held += _batch_runs(b.column("_id").to_pylist(), texts)
            size += sum(map(len, texts))
            if size >= FLUSH_BYTES and held:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return run


# ------------------------------------------------------------ 2. kinds of runs

def _settle(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        tidy()
        kind, blobs = table.column("kind")[0].as_py(), table.column("data").to_pylist()
        if kind == 1:
            cols = _unpack(blobs, _CUT)
            return pa.table(*_packed_table(_rows(1, np.full(cols[0].size, table.column("key")[0].as_py()), cols, _CUT)))
        cols, first = _first_of_kind(_unpack(blobs, _RUN))
        rows = _cuts(cols, ~first, buckets)
        group = np.cumsum(np.r_[True, cols[0][1:] != cols[0][:-1]]) - 1
        several = (np.bincount(group, weights=first) > 1)[group] & first
        asked = [c[several] for c in cols]
        return pa.table(*_packed_table(rows + _rows(0, _bucket(asked[2], buckets), asked, _RUN)))

    return run


# ------------------------------------------------------------ 3. suffix buckets

@functools.cache
def difference_cover(v: int) -> tuple[tuple[int, ...], np.ndarray]:
    """A set D with every residue mod v a difference of two members (greedily grown), and for residues a, b the least d with a + d and b + d in D."""
    cover, missing = [0], set(range(1, v))
    while missing:
        best = max(range(v), key=lambda x: (len({(x - c) % v for c in cover} & missing | {(c - x) % v for c in cover} & missing), -x))
        missing -= {(best - c) % v for c in cover} | {(c - best) % v for c in cover}
        cover.append(best)
    inside = np.zeros(v, bool)
    inside[cover] = True
    d = np.arange(v)
    shift = np.array([[int(np.flatnonzero(inside[(a + d) % v] & inside[(b + d) % v])[0]) for b in range(v)] for a in range(v)])
    return tuple(sorted(cover)), shift


def _words(text: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """The k-th 8 bytes from each place, as numbers in byte order."""
    view = np.lib.stride_tricks.sliding_window_view(text, 8)[at + 8 * k]
    return np.ascontiguousarray(view).view(">u8").ravel().astype(np.uint64)


def _name(keys: list[np.ndarray]) -> np.ndarray:
    """Ranks of the rows of key columns (the first is the most significant), equal rows alike."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(order.size, bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(order.size, np.int64)
    out[order] = np.cumsum(new)
    return out


def sample_ranks(text: np.ndarray, size: int, v: int, depth: int) -> np.ndarray:
    """For the cover sample's positions below size: ranks by their first `depth` bytes or more; -1 elsewhere. text is padded by 8 * v bytes."""
    cover, _ = difference_cover(v)
    inside = np.zeros(v, bool)
    inside[list(cover)] = True
    places = np.flatnonzero(inside[np.arange(size) % v])
    rank = np.full(text.size, -1, np.int64)
    rank[places] = _name([_words(text, places, k) for k in range(v // 8)])
    known = v
    while known < depth:  # a sample position v bytes on is in the sample too
        rank[places] = _name([rank[places], rank[places + known]])
        known *= 2
    return rank


def sort_suffixes(text: np.ndarray, size: int, suffixes: np.ndarray, depth: int = LENGTH, v: int = COVER) -> np.ndarray:
    """The suffixes of one bucket in the order of their first `depth` bytes (at least). text: size bytes and 8 * v of padding."""
    rank = sample_ranks(text, size, v, depth)
    _, shift = difference_cover(v)
    head = _name([_words(text, suffixes, k) for k in range(v // 8)])
    residue = suffixes % v
    own = shift[residue, residue]
    order = np.lexsort((rank[suffixes + own], residue, head))
    # a tie of unlike residues takes the shift of each pair; of one residue it is sorted already
    h, r = head[order], residue[order]
    mixed = np.flatnonzero((h[1:] == h[:-1]) & (r[1:] != r[:-1]))
    out = suffixes[order]
    for tie in np.unique(h[mixed]):
        a, b = np.searchsorted(h, [tie, tie + 1])
        d = lambda x, y: int(rank[x + (s := shift[x % v, y % v])] - rank[y + s])
        out[a:b] = sorted(out[a:b].tolist(), key=functools.cmp_to_key(d))
    return out


def repeated_windows(text: np.ndarray, size: int, suffixes: np.ndarray, order_key: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which suffixes share their first `length` bytes with one of a smaller key. text is padded by 8 * COVER bytes."""
    by = np.argsort(suffixes)
    place = sort_suffixes(text, size, suffixes, length)
    key = order_key[by][np.searchsorted(suffixes[by], place)]
    same = np.ones(max(0, place.size - 1), bool)
    for k in range(length // 8):
        w = _words(text, place, k)
        same &= w[1:] == w[:-1]
    for k in range(length - length % 8, length):
        same &= text[place[1:] + k] == text[place[:-1] + k]
    group = np.cumsum(np.r_[True, ~same]) - 1
    least = np.minimum.reduceat(key, np.flatnonzero(np.r_[True, ~same])) if place.size else key
    repeat = key > least[group]
    out = np.zeros(suffixes.size, bool)
    out[by[np.searchsorted(suffixes[by], place[repeat])]] = True
    return out


def _context(blocks: int):
    """Adds the bytes to the runs that were asked for; rows (kind 0, suffix bucket, runs, bytes)."""

    def run(batches):
        import zstandard

        for b in chunks(batches, size=4 << 20):
            cols, parts = [], []
            for data, text in zip(b.column("data").to_pylist(), b.column("text").to_pylist(), strict=True):
                raw = text.encode()
                c = _unpack([data], _RUN)
                cols.append(c)
                parts += [raw[s : s + n + LENGTH] for s, n in zip(c[3].tolist(), c[4].tolist(), strict=True)]
            c = [np.concatenate(x) for x in zip(*cols, strict=True)]
            key = _block(c[0], blocks)
            order = np.lexsort((c[3], c[2], key))
            c, key = [x[order] for x in c], key[order]
            cuts = np.flatnonzero(np.diff(key, prepend=-1))
            ends = np.append(cuts[1:], key.size)
            z = zstandard.ZstdCompressor(level=1)
            yield pa.record_batch([pa.array(key[cuts]), pa.array([_pack([x[i:j] for x in c], _RUN) for i, j in zip(cuts, ends, strict=True)], pa.binary()), pa.array([z.compress(b"".join(parts[k] for k in order[i:j])) for i, j in zip(cuts, ends, strict=True)], pa.binary())], ["key", "data", "bytes"])

    return run


def _sort_bucket(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        tidy()
        import zstandard

        cols = _unpack(table.column("data").to_pylist(), _RUN)
        raw = b"".join(zstandard.ZstdDecompressor().decompress(x) for x in table.column("bytes").to_pylist())
        n, off = cols[4].astype(np.int64), cols[5].astype(np.int64)
        size = n + LENGTH
        begin = np.cumsum(size) - size
        # anchors stand at multiples of COVER: equal windows then have equal residues
        lead = -off % COVER
        room = -(-(lead + size) // COVER) * COVER
        place = np.cumsum(room) - room + lead
        total = int(room.sum())
        text = np.zeros(total + 8 * COVER, np.uint8)
        text[np.repeat(place - begin, size) + np.arange(int(size.sum()))] = np.frombuffer(raw, np.uint8)
        run_no = np.repeat(np.arange(n.size), n + 1)
        inside = np.arange(run_no.size) - np.repeat(np.cumsum(n + 1) - n - 1, n + 1)
        suffixes = place[run_no] + inside
        start = cols[3].astype(np.int64)[run_no] + inside
        ids = cols[2][run_no]
        key = np.empty(ids.size, np.int64)
        by = np.lexsort((start, ids))
        same = np.r_[False, (ids[by][1:] == ids[by][:-1]) & (start[by][1:] == start[by][:-1])]
        key[by] = np.cumsum(~same)
        dup = repeated_windows(text, total, suffixes, key)
        ids, start = ids[dup], start[dup]
        by = np.lexsort((start, ids))
        ids, start = ids[by], start[by]
        head = np.flatnonzero(np.r_[True, (ids[1:] != ids[:-1]) | (start[1:] > start[:-1] + LENGTH)]) if ids.size else np.zeros(0, np.int64)
        tail = np.r_[head[1:], ids.size] - 1 if ids.size else head
        return pa.table(*_packed_table(_rows(1, _bucket(ids[head], buckets), [ids[head], start[head], start[tail] + LENGTH], _CUT)))

    return run


# ------------------------------------------------------------ 4. documents

def merged(start: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of the stretches [start, to), touching ones joined."""
    if not start.size:
        return start, to
    by = np.argsort(start, kind="stable")
    start, reach = start[by], np.maximum.accumulate(to[by])
    head = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]])
    return start[head], reach[np.r_[head[1:], start.size] - 1]


def _by_document(layout, merge: bool):
    """Packed rows of a bucket of documents to one row for each document."""

    def run(table: pa.Table) -> pa.Table:
        cols = _unpack(table.column("data").to_pylist(), layout)
        at = [n for n, _ in layout].index("id")
        order = np.argsort(cols[at], kind="stable")
        cols = [c[order] for c in cols]
        ids = cols[at]
        cuts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        out = []
        for i, j in zip(cuts, np.append(cuts[1:], ids.size), strict=True):
            c = [x[i:j] for x in cols]
            if merge:
                s, t = merged(c[1].astype(np.int64), c[2].astype(np.int64))
                out.append(np.stack([s, t]).astype("<i4").tobytes())
            else:
                out.append(_pack(c, layout))
        return pa.table([pa.array(ids[cuts], pa.int64()), pa.array(out, pa.binary())], ["_id", "data"])

    return run


def numbered(docs: DataFrame) -> DataFrame:
    """row (a struct of all columns of docs), doc_id, _text (nulls empty) and _id: doc_id where it is unique and not null, else a number in its order."""
    docs = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.col("doc_id"), text_or_empty().alias("_text"))
    ids = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    if ids.where("n > 1 or doc_id is null").isEmpty():
        return docs.withColumn("_id", F.col("doc_id").cast("long"))
    keys = docs.select("doc_id", F.xxhash64("_text").alias("_hash")).distinct()
    keys = materialise(keys.repartitionByRange("doc_id", "_hash").sortWithinPartitions("doc_id", "_hash").select("doc_id", "_hash", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")), "document-keys")
    counts = sorted(map(tuple, keys.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("least")).collect()))  # a row for each partition
    base, starts = 0, []
    for part, n, least in counts:
        starts.append((part, base - least))
        base += n
    known = keys.join(F.broadcast(docs.sparkSession.createDataFrame(starts, "part int, shift long")), "part")
    known = materialise(known.select(F.col("doc_id").alias("_doc"), F.col("_hash").alias("_key"), (F.col("at") + F.col("shift")).alias("_id")), "document-numbers")
    docs = docs.withColumn("_hash", F.xxhash64("_text"))
    return docs.join(known, docs["doc_id"].eqNullSafe(known["_doc"]) & (docs["_hash"] == known["_key"])).select("row", "doc_id", "_text", "_id")


def removals(docs: DataFrame) -> DataFrame:
    """_id and data (starts, then ends, as 32-bit integers) of the documents of numbered() that lose bytes."""
    total = text_bytes(docs, "_text")[1]
    blocks = max(16, int(total / 37 / RUNS_PER_BLOCK))
    buckets = max(8, total // BUCKET_BYTES)
    rows = docs.select("_id", F.col("_text").alias("text"))
    runs = rows.mapInArrow(_scan(blocks, buckets), _PACKED)
    settled = materialise(runs.groupBy("kind", "key").applyInArrow(_settle(buckets), _PACKED), "runs-settled")
    asked = settled.where("kind = 0").select("key", "data").groupBy("key").applyInArrow(_by_document(_RUN, False), "_id long, data binary")
    context = rows.join(asked.hint("shuffle_hash"), "_id").select("data", "text").mapInArrow(_context(blocks), "key long, data binary, bytes binary")
    sorted_ = context.groupBy("key").applyInArrow(_sort_bucket(buckets), _PACKED)
    cuts = settled.where("kind = 1").unionByName(sorted_)
    return cuts.select("key", "data").groupBy("key").applyInArrow(_by_document(_CUT, True), "_id long, data binary")


def _kept(raw: bytes, data: bytes | None) -> tuple[bytes, int, int]:
    if data is None:
        return raw, 0, 0
    s, t = np.frombuffer(data, "<i4").reshape(2, -1).tolist()
    return b"".join(raw[a:b] for a, b in zip([0, *t], [*s, len(raw)], strict=True)), sum(t) - sum(s), len(s)


def dedup(docs: DataFrame) -> DataFrame:
    """row (a struct of the input's columns), n_bytes, n_removed, n_spans and kept (the remaining bytes) of every row of docs."""
    docs = numbered(docs)
    cuts = materialise(removals(docs), "removals")
    out = docs.join(cuts.withColumnRenamed("data", "_cuts").hint("shuffle_hash"), "_id", "left").select("row", F.col("_text"), F.col("_cuts"))
    schema = out.select("row").schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept", "binary")

    def run(batches):
        for b in chunks(batches, "_text"):
            rows = []
            for text, data in zip(b.column("_text").to_pylist(), b.column("_cuts").to_pylist(), strict=True):
                raw = text.encode()
                rows.append((len(raw), *_kept(raw, data)))
            cols = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())]
            yield pa.record_batch([b.column("row"), *cols], ["row", "n_bytes", "n_removed", "n_spans", "kept"])

    return out.mapInArrow(run, schema)


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
