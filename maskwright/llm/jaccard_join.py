"""Exact join of documents whose sets of word 5-grams have a Jaccard similarity of 0.75 or more, as components.

A document's set holds the 64-bit hashes of its distinct shingles. Documents with equal sets are one vertex.

1. One scan makes a row per document (size, fingerprint, bitmap, bin minima, smallest hashes) and a sketch of
   fixed size that counts every shingle of every document. The sketch only sets the order of shingles: those in
   crowded cells come last. Any order gives the same result.
2. First links: documents that share one of their SEEDS smallest hashes and look alike by bin minima are compared, each
   with one earlier document. This finds most groups of near copies and leaves nothing out for step 3.
3. All links: by the prefix rule two documents above the threshold share one of their first n - ceil(0.75 n) + 1
   shingles in the order of step 1. Groups by shingle that lie inside one component need no more work. The others go through a
   signature tree: nodes hold the OR of their documents' bitmaps, the range of their sizes and the fewest bits of a document; pairs of nodes
   are followed down from the root and dropped when even the largest possible overlap is too small. What is left at
   the leaves, in different components, is compared. Groups of at most SMALL documents are leaves alone: their pairs, each once,
   meet the bitmaps directly.
4. Compared means that both sets meet (all 64 bits of each shingle's hash), and link if 7 * intersection >= 3 * (sum of sizes).

Edge cases: null and empty texts, and texts without words, have empty sets and link with nothing; fewer words
than a shingle are one shingle; rows that repeat a doc_id are documents of their own (if their text differs); a null doc_id
comes before all others; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, collect_garbage, materialise, mix64, text_bytes, tidy
from .components import components
from .encoders import Pieces, cached
from .suffix_dedup import _bucket, numbered

SHINGLE = 5
SEEDS = 8
BINS = 64
CELLS = 1 << 22
_CELL = np.uint64(64 - 22)
RANGES = 16
LEADERS = 32
HOT_SEED = 100_000
SEEDS_PER_BLOCK = 200_000
MEMBERS = 24
SMALL = 12
POSTINGS_PER_BLOCK = 1_000_000
BUCKET_DOCS = 4096

# ------------------------------------------------------------ sets

def _word_bytes():
    import xxhash

    return cached("word hashes", lambda: Pieces(xxhash.xxh3_64_digest, 150_000).__getitem__)


def shingles(text: str, k: int = SHINGLE) -> np.ndarray:
    """The sorted hashes of a text's distinct word k-grams."""
    words = text.encode().lower().split()  # bytes: A-Z and the six ASCII white-space characters only
    if not words:
        return np.zeros(0, np.uint64)
    w = np.frombuffer(b"".join(map(_word_bytes(), words)), "<u8")
    n = max(1, w.size - k + 1)
    with np.errstate(over="ignore"):
        h = np.full(n, min(k, w.size), np.uint64)
        for j in range(min(k, w.size)):
            h = h * np.uint64(0x9E3779B97F4A7C15) + w[j : j + n]
    h = np.sort(mix64(h))
    return h[np.r_[True, h[1:] != h[:-1]]]


def fingerprint(h: np.ndarray) -> tuple[int, int]:
    with np.errstate(over="ignore"):
        return int(h.sum(dtype=np.uint64).view(np.int64)), int(np.bitwise_xor.reduce(mix64(h ^ np.uint64(0x5851F42D4C957F2D))).view(np.int64))


def width_of(n: int) -> int:
    return 1 << max(6, (2 * n - 1).bit_length())


def bitmap(h: np.ndarray) -> np.ndarray:
    w = width_of(h.size)
    bits = np.zeros(w, bool)
    bits[(h & np.uint64(w - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little")


def prefix_size(n: int) -> int:
    return n - -(-3 * n // 4) + 1


def ordered(h: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """The set in the common order: by crowding of the sketch's cell, then by hash."""
    level = sketch[(h >> _CELL).astype(np.int64)]
    return h[np.lexsort((h, level))]


def _bin_minima(h: np.ndarray) -> bytes:
    out = np.zeros(BINS, np.uint8)
    b, at = np.unique((h >> np.uint64(58)).astype(np.int64), return_index=True)
    out[b] = ((h[at] >> np.uint64(20)) & np.uint64(0x7F)).astype(np.uint8) + 1
    return out.tobytes()


_ROW = "kind int, id long, n long, f1 long, f2 long, bits binary, minima binary, seeds binary"
_NAMES = ["kind", "id", "n", "f1", "f2", "bits", "minima", "seeds"]
_TYPES = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())


def _scan(batches):
    import zstandard

    sketch, cells, held = np.zeros(CELLS, np.uint32), [], 0
    for b in chunks(batches):
        rows = []
        for i, text in zip(b.column("_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            h = shingles(text)
            if h.size:
                rows.append((0, i, h.size, *fingerprint(h), bitmap(h).tobytes(), _bin_minima(h), h[:SEEDS].tobytes()))
                cells.append((h >> _CELL).astype(np.int64))
                held += h.size
            else:
                rows.append((0, i, 0, 0, 0, b"", b"", b""))
        if held > CELLS // 2:
            sketch += np.bincount(np.concatenate(cells), minlength=CELLS).astype(np.uint32)
            cells, held = [], 0
        yield pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES)], _NAMES)
    if cells:
        sketch += np.bincount(np.concatenate(cells), minlength=CELLS).astype(np.uint32)
    z = zstandard.ZstdCompressor(level=1)
    parts = [(1, k, 0, 0, 0, z.compress(x.view("u1").reshape(-1, 4).T.tobytes()), b"", b"") for k, x in enumerate(np.split(sketch, RANGES)) if x.any()]
    if parts:
        yield pa.record_batch([pa.array([r[i] for r in parts], t) for i, t in enumerate(_TYPES)], _NAMES)


def _add_cells(table: pa.Table) -> pa.Table:
    import zstandard

    total = np.zeros(CELLS // RANGES, np.int64)
    for x in table.column("bits").to_pylist():
        total += np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(x), "u1").reshape(4, -1).T).view("<u4").ravel()
    return pa.table([table.column("id").slice(0, 1), pa.array([total.tobytes()], pa.binary())], ["id", "data"])


def crowding(scanned: DataFrame) -> np.ndarray:
    """A level for each cell of the sketch: 0 near the median count, then by powers of two of the excess. CELLS bytes, whatever the input."""
    total = np.zeros(CELLS, np.int64)
    size = CELLS // RANGES
    for r in scanned.where("kind = 1").select("id", "bits").groupBy("id").applyInArrow(_add_cells, "id long, data binary").collect():  # RANGES rows
        total[r.id * size : (r.id + 1) * size] = np.frombuffer(bytes(r.data), np.int64)
    usual = float(np.median(total))
    excess = total - (usual + 2.5 * np.sqrt(usual) + 1)
    return np.where(excess > 0, 1 + np.log2(1 + np.maximum(excess, 0)), 0).astype(np.uint8)


# ------------------------------------------------------------ comparing

def _pack_set(h: np.ndarray) -> bytes:
    import zstandard

    d = np.diff(h, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(d.view("u1").reshape(-1, 8).T.tobytes())


def _unpack_set(blob: bytes) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), "u1").reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(raw.T).view("<u8").ravel(), dtype=np.uint64)


def _sets(batches):
    for b in chunks(batches):
        yield pa.record_batch([b.column("a"), b.column("salt"), b.column("_id"), pa.array([_pack_set(shingles(t)) for t in b.column("text").to_pylist()], pa.binary())], ["a", "salt", "b", "data"])


def _compare(table: pa.Table) -> pa.Table:
    a = table.column("a")[0].as_py()
    ids, data = table.column("b").to_pylist(), table.column("data").to_pylist()
    own = _unpack_set(data[ids.index(a)])
    out = []
    for i, x in zip(ids, data, strict=True):
        if i != a:
            s = _unpack_set(x)
            at = np.minimum(np.searchsorted(own, s), own.size - 1)
            if 7 * int((own[at] == s).sum()) >= 3 * (own.size + s.size):
                out.append(i)
    return pa.table([pa.array([a] * len(out), pa.int64()), pa.array(out, pa.int64())], ["u", "v"])


def compare(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Of distinct pairs (a, b) of documents those above the threshold, as a written table (u, v).

    A document with many partners is compared in groups of about MEMBERS partners, in different tasks.
    """
    many = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).alias("parts"))
    pairs = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), "parts").alias("salt"))
    sides = pairs.select(F.col("b").alias("_id"), "a", "salt").unionByName(pairs.select(F.col("a").alias("_id"), "a", "salt").distinct())
    sides = materialise(sides, "compared-sides")
    rows = docs.select("_id", F.col("_text").alias("text")).join(sides.hint("shuffle_hash"), "_id").select("a", "salt", "_id", "text")
    sets = rows.mapInArrow(_sets, "a long, salt long, b long, data binary")
    return materialise(sets.groupBy("a", "salt").applyInArrow(_compare, "u long, v long"), "links")


# ------------------------------------------------------------ 2. first links

def _alike(table: pa.Table) -> pa.Table:
    """Documents of a block of seeds: in each group of equal seeds, the first leads and takes those alike; the rest go on, LEADERS times at most."""
    seed, ids, n = (np.asarray(table.column(c)) for c in ("seed", "id", "n"))
    order = np.lexsort((ids, seed))
    seed, ids, n = seed[order], ids[order], n[order]
    m = np.frombuffer(b"".join(table.column("minima").take(pa.array(order)).to_pylist()), np.uint8).reshape(-1, BINS)
    left, a, b = np.arange(ids.size), [], []
    for _ in range(LEADERS):
        if not left.size:
            break
        g = seed[left]
        head = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        lead = np.repeat(left[head], np.diff(np.append(head, left.size)))
        rest = left != lead
        x, y = lead[rest], left[rest]
        if not y.size:
            break
        filled = (m[x] > 0) | (m[y] > 0)
        same = ((m[x] == m[y]) & filled).sum(1) * 2 >= filled.sum(1)
        same &= 4 * np.minimum(n[x], n[y]) >= 3 * np.maximum(n[x], n[y])
        a.append(ids[x[same]])
        b.append(ids[y[same]])
        left = y[~same]
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
    return pa.table([pa.array(a), pa.array(b)], ["a", "b"])


def first_pairs(reps: DataFrame) -> DataFrame:
    """For each document at most one earlier document that it may be a near copy of. Seeds of more than HOT_SEED documents are dealt to several tasks."""

    def run(batches):
        for b in batches:
            seeds = [np.frombuffer(x, "<i8") for x in b.column("seeds").to_pylist()]
            at = np.repeat(np.arange(len(seeds)), [s.size for s in seeds])
            yield pa.record_batch([pa.array(np.concatenate(seeds) if seeds else np.zeros(0, np.int64)), *(b.column(c).take(pa.array(at)) for c in ("id", "n", "minima"))], ["seed", "id", "n", "minima"])

    seeds = reps.select("id", "n", "minima", "seeds").mapInArrow(run, "seed long, id long, n long, minima binary")
    hot = materialise(seeds.groupBy("seed").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > HOT_SEED), "hot-seeds")
    blocks = max(16, reps.count() * SEEDS // SEEDS_PER_BLOCK)
    if hot.isEmpty():
        seeds = seeds.withColumn("part", F.lit(0).cast("long"))
    else:
        seeds = seeds.join(hot, "seed", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("id"), F.ceil(F.col("rows") / HOT_SEED)), F.lit(0)).cast("long"))
    seeds = seeds.withColumn("block", F.pmod(F.xxhash64("seed", "part"), F.lit(blocks)))
    return seeds.select("block", "seed", "id", "n", "minima").groupBy("block").applyInArrow(_alike, "a long, b long").groupBy("b").agg(F.min("a").alias("a"))


# ------------------------------------------------------------ 3. prefixes and signature trees

def _pack2(token: np.ndarray, ids: np.ndarray) -> bytes:
    """(token, id) pairs in id order."""
    import zstandard

    by = np.argsort(ids, kind="stable")
    d = np.diff(ids[by], prepend=np.int64(0))
    return zstandard.ZstdCompressor(level=1).compress(token[by].astype("<u8").tobytes() + d.astype("<i8").view("u1").reshape(-1, 8).T.tobytes())


def _unpack2(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    tokens, ids = [], []
    for x in blobs:
        raw = zstandard.ZstdDecompressor().decompress(x)
        n = len(raw) // 16
        tokens.append(np.frombuffer(raw, "<u8", n))
        ids.append(np.cumsum(np.ascontiguousarray(np.frombuffer(raw, "u1", 8 * n, 8 * n).reshape(8, -1).T).view("<i8").ravel()))
    return np.concatenate(tokens), np.concatenate(ids)


def _deal(key: np.ndarray, token: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    order = np.argsort(key, kind="stable")
    key, token, ids = key[order], token[order], ids[order]
    cuts = np.flatnonzero(np.diff(key, prepend=-1))
    ends = np.append(cuts[1:], key.size) if key.size else cuts
    return pa.record_batch([pa.array(key[cuts], pa.int64()), pa.array([_pack2(token[a:b], ids[a:b]) for a, b in zip(cuts, ends, strict=True)], pa.binary())], ["key", "data"])


def _token_block(token: np.ndarray, blocks: int) -> np.ndarray:
    return (mix64(token) >> np.uint64(32)).astype(np.int64) * blocks >> 32


def _prefixes(levels, blocks: int):
    """Postings (token, id) of all prefixes, dealt by token. Of documents with equal sets in a batch only the first is kept; the first of all is never dropped."""

    def run(batches):
        sketch, held, size = levels.value, {}, 0

        def flush():
            ids = np.repeat(np.array([i for i, _ in held.values()], np.int64), [p.size for _, p in held.values()])
            t = np.concatenate([p for _, p in held.values()])
            return _deal(_token_block(t, blocks), t, ids)

        for b in chunks(batches):
            for i, text in zip(b.column("_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                h = shingles(text)
                if h.size:
                    key = (h.size, *fingerprint(h))
                    if key in held:
                        held[key] = (min(i, held[key][0]), held[key][1])
                    else:
                        held[key] = (i, ordered(h, sketch)[: prefix_size(h.size)])
                        size += held[key][1].size
            if size > 1_000_000:
                yield flush()
                held, size = {}, 0
        if held:
            yield flush()

    return run


def _shared(buckets: int):
    """Postings of tokens that two documents or more have, dealt to the documents' buckets."""

    def run(table: pa.Table) -> pa.Table:
        tidy()
        token, ids = _unpack2(table.column("data").to_pylist())
        u, inv, n = np.unique(token, return_inverse=True, return_counts=True)
        keep = n[inv] > 1
        return pa.Table.from_batches([_deal(_bucket(ids[keep], buckets), token[keep], ids[keep])])

    return run


def _with_component(blocks: int):
    """Postings of a bucket and its documents' components, dealt to the tokens' blocks: (token, component) travel, the ids beside them."""

    def run(postings: pa.Table, docs: pa.Table) -> pa.Table:
        tidy()
        import zstandard

        names = ["key", "data", "more"]
        token = np.zeros(0, np.uint64)
        if postings.num_rows:
            token, ids, comp = _lookup(*_unpack2(postings.column("data").to_pylist()), docs, "component")
        if not token.size:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.binary()), pa.array([], pa.binary())], names)
        key = _token_block(token, blocks)
        order = np.lexsort((ids, key))
        key, token, ids, comp = key[order], token[order], ids[order], comp[order]
        cuts = np.flatnonzero(np.diff(key, prepend=-1))
        ends = np.append(cuts[1:], key.size)
        z = zstandard.ZstdCompressor(level=1)
        more = [z.compress(np.ascontiguousarray((comp - ids)[a:b]).view("u1").reshape(-1, 8).T.tobytes()) for a, b in zip(cuts, ends, strict=True)]
        return pa.table([pa.array(key[cuts]), pa.array([_pack2(token[a:b], ids[a:b]) for a, b in zip(cuts, ends, strict=True)], pa.binary()), pa.array(more, pa.binary())], names)

    return run


def _lookup(token: np.ndarray, ids: np.ndarray, docs: pa.Table, column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Postings of the ids in docs, and their values of a column; other documents have the set of one of those."""
    own = np.asarray(docs.column("id"))
    order = np.argsort(own)
    at = np.minimum(np.searchsorted(own[order], ids), max(0, own.size - 1))
    ok = own[order][at] == ids if own.size else np.zeros(ids.size, bool)
    return token[ok], ids[ok], np.asarray(docs.column(column))[order][at[ok]]


def _between_components(buckets: int):
    """Of tokens whose documents lie in two components or more: kind 0, the pairs of small groups, each once; kind 1, the postings of large ones."""

    def run(table: pa.Table) -> pa.Table:
        tidy()
        import zstandard

        token, ids = _unpack2(table.column("data").to_pylist())
        shift = [np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(x), "u1").reshape(8, -1).T).view("<i8").ravel() for x in table.column("more").to_pylist()]
        comp = ids + np.concatenate(shift)
        order = np.lexsort((ids, token))
        token, ids, comp = token[order], ids[order], comp[order]
        once = np.r_[True, (token[1:] != token[:-1]) | (ids[1:] != ids[:-1])]
        token, ids, comp = token[once], ids[once], comp[once]
        first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        size = np.diff(np.append(first, token.size))
        mixed = np.minimum.reduceat(comp, first) != np.maximum.reduceat(comp, first)
        large = np.repeat(mixed & (size > SMALL), size)
        left = np.flatnonzero(np.repeat(mixed & (size <= SMALL), size))
        token_l, ids_l, comp_l = token[left], ids[left], comp[left]
        a, b = [], []
        for d in range(1, SMALL):  # neighbours at distance d of one token
            same = np.flatnonzero((token_l[d:] == token_l[:-d]) & (comp_l[d:] != comp_l[:-d]))
            if not same.size and not (token_l[d:] == token_l[:-d]).any():
                break
            a.append(ids_l[same])
            b.append(ids_l[same + d])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
        if a.size:
            a, b = np.unique(np.stack([a, b]), axis=1)
        out = [_deal(_bucket(a, buckets), b.view(np.uint64), a), _deal(_bucket(ids[large], buckets), token[large], ids[large])]
        return pa.concat_tables([pa.table([pa.array([k] * x.num_rows, pa.int32()), *x.columns], ["kind", "key", "data"]) for k, x in enumerate(out)])

    return run


def _pair_firsts(buckets: int):
    """The distinct pairs of a bucket with what is known of their first documents."""
    names = ["bucket", "a", "b", "n", "bits"]

    def run(pairs: pa.Table, docs: pa.Table) -> pa.Table:
        if not pairs.num_rows:
            return pa.table([pa.array([], t) for t in (*[pa.int64()] * 4, pa.binary())], names)
        b, a = _unpack2(pairs.column("data").to_pylist())
        a, b = np.unique(np.stack([a, b.view(np.int64)]), axis=1)
        at = _places(a, docs)
        return pa.table([pa.array(_bucket(b, buckets)), pa.array(a), pa.array(b), docs.column("n").take(at), docs.column("bits").take(at)], names)

    return run


def _pair_seconds(pairs: pa.Table, docs: pa.Table) -> pa.Table:
    """The pairs whose sizes and bitmaps allow a similarity above the threshold."""
    a, b = (np.asarray(pairs.column(c)) for c in "ab")
    if not a.size:
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
    at = _places(b, docs)
    n, m = np.asarray(pairs.column("n")), np.asarray(docs.column("n").take(at))
    ok = (4 * n >= 3 * m) & (4 * m >= 3 * n)
    rows = np.flatnonzero(ok)
    bits_a, bits_b = pairs.column("bits").take(pa.array(rows)).to_pylist(), docs.column("bits").take(at.take(pa.array(rows))).to_pylist()
    keep = rows[[_bits_allow(x, y, int(i), int(j)) for x, y, i, j in zip(bits_a, bits_b, n[rows], m[rows], strict=True)]] if rows.size else rows
    return pa.table([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])


def _places(ids: np.ndarray, docs: pa.Table) -> pa.Array:
    own = np.asarray(docs.column("id"))
    order = np.argsort(own)
    return pa.array(order[np.searchsorted(own[order], ids)])


_SIGNED = "block long, token long, id long, n long, component long, bits binary"


def _with_signature(blocks: int):
    names = ["block", "token", "id", "n", "component", "bits"]

    def run(postings: pa.Table, docs: pa.Table) -> pa.Table:
        if not postings.num_rows:
            return pa.table([pa.array([], t) for t in (*[pa.int64()] * 5, pa.binary())], names)
        token, ids = _unpack2(postings.column("data").to_pylist())
        at = _places(ids, docs)
        return pa.table([pa.array(_token_block(token, blocks)), pa.array(token.view(np.int64)), pa.array(ids), *(docs.column(c).take(at) for c in names[3:])], names)

    return run


class SignatureTree:
    """Documents in size order under nodes of FAN children; level 0 holds the documents."""

    FAN = 4

    def __init__(self, n: np.ndarray, comp: np.ndarray, bits: np.ndarray):
        self.low, self.high, self.comp = [n], [n], [comp]
        self.bits, self.fewest = [bits], [np.bitwise_count(bits).sum(1).astype(np.int64)]
        while self.low[-1].size > 1:
            cut = np.arange(0, self.low[-1].size, self.FAN)
            lo, hi = np.minimum.reduceat(self.comp[-1], cut), np.maximum.reduceat(self.comp[-1], cut)
            self.comp.append(np.where(lo == hi, lo, -1))  # -1: of several components
            self.low.append(np.minimum.reduceat(self.low[-1], cut))
            self.high.append(np.maximum.reduceat(self.high[-1], cut))
            self.fewest.append(np.minimum.reduceat(self.fewest[-1], cut))
            self.bits.append(np.bitwise_or.reduceat(self.bits[-1], cut, axis=0))

    def _possible(self, k: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether documents below nodes a and b of level k can be above the threshold and in different components.

        At least fewest - |OR a & OR b| shingles of one document aren't in the other, and at most (4 n - 3 m) / 7 may be, of sizes n and m.
        """
        la, ha, lb, hb = self.low[k][a], self.high[k][a], self.low[k][b], self.high[k][b]
        ok = (4 * ha >= 3 * lb) & (4 * hb >= 3 * la) & ((self.comp[k][a] != self.comp[k][b]) | (self.comp[k][a] < 0))
        at = np.flatnonzero(ok)
        step = max(1, (1 << 22) // max(1, self.bits[k].shape[1]))
        for i in range(0, at.size, step):
            j = at[i : i + step]
            both = np.bitwise_count(self.bits[k][a[j]] & self.bits[k][b[j]]).sum(1).astype(np.int64)
            ok[j] = (7 * (self.fewest[k][a[j]] - both) <= 4 * ha[j] - 3 * lb[j]) & (7 * (self.fewest[k][b[j]] - both) <= 4 * hb[j] - 3 * la[j])
        return ok

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of documents (by place) that may be above the threshold."""
        out_a, out_b = [], []
        top = len(self.low) - 1
        stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            k, a, b = stack.pop()
            if a.size > 1 << 16:
                stack += [(k, a[: a.size // 2], b[: a.size // 2]), (k, a[a.size // 2 :], b[a.size // 2 :])]
                continue
            if k < top or a.size:
                ok = self._possible(k, a, b)
                if k == 0:
                    ok &= a != b
                a, b = a[ok], b[ok]
            if k == 0:
                out_a.append(a)
                out_b.append(b)
            elif a.size:
                d = np.arange(self.FAN)
                x = (a[:, None, None] * self.FAN + d[None, :, None] + 0 * d[None, None, :]).ravel()
                y = (b[:, None, None] * self.FAN + d[None, None, :] + 0 * d[None, :, None]).ravel()
                size = self.low[k - 1].size
                keep = (x < size) & (y < size) & (x <= y)
                stack.append((k - 1, x[keep], y[keep]))
        return np.concatenate(out_a or [np.zeros(0, np.int64)]), np.concatenate(out_b or [np.zeros(0, np.int64)])


def tree_pairs(ids: np.ndarray, n: np.ndarray, comp: np.ndarray, bits: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of ids that may be above the threshold, in different components. Bitmaps of unlike widths meet at the narrower one."""
    width = np.array([len(x) for x in bits])
    a, b = [], []
    for w in np.unique(width):
        own, wide = np.flatnonzero(width == w), np.flatnonzero(width == 2 * w)
        at = np.concatenate([own, wide])
        m = np.zeros((at.size, max(8, w)), np.uint8)
        for k, i in enumerate(at):
            x = np.frombuffer(bits[i], np.uint8)
            m[k, :w] = x if x.size == w else x[:w] | x[w:]
        by = np.argsort(n[at], kind="stable")
        x, y = SignatureTree(n[at][by], comp[at][by], m[by].view(np.uint64)).pairs()
        x, y = at[by][x], at[by][y]
        ok = (width[x] == w) | (width[y] == w)  # two wide ones meet at their own width
        a.append(ids[x[ok]])
        b.append(ids[y[ok]])
    a, b = np.concatenate(a), np.concatenate(b)
    return np.minimum(a, b), np.maximum(a, b)


def _tree(table: pa.Table) -> pa.Table:
    """All tokens of a block; tokens with the same documents are one group."""
    token, ids, n, comp = (np.asarray(table.column(c)) for c in ("token", "id", "n", "component"))
    order = np.lexsort((ids, token))
    token, ids = token[order], ids[order]
    first = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    ends = np.append(first[1:], token.size)
    with np.errstate(over="ignore"):
        same = np.stack([np.add.reduceat(mix64(ids.view(np.uint64)), first), np.bitwise_xor.reduceat(mix64(ids.view(np.uint64) + np.uint64(9)), first), (ends - first).astype(np.uint64)], 1)
    once = np.unique(same, axis=0, return_index=True)[1]
    docs, at = np.unique(ids, return_index=True)
    rows = order[at]
    n, comp, bits = n[rows], comp[rows], table.column("bits").take(pa.array(rows)).to_pylist()
    small, a, b = [], [], []
    for i in once:
        members = np.searchsorted(docs, np.unique(ids[first[i] : ends[i]]))
        if members.size <= 16:
            x, y = np.triu_indices(members.size, 1)
            small.append(members[x] * docs.size + members[y])
        else:
            x, y = tree_pairs(members, n[members], comp[members], [bits[k] for k in members])
            a.append(x)
            b.append(y)
    if small:  # a tree of so few is its leaves
        x, y = np.divmod(np.unique(np.concatenate(small)), docs.size)
        ok = (comp[x] != comp[y]) & (4 * n[x] >= 3 * n[y]) & (4 * n[y] >= 3 * n[x])
        x, y = x[ok], y[ok]
        ok = np.fromiter((_bits_allow(bits[i], bits[j], int(n[i]), int(n[j])) for i, j in zip(x.tolist(), y.tolist(), strict=True)), bool, x.size)
        a.append(x[ok])
        b.append(y[ok])
    a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a, b))
    both = np.unique(a * docs.size + b)
    return pa.table([pa.array(docs[both // max(1, docs.size)]), pa.array(docs[both % max(1, docs.size)])], ["a", "b"])


def _bits_allow(x: bytes, y: bytes, n: int, m: int) -> bool:
    """Whether the bitmaps of two documents of n and m shingles leave a similarity above the threshold possible."""
    w = min(len(x), len(y))
    p, q = (int.from_bytes(v, "little") if len(v) == w else int.from_bytes(v[:w], "little") | int.from_bytes(v[w:], "little") for v in (x, y))
    both = (p & q).bit_count()
    return 7 * (p.bit_count() - both) <= 4 * n - 3 * m and 7 * (q.bit_count() - both) <= 4 * m - 3 * n


# ------------------------------------------------------------ the join

def join(docs: DataFrame, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """(members, links): members has doc_id, n_shingles and component_id of every row; links has pairs (u, v) of compared
    documents above the threshold that join the components (documents with equal sets stand for each other).

    exact: links has all pairs of different sets above the threshold, none skipped for lying in one component, and members
    has n_links, the number of other documents above the threshold, those with an equal set among them."""
    spark = docs.sparkSession
    docs = numbered(docs.select("doc_id", "text"))
    total = text_bytes(docs, "_text")[1]
    rows = docs.select("_id", F.col("_text").alias("text"))
    scanned = materialise(rows.mapInArrow(_scan, _ROW), "shingle-rows")
    every = scanned.where("kind = 0")
    sets = ["f1", "f2", "n"]
    classes = materialise(every.where("n > 0").groupBy(*sets).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("size")), "equal-sets")
    reps = materialise(every.dropDuplicates(["id"]).join(classes.select("id"), "id", "left_semi"), "set-representatives")

    links = compare(materialise(first_pairs(reps), "first-pairs"), docs)
    collect_garbage(spark)
    comps = components(links)
    apart = F.col("id") if exact else F.coalesce("component", "id")  # each set a component of its own: no pair is skipped
    known = materialise(reps.join(comps, "id", "left").select("id", "n", apart.alias("component"), "bits"), "signatures")

    blocks = max(16, total // 24 // POSTINGS_PER_BLOCK)
    buckets = max(8, reps.count() // BUCKET_DOCS)
    by_bucket = known.withColumn("bucket", _bucket_column("id", buckets))
    levels = spark.sparkContext.broadcast(crowding(scanned))  # CELLS bytes
    posted = rows.mapInArrow(_prefixes(levels, blocks), "key long, data binary")
    shared = posted.groupBy("key").applyInArrow(_shared(buckets), "key long, data binary")
    labelled = shared.groupBy("key").cogroup(by_bucket.select("bucket", "id", "component").groupBy("bucket")).applyInArrow(_with_component(blocks), "key long, data binary, more binary")
    mixed = materialise(labelled.groupBy("key").applyInArrow(_between_components(buckets), "kind int, key long, data binary"), "mixed")
    pairs = mixed.where("kind = 0").select("key", "data").groupBy("key").cogroup(by_bucket.groupBy("bucket")).applyInArrow(_pair_firsts(buckets), "bucket long, a long, b long, n long, bits binary")
    pairs = pairs.groupBy("bucket").cogroup(by_bucket.groupBy("bucket")).applyInArrow(_pair_seconds, "a long, b long")
    signed = mixed.where("kind = 1").select("key", "data").groupBy("key").cogroup(by_bucket.groupBy("bucket")).applyInArrow(_with_signature(blocks), _SIGNED)
    more = materialise(signed.groupBy("block").applyInArrow(_tree, "a long, b long").unionByName(pairs).distinct(), "tree-pairs")
    collect_garbage(spark)
    links = links.unionByName(compare(more, docs))
    if exact:
        links = materialise(links.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "all-links")
    collect_garbage(spark)
    comps = components(links)
    extra = ["n_links"] if exact else []
    if exact:
        ends = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        far = ends.join(classes.select(F.col("id").alias("v"), "size"), "v").groupBy(F.col("u").alias("id")).agg(F.sum("size").alias("far"))
        classes = classes.join(far, "id", "left").withColumn("n_links", F.col("size") - 1 + F.coalesce("far", F.lit(0)))

    label = comps.withColumnRenamed("id", "rep")
    classes = materialise(classes.withColumnRenamed("id", "rep").join(label, "rep", "left").select(*sets, *extra, F.coalesce("component", "rep").alias("component")), "set-components")
    members = every.select("id", *sets).join(classes, sets, "left").select(F.col("id").alias("_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component"), *[F.coalesce(c, F.lit(0)).alias(c) for c in extra])
    if dict(docs.dtypes).get("doc_id") != "bigint" or _renumbered(docs):
        members = members.dropDuplicates(["_id"])
        names = materialise(docs.select("_id", "doc_id"), "document-names")
        first = names.dropDuplicates(["_id"]).select(F.col("_id").alias("component"), F.col("doc_id").alias("component_id"))
        return names.join(members, "_id").join(first, "component").select("doc_id", "n_shingles", "component_id", *extra), links
    return members.select(F.col("_id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), *extra), links


def _renumbered(docs: DataFrame) -> bool:
    return not docs.where(~F.col("doc_id").eqNullSafe(F.col("_id"))).isEmpty()


def _bucket_column(name: str, buckets: int):
    @F.pandas_udf("long")
    def bucket(ids):
        import pandas as pd

        return pd.Series(_bucket(ids.to_numpy(np.int64), buckets))

    return bucket(name)


def op8_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))[0]
