"""Quality rules: word counts of a text, and language-specific bands of n-gram perplexity.

The language model is an interpolated modified Kneser-Ney model of character n-grams, one for each language, over the words of a text
joined by single spaces: n-grams reach over the space into the words before. A window is a character and the ORDER - 1 before it (fewer at
a text's beginning). Spark counts the distinct windows of all texts; they are dealt by language and the character before the last,
so that a window, its shorter forms, their contexts and all that is counted before them meet in one task, which makes sorted arrays of
64-bit hashes with log probabilities and back-off weights. N-grams that begin a text have raw counts, all other shorter ones count the
characters seen before them. Only single characters and counts of counts go to the driver.

Scoring takes the arrays in slices of at most SLICE_ENTRIES n-grams, which are broadcast one after the other; with more than one slice
each takes a pass over the texts, and the parts of a text's sum are added. Nothing depends on how many slices there are.

A document's perplexity is that of its words: the mean over them of the log probabilities of their characters and of the space or end behind
each. Documents outside [centre - below, centre + above]
of their language's log perplexities are rejected; centre is the median over all documents that pass the base rules, below and above
are `spread` times the median distance of those under and over it (copies of the centre don't narrow them). `least` only guards against rounding.
The medians are percentile_approx of accuracy 10,000: an edge can move by that share of the ranks with the partitioning.

Edge cases: a null text has no words; a document without words fails the base rules; a null language is one of its own;
repeated rows and null doc_ids are counted and returned each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import chain as _chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, materialise, mix64, text_or_empty, tidy
from .encoders import cached

ORDER = 5
SPREAD, LEAST = 8.0, 1e-6
KNOWN_WORDS = 250_000
BUCKETS = 64
SLICE_ENTRIES = 6_000_000

_SPACES, _SYMBOLS = b" \t\n\v\f\r", b"#*$%&|<>"  # as bytes: of itself, an item is a number, which count() takes too
_SPACE, _EDGE, _NUL = 32, 0x110000, 0x110001  # the edge stands at both ends of a text; 0 stands for no symbol
_END = b"\xff"  # marks the last word of a text; no UTF-8 text holds this byte
_BITS = 21  # of a character
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def language(name: str = "lang") -> Column:
    """The language of a row; null is one of its own, with the empty one."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


# ---------------------------------------------------------------- words and windows

class _Ids(dict):
    """word -> number, given out in the order of first use."""

    def __init__(self):
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n


class Words:
    """The distinct words of a language that a worker has met, with what is known of each in arrays.

    head: its first ORDER - 1 symbols (characters, then the space or edge behind it). tail: its last characters, packed. rest: the
    windows behind the head, which lie inside the word, and where each word's begin.
    """

    def __init__(self):
        self.ids = _Ids()
        self.size = self.plain = self.tail = self.last = np.zeros(0, np.int64)
        self.head, self.head_hash = np.zeros((0, ORDER - 1), np.int32), np.zeros(0, np.uint64)
        self.rest, self.rest_from = np.zeros((0, ORDER), np.int32), np.zeros(1, np.int64)

    def numbers(self, words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of the words of all texts, end to end, and where each text begins. Empty texts must be left out."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        for w in words:
            w[-1] += _END
        ids = np.fromiter(map(self.ids.__getitem__, _chain.from_iterable(words)), np.int64, int(sizes.sum()))
        self._extend()
        return ids, np.cumsum(sizes) - sizes

    def _extend(self) -> None:
        for w in [w for w in self.ids.fresh if w[-1] == 255]:
            self.ids[w[:-1]]  # its plain form is a word too
        fresh, self.ids.fresh = self.ids.fresh, []
        if not fresh:
            return
        final = np.array([w[-1] == 255 for w in fresh])
        plain = len(self.ids) - len(fresh) + np.arange(len(fresh))
        for i in np.flatnonzero(final).tolist():
            fresh[i] = fresh[i][:-1]
            plain[i] = self.ids[fresh[i]]
        sym = np.frombuffer((b" ".join(fresh) + b" ").decode().encode("utf-32-le"), "<u4").astype(np.int64)
        ends = np.flatnonzero(sym == _SPACE) + 1  # no word holds a space
        n = np.diff(ends, prepend=0) - 1
        start = ends - n - 1
        sym[sym == 0] = _NUL
        sym[ends[final] - 1] = _EDGE
        sym = np.r_[sym, np.zeros(ORDER, np.int64)]
        head = np.stack([np.where(n >= j, sym[start + j], 0) for j in range(ORDER - 1)], 1).astype(np.int32)
        at = lambda back: np.where(n >= back, sym[np.maximum(ends - 1 - back, 0)], 0)
        more = np.maximum(0, n - (ORDER - 2))  # windows that end at the symbols from ORDER - 1 on
        first = np.repeat(start, more) + np.arange(int(more.sum())) - np.repeat(np.cumsum(more) - more, more)
        rest = np.stack([sym[first + j] for j in range(ORDER)], 1).astype(np.int32)
        join = lambda a, b: np.concatenate([a, b])
        self.size, self.plain, self.last = join(self.size, n), join(self.plain, plain), join(self.last, at(1))
        self.tail = join(self.tail, at(3) << 2 * _BITS | at(2) << _BITS | at(1))
        self.head, self.head_hash = join(self.head, head), join(self.head_hash, _row_hash(head))
        self.rest, self.rest_from = join(self.rest, rest), join(self.rest_from, self.rest_from[-1] + np.cumsum(more))

    def pairs(self, ids: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each place the number of its (symbols before the word, head of the word), and the symbols of each such pair: ORDER - 1 before, ORDER - 1 of the head."""
        n, opening = self.size[ids], np.zeros(ids.size, bool)
        opening[begins] = True
        lead = np.where(opening, _EDGE, _SPACE)
        before = np.r_[0, self.last[ids[:-1]]] * ~opening
        tail = self.tail[ids] + np.where(n == 2, lead << 2 * _BITS, 0) + np.where(n == 1, (lead << _BITS) + (before << 2 * _BITS), 0)
        tail = np.r_[0, tail[:-1]] * ~opening  # of the word before
        with np.errstate(over="ignore"):
            codes, u = pd.factorize(mix64(tail.view(np.uint64) * _FACTOR + self.head_hash[ids]))
        where = np.empty(u.size, np.int64)
        where[codes[::-1]] = np.arange(codes.size)[::-1]
        t = tail[where]
        low = (1 << _BITS) - 1
        return codes, np.column_stack([t >> 2 * _BITS, t >> _BITS & low, t & low, np.where(t == 0, _EDGE, _SPACE), self.head[ids[where]]])


def _row_hash(rows: np.ndarray) -> np.ndarray:
    h = np.zeros(rows.shape[0], np.uint64)
    with np.errstate(over="ignore"):
        for j in range(rows.shape[1]):
            h = mix64(h * _FACTOR + rows[:, j].astype(np.uint64) + np.uint64(j + 1))
    return h


def head_windows(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows that end at the symbols of the heads of pairs, and the pair of each."""
    pair, j = np.nonzero(symbols[:, ORDER - 1 :])
    return symbols[pair[:, None], j[:, None] + np.arange(ORDER)], pair


def hashes(windows: np.ndarray, lang: str, upto: int = ORDER) -> list[np.ndarray]:
    """h[k]: the hash of the last k symbols of each row, for k up to `upto`."""
    import zlib

    h = [np.full(windows.shape[0], mix64(np.array([zlib.crc32(lang.encode()) + 1], np.uint64))[0])]
    with np.errstate(over="ignore"):
        for k in range(1, upto + 1):
            h.append(mix64(h[-1] * _FACTOR + windows[:, -k].astype(np.uint64) + np.uint64(k)))
    return h


def sizes_of(windows: np.ndarray) -> np.ndarray:
    """How many symbols a window has: zeros stand for none, at the left."""
    return (windows != 0).sum(1)


def bucket_of(windows: np.ndarray) -> np.ndarray:
    return (mix64(windows[:, -2].astype(np.uint64)) % np.uint64(BUCKETS)).astype(np.int64)


def distinct(windows: np.ndarray, counts: np.ndarray, lang: str) -> tuple[np.ndarray, np.ndarray]:
    """Equal windows once, with the sum of their counts."""
    if not counts.size:
        return windows, counts
    codes, u = pd.factorize(hashes(windows, lang)[ORDER])
    where = np.empty(u.size, np.int64)
    where[codes] = np.arange(codes.size)
    return windows[where], np.bincount(codes, counts, u.size).astype(np.int64)


# ---------------------------------------------------------------- counting

def _pack(windows: np.ndarray, counts: np.ndarray) -> bytes:
    import zstandard

    by = np.lexsort(windows.T)
    raw = np.concatenate([windows[by].astype("<u4").view("u1").reshape(by.size, -1), counts[by].astype("<i8").view("u1").reshape(by.size, -1)], 1)
    return zstandard.ZstdCompressor(level=3).compress(raw.T.tobytes())


def _unpack(blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    wide = 4 * ORDER + 8
    raw = [np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(x), "u1").reshape(wide, -1).T) for x in blobs]
    both = np.concatenate(raw) if raw else np.zeros((0, wide), "u1")
    return np.ascontiguousarray(both[:, : 4 * ORDER]).view("<u4").astype(np.int64), np.ascontiguousarray(both[:, 4 * ORDER :]).view("<i8").ravel().astype(np.int64)


def _known(work: str) -> dict[str, Words]:
    """The words of each language, forgotten when they are many."""
    words = cached(work, dict)
    if sum(len(w.ids) for w in words.values()) > KNOWN_WORDS:
        words.clear()
    return words


def _by_language(batch: pa.RecordBatch):
    """(language, numbers of its rows)"""
    codes, names = pd.factorize(batch.column("lang").to_numpy(zero_copy_only=False))
    for k, name in enumerate(names):
        yield name, np.flatnonzero(codes == k)


def _count(batches):
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def flush():
        for lang, parts in held.items():
            windows, counts = distinct(*(np.concatenate(x) for x in zip(*parts, strict=True)), lang)
            bucket = bucket_of(windows)
            order = np.argsort(bucket, kind="stable")
            windows, counts, bucket = windows[order], counts[order], bucket[order]
            cuts = np.searchsorted(bucket, np.arange(BUCKETS + 1))
            keep = [k for k in range(BUCKETS) if cuts[k] < cuts[k + 1]]
            yield pa.record_batch([pa.array([lang] * len(keep)), pa.array(keep, pa.int32()), pa.array([_pack(windows[cuts[k] : cuts[k + 1]], counts[cuts[k] : cuts[k + 1]]) for k in keep], pa.binary())], ["lang", "bucket", "data"])
        held.clear()

    for b in chunks(batches):
        known, texts = _known("counting"), b.column("text").cast(pa.binary()).to_pylist()
        for lang, rows in _by_language(b):
            words = [w for i in rows.tolist() if (w := texts[i].split())]
            if not words:
                continue
            own = known.setdefault(lang, Words())
            ids, begins = own.numbers(words)
            codes, symbols = own.pairs(ids, begins)
            windows, pair = head_windows(symbols)
            u, n = np.unique(ids, return_counts=True)
            more = own.rest_from[u + 1] - own.rest_from[u]
            inside = np.repeat(own.rest_from[u], more) + np.arange(int(more.sum())) - np.repeat(np.cumsum(more) - more, more)
            part = distinct(np.concatenate([windows, own.rest[inside]]), np.concatenate([np.bincount(codes, minlength=symbols.shape[0])[pair], np.repeat(n, more)]), lang)
            held.setdefault(lang, []).append((part[0].astype(np.int32), part[1]))
        if sum(x[1].size for parts in held.values() for x in parts) > 1_000_000:
            yield from flush()
    yield from flush()
    tidy()


def count_windows(docs: DataFrame) -> DataFrame:
    """lang, bucket, data: the distinct windows of what each task reads, with their counts, over every word of every document."""
    rows = docs.select(language().alias("lang"), text_or_empty().alias("text"))
    return rows.mapInArrow(_count, "lang string, bucket int, data binary")


# ---------------------------------------------------------------- the model

class Grams:
    """The distinct k-grams (k = 2 to ORDER) of a bucket of windows: keys[k] (sorted hashes), a window that ends with each, and their counts.

    A k-gram that begins a text has its raw count, as has one of full length; another counts the distinct symbols before it.
    """

    def __init__(self, windows: np.ndarray, counts: np.ndarray, lang: str):
        self.windows, size, h = windows, sizes_of(windows), hashes(windows, lang)
        self.keys, self.at, self.n = [None] * (ORDER + 1), [None] * (ORDER + 1), [None] * (ORDER + 1)
        for k in range(ORDER, 0, -1):
            rows = np.flatnonzero(size >= k)
            self.keys[k], first, inverse = np.unique(h[k][rows], return_index=True, return_inverse=True)
            self.at[k] = rows[first]
            raw = np.bincount(inverse, counts[rows], self.keys[k].size).astype(np.int64)
            if k < ORDER:
                before, n = np.unique(h[k][self.at[k + 1]], return_counts=True)
                cont = np.zeros(self.keys[k].size, np.int64)
                cont[np.searchsorted(self.keys[k], before)] = n
                raw = np.where(windows[self.at[k], ORDER - k] == _EDGE, raw, cont) if k > 1 else cont
            self.n[k] = raw


def discounts(n: np.ndarray) -> np.ndarray:
    """The discounts for counts of 1, 2 and 3 or more (behind a 0), from how many n-grams have the counts 1 to 4."""
    n = np.maximum(1, n)
    y = n[0] / (n[0] + 2 * n[1])
    return np.array([0.0, *(min(max(i + 1 - (i + 2) * y * n[i + 1] / n[i], 0.1), i + 0.9) for i in range(3))])


@dataclass
class Letters:
    """One language's single symbols, by code: how likely each is, the share left for others, and the discounts of the longer n-grams."""

    symbols: np.ndarray
    p: np.ndarray
    unseen: float
    cuts: dict[int, np.ndarray]


def letters(symbols: np.ndarray, n: np.ndarray, counts: dict[int, np.ndarray]) -> Letters:
    by = np.argsort(symbols)
    symbols, n = symbols[by], n[by].astype(np.float64)
    d = discounts(np.array([(n == i).sum() for i in range(1, 5)]))
    cut = d[np.minimum(n, 3).astype(np.int64)]
    share = cut.sum() / n.sum() / (n.size + 1)
    return Letters(symbols, (n - cut) / n.sum() + share, max(share, 1e-9), {k: discounts(c) for k, c in counts.items()})


def estimated(g: Grams, own: Letters, lang: str):
    """(k, keys, log p, context keys, log back-off weights) for k = 2 to ORDER."""
    lower_keys, lower = None, None
    for k in range(2, ORDER + 1):
        w, n = g.windows[g.at[k]], g.n[k].astype(np.float64)
        cut = own.cuts[k][np.minimum(n, 3).astype(np.int64)]
        context = hashes(w[:, :-1], lang, k - 1)[k - 1]
        keys, inverse = np.unique(context, return_inverse=True)
        total, left = (np.bincount(inverse, x, keys.size) for x in (n, cut))
        gamma = left / total
        if k == 2:
            base = own.p[np.searchsorted(own.symbols, w[:, -1])]
        else:
            base = lower[np.searchsorted(lower_keys, hashes(w, lang, k - 1)[k - 1])]
        p = (n - cut) / total[inverse] + gamma[inverse] * base
        yield k, g.keys[k], np.log(p), keys, np.log(gamma)
        lower_keys, lower = g.keys[k], p


def _sum(table: pa.Table) -> pa.Table:
    lang, bucket = (table.column(c)[0].as_py() for c in ("lang", "bucket"))
    windows, counts = distinct(*_unpack(table.column("data").to_pylist()), lang)
    g = Grams(windows, counts, lang)
    most = [np.bincount(np.minimum(g.n[k], 5), minlength=6)[1:5] for k in range(2, ORDER + 1)]
    tidy()
    return pa.table([pa.array([lang]), pa.array([bucket], pa.int32()), pa.array([sum(x.size for x in g.keys[2:])], pa.int64()), pa.array([_pack(windows, counts)], pa.binary()), pa.array([np.concatenate(most).tolist()], pa.list_(pa.int64())), pa.array([windows[g.at[1], -1].tolist()], pa.list_(pa.int64())), pa.array([g.n[1].tolist()], pa.list_(pa.int64()))], ["lang", "bucket", "n", "data", "most", "symbols", "before"])


_SUMMED = "lang string, bucket int, n long, data binary, most array<long>, symbols array<long>, before array<long>"
_ARRAYS = "lang string, bucket int, k int, n long, keys binary, value binary, context binary, back binary"


def _estimate(alphabets: dict[str, Letters]):
    def run(batches):
        for b in batches:
            for lang, bucket, data in zip(*(b.column(c).to_pylist() for c in ("lang", "bucket", "data")), strict=True):
                rows = list(estimated(Grams(*_unpack([data]), lang), alphabets[lang], lang))
                columns = [[r[0] for r in rows], [r[1].size for r in rows], *([r[i].astype(t).tobytes() for r in rows] for i, t in ((1, "<u8"), (2, "<f4"), (3, "<u8"), (4, "<f4")))]
                types = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
                yield pa.record_batch([pa.array([lang] * len(rows)), pa.array([bucket] * len(rows), pa.int32()), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["lang", "bucket", "k", "n", "keys", "value", "context", "back"])

    return run


@dataclass
class Model:
    """A written table of sorted hash arrays by language and bucket, and the alphabets."""

    arrays: DataFrame
    alphabets: dict[str, Letters]
    slices: list[list[tuple[str, int]]] = field(default_factory=list)


def fit(docs: DataFrame, most: int | None = None) -> Model:
    """The model of all documents; `most` n-grams to a slice (one bucket of a language at least)."""
    summed = materialise(count_windows(docs).groupBy("lang", "bucket").applyInArrow(_sum, _SUMMED), "window-counts")
    sizes = summed.select("lang", "bucket", "n", "most").collect()  # at most BUCKETS rows a language
    single = summed.select("lang", F.inline(F.arrays_zip("symbols", "before"))).groupBy("lang", "symbols").agg(F.sum("before").alias("n"))
    chars: dict[str, list[tuple[int, int]]] = {}
    for r in single.collect():  # the distinct characters of each language
        chars.setdefault(r.lang, []).append((r.symbols, r.n))
    alphabets = {}
    for lang, rows in chars.items():
        total = np.sum([r.most for r in sizes if r.lang == lang], 0).reshape(-1, 4)
        alphabets[lang] = letters(*(np.array(x, np.int64) for x in zip(*rows, strict=True)), dict(enumerate(total, 2)))
    arrays = materialise(summed.select("lang", "bucket", "data").mapInArrow(_estimate(alphabets), _ARRAYS), "gram-arrays")
    slices, held = [[]], 0
    for r in sorted(sizes, key=lambda r: (r.bucket, r.lang)):
        if slices[-1] and held + r.n > (most or SLICE_ENTRIES):
            slices.append([])
            held = 0
        slices[-1].append((r.lang, r.bucket))
        held += r.n
    return Model(arrays, alphabets, slices)


class Slice:
    """The arrays of some buckets, each sorted: the log probabilities of k-grams, and the back-off weights of contexts of k - 1 symbols."""

    def __init__(self, model: Model, buckets: list[tuple[str, int]]):
        self.alphabets, self.all = model.alphabets, len(model.slices) == 1
        rest = buckets is model.slices[0]  # the first slice takes the buckets that no text of the model has, too
        self.mine = {lang: np.full(BUCKETS, rest) for lang in model.alphabets}
        for lang, b in _chain.from_iterable(model.slices[1:]) if rest else buckets:
            self.mine[lang][b] = not rest
        numbers = sorted({b for _, b in buckets})
        parts: dict[int, list] = {k: [] for k in range(2, ORDER + 1)}
        wanted = set(buckets)
        for r in model.arrays.where(F.col("bucket").isin(numbers)).toLocalIterator():
            if (r.lang, r.bucket) in wanted:
                parts[r.k].append([np.frombuffer(bytes(x), t) for x, t in ((r["keys"], "<u8"), (r.value, "<f4"), (r.context, "<u8"), (r.back, "<f4"))])
        self.keys, self.value, self.context, self.back = ({} for _ in range(4))
        for k, rows in parts.items():
            x = [np.concatenate(c) for c in zip(*rows, strict=True)] if rows else [np.zeros(0, t) for t in ("<u8", "<f4", "<u8", "<f4")]
            a, b = np.argsort(x[0]), np.argsort(x[2])
            self.keys[k], self.value[k], self.context[k], self.back[k] = x[0][a], x[1][a], x[2][b], x[3][b]

    def logs(self, windows: np.ndarray, lang: str) -> np.ndarray:
        """The log probability of each window's last symbol after the others; 0 for windows of other slices."""
        out = np.zeros(windows.shape[0])
        own = self.alphabets.get(lang)
        if own is None:
            return out
        todo = np.arange(windows.shape[0]) if self.all else np.flatnonzero(self.mine[lang][bucket_of(windows)])
        size, h = sizes_of(windows), hashes(windows, lang)
        score = np.zeros(windows.shape[0])
        for k in range(ORDER, 1, -1):
            rows = todo[size[todo] >= k]
            at, found = _find(self.keys[k], h[k][rows])
            out[rows[found]] = score[rows[found]] + self.value[k][at[found]]
            missed = rows[~found]
            if missed.size:
                at, known = _find(self.context[k], hashes(windows[missed][:, :-1], lang, k - 1)[k - 1])
                score[missed[known]] += self.back[k][at[known]]
                todo = np.concatenate([todo[size[todo] < k], missed])
            else:
                todo = todo[size[todo] < k]
        if todo.size:
            at, found = _find(own.symbols, windows[todo, -1])
            out[todo] = score[todo] + np.log(np.where(found, own.p[np.minimum(at, own.p.size - 1)], own.unseen))
        return out


def _find(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, order = np.empty(h.size, np.int64), np.argsort(h)  # in order, neighbouring searches share their way through memory
    at[order] = np.searchsorted(keys, h[order])
    at = np.minimum(at, max(0, keys.size - 1))
    return at, (keys[at] == h) if keys.size else np.zeros(h.size, bool)


# ---------------------------------------------------------------- documents

def repeated(x: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """For each text its words in windows of three that it has twice or more. x: numbers of words end to end; texts begin at `begins`."""
    text = np.zeros(x.size, np.int64)
    text[begins[1:]] = 1
    text = np.cumsum(text)
    covered = np.zeros(x.size, bool)
    if x.size > 3:
        with np.errstate(over="ignore"):
            h = mix64(mix64(mix64(x[:-2].astype(np.uint64) * _FACTOR + text[:-2].astype(np.uint64)) + x[1:-1].astype(np.uint64)) + x[2:].astype(np.uint64))
        h[text[:-2] != text[2:]] = 0
        order = np.argsort(h, kind="stable")
        order = order[np.searchsorted(h[order], 1) :]
        a, b = order[:-1], order[1:]
        same = h[a] == h[b]
        a, b = a[same], b[same]
        if not ((text[a] == text[b]) & (x[a] == x[b]) & (x[a + 1] == x[b + 1]) & (x[a + 2] == x[b + 2])).all():  # unlike windows share a hash
            keys = np.stack([text[:-2], x[:-2], x[1:-1], x[2:]], 1)
            _, inverse, n = np.unique(keys, axis=0, return_inverse=True, return_counts=True)
            hit = np.flatnonzero((n[inverse.ravel()] > 1) & (text[:-2] == text[2:]))
        else:
            hit = np.unique(np.concatenate([a, b]))
        for k in range(3):
            covered[hit + k] = True
    return np.bincount(text, covered, begins.size).astype(np.int64)


def line_counts(text: bytes) -> tuple[int, int, int]:
    """White-space characters, n_symbols, n_dup_lines of a text in UTF-8."""
    dup = 0
    if b"\n" in text:
        lines = [x for x in text.split(b"\n") if x.strip(_SPACES)]
        dup = len(lines) - len(set(lines))
    return sum(map(text.count, _SPACES)), sum(map(text.count, _SYMBOLS)), dup


class _Scored(Words):
    """Words with the log probabilities of their rests."""

    def __init__(self):
        super().__init__()
        self.rest_log = np.zeros(0)

    def score(self, ids: np.ndarray, begins: np.ndarray, lang: str, part: Slice) -> np.ndarray:
        """The log probability of each text."""
        if self.rest_log.size < self.size.size:
            k = self.rest_log.size
            logs = np.r_[0.0, np.cumsum(part.logs(self.rest[self.rest_from[k] :], lang))]
            at = self.rest_from[k:] - self.rest_from[k]
            self.rest_log = np.r_[self.rest_log, logs[at[1:]] - logs[at[:-1]]]
        codes, symbols = self.pairs(ids, begins)
        windows, pair = head_windows(symbols)
        heads = np.bincount(pair, part.logs(windows, lang), symbols.shape[0])
        return np.add.reduceat(heads[codes] + self.rest_log[ids], begins)


def _measure(part_of, base: bool):
    """Rows with the sums of log probabilities, and with the base counts if asked."""

    def run(batches):
        part = part_of()
        state = cached("measuring", dict)
        if state.get("part") is not part:  # another slice: nothing is known
            state.clear()
            state["part"] = part
        for b in chunks(batches):
            words: dict[str, _Scored] = state.setdefault("words", {})
            if sum(len(w.ids) for w in words.values()) > KNOWN_WORDS:
                words.clear()
            texts = b.column("text").cast(pa.binary()).to_pylist()
            n, rep, logs = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64), np.zeros(len(texts))
            for lang, rows in _by_language(b):
                split = [texts[i].split() for i in rows.tolist()]  # of bytes: exactly the six ASCII white-space characters
                n[rows] = [len(w) for w in split]
                rows, split = rows[n[rows] > 0], [w for w in split if w]
                if not split:
                    continue
                own = words.setdefault(lang, _Scored())
                ids, begins = own.numbers(split)
                logs[rows] = own.score(ids, begins, lang, part)
                if base:
                    rep[rows] = repeated(own.plain[ids], begins)
            columns = [pa.array(logs)]
            if base:
                counts = np.array([line_counts(t) for t in texts], np.int64).reshape(-1, 3)
                counts[:, 0] = np.asarray(pc.utf8_length(b.column("text")), np.int64) - counts[:, 0]
                failed = (n < 50) | (100 * rep > 50 * n)
                columns += [pa.array(n), *(pa.array(counts[:, i]) for i in range(3)), pa.array(rep), pa.array(failed)]
            yield pa.record_batch([*(b.column(c) for c in _KEYS), *columns], [*_KEYS, "log_p", *(_BASE if base else ())])

    return run


_KEYS = ["doc_id", "lang", "text_hash"]
_BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def measure(docs: DataFrame, most: int | None = None) -> DataFrame:
    """A written table: the base counts and the log perplexity of every row."""
    spark = docs.sparkSession
    model = fit(docs, most)
    rows = docs.select("doc_id", language().alias("lang"), F.xxhash64(text_or_empty()).alias("text_hash"), text_or_empty().alias("text"))
    schema = rows.select(*_KEYS).schema
    for c in ("log_p", *_BASE):
        schema = schema.add(c, {"log_p": "double", "base_failed": "boolean"}.get(c, "long"))
    out, more = None, []
    for i, buckets in enumerate(model.slices):
        part = spark.sparkContext.broadcast(Slice(model, buckets))  # at most SLICE_ENTRIES n-grams
        run = _measure(lambda part=part: part.value, i == 0)
        got = materialise(rows.mapInArrow(run, schema if i == 0 else schema[: len(_KEYS) + 1]), "quality-measures")
        out, more = (got, more) if i == 0 else (out, [*more, got])
        part.unpersist()
    if more:  # alike rows have alike sums
        rest = more[0]
        for x in more[1:]:
            rest = rest.unionByName(x)
        n = len(more)
        rest = rest.groupBy(*[F.col(c).alias(f"_{c}") for c in _KEYS]).agg((F.sum("log_p") * n / F.count(F.lit(1))).alias("_more"))
        same = out["doc_id"].eqNullSafe(rest["_doc_id"]) & (out["lang"] == rest["_lang"]) & (out["text_hash"] == rest["_text_hash"])
        out = out.join(rest, same).withColumn("log_p", F.col("log_p") + F.col("_more")).select(*out.columns)
    return out.select(*_KEYS, *_BASE, F.when(F.col("n_words") > 0, -F.col("log_p") / F.col("n_words")).alias("log_perplexity"))


def bands(measures: DataFrame, spread: float = SPREAD, least: float = LEAST) -> DataFrame:
    """lang, low, high: the band of log perplexities of each language."""
    good = measures.where("not base_failed").select("lang", "log_perplexity")
    # written, so its size is known when the join is planned: a few languages are broadcast, a huge table isn't
    centre = materialise(good.groupBy("lang").agg(F.percentile_approx("log_perplexity", 0.5, 10_000).alias("centre")), "band-centres")
    d = F.col("log_perplexity") - F.col("centre")
    side = lambda far: F.greatest(F.lit(least), spread * F.percentile_approx(F.when(far > 0, far), 0.5, 10_000))
    away = good.join(centre, "lang").groupBy("lang", "centre").agg(side(-d).alias("below"), side(d).alias("above"))
    return away.select("lang", (F.col("centre") - F.col("below")).alias("low"), (F.col("centre") + F.col("above")).alias("high"))


def quality(docs: DataFrame, spread: float = SPREAD, least: float = LEAST, more: tuple[str, ...] = ()) -> DataFrame:
    """Every row's measures and verdict; more may name text_hash (xxhash64 of the text)."""
    m = measure(docs)
    out = m.join(materialise(bands(m, spread, least), "bands"), "lang", "left")
    inside = F.coalesce(F.col("log_perplexity").between(F.col("low"), F.col("high")), F.lit(False))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & inside).alias("kept"), "lang", "log_perplexity", "low", "high", *more)


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))
