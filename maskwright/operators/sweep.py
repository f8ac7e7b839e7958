"""Sweeps over the sorted ends of intervals: coverage of sensitive characters, and labels of tokens, in O(n log n) a document.

Both work on whole Arrow batches. For coverage, the texts of a batch lie one behind another on one axis, so one sort and one running sum serve all its documents.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COUNTS = ("sensitive", "covered", "leaked", "type_correct", "wrong_type", "predicted", "collateral", "entities", "entities_full")


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalnum() for i in range(1 << 16)])


def _payload(codes: np.ndarray) -> np.ndarray:
    """Which characters are letters or digits."""
    out = _letters()[np.minimum(codes, 0xFFFF)]
    for i in np.flatnonzero(codes > 0xFFFF):
        out[i] = chr(codes[i]).isalnum()
    return out


def union(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of intervals as disjoint ones in order (touching ones joined, empty ones dropped)."""
    some = end > start
    by = np.argsort(start[some], kind="stable")
    start, reach = start[some][by], np.maximum.accumulate(end[some][by]) if some.any() else end[:0]
    if not start.size:
        return start, reach
    head = np.flatnonzero(np.r_[True, start[1:] > reach[:-1]])
    return start[head], reach[np.r_[head[1:], start.size] - 1]


def both(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Where two unions lie over each other: a sweep over all their ends."""
    at = np.r_[a[0], b[0], a[1], b[1]]
    step = np.r_[np.ones(a[0].size + b[0].size, np.int64), -np.ones(a[1].size + b[1].size, np.int64)]
    by = np.lexsort((-step, at))
    depth = np.cumsum(step[by])
    two = np.flatnonzero(depth == 2)
    return at[by][two], at[by][two + 1] if two.size else at[:0]


def _spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list]:
    """Document, start, end and type of each element of an array column without nulls."""
    n = np.diff(np.asarray(column.offsets))
    types, start, end = column.flatten().flatten()
    return np.repeat(np.arange(n.size), n), np.asarray(start, np.int64), np.asarray(end, np.int64), types.to_pylist()


def coverage_counts(texts: pa.Array, gold: pa.Array, pred: pa.Array) -> list[np.ndarray]:
    """The counts named in COUNTS, an array each."""
    strings = texts.fill_null("").to_pylist()
    sizes = np.array([len(t) for t in strings], np.int64)
    payload = np.r_[0, np.cumsum(_payload(np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), "<u4")))]
    base = np.cumsum(sizes) - sizes
    n, total = len(strings), int(sizes.sum())
    names: dict = {}

    def placed(column):
        doc, s, e, types = _spans(column)
        s, e = np.clip(s, 0, sizes[doc]), np.clip(e, 0, sizes[doc])
        kind = np.array([names.setdefault(t, len(names)) for t in types], np.int64)
        return doc, base[doc] + s, base[doc] + e, kind

    (gd, gs, ge, gt), (_, ps, pe, pt) = placed(gold), placed(pred)

    def amount(i):
        """Letters and digits of disjoint intervals, by document: an interval lies inside one."""
        start, end = i
        doc = np.searchsorted(base, start, "right") - 1
        # documents without text share their place with the next one; a start belongs to the last of them
        return np.bincount(doc, payload[end] - payload[start], n).astype(np.int64)

    def cut(i):
        """Touching intervals of neighbouring documents taken apart."""
        at = np.unique(np.r_[base, i[0], i[1]])
        inside = np.searchsorted(i[0], at[:-1], "right") - 1
        ok = (inside >= 0) & (at[1:] <= i[1][np.maximum(inside, 0)]) if i[0].size else np.zeros(at.size - 1, bool)
        return at[:-1][ok], at[1:][ok]

    g, p = union(gs, ge), union(ps, pe)
    shared = both(g, p)
    by_type = both(union(gs + gt * (total + 1), ge + gt * (total + 1)), union(ps + pt * (total + 1), pe + pt * (total + 1)))
    right = union(by_type[0] % (total + 1), by_type[0] % (total + 1) + by_type[1] - by_type[0])
    sensitive, predicted, covered, correct = (amount(cut(i)) for i in (g, p, shared, right))
    # an entity is covered in full if the payload in it outside the predictions is none
    upto = np.r_[0, np.cumsum(payload[p[1]] - payload[p[0]])]

    def inside(x):
        k = np.searchsorted(p[0], x, "right")
        part = payload[np.minimum(x, p[1][np.maximum(k - 1, 0)])] - payload[p[0][np.maximum(k - 1, 0)]] if p[0].size else 0
        return np.where(k > 0, upto[np.maximum(k - 1, 0)] + part, 0)

    full = payload[ge] - payload[gs] == np.where(ge > gs, inside(ge) - inside(gs), 0)
    full |= ge <= gs
    entities = np.bincount(gd, minlength=n)
    return [sensitive, covered, sensitive - covered, correct, covered - correct, predicted, predicted - covered, entities, np.bincount(gd[full], minlength=n)]


@F.arrow_udf(returnType=T.StructType([T.StructField(c, T.IntegerType()) for c in COUNTS]))
def _coverage(texts: pa.Array, gold: pa.Array, pred: pa.Array) -> pa.Array:
    cols = coverage_counts(texts, gold, pred)
    return pa.StructArray.from_arrays([pa.array(c, pa.int32()) for c in cols], list(COUNTS))


def coverage(docs: DataFrame) -> DataFrame:
    """Coverage of each document's sensitive characters (letters and digits inside gold spans). docs: doc_id, text, gold, pred (arrays of type, start, end).

    A null text is empty, null arrays hold nothing, spans without an end don't count, and ends are cut at the text's. A document without entities is covered in full.
    """
    kind = "array<struct<type:string,start:int,end:int>>"
    typed = lambda c: F.coalesce(F.transform(F.filter(c, lambda e: e["start"].isNotNull() & e["end"].isNotNull()), lambda e: F.struct(e["type"].cast("string").alias("type"), e["start"].cast("int").alias("start"), e["end"].cast("int").alias("end"))), F.array().cast(kind))
    d = docs.select("doc_id", _coverage(F.coalesce("text", F.lit("")), typed(F.col("gold")), typed(F.col("pred"))).alias("c"))
    return d.select("doc_id", "c.*").withColumn("document_full", F.col("entities_full") == F.col("entities"))


# ------------------------------------------------------------ tokens

def token_labels(ts: np.ndarray, te: np.ndarray, es: np.ndarray, ee: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For disjoint tokens in order: the first entity (in the list's order) that holds each, or -1, and whether the token before is in it too.

    Each entity takes the tokens from the first that starts in it to the last that ends in it; a token that is taken is stepped over, so every token is taken once.
    """
    owner = np.full(ts.size, -1, np.int64)
    if not es.size:
        return owner, owner >= 0
    after = list(range(ts.size + 1))  # the next token that is free

    def free(i):
        root = i
        while after[root] != root:
            root = after[root]
        while after[i] != root:
            after[i], i = root, after[i]
        return root

    low, high = np.searchsorted(ts, es, "left"), np.searchsorted(te, ee, "right")
    for e, (first, last) in enumerate(zip(low.tolist(), high.tolist(), strict=True)):
        i = free(first)
        while i < last:
            owner[i] = e
            after[i] = i + 1
            i = free(i)
    return owner, (low[owner] < np.arange(ts.size)) & (owner >= 0)


def label_tokens(docs: DataFrame, tokens: str = "tokens", entities: str = "entities", first_contained: bool = False, *, keep: list[str]) -> DataFrame:
    """keep and `labels`: a label for each token (start, end, ...; disjoint and in order) from entities (label, start, end).

    A token is labelled if it lies inside an entity, by the first such one in the list; B- where it starts with it, else I-. With first_contained the
    first token inside an entity has B- even if it starts later. Null arrays hold nothing.
    """
    plain = lambda c, *more: F.coalesce(F.transform(c, lambda x: F.struct(*[x[m].cast("string").alias(m) for m in more], x["start"].cast("int").alias("start"), x["end"].cast("int").alias("end"))), F.array().cast(f"array<struct<{''.join(f'{m}:string,' for m in more)}start:int,end:int>>"))
    d = docs.select(F.struct(*[F.col(k) for k in keep]).alias("row"), plain(tokens).alias("tokens"), plain(entities, "label").alias("entities"))

    def run(batches):
        for b in batches:
            nt, ne = (np.diff(np.asarray(b.column(c).offsets)) for c in ("tokens", "entities"))
            (ts, te), (names, es, ee) = b.column("tokens").flatten().flatten(), b.column("entities").flatten().flatten()
            ts, te, es, ee, names = *(np.asarray(x, np.int64) for x in (ts, te, es, ee)), names.to_pylist()
            # names at 2 * i + 1 (I-) and 2 * i + 2 (B-), O at 0; the labels of a batch are one take of them
            known = pa.array(["O", *(p + x for x in dict.fromkeys(names) if x is not None for p in ("I-", "B-"))], pa.string())
            at = {x: 2 * i + 1 for i, x in enumerate(x for x in dict.fromkeys(names) if x is not None)}
            code = np.array([at.get(x, -2) for x in names], np.int64)
            t0, e0, out = np.cumsum(nt) - nt, np.cumsum(ne) - ne, np.zeros(ts.size, np.int64)
            for i in np.flatnonzero((nt > 0) & (ne > 0)).tolist():
                x, y = slice(t0[i], t0[i] + nt[i]), slice(e0[i], e0[i] + ne[i])
                owner, earlier = token_labels(ts[x], te[x], es[y], ee[y])
                begins = ~earlier if first_contained else ts[x] == es[y][owner]
                out[x] = np.where(owner < 0, 0, code[y][owner] + begins)
            if (out < 0).any():
                raise ValueError("an entity without a label")
            labels = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(nt)], pa.int32()), known.take(pa.array(out)))
            yield pa.record_batch([b.column("row"), labels], ["row", "labels"])

    schema = d.select("row").schema.add("labels", T.ArrayType(T.StringType()))
    return d.mapInArrow(run, schema).select("row.*", "labels")
