"""Fusion of overlapping candidates into disjoint spans.

Greedy by priority (validated, firm pattern, score, length, then input order), trimmed, grown to word boundaries, and
joined where they overlap (any label; the leftmost, then longest, gives it) or touch (equal labels).
The array form stays in built-in functions, quadratic in a document's candidates; documents with more than
`threshold` go through an Arrow function that works on whole columns of a document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let
from .detect import SOFT, SPAN, SPANS

THRESHOLD = 400


def prioritised(cands: Column) -> Column:
    """Candidates from the most to the least preferred; equals in `ord`, then array order."""
    key = lambda e, i: F.struct(
        (~e["validated"]).alias("a"), (~((e["source"] == "regex") & ~e["label"].isin(*SOFT))).alias("b"), (-e["score"]).alias("c"), (e["start"] - e["end"]).alias("d"), i.alias("i"), e.alias("e"))
    return F.transform(F.array_sort(F.transform(cands, key)), lambda x: x["e"])


def greedy(cands: Column) -> Column:
    """The candidates that overlap none preferred to them, by start."""
    none = F.array().cast(SPANS)
    take = lambda acc, e: F.when(F.exists(acc, lambda k: (k["end"] > e["start"]) & (k["start"] < e["end"])), acc).otherwise(F.array_append(acc, e))
    kept = F.aggregate(prioritised(cands), none, take)
    return F.transform(F.array_sort(F.transform(kept, lambda e: F.struct(e["start"].alias("a"), e.alias("e")))), lambda x: x["e"])


def _with(e: Column, start: Column, end: Column) -> Column:
    return F.struct(e["label"].alias("label"), start.cast("int").alias("start"), end.cast("int").alias("end"), e["score"].alias("score"), e["validated"].alias("validated"), e["source"].alias("source"), e["ord"].alias("ord"))


def trimmed(spans: Column, text: Column) -> Column:
    """White space at the ends goes, and with it spans of nothing else."""

    def trim(e):
        def cut(v):
            left = F.length(F.regexp_replace(v, r"(?U)^\s+", ""))
            right = F.length(F.regexp_replace(v, r"(?U)\s+$", ""))
            return F.when(F.coalesce(v.rlike(r"(?U)^\s|\s$"), F.lit(True)), _with(e, e["end"] - left, e["start"] + right)).otherwise(_with(e, e["start"], e["end"]))

        return let(F.substring(text, e["start"] + 1, e["end"] - e["start"]), cut)

    return F.filter(F.transform(spans, trim), lambda e: e["start"] < e["end"])


def extended(spans: Column, text: Column) -> Column:
    """Edges inside a word move to its ends."""
    word = r"[\p{L}\p{N}_]"
    run = lambda t: F.length(F.regexp_extract(t, f"^{word}*", 0))
    at = lambda place: F.substring(text, place, F.lit(1)).rlike(word)

    def grow(e):
        # the two characters at an edge tell whether it is inside a word; only then the word's rest is looked for, backwards from the left edge
        some = e["end"] > e["start"]
        inside_left = some & (e["start"] > 0) & at(e["start"]) & at(e["start"] + 1)
        inside_right = some & at(e["end"]) & at(e["end"] + 1)
        left = F.when(inside_left, run(F.reverse(F.substring(text, F.lit(1), e["start"])))).otherwise(0)
        right = F.when(inside_right, run(F.substring(text, e["end"] + 1, F.length(text)))).otherwise(0)
        return _with(e, e["start"] - left, e["end"] + right)

    return F.transform(spans, grow)


def coalesced(spans: Column) -> Column:
    """Sorted by start (longest first); overlapping ones joined, touching ones if their labels are equal."""
    order = lambda e, i: F.struct(e["start"].alias("a"), (e["start"] - e["end"]).alias("b"), i.alias("i"), e.alias("e"))
    ordered = F.transform(F.array_sort(F.transform(spans, order)), lambda x: x["e"])

    def step(acc, e):
        last = F.try_element_at(acc, F.lit(-1))
        joins = F.coalesce((e["start"] < last["end"]) | ((e["start"] == last["end"]) & (e["label"] == last["label"])), F.lit(False))
        longer = _with(last, last["start"], F.greatest(last["end"], e["end"]))
        return F.when(joins, F.array_append(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), longer)).otherwise(F.array_append(acc, e))

    return F.aggregate(ordered, F.array().cast(SPANS), step)


def production_spans(spans: Column, text: Column) -> Column:
    """A model's spans as they are shown: trimmed, grown to whole words, overlapping ones joined, touching ones of one label too. No patterns come first here.

    Of spans that begin together the longest names the union, of equally long ones the label that sorts first. A span outside the text, or an empty one, is an error.
    """
    wrong = F.exists(spans, lambda e: (e["start"] < 0) | (e["end"] > F.length(text)) | (e["end"] <= e["start"]))
    safe = F.when(F.coalesce(wrong, F.lit(False)), F.raise_error(F.lit("a span outside the text")).cast(SPANS)).otherwise(spans)
    by_label = lambda s: F.transform(F.array_sort(F.transform(s, lambda e, i: F.struct(e["label"].alias("a"), i.alias("i"), e.alias("e")))), lambda x: x["e"])  # noqa: E731  the later sort keeps this order among equals
    return coalesced(by_label(extended(trimmed(safe, text), text)))


def fused(cands: Column, text: Column, grow: bool = True) -> Column:
    return coalesced(extended(trimmed(greedy(cands), text), text)) if grow else greedy(cands)


# ------------------------------------------------------------ the Arrow form

class CharMap:
    """For every place of a text: the nearest character that isn't white space, and the ends of the run of word characters it is in."""

    def __init__(self, text: str):
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        known, at = np.unique(code, return_inverse=True)
        letters = [chr(c) for c in known.tolist()]
        solid = ~np.array([c.isspace() for c in letters], bool)[at]
        self.word = np.array([c.isalnum() or c == "_" for c in letters], bool)[at]
        place = np.arange(code.size)
        self.solid_from = np.minimum.accumulate(np.where(solid, place, code.size)[::-1])[::-1]
        self.solid_to = np.maximum.accumulate(np.where(solid, place, -1))
        edge = np.flatnonzero(np.diff(self.word, prepend=~self.word[:1], append=~self.word[-1:]))
        run = np.cumsum(np.isin(place, edge)) - 1
        self.run_from, self.run_to = edge[:-1][run], edge[1:][run]

    def fit(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Spans trimmed and grown to whole words, and which of them are left."""
        left = np.flatnonzero(end > start)
        s, e = self.solid_from[start[left]], self.solid_to[end[left] - 1]
        some = s <= e
        left, s, e = left[some], s[some], e[some]
        return left, np.where(self.word[s], self.run_from[s], s), np.where(self.word[e], self.run_to[e], e + 1)


def chosen(rank: np.ndarray, start: np.ndarray, end: np.ndarray, size: int) -> np.ndarray:
    """The candidates, in the order of `rank`, that overlap none taken before.

    They are painted on a strip with two cells a character: one for it and one for the border before it. A span covers its characters and the borders between
    them; an empty one its border. So two spans overlap just if they share a cell.
    """
    strip, out = bytearray(2 * size + 2), []
    low, high = np.where(end > start, 2 * start + 1, 2 * start), np.where(end > start, 2 * end, 2 * start + 1)
    for i, a, b in zip(rank.tolist(), low[rank].tolist(), high[rank].tolist(), strict=True):
        if strip.find(1, a, b) < 0:
            strip[a:b] = b"\x01" * (b - a)
            out.append(i)
    return np.array(out, np.int64)


def islands(start: np.ndarray, end: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order of the spans that begin an island, its start, its end): spans that overlap, then islands that touch under one label."""
    if not start.size:
        return start, start, end
    order = np.lexsort((-end, start))
    s, reach, name = start[order], np.maximum.accumulate(end[order]), label[order]
    for touching in (False, True):
        before = np.r_[-1, reach[:-1]]
        new = (s >= before) if not touching else (s != before) | (name != np.r_[name[:1], name[:-1]])
        new[:1] = True
        head = np.flatnonzero(new)
        last = np.r_[head[1:], s.size] - 1
        order, s, reach, name = order[head], s[head], reach[last], name[head]
    return order, s, reach


def fuse_list(cands: pa.StructArray, text: str, grow: bool = True) -> pa.StructArray:
    """The same for one document, in O(k log k + characters)."""
    col = {f.name: cands.field(i) for i, f in enumerate(cands.type)}
    start, end = (np.asarray(col[c], np.int64) for c in ("start", "end"))
    label = np.unique(np.asarray(col["label"].to_numpy(zero_copy_only=False), str), return_inverse=True)[1]
    firm = np.asarray(pc.and_(pc.equal(col["source"], "regex"), pc.invert(pc.is_in(col["label"], pa.array(SOFT)))).cast(pa.int8()))
    rank = np.lexsort((start - end, -np.asarray(col["score"]), -firm, -np.asarray(col["validated"].cast(pa.int8()))))  # stable: equals stay in input order
    kept = np.sort(chosen(rank, start, end, len(text)))
    kept = kept[np.argsort(start[kept], kind="stable")]
    if not grow:
        return cands.take(pa.array(kept))
    left, s, e = CharMap(text).fit(start[kept], end[kept]) if text else (kept[:0],) * 3
    kept = kept[left]
    order, s, e = islands(s, e, label[kept])
    out = cands.take(pa.array(kept[order]))
    new = {"start": pa.array(s, pa.int32()), "end": pa.array(e, pa.int32())}
    return pa.StructArray.from_arrays([new.get(f.name, out.field(i)) for i, f in enumerate(out.type)], fields=list(out.type))


def merge(docs: DataFrame, text: str = "text", column: str = "candidates", threshold: int | None = THRESHOLD, grow: bool = True) -> DataFrame:
    """docs with a column `entities`. Lists longer than the threshold take the Arrow form, which is sent nothing of other rows; None leaves it out.

    Without grow the chosen candidates stay as they are: neither trimmed nor grown to whole words nor joined.
    """
    cands = F.coalesce(F.col(column), F.array().cast(SPANS))
    if threshold is None:
        return docs.withColumn("entities", fused(cands, F.col(text), grow))

    @F.arrow_udf(SPANS)
    def arrow_form(c: pa.Array, t: pa.Array) -> pa.Array:
        fused_lists = [fuse_list(x.values, y.as_py(), grow) if x.is_valid and y.is_valid else None for x, y in zip(c, t, strict=True)]
        ends = np.cumsum([0, *(0 if x is None else len(x) for x in fused_lists)])
        values = [x for x in fused_lists if x is not None]
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(values) if values else pa.array([], c.type.value_type), type=c.type, mask=pa.array([x is None for x in fused_lists], pa.bool_()))

    many = F.size(cands) > threshold
    long = arrow_form(F.when(many, cands), F.when(many, F.col(text)))
    return docs.withColumn("entities", F.when(many, long).otherwise(fused(cands, F.col(text), grow)))


def merge_long(spans: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fuses a long table of candidates (key, label, start, ...) of documents; one shuffle on key."""
    fields = [x.split(":")[0] for x in SPAN[len("struct<") : -1].split(",")]
    wide = spans.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "start", *[c for c in fields if c not in ("ord", "start")]))), lambda e: F.struct(*[e[c].alias(c) for c in fields])).cast(SPANS).alias("candidates"))
    return merge(docs.join(wide, key, "left"), text)


def merged_same_label(spans: Column, text: Column) -> Column:
    """Spans of one label with nothing but white space between them become one; overlaps are an error."""
    ordered = F.array_sort(F.transform(spans, lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["label"].alias("label"))))

    def step(acc, e):
        last = F.try_element_at(acc, F.lit(-1))
        gap = F.substring(text, last["end"] + 1, F.greatest(F.lit(0), e["start"] - last["end"]))
        bad = F.coalesce(e["start"] < last["end"], F.lit(False))
        joins = F.coalesce((last["label"] == e["label"]) & (F.trim(F.regexp_replace(gap, r"(?U)\s+", "")) == ""), F.lit(False))
        longer = F.struct(last["start"].alias("start"), e["end"].alias("end"), last["label"].alias("label"))
        keep = F.when(joins, F.array_append(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), longer)).otherwise(F.array_append(acc, e))
        return F.when(bad, F.raise_error(F.lit("overlapping spans")).cast("array<struct<start:int,end:int,label:string>>")).otherwise(keep)

    return F.aggregate(ordered, F.array().cast("array<struct<start:int,end:int,label:string>>"), step)
