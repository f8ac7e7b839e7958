"""Token labels: projection of spans, normalisation, spans from labels, offsets, alignment to subwords."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.taxonomy import final_label
from ..functions.text import let

TRIPLES = "array<struct<type:string,start:int,end:int>>"


def span_to_bio(tokens: Column, entities: Column, first_contained: bool = False) -> Column:
    """A label for each token (start, end, ...) from entities (label, start, end).

    A token is labelled if it lies inside an entity; B- where it starts with it, else I-. With first_contained the
    first token inside an entity has B- even if it starts later. Compares each token with each entity, without leaving the JVM: for short
    lists; sweep.label_tokens() does the same for long ones.
    """

    def label(t, i):
        inside = F.get(F.filter(entities, lambda e: (t["start"] >= e["start"]) & (t["end"] <= e["end"])), F.lit(0))
        if first_contained:
            earlier = F.exists(F.slice(tokens, 1, i), lambda u: (u["start"] >= inside["start"]) & (u["end"] <= inside["end"]))
            begins = ~earlier
        else:
            begins = t["start"] == inside["start"]
        return F.coalesce(F.concat(F.when(begins, "B-").otherwise("I-"), inside["label"]), F.lit("O"))

    return F.transform(tokens, label)


def type_of(label: Column) -> Column:
    return F.when(label == "O", F.lit(None)).when(label.startswith("B-") | label.startswith("I-"), F.substring(label, F.lit(3), F.length(label))).otherwise(label)


def normalised(labels: Column, legacy: bool = False) -> Column:
    """Final labels; dropped ones become O, and B- or I- follows from whether the token before has the same final label."""

    def relabel(types):
        def label(t, i):
            same = F.coalesce(F.get(types, i - 1) == t, F.lit(False))
            return F.coalesce(F.concat(F.when(same, "I-").otherwise("B-"), t), F.lit("O"))

        return F.transform(types, label)

    return let(F.transform(labels, lambda x: final_label(type_of(x), legacy)), relabel)


def bio_to_spans(labels: Column) -> Column:
    """(type, first token, token after the last); an I- without an open span of its type opens one."""
    rows = F.transform(labels, lambda x, i: F.struct(type_of(x).alias("t"), x.startswith("B-").alias("b"), i.alias("i")))

    def edges(r):
        """Places where the type changes or a B- stands, each with the type from there on."""
        return F.filter(r, lambda x: x["b"] | ~F.get(r, x["i"] - 1)["t"].eqNullSafe(x["t"]) | (x["i"] == 0))

    def cut(e):
        spans = F.transform(e, lambda x, k: F.struct(x["t"].alias("type"), x["i"].alias("start"), F.coalesce(F.get(e, k + 1)["i"], F.size(labels)).alias("end")))
        return F.filter(spans, lambda x: x["type"].isNotNull())

    return let(let(rows, edges), cut).cast(TRIPLES)


def canonical_text(tokens: Column) -> Column:
    return F.array_join(tokens, " ")


@F.arrow_udf(returnType=T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))
def _joined_offsets(sizes: pa.Array) -> pa.Array:
    """Running sums of each list's sizes, with one space between: one cumulative sum over all lists of a batch."""
    n = np.asarray(sizes.flatten(), np.int64)
    first = np.asarray(sizes.offsets, np.int64) - sizes.offsets[0].as_py()
    upto = np.r_[0, np.cumsum(n + 1)]
    start = upto[:-1] - np.repeat(upto[first[:-1]], np.diff(first))
    rows = pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(start + n, pa.int32())], ["start", "end"])
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), rows, mask=sizes.is_null())


def canonical_offsets(tokens: Column) -> Column:
    """(start, end) of each token in the text of tokens joined by spaces; only the tokens' lengths leave the JVM."""
    return _joined_offsets(F.transform(tokens, F.length))


def word_to_char_spans(spans: Column, offsets: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["type"].alias("type"), F.get(offsets, s["start"])["start"].alias("start"), F.get(offsets, s["end"] - 1)["end"].alias("end"))).cast(TRIPLES)


def aligned_words(word_ids: Column, labels: Column) -> Column:
    """Labels of subwords from their words': B- becomes I- on continuations; null word ids (special tokens) have none."""

    def label(w, i):
        own = F.get(labels, w)
        again = F.coalesce(F.get(word_ids, i - 1) == w, F.lit(False))
        return F.when(w.isNull(), F.lit(None)).otherwise(F.when(again & own.startswith("B-"), F.concat(F.lit("I"), F.substring(own, F.lit(2), F.length(own)))).otherwise(own))

    return F.transform(word_ids, label)


def aligned_chars(offsets: Column, entities: Column, legacy: bool = False) -> Column:
    """Labels of subwords (start, end) from the entities they overlap; two entities on one are an error."""

    def label(t, i):
        hit = F.filter(entities, lambda e: (t["start"] < e["end"]) & (t["end"] > e["start"]))
        kind = final_label(F.get(hit, F.lit(0))["label"], legacy)
        earlier = F.get(offsets, i - 1)
        cont = F.coalesce((earlier["start"] < F.get(hit, F.lit(0))["end"]) & (earlier["end"] > F.get(hit, F.lit(0))["start"]), F.lit(False))
        own = F.coalesce(F.concat(F.when(cont, "I-").otherwise("B-"), kind), F.lit("O"))
        return F.when(t["start"] >= t["end"], F.lit(None)).otherwise(F.when(F.size(hit) > 1, F.raise_error(F.lit("a token overlaps two entities")).cast("string")).otherwise(own))

    return F.transform(offsets, label)


def first_subword(labels: DataFrame, keys: tuple[str, ...] = ("doc_id", "word_id"), pos: str = "pos", value: str = "label") -> DataFrame:
    """The label of each word's first subword, from a long table."""
    return labels.where(F.col(keys[-1]).isNotNull()).groupBy(*keys).agg(F.min_by(value, pos).alias(value))


def simple_spans(subwords: DataFrame, key: str = "doc_id") -> DataFrame:
    """Character spans from subword labels in a long table (key, pos, label, start, end, special).

    Special tokens are skipped; a label without prefix continues; B- splits; a subword without characters closes.
    """
    rows = subwords.where(~F.col("special")).withColumn("type", type_of(F.col("label")))
    w = Window.partitionBy(key).orderBy("pos")
    closes = F.col("end") <= F.col("start")
    before = F.when(F.lag(closes).over(w), None).otherwise(F.lag("type").over(w))
    opens = F.col("type").isNotNull() & (F.col("label").startswith("B-") | ~F.coalesce(before == F.col("type"), F.lit(False)))
    rows = rows.withColumn("opens", opens).withColumn("no", F.sum(F.col("opens").cast("int")).over(w)).where(F.col("type").isNotNull() & ~closes)
    return rows.groupBy(key, "no").agg(F.first("type").alias("type"), F.min("start").alias("start"), F.max("end").alias("end")).select(key, "type", "start", "end")


def char_predictions(subwords: DataFrame, words: DataFrame, key: str = "doc_id") -> DataFrame:
    """Character spans in the canonical text from subwords whose offsets are within their words.

    subwords: key, pos, word_id, label, start, end, special. words: key, word_id, base (where the word begins). Special tokens and such without a word are skipped.
    """
    placed = subwords.where(~F.col("special") & F.col("word_id").isNotNull()).join(words.select(key, "word_id", "base"), [key, "word_id"])
    return simple_spans(placed.select(key, "pos", "label", (F.col("start") + F.col("base")).alias("start"), (F.col("end") + F.col("base")).alias("end"), "special"), key)


def subword_windows(n: Column, size: int, stride: int) -> Column:
    """(window, first, last + 1) of windows of `size` tokens that overlap by `stride`, over n tokens."""
    step = size - stride
    last = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(step)).cast("int"))
    rows = F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(k.alias("window"), (k * step).alias("first"), F.least(k * step + size, n).cast("int").alias("end")))
    return F.when(n > 0, rows).otherwise(F.array().cast("array<struct<window:int,first:int,end:int>>"))


def merged_windows(logits: DataFrame, key: str = "doc_id") -> DataFrame:
    """The label of each token from overlapping windows: mean logit by identical (start, end), the least id among equals.

    Input rows: key, window, start, end, special, label_id, logit. Tokens of unlike offsets that overlap are an error.
    """
    mean = logits.where(~F.col("special") & (F.col("end") > F.col("start"))).groupBy(key, "start", "end", "label_id").agg(F.avg("logit").alias("logit"))
    best = mean.groupBy(key, "start", "end").agg(F.min_by("label_id", F.struct(-F.col("logit"), "label_id")).alias("label_id"))
    w = Window.partitionBy(key).orderBy("start", "end")
    bad = F.coalesce(F.lag("end").over(w) > F.col("start"), F.lit(False))
    return best.withColumn("bad", bad).where(F.when(F.col("bad"), F.raise_error(F.lit("windows disagree on tokens")).cast("boolean")).otherwise(F.lit(True))).drop("bad")


def recased(tokens: Column, labels: Column, key: Column, seed: int = 0) -> Column:
    """Case variants by a hash of the row: 35 % lower, 10 % upper, 8 % token by token, 22 % entities only, the rest as they are."""
    roll = lambda *c: F.pmod(F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), *[x.cast("string") for x in c]), 256), 1, 8), 16, 10).cast("long"), F.lit(100))
    r = roll(key)

    def by_token(t, i):
        k = roll(key, i) % 3
        return F.when(k == 0, F.lower(t)).when(k == 1, F.upper(t)).otherwise(F.initcap(t))

    def entities(kind):  # what is the same for all tokens is worked out once
        case = lambda t: F.when(kind == 0, F.lower(t)).when(kind == 1, F.upper(t)).otherwise(F.initcap(t))
        return F.zip_with(tokens, labels, lambda t, x: F.when(x == "O", t).otherwise(case(t)))

    only = let(roll(key, F.lit("entity")) % 3, entities)
    return F.when(r < 35, F.transform(tokens, F.lower)).when(r < 45, F.transform(tokens, F.upper)).when(r < 53, F.transform(tokens, by_token)).when(r < 75, only).otherwise(tokens)


def tag_set(labels: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(labels, type_of), lambda t: t.isNotNull())))


def check_inventory(labels: list[str]) -> dict[str, int]:
    """Ids of a label list; every B- needs its I-, O comes first, and none may repeat."""
    if len(set(labels)) != len(labels) or labels[:1] != ["O"]:
        raise ValueError("labels must be distinct and begin with O")
    lost = [x for x in labels if x.startswith("B-") and f"I-{x[2:]}" not in labels]
    if lost:
        raise ValueError(f"labels without their continuation: {lost}")
    return {x: i for i, x in enumerate(labels)}
