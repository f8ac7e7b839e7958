"""Reversible and irreversible rewriting: placeholders, dictionaries, segments, restoring, residual checks."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import unfolded
from ..functions.text import collapse, let
from .detect import SPANS, detect
from .fuse import THRESHOLD, merge

def exclude(cands: Column, labels: Iterable[str]) -> Column:
    """Drops labels before fusion: others may then take their place."""
    out = list(labels)
    return F.filter(cands, lambda e: ~e["label"].isin(*out)) if out else cands


_FIELDS = ("label", "start", "end", "score", "validated", "source", "ord")
_NUMBERS = "array<struct<n:int,first:boolean>>"


def _numbers(keys: Column) -> Column:
    """For each (label, key) its number among its label's by first occurrence, and whether it is the first; quadratic in their count."""

    def known(distinct):
        def one(k, i):
            at = F.array_position(distinct, k).cast("int")
            n = F.size(F.filter(F.slice(distinct, F.lit(1), at), lambda d: d["label"] == k["label"]))
            return F.struct(n.alias("n"), (F.array_position(keys, k) == i + 1).alias("first"))

        return F.transform(keys, one)

    return let(F.array_distinct(keys), known).cast(_NUMBERS)


def _number_lists(keys: pa.Array) -> pa.Array:
    """The same in one pass over each list."""

    def one(rows):
        last, seen, out = {}, {}, []
        for r in rows:
            k = (r["label"], r["key"])
            first = k not in seen
            if first:
                seen[k] = last[k[0]] = last.get(k[0], 0) + 1
            out.append({"n": seen[k], "first": first})
        return out

    return pa.array([None if x is None else one(x) for x in keys.to_pylist()], pa.list_(pa.struct([("n", pa.int32()), ("first", pa.bool_())])))


def with_placeholders(entities: Column, text: Column, threshold: int | None = THRESHOLD) -> Column:
    """Entities with value, number, placeholder and whether it is its placeholder's first.

    Values equal but for case and white space share the number of their first occurrence, counted by label. Lists longer than the threshold are numbered in an
    Arrow function, which is sent nothing of other rows; None leaves it out.
    """
    key = lambda e: F.struct(e["label"].alias("label"), F.lower(collapse(e["value"])).alias("key"))

    def named(e, x):
        return F.struct(*[e[c].alias(c) for c in (*_FIELDS, "value")], F.concat(F.lit("["), e["label"], F.lit("_"), x["n"].cast("string"), F.lit("]")).alias("ph"), x["n"].alias("n"), x["first"].alias("first"))

    valued = F.transform(entities, lambda e: F.struct(*[e[c].alias(c) for c in _FIELDS], F.substring(text, e["start"] + 1, e["end"] - e["start"]).alias("value")))
    if threshold is None:
        return let(valued, lambda v: F.zip_with(v, let(F.transform(v, key), _numbers), named))
    many = F.size(entities) > threshold
    long = F.arrow_udf(_number_lists, _NUMBERS)(F.when(many, F.transform(valued, key)))
    return F.when(many, F.zip_with(valued, long, named)).otherwise(let(valued, lambda v: F.zip_with(v, let(F.transform(v, key), _numbers), named)))


def dictionary(kept: Column) -> Column:
    """Placeholder to first surface form."""
    return F.map_from_entries(F.transform(F.filter(kept, lambda e: e["first"]), lambda e: F.struct(e["ph"].alias("ph"), e["value"].alias("value"))))


def _pieces(kept: Column, text: Column, shown) -> Column:
    gap = lambda e, i: F.substring(text, F.coalesce(F.get(kept, i - 1)["end"], F.lit(0)) + 1, e["start"] - F.coalesce(F.get(kept, i - 1)["end"], F.lit(0)))
    body = F.array_join(F.transform(kept, lambda e, i: F.concat(gap(e, i), shown(e))), "")
    end = F.coalesce(F.try_element_at(kept, F.lit(-1))["end"], F.lit(0))
    return F.concat(body, F.substring(text, end + 1, F.length(text)))


def anonymised(kept: Column, text: Column) -> Column:
    return _pieces(kept, text, lambda e: e["ph"])


def anonymised_by_type(kept: Column, text: Column) -> Column:
    return _pieces(kept, text, lambda e: F.concat(F.lit("["), e["label"], F.lit("]")))


def segments(kept: Column, text: Column, reversible: bool = True) -> Column:
    """Plain and replaced stretches in order; without reversible the replaced ones keep no text."""
    kind = "array<struct<t:string,label:string,ph:string,src:string,validated:boolean>>"
    none = F.lit(None).cast("string")
    plain = lambda t: F.struct(t.alias("t"), none.alias("label"), none.alias("ph"), none.alias("src"), F.lit(None).cast("boolean").alias("validated"))

    def both(e, i):
        before = F.coalesce(F.get(kept, i - 1)["end"], F.lit(0))
        own = F.struct((e["value"] if reversible else none).alias("t"), e["label"].alias("label"), e["ph"].alias("ph"), e["source"].alias("src"), e["validated"].alias("validated"))
        return F.array(plain(F.substring(text, before + 1, e["start"] - before)), own)

    end = F.coalesce(F.try_element_at(kept, F.lit(-1))["end"], F.lit(0))
    out = F.concat(F.flatten(F.transform(kept, both)), F.array(plain(F.substring(text, end + 1, F.length(text)))))
    return F.filter(out, lambda s: s["label"].isNotNull() | (s["t"] != "")).cast(kind)


def counts(kept: Column, field: str) -> Column:
    """(value, n) by a field, the most frequent first."""
    names = F.array_distinct(F.transform(kept, lambda e: e[field]))
    rows = F.transform(names, lambda v: F.struct((-F.size(F.filter(kept, lambda e: e[field] == v))).alias("m"), v.alias("v")))
    return F.transform(F.array_sort(rows), lambda r: F.struct(r["v"].alias("value"), (-r["m"]).alias("n")))


def analyse(docs: DataFrame, text: str = "text", labels: Iterable[str] | None = None, excluded: Iterable[str] = (), reversible: bool = True, grouped: bool = True, model: str | None = None, grow: bool = True) -> DataFrame:
    """The whole path in one plan without a shuffle: detect, exclude, fuse, number, render.

    model names an array column (SPANS) of candidates from elsewhere; they come before the patterns' among equals. Without grow a match inside a word
    stays as it is, the rest of the word with it; by default the whole word is replaced.
    """
    out = detect(docs, text, labels, grouped)
    if model:
        out = out.withColumn("candidates", F.concat(F.coalesce(F.col(model), F.array().cast(SPANS)), "candidates"))
    out = merge(out.withColumn("candidates", exclude(F.col("candidates"), excluded)), text, grow=grow)
    out = out.withColumn("entities", with_placeholders(F.col("entities"), F.col(text)))
    kept, t = F.col("entities"), F.col(text)
    cols = {
        "anonymized_text": anonymised(kept, t), "segments": segments(kept, t, reversible), "n_chars": F.length(t), "n_entities": F.size(kept),
        "n_unique": F.size(F.filter(kept, lambda e: e["first"])), "by_label": counts(kept, "label"), "by_source": counts(kept, "source"), "mapping_enabled": F.lit(reversible),
    }
    if reversible:
        cols["mapping"] = dictionary(kept)
    return out.withColumns(cols)


def restored(text: Column, mapping: Column, strict: bool = False) -> Column:
    """Placeholders replaced by their values, longest first.

    Unless strict, brackets are optional and white space inside them goes, so a bare FULLNAME_1 also takes the white space around it.
    """
    keys = F.transform(F.map_keys(mapping), lambda k: F.struct((-F.length(k)).alias("a"), k.alias("k")))
    ordered = F.transform(F.array_sort(keys), lambda x: x["k"])
    name = lambda k: F.regexp_replace(k, r"^\[|\]$", "")
    quoted = lambda v: F.regexp_replace(v, r"([\\$])", r"\\$1")
    pattern = (lambda k: F.concat(F.lit(r"\[\s*"), name(k), F.lit(r"\s*\]"))) if strict else (lambda k: F.concat(F.lit(r"\[?\s*"), name(k), F.lit(r"(?![0-9])\s*\]?")))
    return F.aggregate(ordered, text, lambda t, k: F.regexp_replace(t, pattern(k), quoted(F.element_at(mapping, k))))


def noisy(value: Column) -> Column:
    """Too little to search for: fewer than two letters or digits, or exactly two digits."""
    alnum = F.regexp_replace(value, r"[^\p{L}\p{N}]", "")
    return (F.length(alnum) < 2) | alnum.rlike("^[0-9]{2}$")


def value_pattern(value: Column, cut: Column | None = None) -> Column:
    """A pattern for a value as it may be printed: whole words, any white space, hyphenated line breaks.

    cut (left, right) says on which sides it was cut out of a word: there no word boundary is needed.
    """
    quoted = F.regexp_replace(F.trim(value), r"([\\.^$|?*+()\[\]{}\-])", r"\\$1")
    spaced = F.regexp_replace(quoted, r"\s+", r"\\s+")
    broken = F.regexp_replace(spaced, r"(\p{L})(?=\p{L})", r"$1(?:-\\s*\\n\\s*)?")
    edge = lambda side, boundary: F.lit(boundary) if cut is None else F.when(cut[side], "").otherwise(boundary)
    return F.concat(F.lit("(?U)"), edge("left", r"(?<!\w)"), broken, edge("right", r"(?!\w)"))


def redacted(text: Column, mapping: Column, mask: str = "█") -> Column:
    """Every occurrence of the mapping's values, longest first, noisy ones skipped."""
    rows = F.filter(F.transform(F.map_values(mapping), lambda v: F.struct((-F.length(v)).alias("a"), v.alias("v"))), lambda r: ~noisy(r["v"]))
    return F.aggregate(F.array_sort(rows), text, lambda t, r: F.regexp_replace(t, value_pattern(r["v"]), F.lit(mask)))


def substituted(text: Column, patterns: list[str], mask: str) -> Column:
    """(text, n): every match of the patterns replaced, one pattern after the other, and how many there were."""
    out = F.struct(text.alias("text"), F.lit(0).alias("n"))

    def one(pattern):
        return lambda s: F.struct(F.regexp_replace(s["text"], pattern, mask).alias("text"), (s["n"] + F.regexp_count(s["text"], F.lit(pattern))).alias("n"))

    for p in patterns:
        out = let(out, one(p))
    return out


def cut_sides(kept: Column, text: Column) -> Column:
    """Placeholder to (left, right): whether a word character stands right before or behind its first occurrence."""
    left = lambda e: (e["start"] > 0) & F.substring(text, e["start"], F.lit(1)).rlike(r"(?U)\w")
    right = lambda e: F.substring(text, e["end"] + 1, F.lit(1)).rlike(r"(?U)\w")
    return F.map_from_entries(F.transform(F.filter(kept, lambda e: e["first"]), lambda e: F.struct(e["ph"].alias("ph"), F.struct(left(e).alias("left"), right(e).alias("right")).alias("cut"))))


def residual(text: Column, mapping: Column, cut: Column | None = None) -> Column:
    """Placeholders whose value can still be found: as whole words, or inside words on the sides that cut_sides() names."""
    sides = lambda e: None if cut is None else F.element_at(cut, e["key"])
    left = F.filter(F.map_entries(mapping), lambda e: ~noisy(e["value"]) & F.regexp_like(text, value_pattern(e["value"], sides(e))))
    return F.array_sort(F.transform(left, lambda e: e["key"]))


def swept(text: Column, mapping: Column, cut: Column | None = None) -> Column:
    """(text, left): values that residual() still finds in a rewritten text replaced by their placeholders, the longest first, and what it finds then.

    A detector can miss at one place what it knows from another: a card number with a digit behind it, or printed over two lines. A value that only stands as
    a whole word once its neighbour is replaced goes in the next round; there are as many rounds at most as there are places of values, in words or not.
    """
    found = lambda t: F.struct(t.alias("text"), residual(t, mapping, cut).alias("left"))
    quoted = lambda k: F.regexp_replace(k, r"([\\$])", r"\\$1")

    def once(s):
        value = lambda k: F.element_at(mapping, k)
        pattern = lambda k: value_pattern(value(k), None if cut is None else F.element_at(cut, k))
        longest = F.array_sort(F.transform(s["left"], lambda k: F.struct((-F.length(value(k))).alias("a"), k.alias("k"))))
        return let(F.aggregate(longest, s["text"], lambda t, x: F.regexp_replace(t, pattern(x["k"]), quoted(x["k"]))), found)

    anywhere = F.struct(F.lit(True).alias("left"), F.lit(True).alias("right"))
    places = lambda t: F.aggregate(F.map_values(mapping), F.lit(0), lambda n, v: n + F.when(noisy(v), 0).otherwise(F.regexp_count(t, value_pattern(v, anywhere))))
    rounds = lambda s: F.aggregate(F.sequence(F.lit(1), places(s["text"])), s, lambda r, _: F.when(F.size(r["left"]) == 0, r).otherwise(once(r)))
    return let(let(text, found), lambda s: F.when(F.size(s["left"]) == 0, s).otherwise(rounds(s)))


def dictionary_rows(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """The dictionary as a table: key, ph, label, n, value."""
    one = unfolded(docs, "entities", key)
    return one.groupBy(key, "ph", "label", "n").agg(F.min_by("value", "start").alias("value"))
