"""Values of a dictionary found in texts, redacted or reported, with one automaton for all of them.

What a value matches: its characters in either case; between its words any white space or none; between two characters of a word a line break, with a hyphen or soft hyphen before it or
not. It must begin and end at word boundaries, except on a side where the value itself ends in punctuation (a cut word) and at least CUT letters and digits remain: that punctuation is left out.

One pass finds where the letters and digits of values stand in the letters and digits of a text (an Aho-Corasick automaton); only there the exact form is compared. Longer values go first, and what one
has taken is closed to the others: the result is that of replacing value by value over the whole text.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .sweep import _payload

# fixed values: letters and digits that a cut value needs, and what may stand between two characters of a word
CUT = 4
BREAK = r"(?:[­‐-]?[ \t]*\n[ \t]*)?"

SLICE_VALUES, SLICE_BYTES, SLICES = 100_000, 16 << 20, 16
SPAN = T.StructType([T.StructField("ph", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


@functools.cache
def _lower() -> np.ndarray:
    low = [chr(i).lower() for i in range(1 << 16)]
    return np.array([ord(c) if len(c) == 1 and ord(c) < 1 << 16 else i for i, c in enumerate(low)], "<u4")


def lowered(text: str) -> tuple[str, np.ndarray]:
    """text in lower case, character by character (their places stay), and its codes."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    small = codes < 1 << 16
    codes = np.where(small, _lower()[np.where(small, codes, 0)], codes).astype("<u4")
    return codes.tobytes().decode("utf-32-le", "surrogatepass"), codes


def letters(value: str) -> str:
    return "".join(c for c in value if c.isalnum())


def noisy(value: str) -> bool:
    """Too little to look for: fewer than two letters or digits, or just two digits."""
    alnum = letters(value)
    return len(alnum) < 2 or len(alnum) == 2 and alnum.isdigit()


def form(value: str, breaks: bool = True) -> tuple[str, bool, bool] | None:
    """The pattern of a value's body, and whether its left and right sides must be word boundaries. None for noisy values."""
    value = lowered(" ".join(value.split()))[0]
    if noisy(value):
        return None
    core = re.sub(r"^\W+|\W+$", "", value)
    cut = len(letters(core)) >= CUT
    words = (core if cut else value).split(" ")
    joint = BREAK if breaks else ""
    body = (r"\s*" if breaks else r"\s+").join(joint.join(map(re.escape, w)) for w in words if w)
    return body, not (cut and re.match(r"\W", value)), not (cut and re.search(r"\W$", value))


class Dictionary:
    """An automaton of (ph, value) pairs in the order in which they go: longest first, then by ph."""

    def __init__(self, entries: list[tuple[str, str]], breaks: bool):
        import ahocorasick

        self.entries, self.automaton, keys = [], ahocorasick.Automaton(), {}
        for ph, value in entries:
            made = form(value, breaks)
            if made:
                body, left, right = made
                key = letters(lowered(value)[0])
                first = re.match(r"\\?(.)", body, re.DOTALL)[1]
                keys.setdefault(key, []).append(len(self.entries))
                self.entries.append((ph, re.compile(body), left, right, first.isalnum()))
        for key, which in keys.items():
            self.automaton.add_word(key, (len(key), which))
        if keys:
            self.automaton.make_automaton()
        self.empty = not keys

    def _candidates(self, text: str, codes: np.ndarray):
        """(entry, start, end) of all bodies in the text, in any order."""
        places = np.flatnonzero(_payload(codes))
        seen = set()
        for end, (size, which) in self.automaton.iter(codes[places].tobytes().decode("utf-32-le")):
            start = int(places[end - size + 1])
            for e in which:
                body, plain = self.entries[e][1], self.entries[e][4]
                if plain:
                    if m := body.match(text, start):
                        yield e, start, m.end()
                elif e not in seen:  # punctuation stands before its first letter: looked for in the whole text, once
                    seen.add(e)
                    at = 0
                    while m := body.search(text, at):
                        yield e, m.start(), m.end()
                        at = m.start() + 1

    def spans(self, text: str, taken: list[tuple[str, int, int]] = ()) -> list[tuple[str, int, int]]:
        """taken, and the values found in what it leaves."""
        out = list(taken)
        if self.empty or not text:
            return out
        low, codes = lowered(text)
        closed = bytearray(len(text))
        for _, a, b in out:
            closed[a:b] = b"\x01" * (b - a)
        word = lambda i: not closed[i] and (low[i].isalnum() or low[i] == "_")
        for e, a, b in sorted(self._candidates(low, codes)):
            ph, _, left, right, _ = self.entries[e]
            if closed.find(1, a, b) < 0 and not (left and a and word(a - 1)) and not (right and b < len(low) and word(b)):
                closed[a:b] = b"\x01" * (b - a)
                out.append((ph, a, b))
        return out


_built: dict = {}


def _automaton(entries: list[tuple[str, str]], breaks: bool) -> Dictionary:
    """The automaton of a broadcast list, built once in a worker."""
    key = id(entries), breaks
    if key not in _built:
        while len(_built) >= SLICES:
            _built.pop(next(iter(_built)))
        _built[key] = Dictionary(entries, breaks), entries  # the list stays alive, so its id stays its own
    return _built[key][0]


def slices(values: DataFrame) -> list[list[tuple[str, str]]]:
    """The dictionary (ph, value), longest values first, in parts of bounded size. A larger one is an error."""
    v = values.where("ph is not null and value is not null").select(F.col("ph").cast("string"), F.col("value").cast("string")).distinct()
    n, size = v.select(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("value") + F.octet_length("ph")), F.lit(0))).first()
    if n > SLICES * SLICE_VALUES or size > SLICES * SLICE_BYTES:
        raise ValueError(f"a dictionary of {n} values and {size} bytes is more than {SLICES} slices")
    rows = sorted(((r.ph, r.value) for r in v.collect()), key=lambda r: (-len(r[1]), r))
    out, held, count = [], 0, 0
    for r in rows:
        if not out or count >= SLICE_VALUES or held >= SLICE_BYTES:
            out.append([])
            held = count = 0
        out[-1].append(r)
        held, count = held + len(r[0].encode()) + len(r[1].encode()), count + 1
    return out


def find_values(docs: DataFrame, values: DataFrame, text: str = "text", breaks: bool = True) -> DataFrame:
    """docs with `found`: the places (ph, start, end; in order) of the dictionary's values in each text.

    values: ph, value. Noisy values are skipped (see noisy()); of equal values the first ph takes the places; a null text has none. breaks=False looks for words as they stand, with white space between them.
    Dictionaries of more than one slice go through the texts slice by slice in one stage.
    """
    spark, names = docs.sparkSession, [c for c in docs.columns if c != text]
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row") if names else F.struct(F.lit(0).alias("_")).alias("row"), F.col(text).cast("string").alias("text"), F.array().cast(T.ArrayType(SPAN)).alias("found"))
    for part in slices(values):
        known = spark.sparkContext.broadcast(part)

        def run(batches, known=known):
            for b in batches:
                look = _automaton(known.value, breaks)
                found = [look.spans(t, [(s["ph"], s["start"], s["end"]) for s in f]) if t is not None else [] for t, f in zip(b.column("text").to_pylist(), b.column("found").to_pylist(), strict=True)]
                yield pa.record_batch([b.column("row"), b.column("text"), pa.array([[dict(zip(("ph", "start", "end"), s, strict=True)) for s in f] for f in found], pa.list_(pa.struct([("ph", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))], ["row", "text", "found"])

        d = d.mapInArrow(run, d.schema)
    ordered = F.array_sort("found", lambda a, b: a["start"] - b["start"])
    return d.select(*[F.col("row")[c].alias(c) for c in names], F.col("text").alias(text), ordered.alias("found"))


def redact_values(docs: DataFrame, values: DataFrame, text: str = "text", mask: str = "█", breaks: bool = True) -> DataFrame:
    """docs with `found` and `redacted`: the text with each place replaced by the mask."""
    t, f = F.col(text), F.col("found")
    before = lambda i: F.coalesce(F.get(f, i - 1)["end"], F.lit(0))
    head = F.array_join(F.transform(f, lambda s, i: F.concat(F.substring(t, before(i) + 1, s["start"] - before(i)), F.lit(mask))), "")
    tail = F.substring(t, F.coalesce(F.try_element_at(f, F.lit(-1))["end"], F.lit(0)) + 1, F.length(t))
    return find_values(docs, values, text, breaks).withColumn("redacted", F.concat(head, tail))


def residual_values(docs: DataFrame, values: DataFrame, text: str = "text", breaks: bool = True) -> DataFrame:
    """docs with `left`: the phs whose value still stands in the text (one for each, in order)."""
    return find_values(docs, values, text, breaks).withColumn("left", F.array_sort(F.array_distinct(F.transform("found", lambda s: s["ph"])))).drop("found")
