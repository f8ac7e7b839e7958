"""Words and name pairs of whole texts, by batches: what text.name_pairs() finds, for corpora.

A text is one pass of a byte table (its words) or of one pattern (its capitals); each word is only put into a set.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import TITLES, WORD

#: how many different words a task holds before it hands them on
HELD = 500_000

_LETTERS = "A-Za-zÀ-ÿ"
_UPPER = "A-ZÀ-ÖØ-Þ"
_WORD = re.compile(WORD)
_CAPITAL_TITLES = frozenset(t.capitalize() for t in TITLES)
_IN_WORD = re.compile(f"[{_LETTERS}'.]")
#: all that can't stand in a word becomes a space (letters of words are all in Latin-1; encoding makes others a question mark)
_SPACED = bytes(c if _IN_WORD.match(chr(c)) else 32 for c in range(256))
#: the capitalised rest of a word (titles have a capital too); group 1 is the next word if the two can be a pair. What is no pair is matched too, so that no run of letters is read twice.
_CAPITALS = re.compile(rf"[{_UPPER}][{_LETTERS}.]*+(?:(?!')(?<!\.)[^{_LETTERS}]++(?=((?:[{_LETTERS}'.]*['.])?[{_UPPER}][{_LETTERS}'.]*))|)")
#: in words between spaces: a bare word that begins with a small letter, full stops at its end included
_SMALL = re.compile(rf"(?<=[ '])\.*+([a-zß-öø-ÿ][{_LETTERS}.]*+)(?= )")


def slot(ascii_only: bool = False) -> re.Pattern:
    return re.compile(r"\{\w+\}", re.ASCII if ascii_only else 0)


def bare(word: str) -> str:
    """What follows the last apostrophe, without full stops at its ends."""
    return word[word.rfind("'") + 1 :].strip(".")


def _named(x: str) -> bool:
    return x[:1].isupper() and not x.isupper() and x not in _CAPITAL_TITLES


def small(words: set[bytes]) -> set[str]:
    """Bare words in lower case of those words in Latin-1 whose bare words begin with a small letter."""
    return {x.rstrip(".").lower() for x in _SMALL.findall(b" ".join([b"", *words, b""]).decode("latin-1"))}


def small_words(corpus: DataFrame, text: str, counted: bool = False, ascii_slots: bool = False, held: int = HELD) -> DataFrame:
    """word, n: words that stand in lower case in the texts, slots left out. A word has a row for each `held` words that a task reads; n is in how many of those texts it stands (counted), or 1."""

    def run(batches):
        slots = slot(ascii_slots)
        seen, n = set(), Counter()

        def rows():
            n.update(small(seen))
            return pa.record_batch([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["word", "n"])

        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    t = slots.sub(" ", t) if "{" in t else t
                    words = t.encode("latin-1", "replace").translate(_SPACED).split()
                    n.update(small(set(words))) if counted else seen.update(words)
                    if len(n) + len(seen) >= held:
                        yield rows()
                        seen, n = set(), Counter()
        yield rows()

    return corpus.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "word string, n long")


def pairs_of(text: str):
    """(a, b, first, second) of a text without slots, in order."""
    for m in _CAPITALS.finditer(text):
        if b := m[1]:
            start = m.start()  # the word may begin before its capital
            while start and _IN_WORD.match(text, start - 1):
                start -= 1
            a = _WORD.search(text, start)[0]
            first, second = bare(a), bare(b)
            if _named(second):
                if _named(first):
                    yield a, b, first, second
                elif a in TITLES:
                    yield a, b, None, second


def name_rows(templates: DataFrame, key: str, text: str, ascii_slots: bool = False) -> DataFrame:
    """key, a, b, first, second: a row for each pair of text.name_pairs()."""

    def run(batches):
        slots = slot(ascii_slots)
        for batch in batches:
            at, found = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                if t:
                    for p in pairs_of(slots.sub(" ", t) if "{" in t else t):
                        at.append(i)
                        found.append(p)
            values = [pa.array([p[k] for p in found], pa.string()) for k in range(4)]
            yield pa.record_batch([batch.column(0).take(pa.array(at, pa.int64())), *values], [key, "a", "b", "first", "second"])

    schema = T.StructType([templates.schema[key], *[T.StructField(c, T.StringType()) for c in ("a", "b", "first", "second")]])
    return templates.select(key, F.col(text).cast("string").alias("text")).mapInArrow(run, schema)
