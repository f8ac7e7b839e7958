"""Queries against brute force over texts longer, and counts lower, than the limits they once had."""

import random
from collections import Counter

import pytest

from maskwright.plans import QUERIES

LABEL_QUERIES = ["normalize_labels", "bio_to_spans", "canonical_offsets", "span_to_bio", "token_entity_range", "align_words"]


@pytest.fixture(scope="module")
def long_texts(spark, tmp_path_factory):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdè") for _ in range(rng.randint(1, 12)))
    docs = {i: " ".join(word() for _ in range(n)) for i, n in enumerate((1, 199, 200, 201, 950), 1)}
    d = str(tmp_path_factory.mktemp("long"))
    spark.createDataFrame(list(docs.items()), "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    return d, docs


def plain_labels(words):
    types = [{0: "FULLNAME", 1: "FULLNAME"}.get(len(w) % 5, "PIVA" if len(w) == 8 else None) for w in words]
    return types, ["O" if t is None else ("I-" if i and types[i - 1] == t else "B-") + t for i, t in enumerate(types)]


def plain_spans(labels):
    out = []
    for i, x in enumerate(labels):
        if x.startswith("B-"):
            out.append([x[2:], i, i + 1])
        elif x.startswith("I-"):
            out[-1][2] = i + 1
    return [tuple(x) for x in out]


def plain_offsets(words):
    out, at = [], 0
    for w in words:
        out.append((at, at + len(w)))
        at += len(w) + 1
    return out


def plain(name, doc_id, text):
    words = text.split()
    labels, offsets, a = plain_labels(words)[1], plain_offsets(words), doc_id % 30
    inside = [a <= s and e <= a + 40 for s, e in offsets]
    if name == "normalize_labels":
        return [(doc_id, " ".join(labels))]
    if name == "bio_to_spans":
        return [(doc_id, *x) for x in plain_spans(labels)]
    if name == "canonical_offsets":
        return [(doc_id, i, *x) for i, x in enumerate(offsets, 1)]
    if name == "span_to_bio":
        return [(doc_id, " ".join(("B-CITY" if s == a else "I-CITY") if y else "O" for (s, _), y in zip(offsets, inside, strict=True)))]
    if name == "token_entity_range":
        return [(doc_id, sum(inside))] if any(inside) else []
    return [(doc_id, " ".join(y for x in labels for y in (x, x.replace("B-", "I-"))))]


@pytest.mark.parametrize("name", LABEL_QUERIES)
def test_labels_of_every_word(spark, long_texts, name):
    d, docs = long_texts
    got = sorted(tuple(r) for r in QUERIES[name](spark, d).collect())
    assert got == sorted(x for i, t in docs.items() for x in plain(name, i, t))


def test_every_word_pair_counts(spark, long_texts):
    d, docs = long_texts
    want = Counter(p for t in docs.values() for p in zip(t.split(), t.split()[1:], strict=False))
    assert min(want.values()) < 20
    assert sorted(tuple(r) for r in QUERIES["word_bigrams"](spark, d).collect()) == sorted((*p, n) for p, n in want.items())


def test_novelty_by_whole_texts(spark, tmp_path):
    head = "x" * 60
    docs = [(3, f"{head} one"), (6, "short"), (1, f"{head} two"), (2, f"{head} one"), (4, f"{head}  one"), (5, None), (7, "shor"), (8, head)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    seen = {" ".join(t.split()) for i, t in docs if i % 3 == 0}
    want = sorted(i for i, t in docs if i % 3 and (t is None or " ".join(t.split()) not in seen))
    assert want == [1, 5, 7, 8]
    assert sorted(r.doc_id for r in QUERIES["novel_anti"](spark, str(tmp_path)).collect()) == want
