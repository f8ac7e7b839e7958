import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from maskwright.llm import substring_dedup as sd

_WORDS = re.compile("[^\x20\x09-\x0d]+")


def _brute(rows, length):
    words = [_WORDS.findall(t or "") for _, t in rows]
    windows = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        cut = {j for i in range(len(w) - length + 1) if windows[tuple(w[i : i + length])] > 1 for j in range(i, i + length)}
        out.append((d, len(w), len(cut), " ".join(x for j, x in enumerate(w) if j not in cut)))
    return sorted(out, key=str)


def _got(spark, rows, length, parts=3):
    docs = spark.createDataFrame([(*r, 0, "x") for r in rows], "doc_id long, text string, n_words int, kept string").repartition(parts)
    return sorted(((r.row.doc_id, r.n_words, r.n_removed, bytes(r.kept).decode()) for r in sd.dedup(docs, length).collect()), key=str)


@pytest.mark.parametrize("period", sd.COVERS)
def test_any_two_places_reach_the_cover_together(period):
    cover = set(sd.COVERS[period])
    assert all(any((a + k) % period in cover and (b + k) % period in cover for k in range(period)) for a in range(period) for b in range(period))
    assert sd.period_for(sd.LENGTH) == 21


@pytest.mark.parametrize("length", [1, 5, 12, 35])
def test_equals_brute_force(spark, length):
    random.seed(length)
    word = lambda: random.choice("abéc") * random.randint(1, 2)
    text = lambda n: "".join(word() + random.choice([" ", "\n", "\t ", " "]) for _ in range(n))
    shared = [text(length + k) for k in (0, 1, 30)]
    rows = [(i, text(random.randint(0, 90)) + " " + random.choice(shared) + " " + text(random.randint(0, 60))) for i in range(40)]
    rows += [(50, None), (51, ""), (52, " \n"), (53, shared[0]), (53, shared[0]), (None, shared[1]), (None, "x"), (54, "only once here"), (55, text(3000))]
    assert _got(spark, rows, length) == _brute(rows, length)


def test_a_group_in_many_batches_and_long_words(spark, monkeypatch):
    monkeypatch.setattr(sd, "FLUSH_BYTES", 1)
    random.seed(3)
    unlike = lambda n: " ".join(str(random.random()) for _ in range(n))
    passage, long = unlike(40), "w" * (sd._SPAN + 5)
    rows = [(i, f"{unlike(i % 25)} {passage} {unlike(5)}") for i in range(60)] + [(100, f"{long} {unlike(40)}"), (101, f"a {long} b"), (102, f"{unlike(300_000)} {passage}")]
    assert _got(spark, rows, 35, 7) == _brute(rows, 35)


def test_hashes_of_pieces_equal_those_of_the_whole():
    random.seed(1)
    texts = [" ".join("".join(random.choice("xyz") for _ in range(random.randint(1, 9))) for _ in range(n)).encode() for n in (0, 3, 400_000, 1, 20, 2)]
    for at, counts, (a, b) in sd.grouped_words(texts, 2):
        want = [w for t in texts[at : at + counts.size] for w in t.split()]
        assert counts.tolist() == [len(t.split()) for t in texts[at : at + counts.size]] and a.size == b.size == len(want)
        known = {}
        assert all(known.setdefault(w, (x, y)) == (x, y) for w, x, y in zip(want, a.tolist(), b.tolist(), strict=True))
        assert len(set(known.values())) == len(known)
    keys = sd.window_keys(np.arange(2_000_000, dtype=np.uint64) % np.uint64(7), 14)
    assert keys.size == 1_999_987 and (keys[7:] == keys[:-7]).all() and np.unique(keys[:7]).size == 7


def test_no_rows_and_ids_of_another_type(spark):
    assert _got(spark, [], 35) == []
    with pytest.raises(TypeError):
        sd.dedup(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_query_and_its_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    got = sorted(map(tuple, sd.op11_substring_dedup(spark, sf).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert got == sorted(con.execute(sd.OP11_SQL).fetchall())
    assert sum(r[2] for r in got) > 0 and all(r[3] != hashlib.sha256(b"").hexdigest() for r in got if r[1] > r[2])
