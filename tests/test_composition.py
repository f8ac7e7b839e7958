import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from maskwright.operators import dataset
from maskwright.operators import synthesis as sy

SPANS = "array<struct<label:string,start:int,end:int>>"


def _apportioned(rows, n):
    """Rows dealt at one rising level: every template gives level * weight, full ones stop; then the largest remainders."""
    rows = [(k, w, c) for k, w, c in rows if w > 0 and c > 0]
    full, out = set(), {}
    while True:
        rest, left = n - sum(c for k, _, c in rows if k in full), sum(w for k, w, _ in rows if k not in full)
        more = {k for k, w, c in rows if k not in full and left and Fraction(rest * w, left) >= c}
        if not more:
            break
        full |= more
    share = {k: Fraction(rest * w, left) for k, w, _ in rows if k not in full} if left else {}
    out = {k: c for k, _, c in rows if k in full} | {k: int(s) for k, s in share.items()}
    for k in sorted(share, key=lambda k: (int(share[k]) - share[k], k))[: max(0, rest - sum(int(s) for s in share.values())) if left else 0]:
        out[k] += 1
    return out


@pytest.mark.parametrize("n", [0, 1, 37, 500, 100_000])
def test_planned_counts(spark, n):
    random.seed(n)
    rows = [(k, random.choice([0, 1, 2, 5, 64]), random.choice([0, 3, 10, 50, 400])) for k in range(60)]
    got = {r.k: r.planned for r in dataset.apportioned(spark.createDataFrame(rows, "k int, weight int, capacity int").repartition(4), "k", n).collect()}
    want = _apportioned(rows, n)
    assert got == {k: want.get(k, 0) for k, _, _ in rows}
    assert sum(got.values()) == min(n, sum(c for _, w, c in rows if w))


def test_capacity_of_templates(spark):
    rows = [("t1", "a")] * 7 + [("t1", "b")] * 2 + [("t2", "c")] * 3 + [("t2", "d")] * 9
    got = {r.t: tuple(r)[1:] for r in dataset.capacity_report(spark.createDataFrame(rows, "t string, s string"), "t", "s", 3).collect()}
    assert got == {"t1": (9, 2, 5, 4, 1, False), "t2": (12, 2, 6, 6, 2, True)}


def test_weighted_choice_meets_each_row_once(spark):
    choices = spark.createDataFrame([(i, float(w)) for i, w in enumerate([0, 1, 0.001, 50, 3, 0, 7])], "id int, weight double")
    got = dataset.weighted_choice(spark.range(5000).withColumnRenamed("id", "k"), choices, "z", "k").collect()
    assert sorted(r.k for r in got) == list(range(5000)) and {r.id for r in got} <= {1, 2, 3, 4, 6}
    assert 0.75 < sum(r.id == 3 for r in got) / 5000 < 0.88


def test_insertions_move_spans(spark):
    random.seed(9)
    rows = []
    for i in range(150):
        text = "".join(random.choice("ab .é") for _ in range(random.randint(0, 30)))
        ends = sorted(random.sample(range(len(text) + 1), 2 * min(2, len(text) // 4)))
        entities = [("X", a, b) for a, b in zip(ends[::2], ends[1::2], strict=True)]
        spots = [p for p in range(len(text) + 1) if not any(a < p < b for _, a, b in entities)]
        ins = [(random.choice(spots), "N" * random.randint(0, 4) + str(k), [("Y", 0, 1)]) for k in range(random.randint(0, 4))]
        rows.append((i, text, entities, ins))
    d = spark.createDataFrame(rows, f"id int, t string, e {SPANS}, ins array<struct<at:int,text:string,entities:{SPANS}>>")
    got = {r.id: r.r for r in d.select("id", dataset.with_insertions(F.col("t"), F.col("e"), F.col("ins")).alias("r")).collect()}
    for i, text, entities, ins in rows:
        want, spans, at = "", [], 0
        for p, t, es in sorted(ins, key=lambda x: x[0]):
            want += text[at:p]
            spans += [("Y", len(want) + a, len(want) + b) for _, a, b in es]
            want, at = want + t, p
        want += text[at:]
        assert got[i].text == want
        values = sorted((lab, want[a:b]) for lab, a, b in spans) + sorted((lab, text[a:b]) for lab, a, b in entities)
        assert sorted(values) == sorted((e.label, got[i].text[e.start : e.end]) for e in got[i].entities)
    with pytest.raises(Exception, match="cuts an entity"):
        spark.createDataFrame([("abc", [("X", 0, 3)], [(1, "n", [])])], f"t string, e {SPANS}, ins array<struct<at:int,text:string,entities:{SPANS}>>").select(dataset.with_insertions(F.col("t"), F.col("e"), F.col("ins"))).collect()


def test_validation_rows(spark):
    pool = spark.createDataFrame([(i, f"Numero {i}. Il sig. Rossi scrive. Fine", [("FULLNAME", 17 + len(str(i)), 22 + len(str(i)))] if i % 2 else []) for i in range(7)] + [(7, "", [])], f"doc_id int, text string, entities {SPANS}")
    snippets = spark.createDataFrame([("CF", "C.F. {CF}"), ("CF", "codice fiscale {CF}"), ("CATASTO", "immobile al {CATASTO}"), ("PIVA", "P.IVA {PIVA}")], "tag string, snippet string")
    rows = sy.injected_rows(pool, "doc_id", snippets, 20, 4, several=2).collect()
    assert {t: sum(r.tag == t for r in rows) for t in ("CF", "CATASTO", "PIVA")} == dict.fromkeys(("CF", "CATASTO", "PIVA"), 20)
    for r in rows:
        values = [(e.label, r.text[e.start : e.end]) for e in r.entities]
        assert sum(lab == r.tag for lab, _ in values) == (6 if r.tag == "CATASTO" else 2)
        assert all(v == "Rossi" for lab, v in values if lab == "FULLNAME") and all(len(v) in (16, 11) for lab, v in values if lab in ("CF", "PIVA"))
    assert len({r.doc_id for r in rows}) == 8
