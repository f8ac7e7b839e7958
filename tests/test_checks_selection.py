import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from maskwright.functions import text
from maskwright.operators import bio, dataset, metrics, selection
from maskwright.sources import records


def test_checks_hold_whatever_columns_are_asked_for(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(json.dumps({"tokens": ["a", "b"], "bio_labels": ["O"]}) + "\n")
    strict = records.read_jsonl(spark, str(tmp_path / "a.jsonl"), mode="strict")
    for ask in (lambda d: d.count(), lambda d: d.select("labels").collect()):
        with pytest.raises(PySparkException):
            ask(strict)
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(2,)], "k int")
    with pytest.raises(PySparkException):
        dataset.require_disjoint(a, b, "k").select("v").collect()
    assert dataset.require_disjoint(a, b.where("k > 2"), "k").select("v").count() == 2
    one, two = spark.createDataFrame([(1, 5), (2, 6)], "doc_id int, n int"), spark.createDataFrame([(1, 5)], "doc_id int, n int")
    with pytest.raises(PySparkException):
        metrics.paired_checked(one, two, ("n",)).select("n").collect()
    logits = spark.createDataFrame([(1, 0, 0, 3, False, 0, 1.0), (1, 1, 2, 4, False, 0, 1.0)], "doc_id int, window int, start int, end int, special boolean, label_id int, logit double")
    with pytest.raises(PySparkException):
        bio.merged_windows(logits).select("start").collect()


def test_shapes_and_sources(spark, tmp_path):
    rows = spark.createDataFrame([("it", ["a"], ["O"]), (None, ["a"], ["O", "O"])], "language string, tokens array<string>, labels array<string>")
    assert tuple(records.shape(rows, ["language"], ("tokens", "labels")).first()) == (2, 1, 1)
    with pytest.raises(ValueError):
        records.require_shape(rows, 2, ["language"])
    with pytest.raises(ValueError):
        records.shape(rows, ["lost"])
    rows.write.parquet(str(tmp_path / "p.parquet"))
    with pytest.raises(ValueError):
        records.read_parquet(spark, str(tmp_path / "p.parquet"), ["language", "lost"])
    assert records.read_splits(spark, {"train": str(tmp_path / "p.parquet")}, columns=["language"])["train"].columns == ["language"]
    (tmp_path / "m").mkdir()
    for name in "abc":
        (tmp_path / "m" / name).write_text(name)
    old = spark.createDataFrame(records.manifest(spark, str(tmp_path / "m")).collect())
    assert records.verify_sources(spark, str(tmp_path / "m"), old).count() == 0
    (tmp_path / "m" / "a").write_text("z")
    (tmp_path / "m" / "b").unlink()
    (tmp_path / "m" / "d").write_text("new")
    assert {r.path[-1]: r.state for r in records.verify_sources(spark, str(tmp_path / "m"), old).collect()} == {"a": "changed", "b": "missing", "d": "new"}


def test_seeded_limit_and_publishing(spark, tmp_path):
    lines = [json.dumps({"tokens": [str(i)], "bio_labels": ["O"]}) for i in range(30)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    (tmp_path / "b.jsonl").write_text("\n".join(lines[::-1]))
    got = [[r.tokens[0] for r in records.read_jsonl(spark, str(tmp_path / f"{x}.jsonl"), limit=7, seed=s).collect()] for x, s in (("a", 1), ("b", 1), ("a", 2))]
    assert got[0] == got[1] != got[2] and len(got[0]) == 7
    d = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    (tmp_path / "out.staging").mkdir()
    assert records.publish(d, str(tmp_path / "out")) and not records.publish(d.orderBy(F.desc("a")), str(tmp_path / "out"))
    with pytest.raises(ValueError):
        records.publish(d.limit(1), str(tmp_path / "out"))


def test_templates(spark):
    t = "```text\nTribunale Ordinario, Codice Civile.\\nIl Sig {FULLNAME} paga {AMOUNT}\n```"
    r = spark.range(1).select(text.cleaned_template(F.lit(t)).alias("t")).first().t
    assert r == "Tribunale Ordinario, Codice Civile.\nIl Sig {FULLNAME} paga {AMOUNT}"
    cases = {"parla Mario Verdi": 1, "Sig Bianchi": 1, "Sig. Bianchi": 0, "MARIO Verdi": 0, "l'Avv Rossi": 0, "Gazzetta Ufficiale": 0, "Mario. Verdi": 0, "{A} Mario {B} Verdi": 1}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", F.size(text.stray_names(F.col("t"), ("gazzetta", "ufficiale"))).alias("n")).collect()
    assert {x.t: x.n for x in got} == cases
    corpus = spark.createDataFrame([("la gazzetta ufficiale dell'avvocato",), ("Un Tribunale; MARIO verdi?",), (None,)], "text string")
    rows = spark.createDataFrame([(1, "Gazzetta Ufficiale, Mario Rossi"), (2, "l'Avvocato Tribunale"), (3, "Bruno Verdi"), (4, None)], "id int, t string")
    assert sorted(map(tuple, dataset.stray_name_rows(rows, "id", "t", dataset.common_words(corpus)).collect())) == [(1, "Mario", "Rossi")]
    error = spark.createDataFrame([("no slots here",), ("a {FULLNAME} b",), ("a {OTHER} b",)], "t string").select(dataset.template_error(F.col("t"), ["FULLNAME"])).collect()
    assert [e[0] for e in error] == ["no slots", None, "unknown slots: OTHER"]


def test_selection_keeps_skeletons_apart_and_fails_when_short(spark):
    rows = spark.createDataFrame([(str(i), f"s{i % 6}", "ab"[i % 2], ["X"] if i % 3 else [], "short") for i in range(24)], "record_id string, skeleton string, variant string, tags array<string>, length_bin string")
    picks = selection.Picks(rows, spark.createDataFrame([("99", "s0")], "record_id string, skeleton string"))
    selection.balanced(picks, 3, ("a", "b"), "z")
    selection.replay(picks, 2, 1, ["X"], "z")
    made = picks.frame().collect()
    assert len(made) == 5 and len({r.skeleton for r in made}) == 5 and "s0" not in {r.skeleton for r in made}
    again = selection.Picks(rows.repartition(5), spark.createDataFrame([("99", "s0")], "record_id string, skeleton string"))
    selection.balanced(again, 3, ("a", "b"), "z")
    assert {tuple(r) for r in again.frame().collect()} == {tuple(r) for r in made if r.reason.startswith("hard-negative")} and again.frame().count() == 3
    with pytest.raises(ValueError):
        picks.take(1, "z", "more", "X")
    with pytest.raises(ValueError):
        selection.replay(picks, 1, 2, ["X"], "z")


def test_small_reports(spark):
    d = spark.createDataFrame([("CF", 0.5, 3), ("VERYLONGNAME", None, 1)], "type string, f1 double, n int")
    assert metrics.report_text(d.orderBy("type"), ["type", "f1"], 6) == "type   f1\nCF     0.5000\nVERYLO"
    assert metrics.latest(["v1.9", "v1.10", "v0.99"]) == "v1.10" and metrics.latest([]) is None
