"""Offsets of joined tokens: one running sum for a whole batch, and no shuffle of tokens."""

from pyspark.sql import functions as F

from maskwright.operators import bio, sweep
from maskwright.plans import QUERIES


def test_offsets_of_lists_of_any_length(spark):
    lists = [["ab", "", "è😀"], [], None, ["x"] * 1000, ["one"]]
    rows = spark.createDataFrame(list(enumerate(lists)), "i int, t array<string>").select("i", bio.canonical_offsets(F.col("t")).alias("o")).collect()
    for i, o in rows:
        if lists[i] is None:
            assert o is None
            continue
        at, want = 0, []
        for t in lists[i]:
            want.append((at, at + len(t)))
            at += len(t) + 1
        assert [tuple(x) for x in o] == want


def test_tokens_are_neither_joined_nor_exploded(spark, tmp_path):
    spark.createDataFrame([(31, "a bcd " * 40), (2, "x"), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    d = QUERIES["token_entity_range"](spark, str(tmp_path))
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
    assert {r.doc_id: r.n_inside for r in d.collect()} == {31: 13}  # from character 1 to 41: thirteen whole words


def test_labels_cost_the_same_for_each_token(spark, tmp_path):
    """No sums over the tokens before and no pattern for a token's label."""
    spark.createDataFrame([(1, "a bcd")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("span_to_bio", "align_words"):
        plan = QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
        assert "aggregate(" not in plan and "regexp_replace" not in plan


def test_labels_of_a_batch_are_its_entities(spark):
    kind = "i int, tokens array<struct<start:int,end:int>>, entities array<struct<label:string,start:int,end:int>>"
    t = [(0, 2), (3, 5), (6, 9)]
    rows = [(1, t, [("A", 0, 5), ("B", 6, 9)]), (2, [], [("C", 0, 1)]), (3, t, None), (4, t, [("B", 3, 9), ("A", 0, 2)]), (5, None, None)]
    d = spark.createDataFrame(rows, kind).coalesce(1)
    got = {r.i: r.labels for r in sweep.label_tokens(d, keep=["i"]).collect()}
    assert got == {1: ["B-A", "I-A", "B-B"], 2: [], 3: ["O"] * 3, 4: ["B-A", "B-B", "I-B"], 5: []}
