import random

from pyspark.sql import functions as F

from maskwright.operators import sweep

KIND = "array<struct<type:string,start:int,end:int>>"


def _brute(text, gold, pred):
    text, gold, pred = text or "", gold or [], pred or []
    spots = lambda s, e: {i for i in range(max(s, 0), min(e, len(text))) if text[i].isalnum()}
    every = lambda spans, t=None: {i for k, s, e in spans if t is None or k == t for i in spots(s, e)}
    g, p = every(gold), every(pred)
    right = {i for t in {k for k, _, _ in gold} for i in every(gold, t) & every(pred, t)}
    full = sum(not spots(s, e) - p for _, s, e in gold)
    return len(g), len(g & p), len(g - p), len(right), len(g & p) - len(right), len(p), len(p - g), len(gold), full, full == len(gold)


def test_coverage_equals_sets_of_positions(spark):
    random.seed(4)
    spans = lambda n: [(random.choice("ABC"), s := random.randint(0, n), min(n, s + random.randint(0, 9))) for _ in range(random.randint(0, 6))]
    rows = []
    for i in range(300):
        n = random.choice([0, 0, 1, 5, 40])
        rows.append((i, "".join(random.choice("ab1 .-é中𝟘😀") for _ in range(n)), spans(n), spans(n)))
    rows += [(400, None, [("A", 0, 3)], None), (401, "abc", None, [("A", 0, 99)]), (402, "abc", [("A", 0, 3), ("A", 0, 3), ("B", 2, 2)], [("A", 0, 1), ("B", 1, 3)])]
    got = sweep.coverage(spark.createDataFrame(rows, f"doc_id int, text string, gold {KIND}, pred {KIND}").repartition(3)).collect()
    assert sorted(map(tuple, got)) == sorted((i, *_brute(t, g, p)) for i, t, g, p in rows)


def test_labels_of_tokens_equal_the_definition(spark):
    random.seed(6)
    rows = []
    for i in range(200):
        ends = sorted(random.sample(range(60), 2 * random.randint(0, 12)))
        tokens = list(zip(ends[::2], ends[1::2], strict=True))
        rows.append((i, tokens, [(random.choice("XY"), s := random.randint(0, 55), s + random.randint(0, 30)) for _ in range(random.randint(0, 5))]))
    rows += [(900, None, [("X", 0, 1)]), (901, [(0, 1)], None)]
    d = spark.createDataFrame(rows, "id int, t array<struct<start:int,end:int>>, e array<struct<label:string,start:int,end:int>>")
    for first in (False, True):
        def one(i, tokens, entities):
            inside = next((e for e in entities if tokens[i][0] >= e[1] and tokens[i][1] <= e[2]), None)
            if inside is None:
                return "O"
            begins = not any(s >= inside[1] and e <= inside[2] for s, e in tokens[:i]) if first else tokens[i][0] == inside[1]
            return ("B-" if begins else "I-") + inside[0]

        got = {r[0]: r[1] for r in sweep.label_tokens(d, "t", "e", first, keep=["id"]).collect()}
        assert got == {i: [one(k, t or [], e or []) for k in range(len(t or []))] for i, t, e in rows}


def test_many_spans_on_a_long_text_take_no_product(spark):
    n = 40_000
    d = spark.range(1).select(F.lit(1).alias("doc_id"), F.expr(f"repeat('ab ', {n})").alias("text"), F.expr(f"transform(sequence(0, {n - 1}), i -> named_struct('type', 'A', 'start', i * 3, 'end', i * 3 + 2))").alias("gold"))
    r = sweep.coverage(d.withColumn("pred", F.col("gold"))).first()
    assert (r.sensitive, r.type_correct, r.entities_full) == (2 * n, 2 * n, n)
