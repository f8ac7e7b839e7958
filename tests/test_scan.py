import random

import pytest
from pyspark.sql import functions as F

from maskwright.operators.scan import running


@pytest.mark.parametrize("aqe", ["true", "false"])
@pytest.mark.parametrize("parts", [1, 8])
def test_numbers_and_sums_of_keys_over_ranges(spark, aqe, parts):
    random.seed(5)
    rows = [(random.choice(["hot"] * 20 + ["a", "b", None]), i, random.choice([None, 1, 2, 3])) for i in range(2000)]
    random.shuffle(rows)
    spark.conf.set("spark.sql.adaptive.enabled", aqe)
    try:
        got = {(r.k, r.i): (r.n, r.s) for r in running(spark.createDataFrame(rows, "k string, i int, v int").repartition(7), ["k"], [F.col("i").desc()], "n", {"s": "v"}, parts).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    want, state = {}, {}
    for k, i, v in sorted(rows, key=lambda r: -r[1]):
        n, s = state.get(k, (0, 0))
        want[k, i] = state[k] = (n + 1, s + (v or 0))
    assert got == want


def test_one_key_for_all_ties_and_no_rows(spark):
    d = spark.range(3000).select((F.col("id") % 3).alias("x"), "id")
    got = running(d, [], ["x"], "n", parts=6).collect()
    assert sorted(r.n for r in got) == list(range(1, 3001)) and all((r.n - 1) // 1000 == r.x for r in got)
    assert running(d.where("id < 0"), ["x"], ["id"], "n", {"s": F.lit(1)}).collect() == []
