import datetime
import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from maskwright.operators import dataset, metrics
from maskwright.operators.quantiles import ordered_key, quantiles


def _linear(values, p):
    v = sorted(values)
    i = (len(v) - 1) * p
    lo = int(i)
    return v[lo] * (1 - (i - lo)) + v[min(lo + 1, len(v) - 1)] * (i - lo)


def test_keys_order_as_values_do(spark):
    random.seed(1)
    x = [0.0, -0.0, 5e-324, -5e-324, 2.0**-1022, 2.0**-1022 * (1 - 2**-52), 1.7976931348623157e308, -1.7976931348623157e308, 1.0, 1 - 2**-53, 1 + 2**-52]
    x += [random.choice([-1, 1]) * random.random() * 10.0 ** random.randint(-320, 300) for _ in range(3000)] + [math.ldexp(1, e) for e in range(-1074, 1024)]
    got = spark.createDataFrame([(v,) for v in x], "x double").select("x", ordered_key(F.col("x"), T.DoubleType()).alias("k")).collect()
    by = sorted(got, key=lambda r: r.k)
    assert [r.x for r in by] == sorted(x) and all((a.k == b.k) == (a.x == b.x) for a, b in zip(by, by[1:]))


@pytest.mark.parametrize("aqe", ["true", "false"])
def test_quantiles_equal_the_formula(spark, aqe):
    random.seed(2)
    rows = [(random.choice(["hot"] * 30 + ["a", None]), random.choice([random.gauss(0, 1e3), random.expovariate(1e-9), -1.5, None])) for _ in range(4000)] + [("one", 7.0), ("none", None)]
    probs = [0.0, 0.05, 0.5, 0.95, 0.999, 1.0]
    spark.conf.set("spark.sql.adaptive.enabled", aqe)
    try:
        got = {r.g: (r.n, r.quantiles) for r in quantiles(spark.createDataFrame(rows, "g string, v double").repartition(8), "v", ["g"], probs).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    groups = {g: [v for h, v in rows if h == g and v is not None] for g, _ in rows}
    assert got == {g: (len(v), [_linear(v, p) for p in probs]) for g, v in groups.items() if v}


@pytest.mark.parametrize("sorted_values", [0, 150, 10**6])
def test_sorted_groups_and_histograms_agree(spark, sorted_values):
    random.seed(3)
    rows = [(random.choice(["hot"] * 30 + ["a", None]), random.choice([random.gauss(0, 1e3), -0.0, None])) for _ in range(3000)]
    probs = [0.0, 0.1, 0.5, 0.999]
    got = {r.g: (r.n, r.quantiles) for r in quantiles(spark.createDataFrame(rows, "g string, v double"), "v", ["g"], probs, sorted_values).collect()}
    groups = {g: [v for h, v in rows if h == g and v is not None] for g, _ in rows}
    assert got == {g: (len(v), [_linear(v, p) for p in probs]) for g, v in groups.items()}


def test_small_groups_take_one_sort(spark, monkeypatch):
    monkeypatch.setattr("maskwright.operators.quantiles._refined", None)
    d = spark.createDataFrame([(i % 50, float(i)) for i in range(1000)], "g int, v double")
    assert {r.g: r.quantiles for r in quantiles(d, "v", ["g"], [0.0, 1.0]).collect()} == {g: [float(g), 950.0 + g] for g in range(50)}


def test_other_types_and_odd_values(spark):
    d = spark.createDataFrame([(i, datetime.date(2020, 1, 1 + i % 3), f"{i}.25") for i in range(101)], "i int, d date, s string").withColumn("m", F.col("s").cast("decimal(10,2)"))
    assert quantiles(d, "i", [], [0.25]).first().quantiles == [25.0] and quantiles(d, "m", [], [0.5]).first().quantiles == [50.25]
    assert quantiles(d, "d", [], [0.0, 1.0]).first().quantiles == [datetime.date(2020, 1, 1), datetime.date(2020, 1, 3)]
    assert quantiles(d.where("i < 0"), "i", [], [0.5]).collect() == []
    with pytest.raises(Exception, match="finite"):
        quantiles(spark.createDataFrame([(float("inf"),)], "x double"), "x", [], [0.5]).collect()
    with pytest.raises(TypeError):
        quantiles(d, "s", [], [0.5])


def test_length_report(spark):
    r = metrics.length_report(spark.createDataFrame([(n,) for n in range(1, 301)], "n int"), "n").first()
    assert (r.n, r.longest, r.p50, r.p99, r.over_128, r.over_512) == (300, 300, 150, 297, round(100 * 172 / 300, 6), 0.0)


@pytest.mark.parametrize("aqe", ["true", "false"])
def test_round_robin_over_partitions(spark, aqe):
    rows = spark.range(20_000).select((F.col("id") * 7919 % 20_011).alias("k")).repartition(8)
    pool = spark.range(37).select((F.col("id") * 3).alias("p"))
    for k in ("adaptive.enabled", "adaptive.coalescePartitions.enabled"):
        spark.conf.set(f"spark.sql.{k}", aqe)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        got = sorted((r.k, r.p) for r in dataset.round_robin(rows, pool, "k", "p").collect())
        large = sorted((r.k, r.p) for r in dataset.round_robin(rows, pool, "k", "p", most=10).collect())
    finally:
        for k in ("adaptive.enabled", "adaptive.coalescePartitions.enabled"):
            spark.conf.unset(f"spark.sql.{k}")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == large == [(k, i % 37 * 3) for i, k in enumerate(sorted(i * 7919 % 20_011 for i in range(20_000)))]


def test_cumulative_is_drawn_on_to_the_last_day(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("b", 9, "z"), (None, 2, "w")], "g string, t int, other string")
    got = sorted((r.g or "", r.t, r.other or "", r.cumulative) for r in metrics.cumulative(rows, "t", "g", until=F.lit(9)).collect())
    assert got == [("", 2, "w", 1), ("", 9, "", 1), ("a", 1, "x", 1), ("a", 3, "y", 2), ("a", 9, "", 2), ("b", 9, "z", 1)]
