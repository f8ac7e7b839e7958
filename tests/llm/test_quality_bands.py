import random

from maskwright.llm import quality_rules


def _measures(spark, rows):
    return spark.createDataFrame(rows, "lang string, log_perplexity double, base_failed boolean")


def test_each_side_of_a_band_has_the_spread_of_its_language(spark):
    below, above = [0.01 * i for i in range(1, 8)], [0.002 * i for i in range(1, 8)]
    rows = [("aa", 2.0 + x, False) for x in (0.0, *(-y for y in below), *above)]
    rows += [("bb", 1.0, False)] * 50 + [("bb", 1.1, False), ("bb", 1.2, False), ("bb", 1.3, False), ("cc", 3.0, False), ("cc", 9.0, True)]
    got = {r.lang: (r.low, r.high) for r in quality_rules.bands(_measures(spark, rows)).collect()}
    near = lambda x, y: abs(x - y) < 1e-9
    assert near(got["aa"][0], 2.0 - 8 * 0.04) and near(got["aa"][1], 2.0 + 8 * 0.008)
    assert near(got["bb"][0], 1.0 - quality_rules.LEAST) and near(got["bb"][1], 1.0 + 8 * 0.2)  # copies don't narrow the other side
    assert got["cc"][0] < 3.0 < got["cc"][1] < 3.1


def test_symbol_junk_is_outside(spark):
    rng = random.Random(8)
    vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(2000)]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(1200)), "aa") for i in range(200)]
    rows += [(1000 + i, " ".join(rng.choice(vocab) + rng.choice(["%%%", "###", "&&&", ""]) for _ in range(1200)), "aa") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.kept for r in quality_rules.quality(docs).collect()}
    assert all(got[i] for i in range(200)) and not any(got[1000 + i] for i in range(12))
