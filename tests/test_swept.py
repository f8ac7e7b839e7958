"""Values that a detector knows from one place and misses at another."""

import duckdb
from pyspark.sql import functions as F

from maskwright.operators import rewrite
from maskwright.plans import QUERIES, SQL

CARD = "4111111111111111"
TEXTS = {
    1: f"{CARD}, but {CARD} 5 of them", 2: "4111 1111 1111 1111 and 4111 1111\n1111  1111", 3: f"x{CARD}y; 9{CARD}000", 4: "no value", 5: None,
    8: f"_2{CARD}2{CARD} 2{CARD[:3]} x{CARD}y", 9: f"{CARD}_ 4{CARD} _5023681828137 {CARD}{CARD}{CARD} {CARD}_",
    6: "see exa.com, not exa.c-\nom", 7: f"{CARD} and 5500005555555559, 5500005555555559 {CARD} 1",
}


def test_nothing_is_left_as_in_the_sql(spark, tmp_path):
    spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, QUERIES["residual_check"](spark, str(tmp_path)).collect())) == sorted(con.execute(SQL["residual_check"]).fetchall())


def test_what_is_found_goes_and_the_rest_stays(spark):
    d = spark.createDataFrame([(i, t) for i, t in TEXTS.items()], "i int, text string")
    d = rewrite.analyse(d, labels=["URL", "CREDITCARDNUMBER"], grouped=False, grow=False).withColumn("cut", rewrite.cut_sides(F.col("entities"), F.col("text")))
    s = d.select("i", rewrite.residual(F.col("anonymized_text"), F.col("mapping"), F.col("cut")).alias("was"), rewrite.swept(F.col("anonymized_text"), F.col("mapping"), F.col("cut")).alias("s"))
    got = {r.i: r for r in s.collect()}
    assert {i for i, r in got.items() if r.was} == {1, 2, 3, 6, 7, 8, 9} and not any(r.s.left for r in got.values())
    c = "[CREDITCARDNUMBER_1]"
    assert [got[i].s.text for i in range(1, 7)] == [f"{c}, but {c} 5 of them", f"{c} and {c}", f"x{c}y; 9{c}000", "no value", None, "see [URL_1], not [URL_1]"]


def test_a_value_freed_by_its_neighbour_goes_too(spark):
    row = spark.createDataFrame([("longerab longer ab", {"[A_1]": "longer", "[B_1]": "ab", "[C$_1]": "1"})], "t string, m map<string,string>")
    cut = F.expr("map('[A_1]', named_struct('left', false, 'right', false), '[B_1]', named_struct('left', true, 'right', false), '[C$_1]', named_struct('left', false, 'right', false))")
    s = row.select(rewrite.swept(F.col("t"), F.col("m"), cut).alias("s")).first().s
    assert s.text == "[A_1][B_1] [A_1] [B_1]" and s.left == []
