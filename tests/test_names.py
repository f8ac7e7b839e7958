"""Names in whole texts: the batch form against the SQL and the column form."""

import time

import duckdb
import pytest
from pyspark.sql import functions as F

from maskwright.functions import text
from maskwright.operators import dataset, names
from maskwright.plans import QUERIES, SQL

TEXTS = [
    "Mario Rossi Verdi parla.", "parla. Mario. Verdi Bianchi", "l'Avv Rossi e dell'Avvocato Neri", "Sig Bianchi, Sig. Gialli, Sig.ra Verdi", "MARIO Rossi Mc'Donald Blu A.Mario Elio", "{mario} {A}Ugo{B}Foscolo {città} Città Nuova {parla_1}",
    "'Ada' Lovelace ''.Ugo 'Tognazzi Ada'. Bo", "Ada ×Bo÷Cid Éric Ångström ß élan Élan Vital iPhone Iphone Due", "Ada 1, (2)\n\tBo жЖ Bo 世Ada Cid", "gialli.. l'elio d'.ugo neri' casa.", "A" * 5000 + " Bo " + "Ab." * 3000, "", None,
]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("names"))
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3).write.parquet(f"{d}/documents.parquet")
    return d


def test_query_gives_the_rows_of_its_sql(spark, docs):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{docs}/documents.parquet/*.parquet'")
    got = sorted(map(tuple, QUERIES["stray_names_found"](spark, docs).collect()))
    assert got == sorted(con.execute(SQL["stray_names_found"]).fetchall()) and (0, "Mario", "Rossi") in got  # mario stands in lower case in a slot alone


def test_no_word_is_taken_apart_in_the_plan(spark, docs):
    plan = QUERIES["stray_names_found"](spark, docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp" not in plan.lower() and "transform(" not in plan


def test_batches_find_what_the_column_form_finds(spark):
    d = spark.createDataFrame(list(enumerate(TEXTS)), "k int, t string")
    column = d.select("k", F.inline(text.name_pairs(F.col("t"))))
    batches = names.name_rows(d, "k", "t")
    assert batches.schema == column.schema and sorted(map(repr, batches.collect())) == sorted(map(repr, column.collect())) != []


def test_common_words_are_counted_by_text(spark):
    d = spark.createDataFrame([("casa casa. l'casa iPhone",), ("Casa casa {solo} iphone",), ("solo Solo",), (None,)], "text string")
    words = lambda n: sorted(r.word for r in dataset.common_words(d, least=n).collect())
    assert words(1) == ["casa", "iphone", "solo"] and words(2) == ["casa", "iphone"] and words(3) == []
    handed = names.small_words(d.coalesce(1), "text", held=2).collect()
    assert {r.word for r in handed} == {"casa", "iphone", "solo"} and len(handed) > 3


def test_long_runs_are_read_once():
    began = time.time()
    assert [sum(1 for _ in names.pairs_of(t)) for t in ("A" * 500_000, "A." * 250_000, "A'" * 250_000, "Ada " + "1" * 500_000 + " Bob", "Ada " + "a." * 250_000)] == [0, 0, 0, 1, 0]
    assert time.time() - began < 20
