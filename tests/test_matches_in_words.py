"""Matches inside longer words: the rewriting queries against their SQL."""

import duckdb
import pytest

from maskwright.operators import fuse, rewrite
from maskwright.plans import QUERIES, SQL

CARD = "4111111111111111"
TEXTS = {1: f'token = "068c{CARD}d35406" ok', 2: f"{CARD} and x{CARD}", 3: "Mail a@b.it+c@d.it, èa@b.it; è.f@b.it", 4: "no value", 5: "", 6: None}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("words"))
    spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").coalesce(1).write.parquet(f"{d}/documents.parquet")
    return d


@pytest.mark.parametrize("name", ["anonymize_text", "anonymize_typeonly", "exclude_tags", "irreversible", "merge_greedy", "ph_assign", "ph_dictionary", "residual_check", "stats_by_label", "segments_count"])
def test_query_gives_the_rows_of_its_sql(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    key = lambda r: tuple(map(repr, r))
    assert sorted(map(tuple, QUERIES[name](spark, folder).collect()), key=key) == sorted(con.execute(SQL[name]).fetchall(), key=key)


def test_long_lists_stay_as_they_are_without_grow(spark):
    d = spark.createDataFrame([("ab" * 8, [("X", i, i + 1, 0.9, False, "regex", 1) for i in range(1, 16, 2)])], f"text string, candidates {fuse.SPANS}")
    short, long = (fuse.merge(d, threshold=n, grow=False).first().entities for n in (400, 0))
    assert short == long and [(e.start, e.end) for e in long] == [(i, i + 1) for i in range(1, 16, 2)]
    assert [(e.start, e.end) for e in fuse.merge(d).first().entities] == [(0, 16)]


def test_by_default_the_whole_word_goes(spark):
    d = spark.createDataFrame([(1, TEXTS[1])], "doc_id int, text string")
    assert rewrite.analyse(d).first().anonymized_text == 'token = "[CREDITCARDNUMBER_1]" ok'
