"""Label queries on documents without words, against their SQL."""

import duckdb
import pytest

from maskwright.plans import QUERIES, SQL

TEXTS = ["one seven77 abcde", "", None, " \t\n\f\r ", "\x0b", "abcd\x0befghij five5 \x0b", "\u00a0 \u2003x\u0085y", " a ", "\x1c \x00b"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("wordless"))
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1).write.parquet(f"{d}/documents.parquet")
    return d


@pytest.mark.parametrize("name", ["align_words", "normalize_labels", "span_to_bio", "bio_to_spans", "canonical_offsets", "token_entity_range", "bio_islands", "count_by_label"])
def test_query_gives_the_rows_of_its_sql(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    key = lambda r: tuple(map(repr, r))
    assert sorted(map(tuple, QUERIES[name](spark, folder).collect()), key=key) == sorted(con.execute(SQL[name]).fetchall(), key=key)
