"""merge_coalesce against its SQL: halves, and spans equal in start and stop."""

import duckdb

from maskwright.plans import QUERIES, SQL


def test_halves_and_equal_spans(spark, tmp_path):
    lines = [(k, k * 7 % 60 + 3 * (i // 2), 2.5 + 5 * (k % 3) + 2.5 * i) for k in range(40) for i in range(k % 5 + 1)]
    spark.createDataFrame([*lines, *[(99, 57, 11.0), (99, 57, 11.0), (99, 17, 45.0)]], "l_orderkey long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    got = sorted(map(tuple, QUERIES["merge_coalesce"](spark, str(tmp_path)).collect()))
    # both windows in one order, whichever it is among equals: the SQL leaves it open
    for tie in ("rowid", "rowid DESC"):
        sql = SQL["merge_coalesce"].replace("SELECT l_orderkey AS doc_id,", "SELECT row_number() OVER () AS rowid, l_orderkey AS doc_id,").replace("ORDER BY start, stop DESC", f"ORDER BY start, stop DESC, {tie}")
        assert got == sorted(con.execute(sql).fetchall())
    assert (99, 17, 27) in got and (99, 57, 60) in got
