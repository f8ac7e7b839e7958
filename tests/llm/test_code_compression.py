import hashlib
import math
import random

import pytest

from maskwright.llm import code_compression as cc


def _brute(rows, parts, entries, rounds):
    """(vec_id, code, error, label_error) of the kept rows and the codebooks, by the definition."""
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // parts
    cut = [[[math.floor(256 * x) for x in v[m * w : m * w + w]] for m in range(parts)] for _, v, _ in kept]
    books = [[cut[e][m] for e in range(min(entries, len(kept)))] for m in range(parts)]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [[min(range(len(books[m])), key=lambda e: (dist(c[m], books[m][e]), e)) for m in range(parts)] for c in cut]
    for _ in range(rounds):
        codes = assign()
        for m in range(parts):
            for e in range(len(books[m])):
                mine = [c[m] for c, k in zip(cut, codes, strict=True) if k[m] == e]
                if mine:
                    books[m] = [*books[m][:e], [sum(x) // len(mine) for x in zip(*mine, strict=True)], *books[m][e + 1 :]]
    codes = assign()
    errors = [sum(dist(c[m], books[m][k[m]]) for m in range(parts)) for c, k in zip(cut, codes, strict=True)]
    label = lambda lab: sum(e for e, r in zip(errors, kept, strict=True) if r[2] == lab)
    return sorted(((r[0], bytes(k).hex(), e, label(r[2])) for r, k, e in zip(kept, codes, errors, strict=True)), key=str), books


@pytest.mark.parametrize("rounds", [0, 2, 5])
def test_codes_equal_brute_force(spark, rounds):
    random.seed(rounds)
    near = [[random.gauss(0, 1) for _ in range(8)] for _ in range(4)]
    rows = [(i, [x + random.gauss(0, 0.2) for x in random.choice(near)], random.choice([0, 1, None])) for i in range(150)]
    rows += [(7, rows[3][1], 5), (7, rows[3][1], 5), (None, [0.1] * 8, 2), (200, None, 1), (201, [1.0, None] * 4, 1), (202, [float("nan")] * 8, 1), (-1, [float("-inf")] * 8, 1), (203, [-0.001] * 8, None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, code string, error int").repartition(5)
    out, books = cc.compress(df, parts=4, entries=6, rounds=rounds)
    want, want_books = _brute(rows, 4, 6, rounds)
    assert books.tolist() == want_books
    assert sorted(((r.vec_id, bytes(r.code).hex(), r.error, r.label_error) for r in cc.label_errors(out).collect()), key=str) == want


def test_few_rows_no_rows_and_odd_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int"
    out, books = cc.compress(spark.createDataFrame([(1, [1.0] * 4, None), (2, [1.0] * 4, None)], schema), parts=2, entries=64)
    assert books.shape == (2, 2, 2) and [bytes(r.code) for r in out.collect()] == [b"\0\0"] * 2  # ties go to the lower index
    assert cc.label_errors(cc.compress(spark.createDataFrame([(1, None, 1)], schema))[0]).collect() == []
    for bad in ([[1.0] * 3], [[1.0] * 4, [1.0] * 8], [[1e6] * 4]):
        with pytest.raises(Exception, match="equal parts|same length|64 bits"):
            cc.compress(spark.createDataFrame([(i, v, 0) for i, v in enumerate(bad)], schema), parts=2)


def test_only_moved_parts_give_differences(spark):
    rows = [("a", [0.0, 0.0], b"\0\0", b"\0\1"), ("b", [1.0, 2.0], b"\1\1", b"\1\1"), ("c", [3.0, 4.0], b"\0\1", b"\1\1")]
    state = spark.createDataFrame(rows, "vec_id string, vector array<double>, before binary, code binary")
    sums, counts = cc._differences(state, 2, 2, 2)
    assert counts.tolist() == [[-1, 1], [-1, 1]] and sums.ravel().tolist() == [-768, 768, 0, 0]


def test_query_and_its_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    got = sorted(map(tuple, cc.op13_vector_codes(spark, sf).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert got == sorted(con.execute(cc.OP13_SQL).fetchall())
    _, books = cc.compress(spark.read.parquet(f"{sf}/embeddings.parquet"))
    assert got[0][4] == hashlib.sha256(cc.codebooks_text(books).encode()).hexdigest()
