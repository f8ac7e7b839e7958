import base64
import gzip
import hashlib
import re

import numpy as np

from maskwright.llm import exact_dedup, fuse_filter, warc


def test_fuse_filter_misses_no_key_and_passes_few_others():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 10, 1000, 40_000):
        keys = rng.integers(0, 1 << 63, n).astype(np.uint64)
        f = fuse_filter.build(keys)
        assert fuse_filter.contains(f, keys).all()
        others = rng.integers(1 << 63, (1 << 64) - 1, 20_000, dtype=np.uint64)
        assert fuse_filter.contains(f, others).mean() < (0.01 if n else 1e-9)
        assert n < 1000 or len(f) < 1.4 * n + 200


def _rows():
    texts = ["a b", "a  b", "a\tb", " a b", "", None, "x", "a b", "\n", " ", "a\x0b\x0cb", "y" * 50_000]
    return [(i * 3 % 37, t, "doc") for i, t in enumerate(texts * 2)] + [(5, "a b", "again"), (5, "a b", "again")]


def test_dedup_equals_brute_force_for_any_cut(spark):
    rows = [(d if n < 24 else 5, t, x) for n, (d, t, x) in enumerate(_rows())]
    norm = [re.sub("[\x20\x09-\x0d]+", " ", t or "") for _, t, _ in rows]
    want = sorted((d, min(e for (e, _, _), y in zip(rows, norm) if y == x), norm.count(x), hashlib.sha256(x.encode()).hexdigest()) for (d, _, _), x in zip(rows, norm))
    docs = spark.createDataFrame(rows, "doc_id long, text string, keep_id string")
    for cut in (None, -1, 9, 100):
        got = exact_dedup.dedup(docs, cut).collect()
        assert sorted((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
        assert all(r.keep_id == r.doc_id for r in got if r.kept)
        assert sorted(r.text_sha256 for r in got if r.kept) == sorted({r.text_sha256 for r in got})  # one row of each class
    assert exact_dedup.dedup(docs.limit(0)).count() == 0


def test_ids_that_are_repeated_or_null(spark):
    for rows, want in (
        ([(1, "a"), (1, "b"), (5, "a")], [(1, "a", 1, 2, True), (1, "b", 1, 1, True), (5, "a", 1, 2, False)]),
        ([(None, "c"), (None, "c"), (6, "c")], [(None, "c", None, 3, True), (None, "c", None, 3, False), (6, "c", None, 3, False)]),
        ([(1, "a"), (1, "a"), (None, "d")], [(1, "a", 1, 2, True), (1, "a", 1, 2, False), (None, "d", None, 1, True)]),
    ):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        names = {hashlib.sha256(t.encode()).hexdigest(): t for _, t in rows}
        for cut in (None, 3):
            got = [(r.doc_id, names[r.text_sha256], r.keep_id, r.group_size, r.kept) for r in exact_dedup.dedup(docs, cut).collect()]
            assert sorted(got, key=str) == sorted(want, key=str), cut


def test_equal_digests_with_unlike_bytes_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "sha2", lambda c, n: exact_dedup.F.lit("same"))
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    assert sorted((r.doc_id, r.keep_id) for r in exact_dedup.dedup(docs, 1).collect()) == [(1, 1), (2, 2)]


PAGES = [(4, "http://www.Example.com:80/a?b#c", "<p>é</p>"), (2, "http://example.com/x", "<p>é</p>"), (3, None, None), (1, "", ""), (9, "bad\r\nurl: x", "z" * 70_000 + "\r\n\r\nWARC/1.1"), (8, "http://example.com/x", "other"), (8, "http://example.com/x", "other")]


def test_archives_read_back_through_the_index(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame([(*p, 1) for p in PAGES], "page_id long, url string, html string, size int"), path)
    index = warc.build_index(spark, path)
    want = []
    for p, _, h in PAGES:
        raw = (h or "").encode()
        first = min(q for q, _, x in PAGES if (x or "") == (h or ""))
        want.append((p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if p == first else "revisit", None if p == first else first))
    assert sorted(map(tuple, warc.read_records(spark, index).collect()), key=str) == sorted(want, key=str)
    raw = b"".join(gzip.decompress(f.read_bytes()) for f in (tmp_path / "w").glob("*/part-*"))
    assert raw.count(b"WARC-Type: response") == 5 and raw.count(b"WARC-Type: revisit") == 2
    hits = warc.lookup(spark, index, "http://example.com/x")
    assert [(h["page_id"], h["record_type"], h["payload"]) for h in hits] == [(2, "response", "<p>é</p>".encode()), (8, "response", b"other"), (8, "response", b"other")]
    assert warc.lookup(spark, index, "http://nowhere.org/") == []
    empty = str(tmp_path / "e")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), empty)
    assert warc.read_records(spark, warc.build_index(spark, empty)).count() == 0


def test_small_payloads_are_not_revisits_above_a_bound(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab")], "page_id long, url string, html string"), str(tmp_path / "w"), revisit_from=3)
    assert {r.record_type for r in warc.read_records(spark, warc.build_index(spark, str(tmp_path / "w"))).collect()} == {"response"}


def test_blocks_are_sorted_and_searched(spark, tmp_path):
    rows = [(i, f"http://s{i % 9}.example.org/{i % 40}", f"page {i % 33}") for i in range(200)]
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), str(tmp_path / "w"))
    index = warc.build_index(spark, str(tmp_path / "w"), block_lines=7)
    blocks = index.blocks.orderBy("block").collect()
    assert len(blocks) > 20 and [b.first_key for b in blocks] == sorted(b.first_key for b in blocks)
    for u in (rows[5][1], rows[77][1]):
        assert [h["page_id"] for h in warc.lookup(spark, index, u)] == sorted(p for p, x, _ in rows if x == u)


def test_url_keys():
    assert warc.url_key("https://Blog.Example.com:8080/p?q=1#f") == "com,example,blog:8080)/p?q=1"
    assert warc.url_key("no url") == "no url" and warc.url_key("") == ""


def test_files_are_bounded_and_ranges_read_little(spark, tmp_path, monkeypatch):
    import random

    rng = random.Random(3)
    rows = [(i, f"http://s{i % 5}.example.org/{i}", "".join(rng.choice("abcdefghij") for _ in range(4000))) for i in range(120)]
    rows.append((500, "http://big.example.org/", "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(300_000))))
    path = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2), path, file_bytes=20_000)
    files = list((tmp_path / "w").glob("*/part-*"))
    assert len(files) > 10 and sum(f.stat().st_size > 25_000 for f in files) <= 1
    index = warc.build_index(spark, path, block_lines=10)
    assert {r.page_id for r in warc.read_records(spark, index).collect()} == {r[0] for r in rows}
    ((file, offset, length),) = warc.find(index, rows[7][1])
    one = warc.Ranges(file)
    (got,) = warc.read_ranges(one, [(offset, length)])
    assert one.read_bytes == length < 4000 and warc.parse(got)[5].decode() == rows[7][2]
    assert warc.driver_range(spark, file, offset, length) == got
    members = [(o, n) for _, o, n in warc._members(warc.Ranges(file))]
    monkeypatch.setattr(warc, "READ_BYTES", 700)  # members over many reads
    assert [(o, n) for _, o, n in warc._members(warc.Ranges(file))] == members and (offset, length) in members
    assert list(warc.read_ranges(warc.Ranges(file), members[:3])) == [warc.Ranges(file).read(o, n) for o, n in members[:3]]
    monkeypatch.setattr(warc, "opens", lambda path: False)  # a store that only Spark reads
    assert {r.page_id for r in warc.read_records(spark, warc.build_index(spark, path)).collect()} == {r[0] for r in rows}


def test_null_page_ids(spark, tmp_path):
    rows = [(5, "same"), (None, "same"), (None, "nowhere else"), (None, "nulls"), (None, "nulls"), (3, None), (None, "")]
    path = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame([(p, "http://e.org/", h) for p, h in rows], "page_id long, url string, html string"), path)
    got = warc.read_records(spark, warc.build_index(spark, path)).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in got), key=str) == sorted(
        [(5, 4, "response", None), (None, 4, "revisit", 5), (None, 12, "response", None), (None, 5, "response", None), (None, 5, "response", None), (3, 0, "response", None), (None, 0, "revisit", 3)], key=str)
