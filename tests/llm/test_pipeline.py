import random
import zlib

import pytest

import corpus_pipeline
from maskwright.llm import quality_rules

from .test_jaccard_join import brute as brute_links
from .test_suffix_dedup import brute as brute_cuts


def _corpus():
    rng = random.Random(12)
    vocab = ["".join(rng.choice(["ka", "lo", "mi", "né", "tu"]) for _ in range(rng.randint(1, 4))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage, rows = text(60), []
    for i in range(70):
        kind = rng.randrange(5)
        if kind == 0 and rows:
            t = rng.choice(rows)[1]
        elif kind == 1 and rows:
            w = (rng.choice(rows)[1] or "").split(" ")
            w[rng.randrange(len(w))] = "changed"
            t = " ".join(w)
        elif kind == 2:
            t = text(rng.randint(60, 90)) + " " + passage
        else:
            t = text(rng.choice([10, 80, 150, 900]))
        rows.append((i, t))
    return [*rows, (200, None), (201, "")]


def test_stages_equal_a_brute_force_version(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    from maskwright.llm.encoders import ids_bytes, load, tokenizer_path

    rows = _corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], schema)
    kept = {r.doc_id for r in quality_rules.quality(docs).where("kept").collect()}
    assert 30 < len(kept) < len(rows)
    want = {i: t for i, t in rows if i in kept}
    stages = [want]
    first = {}
    for i in sorted(want):
        first.setdefault(" ".join((want[i] or "").split()), i)
    want = {i: want[i] for i in first.values()}
    stages.append(want)
    want = {d: want[d] for d, _, c in brute_links(sorted(want.items())) if d == c}
    stages.append(want)
    cut = brute_cuts([(i, t.encode()) for i, t in want.items()])
    want = {i: bytes(b for b, c in zip(t.encode(), cut[i], strict=True) if not c).decode("utf-8", "ignore") for i, t in want.items()}
    stages.append(want)
    assert len({len(s) for s in stages[:3]}) == 3 and stages[3] != stages[2]
    now = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, now, "").write.parquet(str(tmp_path / str(k)))
        now = spark.read.parquet(str(tmp_path / str(k)))
        assert now.columns == docs.columns
        assert {r.doc_id: r.text for r in now.collect()} == stages[k], name
    assert all(r.n_chars == len(r.text) for r in now.collect())
    placed = corpus_pipeline.STAGES[-1][1](spark, now, "").collect()
    used, pieces = {}, {}
    for r in placed:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
        pieces[r.doc_id, r.piece] = (r.start, r.length, r.ids_crc32)
    for i, t in stages[3].items():
        ids = [*load(tokenizer_path("word_bpe_49k.json")).encode(t, add_special_tokens=False).ids, 0]
        for p, at in enumerate(range(0, len(ids), 2048)):
            x = ids[at : at + 2048]
            assert pieces.pop((i, p)) == (at, len(x), zlib.crc32(ids_bytes(x)))
    assert not pieces
    for places in used.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 2048
    assert len(used) <= -(-sum(r.length for r in placed) // 2048) + 1


def test_run_takes_all_stages(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in _corpus()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 20
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "exact dedup", "n-gram Jaccard join", "suffix-array dedup", "best-fit packing"]


def test_repeated_and_null_ids_clashing_columns_and_a_long_text(spark, tmp_path):
    """The same texts stay as if the rows had ids of their own in the same order."""
    rng = random.Random(4)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(10_000)) for _ in range(60_000))
    rows = [(i // 3 if i % 4 else None, t) for i, (_, t) in enumerate(_corpus())] + [(7, long)]
    rows += rows[:9] + [(None, rows[20][1]), (5, rows[30][1])]
    odd = spark.createDataFrame([(d, t, "en", "s", len(t or ""), n % 3, "x", 1.5, None, True) for n, (d, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, row int, text_hash string, component_id double, _id string, kept boolean")
    hashes = [r[0] for r in spark.createDataFrame([(n, t or "") for n, (_, t) in enumerate(rows)], "n int, t string").orderBy("n").selectExpr("xxhash64(t)").collect()]
    order = sorted(range(len(rows)), key=lambda n: (rows[n][0] is not None, rows[n][0] or 0, hashes[n]))
    plain = spark.createDataFrame([(k, rows[n][1], "en", "s", len(rows[n][1] or "")) for k, n in enumerate(order)], "doc_id long, text string, lang string, source string, n_chars long")
    sizes = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        texts = []
        for which, now in (("odd", odd), ("plain", plain)):
            stage(spark, now, "").write.parquet(str(tmp_path / f"{which}{k}"))
            out = spark.read.parquet(str(tmp_path / f"{which}{k}"))
            assert out.columns == now.columns
            texts.append(sorted(r.text or "" for r in out.collect()))
        odd, plain = (spark.read.parquet(str(tmp_path / f"{w}{k}")) for w in ("odd", "plain"))
        assert texts[0] == texts[1], name
        sizes.append(len(texts[0]))
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3] and odd.where("row is null or kept is null").count() == 0
    if pytest.importorskip("public_tokenizers"):
        assert corpus_pipeline.STAGES[-1][1](spark, odd, "").count() >= sizes[3]
