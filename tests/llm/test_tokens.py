import random
import zlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
from maskwright.llm.encoders import ByteEncoder, WordEncoder, encoder, ids_bytes, load, tokenizer_path
from maskwright.llm.token_files import EliasFano, elias_fano, read_documents, write_token_files
from maskwright.llm.tree_bpe import decode, encode_decode, tree_encoder

BYTES, WORDS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("word_bpe_49k.json")
ODD = ["", " ", "\n", "a  b", "a\n b", "a \nb", "a\n\nb", "a\n\n\nb", "\na", "a\n", "a \tb", "a\t b", "<|endoftext|>", "x<|endoftext|> y", "don't DON'T", "日本語 テキスト", "a\x1cb \x1cb", "１２３ 45", "ΑΣ ΣΑΣ", "a\r\nb\r\n", "𝔘𝔫 😀😀 é", " <|startoftext|> q"]


def _random(rng, alphabet, n):
    return "".join(rng.choice(alphabet) for _ in range(n))


@pytest.mark.parametrize(("kind", "path"), [(ByteEncoder, BYTES), (WordEncoder, WORDS)])
def test_pieces_give_the_librarys_ids(kind, path):
    rng = random.Random(1)
    texts = ODD + [_random(rng, " \n\tab'.1é<|", rng.randint(1, 14)) for _ in range(1500)]
    assert encoder(kind, path).encode(texts) == [ids_bytes(load(path).encode(t, add_special_tokens=False).ids) for t in texts]


def test_tree_joins_give_the_librarys_ids():
    rng, tree = random.Random(2), tree_encoder(BYTES)
    texts = ODD + [_random(rng, a, rng.randint(1, 400)) for a in ("ab", "a", " ", " \n", "the ion.", "é日😀", "ab  \n'st12", "x'll 've") for _ in range(40)]
    for t in texts:
        for leaf in (3, 17, 64):
            assert tree.encode(t, leaf) == load(BYTES).encode(t, add_special_tokens=False).ids, (t, leaf)
    for n in (5000, 20000):
        t = _random(rng, "thesaion", n)
        assert tree.encode(t, 1024) == load(BYTES).encode(t, add_special_tokens=False).ids
        assert tree.halves(t, 32) == [x.id for x in load(BYTES).model.tokenize(t)]


def test_decoding_is_the_librarys():
    rng = random.Random(3)
    for _ in range(300):
        ids = [rng.randrange(50257) for _ in range(rng.randint(0, 9))]
        assert decode(ids, BYTES) == load(BYTES).decode(ids, skip_special_tokens=False)


def test_elias_fano_round_trip():
    rng = np.random.default_rng(4)
    for n, top in ((0, 1), (1, 0), (1, 5), (7, 3), (1000, 40), (5000, 1 << 31), (3000, 3000)):
        v = np.sort(rng.integers(0, top + 1, n))
        e = EliasFano(elias_fano(v))
        assert (e.get(np.arange(n)) == v).all()
        assert len(elias_fano(v)) < 200 + n * (3 + np.log2(max(1, top / max(1, n)) + 1)) / 8 * 1.2
    with pytest.raises(ValueError):
        elias_fano(np.array([3, 2]))


def test_queries_on_odd_rows(spark):
    rows = [(i, t, "x") for i, t in enumerate(ODD + [None, "a" * 3000, "ab \n" * 900])] + [(3, ODD[3], "again"), (None, "no id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(encode_decode(docs, BYTES, leaf=256).collect(), key=str)
    import hashlib

    want = []
    for d, t, _ in rows:
        ids = load(BYTES).encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), hashlib.sha256(ids_bytes(ids)).hexdigest(), hashlib.sha256(load(BYTES).decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    files = write_token_files(docs, BYTES)
    at, expect = 0, []
    for d, t, _ in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        ids = [*load(BYTES).encode(t or "", add_special_tokens=False).ids, 2]
        expect.append((d, at, len(ids), zlib.crc32(ids_bytes(ids))))
        at += len(ids)
    assert sorted(map(tuple, read_documents(files).collect()), key=str) == sorted(expect, key=str)
    empty = docs.limit(0)
    assert encode_decode(empty, BYTES).count() == 0 and read_documents(write_token_files(empty, BYTES)).count() == 0


def test_an_id_of_most_rows_is_dealt_to_several_parts(spark, monkeypatch):
    from maskwright.llm import token_files

    monkeypatch.setattr(token_files, "PART_BYTES", 200)
    rng = random.Random(6)
    rows = [(7 if i % 3 else i, _random(rng, "ab c", rng.randint(0, 30))) for i in range(300)] + [(None, "none")] * 3
    files = write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), BYTES)
    assert len({r.part for r in files.collect() if 7 in r.doc_ids}) > 5
    got = sorted(read_documents(files).collect(), key=lambda r: r.start)
    key = lambda x: -1 if x is None else x
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=key)
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))]
    want = sorted((key(i), zlib.crc32(ids_bytes([*load(BYTES).encode(t, add_special_tokens=False).ids, 2]))) for i, t in rows)
    assert sorted((key(r.doc_id), r.ids_crc32) for r in got) == want
