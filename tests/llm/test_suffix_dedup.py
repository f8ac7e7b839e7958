import hashlib
import random

import numpy as np

from maskwright.llm import suffix_dedup as S


def brute(rows):
    """rows: (order, bytes); for each the repeated stretches."""
    seen, out = set(), {}
    for key, raw in sorted(rows):
        cut = np.zeros(len(raw), bool)
        for s in range(len(raw) - S.LENGTH + 1):
            w = raw[s : s + S.LENGTH]
            if w in seen:
                cut[s : s + S.LENGTH] = True
            else:
                seen.add(w)
        out[key] = cut
    return out


def expect(rows):
    out = []
    for key, cut in brute([(k, t.encode()) for k, t in rows]).items():
        raw = dict(rows)[key].encode()
        out.append((key, len(raw), int(cut.sum()), int((np.diff(np.r_[0, cut.astype(int)]) == 1).sum()), hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~cut])).hexdigest()))
    return sorted(out)


def got(spark, rows):
    d = S.dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    return sorted((r.row.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(bytes(r.kept)).hexdigest()) for r in d.collect())


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = ["the", "of", "tion", "é", "ung", "and", "日本"]
    text = lambda k: " ".join(rng.choice(words) + rng.choice(words) for _ in range(k))
    shared, out = [text(40) for _ in range(4)], []
    for i in range(n):
        kind = rng.randrange(7)
        if kind == 0 and out:
            t = rng.choice(out)[1]
        elif kind == 1 and out:
            t = list(rng.choice(out)[1])
            for _ in range(rng.randint(1, 3)):
                if t:
                    t[rng.randrange(len(t))] = "x"
            t = "".join(t)
        elif kind == 2:
            t = text(rng.randint(0, 30)) + rng.choice(shared) + text(rng.randint(0, 30))
        elif kind == 3:
            t = rng.choice(["a", "ab", "abc "]) * rng.randint(0, 300)
        elif kind == 4:
            t = rng.choice(shared)[rng.randint(0, 50) : rng.randint(150, 250)]
        else:
            t = text(rng.randint(0, 120))
        out.append((rng.randrange(10**6) * 100 + i, t))
    return out


def test_equals_brute_force(spark):
    for seed in range(4):
        rows = corpus(seed)
        assert got(spark, rows) == expect(rows)


def test_suffix_order_with_unlike_residues():
    rng = np.random.default_rng(5)
    for alphabet in (2, 3):
        raw = rng.integers(97, 97 + alphabet, 3000).astype(np.uint8)
        raw[1000:1400] = raw[100:500]
        raw[2000:2300] = 97
        text = np.r_[raw, np.zeros(8 * S.COVER, np.uint8)]
        suffixes = np.arange(raw.size - S.LENGTH + 1)
        order = S.sort_suffixes(text, raw.size, suffixes)
        b = [raw[s : s + S.LENGTH].tobytes() for s in order]
        assert b == sorted(b)
        seen, want = set(), []
        for s in suffixes:
            w = raw[s : s + S.LENGTH].tobytes()
            want.append(w in seen)
            seen.add(w)
        assert S.repeated_windows(text, raw.size, suffixes, suffixes).tolist() == want


def test_difference_cover():
    for v in (8, 32, 64):
        cover, shift = S.difference_cover(v)
        assert {(a - b) % v for a in cover for b in cover} == set(range(v))
        assert all((a + shift[a, b]) % v in cover and (b + shift[a, b]) % v in cover for a in range(v) for b in range(v))


def test_odd_rows(spark):
    long = " ".join(str(i) for i in range(60))
    rows = [(5, long), (5, "x" + long), (5, long), (None, long), (7, None), (8, "")]
    d = S.dedup(spark.createDataFrame([(*r, "k", 1, "i") for r in rows], "doc_id long, text string, n_bytes string, _text int, _id string"))
    res = sorted(((r.row.doc_id is not None, r.row.doc_id or 0, r.n_bytes, r.n_removed, r.row.n_bytes) for r in d.collect()))
    n = len(long)
    assert res[0] == (False, 0, n, 0, "k")
    assert [r[2:4] for r in res[1:4]] == [(n, n), (n, n), (n + 1, n)]
    assert [r[2:4] for r in res[4:]] == [(0, 0), (0, 0)]
    assert S.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_spans_of_a_long_document(spark, monkeypatch):
    rng = random.Random(9)
    t = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    rows = [(1, t[:1500]), (2, t), (3, t[700:2500] + t)]
    monkeypatch.setattr(S, "_SPAN", 1024)
    ids, s0, to = [], [], []
    for cols in S._batch_runs([r[0] for r in rows], [r[1].encode() for r in rows]):
        ids += cols[2].tolist()
        s0 += cols[3].tolist()
        to += (cols[3] + cols[4]).tolist()
    for i, x in rows:
        covered = sorted(w for d, a, b in zip(ids, s0, to) if d == i for w in range(a, b + 1))
        assert covered == list(range(len(x) - S.LENGTH + 1))
