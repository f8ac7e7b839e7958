import random
import re

import numpy as np

from maskwright.llm import jaccard_join as J
from maskwright.llm.components import components


def sets_of(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return set()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def brute(rows):
    s = [(d, sets_of(t)) for d, t in rows]
    parent = {d: d for d, _ in s}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(s):
        for b, y in s[:i]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((find(a), find(b)))
                parent[q] = p
    return sorted((d, len(x), find(d)) for d, x in s)


def corpus(seed, n=150):
    rng = random.Random(seed)
    vocab = ["w%d" % i for i in range(300)]
    text = lambda k: [rng.choice(vocab) for _ in range(k)]
    passage, out = text(40), []
    for i in range(n):
        kind = rng.randrange(6)
        if kind <= 2 and out:
            w = list(rng.choice(out)[1])
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                if w:
                    w[rng.randrange(len(w))] = rng.choice(vocab).upper()
            if rng.random() < 0.3:
                w = w[: int(len(w) * rng.uniform(0.7, 1))]
        elif kind == 3:
            w = text(rng.randint(0, 40)) + passage + text(rng.randint(0, 20))
        else:
            w = text(rng.choice([0, 1, 3, 5, 7, 60, 200]))
        out.append((rng.randrange(1000) * 1000 + i, w))
    return [(d, " ".join(w)) for d, w in out]


def test_equals_brute_force(spark):
    for seed in range(3):
        rows = corpus(seed)
        got = sorted(map(tuple, J.join(spark.createDataFrame(rows, "doc_id long, text string"))[0].collect()))
        assert got == brute(rows)


def test_prefixes_and_trees_alone_find_every_link(spark, monkeypatch):
    monkeypatch.setattr(J, "first_pairs", lambda reps: reps.select(J.F.col("id").alias("b"), J.F.col("id").alias("a")).limit(0))
    rows = corpus(11)
    got = sorted(map(tuple, J.join(spark.createDataFrame(rows, "doc_id long, text string"))[0].collect()))
    assert got == brute(rows)


def test_tree_never_drops_a_pair_above_the_threshold():
    rng = np.random.default_rng(2)
    base = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (3, 20, 90, 200, 260, 1000)]
    sets = []
    for b in base:
        for _ in range(12):
            keep = b[rng.random(b.size) < rng.uniform(0.7, 1)]
            sets.append(np.unique(np.r_[keep, rng.integers(0, 1 << 63, rng.integers(0, 1 + b.size // 8)).astype(np.uint64)]))
    sets = [s for s in sets if s.size]
    n = np.array([s.size for s in sets])
    comp = np.arange(n.size) // 2
    a, b = J.tree_pairs(np.arange(n.size), n, comp, [J.bitmap(s).tobytes() for s in sets])
    found = set(zip(a.tolist(), b.tolist()))
    want = {(i, j) for i in range(n.size) for j in range(i + 1, n.size) if comp[i] != comp[j] and 7 * np.intersect1d(sets[i], sets[j]).size >= 3 * (n[i] + n[j])}
    assert want and want <= found
    assert all(comp[i] != comp[j] for i, j in found) and len(found) < n.size * (n.size - 1) / 4


def test_odd_rows(spark):
    rows = [(3, "a b c"), (3, "A B c"), (None, "a  b\tc"), (7, None), (8, ""), (9, " \n"), (4, "a b c d")]
    got = J.join(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n long"))[0].collect()
    assert sorted(map(tuple, got), key=str) == sorted([(3, 1, None), (3, 1, None), (None, 1, None), (7, 0, 7), (8, 0, 8), (9, 0, 9), (4, 1, 4)], key=str)
    assert J.join(spark.createDataFrame([], "doc_id long, text string"))[0].count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 460)]
    parent = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(400):
        for u, v in edges:
            if u != v:
                m = min(parent[u], parent[v])
                parent[u] = parent[v] = m
    assert dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect())) == parent
