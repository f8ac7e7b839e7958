import hashlib
import random
from zlib import crc32

import numpy as np
import pytest

from maskwright.llm import prefix_trie as pt


def _brute(rows):
    """The nodes by the definition; rows: conv_id, turn, role, text."""
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    convs = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in convs.items()}
    paths = {}
    for c, own in convs.items():
        h = crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        paths[c] = tuple(convs.get(base, [])[:h] + own[h:])
    members = {}
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members.setdefault(p[:d], []).append(c)
    children = {n: [m for m in members if len(m) == len(n) + 1 and m[: len(n)] == n] for n in members}

    def rolled(n):
        below = [rolled(m) for m in children[n]]
        own = (len(members[n]) - 1) * len(n[-1][1]) if n else 0
        return max(1, sum(b[0] for b in below)), own + sum(b[1] for b in below)

    out = []
    for n, who in members.items():
        end = ",".join(map(str, sorted(c for c in who if len(paths[c]) == len(n))))
        out.append((min(who), len(n), min(members[n[:-1]]) if n else None, len(who), len(children[n]), *rolled(n), hashlib.sha256(end.encode()).hexdigest()))
    return sorted(out, key=str)


_COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def _got(spark, rows, bits=64):
    d = spark.createDataFrame([(*r, 7, "x") for r in rows], "conv_id long, turn long, role string, text string, key int, depth string").repartition(5)
    return sorted(map(tuple, pt.trie(d, bits).select(*_COLUMNS).collect()), key=str)


def _rows(seed, n=250):
    random.seed(seed)
    ids = random.sample(range(0, 900), n // 4) + [0, 100, 200, -5, -100, -250]
    rows = [(c, t, random.choice(["user", "bot", None]), random.choice(["hi", "hello there", "", None, "é" * random.randint(1, 3)])) for c in ids for t in range(random.randint(1, 9))]
    rows += [(300, None, "user", "first"), (300, None, "user", "first"), (300, 1, "user", "tie b"), (300, 1, "bot", "tie a"), (None, 1, "user", "nowhere")]
    rows += [(c, t, "user", "same") for c in range(1000, 1060) for t in range(4)]  # a group of copies
    return rows


@pytest.mark.parametrize("bits", [64, 3])
def test_equals_brute_force(spark, bits):
    rows = _rows(bits)
    assert _got(spark, rows, bits) == _brute(rows)


def test_a_conversation_over_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(pt, "_ROWS", 16)
    monkeypatch.setattr(pt, "PIECE", 3)
    rows = [(c, t, "user", f"turn {t}") for c in (100, 107, 2000) for t in range(150)] + [(3000, t, "user", "again") for t in range(40)] + [(c, 0, "u", "x") for c in range(5001, 5040)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert _got(spark, rows) == _brute(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_fingerprints_go_on_over_batches_and_ranges():
    rng = np.random.default_rng(2)
    codes = rng.integers(0, 1 << 63, 40).astype(np.uint64)
    whole = pt.prefix_fingerprints(codes, np.arange(40) % 25 == 0, 0, 0)
    cut = [pt.prefix_fingerprints(codes[:7], np.arange(7) == 0, 0, 0)]
    cut.append(pt.prefix_fingerprints(codes[7:], np.arange(7, 40) % 25 == 0, int(cut[0][0][-1]), int(cut[0][1][-1])))
    for a, b in zip(whole, zip(*cut, strict=True), strict=True):
        assert (a == np.concatenate(b)).all()
    assert pt._carried([(0, 1, (2, 3, 9)), (1, 2, (2, 2, 5)), (2, 2, (4, 1, 1)), (3, 5, (6, 1, 1))]) == {1: (2, 3, 9), 2: (2, 5, (9 * pt._B**2 + 5) % (1 << 64))}


def test_no_rows_and_turnless_conversations(spark):
    assert _got(spark, []) == [] and _got(spark, [(None, 0, "a", "b")]) == []
    alone = [(c, 0, "u", "x") for c in range(1, 60) if crc32(str(c).encode()) % 6][:5]  # their own turn goes, their base is absent
    assert _got(spark, alone) == _brute(alone) and len(_brute(alone)) == 1


def test_query_and_its_sql(spark):
    import duckdb

    sf = "/root/testdata/sf0.001"
    got = sorted(map(tuple, pt.op12_prefix_trie(spark, sf).select(*_COLUMNS).collect()), key=str)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    assert got == sorted(con.execute(pt.OP12_SQL).fetchall(), key=str)
    assert got == _brute([tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()])
