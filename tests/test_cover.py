import random
from collections import Counter

import pytest

from maskwright.operators import cover, selection


def _rows(n=600):
    random.seed(12)
    out = []
    for i in range(n):
        f = [t for t, p in (("common", 0.9), ("a", 0.2), ("b", 0.1), ("c", 0.05), ("rare", 0.02)) if random.random() < p]
        out.append((i, f"s{i % 450}", f))
    return [*out, (n, "null", None)]


def _frame(spark, rows, parts):
    return spark.createDataFrame(rows, "id int, sk string, fs array<string>").repartition(parts)


FLOORS = {"common": 40, "a": 30, "b": 20, "c": 12, "rare": 4}


def test_floors_are_met_together(spark):
    rows = _rows()
    got = cover.cover(_frame(spark, rows, 5), "id", "sk", "fs", FLOORS, "z").collect()
    have = Counter(f for r in got for f in r.features)
    assert all(have[f] >= n for f, n in FLOORS.items())
    assert len({r.id for r in got}) == len({r.sk for r in got}) == len(got) < sum(FLOORS.values())  # rows that serve several floors
    again = cover.cover(_frame(spark, rows, 2), "id", "sk", "fs", FLOORS, "z").collect()
    assert sorted(r.id for r in got) == sorted(r.id for r in again)
    assert sorted(r.id for r in got) != sorted(r.id for r in cover.cover(_frame(spark, rows, 2), "id", "sk", "fs", FLOORS, "y").collect())


def test_forbidden_rows_and_floors_out_of_reach(spark):
    rows = _rows()
    gone = _frame(spark, [r for r in rows if r[2] and "rare" in r[2]], 1)
    with pytest.raises(ValueError, match="rare"):
        cover.cover(_frame(spark, rows, 3), "id", "sk", "fs", FLOORS, "z", forbidden=gone)
    loose = cover.cover(_frame(spark, rows, 3), "id", "sk", "fs", FLOORS, "z", forbidden=gone, strict=False).collect()
    have = Counter(f for r in loose for f in r.features)
    assert all(have[f] >= n for f, n in FLOORS.items() if f != "rare") and not have["rare"]
    assert cover.cover(_frame(spark, [], 1), "id", "sk", "fs", {}, "z").collect() == []
    with pytest.raises(ValueError, match="levels"):
        cover.cover(_frame(spark, rows, 1), "id", "sk", "fs", FLOORS, "z", levels=(2,))


def test_replay_with_floors(spark):
    rows = _frame(spark, _rows(), 4).selectExpr("cast(id AS string) AS record_id", "sk AS skeleton", "fs AS features")
    picks = selection.Picks(rows, spark.createDataFrame([("0", "s1")], "record_id string, skeleton string"))
    selection.replay_with_floors(picks, 150, FLOORS, "w")
    got = picks.frame().join(rows, ["record_id", "skeleton"]).collect()
    have = Counter(f for r in got for f in r.features or [])
    assert len(got) == len({r.skeleton for r in got}) == 150 and all(have[f] >= n for f, n in FLOORS.items())
    assert not {r.record_id for r in got} & {"0"} and not {r.skeleton for r in got} & {"s1"}
    with pytest.raises(ValueError, match="floors take"):
        selection.replay_with_floors(selection.Picks(rows), 10, FLOORS, "w")
