import random

from maskwright.llm.packing import plan


def test_plan_places_every_piece_once_without_overlap_or_gap():
    rng = random.Random(3)
    for capacity in (12, 64, 2048):
        for _ in range(15):
            lengths = [rng.choice([capacity, rng.randint(1, capacity), rng.randint(1, max(1, capacity // 5))]) for _ in range(rng.randint(0, 400))]
            counts = {n: lengths.count(n) for n in set(lengths)}
            rules, bins = plan(counts, capacity)
            seen, fill = {n: set() for n in counts}, {}
            for length, lo, hi, first, per, offset in rules:
                for r in range(lo, hi):
                    assert r not in seen[length]
                    seen[length].add(r)
                    fill.setdefault(first + (r - lo) // per, []).append((offset + (r - lo) % per * length, length))
            assert {n: len(s) for n, s in seen.items()} == counts
            assert sorted(fill) == list(range(bins))
            for places in fill.values():
                at = 0
                for o, n in sorted(places):
                    assert o == at
                    at += n
                assert at <= capacity
            assert bins <= 1.25 * sum(lengths) / capacity + 2 + sum(1 for n in lengths if 2 * n > capacity) / 2


def test_plan_matches_large_pieces_in_pairs():
    assert plan({6: 2, 4: 2}, 10)[1] == 2
    assert plan({10: 3}, 10)[1] == 3
    assert plan({}, 10) == ([], 0)
    assert plan({1: 25}, 10)[1] == 3
