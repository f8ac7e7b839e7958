import random
from itertools import combinations

from maskwright.llm import jaccard_join


def test_all_links_and_their_numbers(spark):
    rng = random.Random(12)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    docs = {i: " ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for i in range(20)}
    for i in range(20, 60):  # near copies of one text
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        docs[i] = " ".join(words)
    docs |= {60: docs[25], 61: docs[3], 62: ""}
    sets = {i: set(jaccard_join.shingles(t).tolist()) for i, t in docs.items()}
    alike = [p for p in combinations(docs, 2) if (u := sets[p[0]] | sets[p[1]]) and 4 * len(sets[p[0]] & sets[p[1]]) >= 3 * len(u)]
    rep = {i: min(j for j in docs if sets[j] == sets[i]) for i in docs}
    members, links = jaccard_join.join(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), exact=True)
    assert {r.doc_id: r.n_links for r in members.collect()} == {i: sum(i in p for p in alike) for i in docs}
    assert sorted((r.u, r.v) for r in links.collect()) == sorted({(rep[a], rep[b]) if rep[a] < rep[b] else (rep[b], rep[a]) for a, b in alike if rep[a] != rep[b]})
