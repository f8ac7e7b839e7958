import random
from collections import Counter

import numpy as np

from maskwright.llm import quality_classifier, quality_rules, toxicity


def plain_base(text):
    words = [w for w in __import__("re").findall("[^\x20\x09-\x0d]+", text or "")]
    lines = [x for x in (text or "").split("\n") if x.strip("\x20\x09\x0a\x0b\x0c\x0d")]
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = {j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def counts_of(texts):
    words = [t.encode().split() for t in texts]
    out = []
    for w, t in zip(words, texts, strict=True):
        spaces, *rest = quality_rules.line_counts(t.encode())
        out.append((len(w), len(t) - spaces, *rest, 0))
    own, rows = quality_rules.Words(), [i for i, w in enumerate(words) if w]
    ids, begins = own.numbers([words[i] for i in rows])
    for i, n in zip(rows, quality_rules.repeated(own.plain[ids], begins).tolist(), strict=True):
        out[i] = (*out[i][:4], n)
    return out


def test_base_counts():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab #|\n\t ") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    for t, got in zip(texts, counts_of(texts), strict=True):
        assert got == plain_base(t), t


def test_windows_that_share_a_hash_are_told_apart(monkeypatch):
    texts = ["a b c x y z a b d x y z", "q a b c", "a b c a b c"]
    want = [plain_base(t) for t in texts]
    monkeypatch.setattr(quality_rules, "mix64", lambda x: np.asarray(x, np.uint64) % np.uint64(3) + np.uint64(1))
    own = quality_rules.Words()
    words = [t.encode().split() for t in texts]
    flat = [w for x in words for w in x]
    ids = np.array([sorted(set(flat)).index(w) for w in flat])
    begins = np.cumsum([0, *map(len, words)])[:-1]
    assert quality_rules.repeated(ids, begins).tolist() == [w[4] for w in want] and own.ids == {}


EDGE = "<edge>"


def plain_kneser_ney(texts, order=5):
    """Modified Kneser-Ney on lists of symbols, written from the textbook; returns a function for the log probability of a text."""
    streams = [[EDGE, *" ".join(t.split()), EDGE] for t in texts if t.split()]
    raw, before = Counter(), {}
    for s in streams:
        for i in range(1, len(s)):
            for k in range(1, min(order, i + 1) + 1):
                g = tuple(s[i - k + 1 : i + 1])
                raw[g] += 1
                if i - k >= 0:
                    before.setdefault(g, set()).add(s[i - k])
    use = {g: n if len(g) == order or (len(g) > 1 and g[0] == EDGE) else len(before[g]) for g, n in raw.items()}
    cuts = {}
    for k in range(1, order + 1):
        n1, n2, n3, n4 = (max(1, sum(len(g) == k and n == i for g, n in use.items())) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)
        cuts[k] = [min(max(1 - 2 * y * n2 / n1, 0.1), 0.9), min(max(2 - 3 * y * n3 / n2, 0.1), 1.9), min(max(3 - 4 * y * n4 / n3, 0.1), 2.9)]
    cut = lambda g: cuts[len(g)][min(use[g], 3) - 1]
    total, left = Counter(), Counter()
    for g, n in use.items():
        total[g[:-1]] += n
        left[g[:-1]] += cut(g)
    symbols = sum(len(g) == 1 for g in use)

    def p(context, x):
        rest = p(context[1:], x) if context else 1 / (symbols + 1)
        if not total[context]:
            return rest
        g = (*context, x)
        return (max(0, use[g] - cut(g)) if g in use else 0) / total[context] + left[context] / total[context] * rest

    def score(text):
        s = [EDGE, *" ".join(text.split()), EDGE]
        return sum(np.log(p(tuple(s[max(0, i - order + 1) : i]), s[i])) for i in range(1, len(s)))

    return score


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, n_words string")


def _own_logs(model, slices, texts, lang):
    logs = np.zeros(len(texts))
    for part in slices:
        own = quality_rules._Scored()
        logs += own.score(*own.numbers([t.encode().split() for t in texts]), lang, part)
    return logs


def test_model_equals_a_plain_one(spark):
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdeé") for _ in range(rng.choice([1, 1, 2, 3, 4, 5, 9]))) for _ in range(60)]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 40))) for _ in range(50)]
    texts += ["abcde  fg\n"] * 300 + ["bcdef", "cdefg", "a", "x\x00y", "a"]  # a skewed beginning
    docs = _docs(spark, [(i, t, "xx" if i % 9 else "yy", None) for i, t in enumerate(texts)]).repartition(5)
    for lang in ("xx", "yy"):
        own = [t for i, t in enumerate(texts) if (i % 9 == 0) == (lang == "yy")]
        plain = plain_kneser_ney(own)
        ask = [*own[:30], "abcde", "bcdef", "cdefg", "zzz a", "abcabcabc", "é é", "a"]
        for most in (10**9, 100):
            model = quality_rules.fit(docs, most)
            assert (len(model.slices) > 3) == (most == 100)
            got = _own_logs(model, [quality_rules.Slice(model, b) for b in model.slices], ask, lang)
            want = np.array([plain(t) for t in ask])
            assert np.allclose(got, want, atol=1e-3), [(t, a, b) for t, a, b in zip(ask, got, want, strict=True) if abs(a - b) > 1e-3]
    by = dict(zip(ask, got, strict=True))
    assert by["a"] != by["abcde"]


def test_slices_give_the_same_measures(spark):
    rng = random.Random(9)
    rows = [(i % 40, " ".join(rng.choice(["ab", "ba", "abc", "c", "dd"]) for _ in range(rng.randint(0, 70))), rng.choice(["xx", None]), None) for i in range(60)]
    docs = _docs(spark, [*rows, *rows[:5], (None, None, "xx", None)])
    one, many = (sorted(quality_rules.measure(docs, most).collect(), key=str) for most in (None, 30))
    assert len(one) == len(many) == 66
    assert all(a[:-1] == b[:-1] and (a[-1] == b[-1] or abs(a[-1] - b[-1]) < 1e-9) for a, b in zip(one, many, strict=True))


def test_verdicts(spark):
    rng = random.Random(6)
    vocab = ["".join(rng.choice(["ka", "lo", "mi", "ne", "tu"]) for _ in range(rng.randint(1, 4))) for _ in range(200)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    rows = [(i, text(80), "aa", None) for i in range(60)] + [(100, "".join(rng.choice("xqzwj ") for _ in range(900)), "aa", None), (101, "k " * 100, "aa", None), (102, None, None, None), (103, "", "aa", None), (104, text(49), "aa", None), (104, text(60), "aa", None)]
    got = quality_rules.quality(_docs(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].kept for i in range(60)) and not by[100].base_failed and not by[100].kept
    assert by[101].base_failed and by[102].base_failed and by[103].n_words == 0
    assert sorted(r.kept for r in got if r.doc_id == 104) == [False, True]
    for d, t, *_ in rows[:104]:
        if d != 104:
            assert (by[d].n_words, by[d].word_chars, by[d].n_symbols, by[d].n_dup_lines, by[d].n_repeat_words) == plain_base(t)
    assert quality_rules.quality(_docs(spark, rows).limit(0)).count() == 0


def _labelled(spark, n=900):
    rng = random.Random(7)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(vocab) for _ in range(rng.randint(20, 90))]
        toxic, good = rng.random() < 0.3, rng.random() < 0.7
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = "vilex" + rng.choice(vocab)
        if not good:
            words = [w + "!!" for w in words]
        docs.append((i, " ".join(words), rng.choice(["en", "de", None]), "s"))
        labels.append((i, int(good), int(toxic)))
    docs += [(n, None, None, None), (n + 1, "", "en", None), (n + 2, "w " * 30_000, "en", None), (5, docs[5][1], "en", None)]
    labels += [(5, None, None), (None, 1, 1)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string, score string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {i: (q, t) for i, q, t in labels if q is not None}


def _accuracy(rows, truth, k):
    held = [(r.predicted, truth[r.doc_id][k]) for r in rows if r.held_out and r.doc_id in truth]
    return sum(p == y for p, y in held) / len(held)


def test_classifiers_on_held_out_rows(spark):
    docs, labels, truth = _labelled(spark)
    q = quality_classifier.score(docs, quality_classifier.fit(docs, labels)).collect()
    t = toxicity.score(docs, toxicity.fit(docs, labels)).collect()
    assert len(q) == len(t) == docs.count() and all(0 <= r.score <= 1 for r in q + t)
    assert _accuracy(q, truth, 0) > 0.97 and _accuracy(t, truth, 1) > 0.93
    assert len({r.score for r in t if r.doc_id == 5}) == 1
    none = labels.where("doc_id < 0")
    assert {r.score for r in quality_classifier.score(docs, quality_classifier.fit(docs, none)).collect()} == {0.5}
    assert max(r.score for r in toxicity.score(docs, toxicity.fit(docs, none)).collect()) < 1e-9
    assert toxicity.score(docs.limit(0), toxicity.fit(docs, labels)).count() == 0


def test_scores_ignore_language_source_and_id(spark):
    docs, labels, _ = _labelled(spark, 300)
    other = docs.selectExpr("doc_id + 7000 AS doc_id", "text", "'zz' AS lang", "score")
    for module in (quality_classifier, toxicity):
        m = module.fit(docs, labels)
        score = lambda d: {r.doc_id % 7000: r.score for r in module.score(d, m).collect()}  # noqa: B023, E731
        assert score(docs) == score(other)


def test_scores_equal_plain_loops():
    import re
    from zlib import crc32

    rng = np.random.default_rng(2)
    texts = ["", "one", "Some words, some MORE words!! and (marks).", "a a a a", "x y z " * 50]
    weights = rng.normal(size=1 << quality_classifier.BITS).astype(np.float32)
    model = quality_classifier.Model(weights, 0.3)
    for t, got in zip(texts, quality_classifier.scores(texts, model), strict=True):
        h = [crc32(w.encode()) for x in t.split() for w in re.findall(r"\w+|[^\w\s]+", x)]
        keys = h + [0 if a == b else (a * 0x9E3779B97F4A7C15 + b + 1) % 2**64 for a, b in zip(h, h[1:], strict=False)]
        z = 0.3
        for k in keys:
            for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
                k = (k ^ k >> shift) * factor % 2**64
            k ^= k >> 33
            z += float(weights[k % (1 << quality_classifier.BITS)]) * quality_classifier.SCALE / len(keys)
        assert abs(got - 1 / (1 + np.exp(-z))) < 1e-5
    spans = sum(toxicity.WIDTHS)
    known = rng.random(toxicity.BUCKETS) < 0.7
    table = rng.normal(size=(toxicity.BUCKETS, spans, toxicity.FILTERS)).astype(np.float32)
    table[0] = 0
    m = toxicity.Model(table, rng.normal(size=(len(toxicity.WIDTHS), toxicity.FILTERS)).astype(np.float32), rng.normal(size=len(toxicity.WIDTHS) * toxicity.FILTERS + 1), 0.2, known)
    hashed = toxicity.tokens("words")
    for t, got in zip(texts, toxicity.logits([hashed(t) for t in texts], m), strict=True):
        words = [w for x in t.split() for w in re.findall(r"\w+", x.lower())]
        rows = []
        for w in words:
            b = [crc32(x.encode()) % (toxicity.BUCKETS - 1) + 1 for x in (w, "5" + w[:5], "4" + w[:4])]
            rows.append(sum(table[i if known[i] else 0] for i in b))
        rows += [table[0] * 3] * toxicity.WIDTHS[-1]  # behind a text stands nothing
        at, z, k = 0, m.out[-1] + 0.2, 0
        for i, width in enumerate(toxicity.WIDTHS):
            for f in range(toxicity.FILTERS):
                tops = [sum(rows[p + j][at + j][f] for j in range(width)) for p in range(max(1, len(words)))]
                z += max(0.0, max(tops) + m.bias[i][f]) * m.out[k]
                k += 1
            at += width
        assert abs(got - z) < 1e-3, t


def test_the_sample_is_bounded_in_bytes_and_fixed(spark):
    from maskwright.llm.features import labelled_sample

    docs = spark.createDataFrame([(i, "word " * 50, "en") for i in range(60)] + [(3, "other", "en")] * 5, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    whole = labelled_sample(docs, labels, "quality", 100, "marks")
    small = labelled_sample(docs.repartition(7), labels, "quality", 100, "marks", most_bytes=1100)
    assert len(whole[0]) > 30 and len(small[0]) in range(6, 10) and whole[3] == small[3]
    again = labelled_sample(docs.repartition(3), labels, "quality", 100, "marks", most_bytes=1100)
    assert [x.tolist() for x in small[0]] == [x.tolist() for x in again[0]]
