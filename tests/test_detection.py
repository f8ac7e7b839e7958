import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from maskwright.functions import checks
from maskwright.operators import detect, fuse, rewrite

IBAN, HU = "IT60X0542811101000000123456", "HU26 ED40 LPFN GL54 NKH1 X8UD SV92"
in_groups = lambda n, sep=" ": sep.join(IBAN[i : i + n] for i in range(0, len(IBAN), n))

FOUND = [
    ("IBAN", f"Pay {IBAN} now.", IBAN), ("IBAN", f"to {in_groups(4)} of the branch", in_groups(4)), ("IBAN", f"to {in_groups(4, '-')}.", in_groups(4, "-")), ("IBAN", f"to {IBAN.lower()} please", IBAN.lower()),
    ("IBAN", f"x {in_groups(4, chr(160))} y", in_groups(4, chr(160))), ("IBAN", f"x {in_groups(5)} y", in_groups(5)), ("IBAN", f"x {in_groups(4, '   ')} y", in_groups(4, "   ")),
    ("IBAN", "see IT60 X054 2811\n1010 0000 0123 456 there", "IT60 X054 2811\n1010 0000 0123 456"), ("IBAN", "on ES91 2100 0418 4502 0005 1332.", "ES91 2100 0418 4502 0005 1332"), ("IBAN", f"on {HU} to", HU),
    ("IBAN", "MA64011519000001205000534921 abroad", "MA64011519000001205000534921"), ("IBAN", f"VAT IT77781880495 on {in_groups(4)} in 30 days", in_groups(4)),
    ("CF", "code RSSMRA85H12F205Y, says", "RSSMRA85H12F205Y"), ("CF", "code RSSMRA85H12F2LRE, says", "RSSMRA85H12F2LRE"), ("CF", "of BNCLCU90A41H50MO here", "BNCLCU90A41H50MO"), ("CF", "rssmra85h12f205y too", "rssmra85h12f205y"),
    ("CREDITCARDNUMBER", "card 4111 1111 1111 1111.", "4111 1111 1111 1111"), ("CREDITCARDNUMBER", "card 4111.1111.1111.1111.", "4111.1111.1111.1111"), ("CREDITCARDNUMBER", "card 4111111111111111", "4111111111111111"),
    ("TELEPHONENUM", "call 333 123 4567 ok", "333 123 4567"), ("TELEPHONENUM", "call +39-333-123-4567 ok", "+39-333-123-4567"), ("TELEPHONENUM", "call 010.2471234 ok", "010.2471234"),
    ("PIVA", "VAT 00743110157 of", "00743110157"), ("PIVA", "VAT IT00743110157, of", "00743110157"),
    ("DOCID", "case R.G.N.R. 123/2023 of", "R.G.N.R. 123/2023"), ("DOCID", "Prot. n. 456/2024 of", "Prot. n. 456/2024"), ("DOCID", "protocollo num. 789 in", "protocollo num. 789"), ("DOCID", "repertorio 8891/2022 of", "repertorio 8891/2022"),
    ("DATE", "on 28/02/2024 09:15 at", "28/02/2024 09:15"), ("DATE", "on 3.7.1999 we", "3.7.1999"), ("TARGA", "car AB-123-CD here", "AB-123-CD"), ("AMOUNT", "sum € 12.500,00 due", "€ 12.500,00"), ("AMOUNT", "sum 1.250,00 EUR due", "1.250,00 EUR"),
    ("URL", "see https://x.it/page.", "https://x.it/page"), ("URL", "see studio.example.com, then", "studio.example.com"), ("EMAIL", "to m.rossi@studio.it now", "m.rossi@studio.it"),
]
MISSED = [
    ("IBAN", "IT61 X054 2811 1010 0000 0123 456"), ("IBAN", "IT61X0542811101000000123456"), ("IBAN", "AT29\n2914\n1777\n6317\n0669\n"), ("IBAN", "IT60 X0542 811 1010 0000 0123 456"), ("IBAN", f"{IBAN}7890 internal"), ("IBAN", "IT96 3B8J I6WA Q9YI    KB8S ASPB 8JO"), ("IBAN", "GR14 0172 7402 1280 ref"),
    ("CREDITCARDNUMBER", "4111 1111 1111 1112"), ("PIVA", "00743110158"), ("CF", "RSSMRA85H12F2LRA"), ("DOCID", "Art. 1234 of"), ("DOCID", "the Rep. Ceca in 1980"), ("DATE", "45/13/2025"), ("DATE", "12/06/1899"), ("DATE", "1/2/3"), ("URL", "la p.iva e n.ro S.r.l."), ("TELEPHONENUM", "+1 (743) 555-3824"),
]


def test_patterns_find_whole_values(spark):
    rows = [(i, label, text, want) for i, (label, text, want) in enumerate(FOUND)] + [(1000 + i, label, text, None) for i, (label, text) in enumerate(MISSED)]
    d = detect.detect(spark.createDataFrame(rows, "i int, label string, text string, want string"))
    for r in d.collect():
        own = [r.text[c.start : c.end] for c in r.candidates if c.label == r.label]
        assert (r.want in own) if r.want else not own, (r.text, own)


def test_a_canonical_tax_code_counts_even_if_its_letter_is_wrong(spark):
    r = detect.detect(spark.createDataFrame([("x RSSMRA85H12F205Z y",)], "text string")).first()
    assert [(c.label, c.validated, c.score) for c in r.candidates] == [("CF", False, 0.9)]


def test_generated_codes_are_valid(spark):
    d = spark.range(300).select(F.lpad((F.col("id") * 7919 % 10**10).cast("string"), 10, "0").alias("v"), F.lpad((F.col("id") * 15485863).cast("string"), 22, "7").alias("b"), "id")
    d = d.select(checks.piva_ok(checks.vat_number(F.col("v"))).alias("p"), checks.iban_ok(checks.iban_it(F.col("b"))).alias("i"), *[
        checks.cf_ok(checks.tax_code(F.lit("Niccolò"), F.lit("D'Amico"), F.when(F.col("id") % 2 == 0, "F").otherwise("M"), F.lit(1985), (F.col("id") % 12 + 1).cast("int"), (F.col("id") % 28 + 1).cast("int"), F.lit("F205"), k)).alias(f"c{k}") for k in range(8)])
    assert d.where(~(F.col("p") & F.col("i") & F.expr(" AND ".join(f"c{k}" for k in range(8))))).count() == 0
    r = spark.range(1).select(checks.tax_code(F.lit("Mario"), F.lit("Rossi"), F.lit("M"), F.lit(1985), F.lit(6), F.lit(12), F.lit("F205"), 0), checks.tax_code(F.lit("Mario"), F.lit("Rossi"), F.lit("M"), F.lit(1985), F.lit(6), F.lit(12), F.lit("F205"), 2)).first()
    assert tuple(r) == ("RSSMRA85H12F205Y", "RSSMRA85H12F2LRE")


def _random_case(rng):
    text = "".join(rng.choice("ab 1_é\t-") for _ in range(rng.randint(0, 40)))
    cands = []
    for i in range(rng.randint(0, 9)):
        s = rng.randint(0, max(0, len(text) - 1))
        e = min(len(text), s + rng.randint(1, 9))
        if s < e:
            cands.append((rng.choice(["A", "B", "DATE"]), s, e, rng.choice([0.5, 0.9, 1.0]), rng.random() < 0.3, rng.choice(["regex", "model"]), i))
    return text, cands


def plain_fusion(cands, text):
    """The rules one by one, without any index."""
    c = [dict(zip(("label", "start", "end", "score", "validated", "source", "ord"), x)) for x in cands]
    c.sort(key=lambda e: (e["validated"], e["source"] == "regex" and e["label"] != "DATE", e["score"], e["end"] - e["start"]), reverse=True)
    kept = []
    for e in c:
        if not any(k["end"] > e["start"] and k["start"] < e["end"] for k in kept):
            kept.append(e)
    kept.sort(key=lambda e: e["start"])
    out = []
    for e in kept:
        s, t = e["start"], e["end"]
        while s < t and text[s].isspace():
            s += 1
        while t > s and text[t - 1].isspace():
            t -= 1
        word = lambda ch: ch.isalnum() or ch == "_"
        if s == t:
            continue
        while s and word(text[s - 1]) and word(text[s]):
            s -= 1
        while t < len(text) and word(text[t]) and word(text[t - 1]):
            t += 1
        out.append(e | {"start": s, "end": t})
    out.sort(key=lambda e: (e["start"], -e["end"]))
    res = []
    for e in out:
        if res and (e["start"] < res[-1]["end"] or e["start"] == res[-1]["end"] and e["label"] == res[-1]["label"]):
            res[-1]["end"] = max(res[-1]["end"], e["end"])
        else:
            res.append(e)
    return [(e["label"], e["start"], e["end"], e["score"], e["source"]) for e in res]


def test_fusion_forms_agree_with_the_rules(spark):
    rng = random.Random(8)
    cases = [_random_case(rng) for _ in range(1500)]
    kind = pa.struct([("label", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("validated", pa.bool_()), ("source", pa.string()), ("ord", pa.int32())])
    for text, cands in cases:
        rows = pa.array([dict(zip(kind.names, x, strict=True)) for x in cands], kind)
        assert [(e["label"], e["start"], e["end"], e["score"], e["source"]) for e in fuse.fuse_list(rows, text).to_pylist()] == plain_fusion(cands, text)
    d = spark.createDataFrame([(i, t, c) for i, (t, c) in enumerate(cases[:400])], f"i int, text string, candidates {detect.SPANS}")
    for threshold in (400, 0):
        got = {r.i: [(e.label, e.start, e.end, e.score, e.source) for e in r.entities] for r in fuse.merge(d, threshold=threshold).collect()}
        assert all(got[i] == plain_fusion(c, t) for i, (t, c) in enumerate(cases[:400]))


def test_leftmost_label_wins_when_grown_spans_meet(spark):
    text = "VERDI77 x"
    c = [("A", 0, 2, 0.6, False, "model", 0), ("B", 3, 5, 0.99, False, "model", 1)]
    r = fuse.merge(spark.createDataFrame([(text, c)], f"text string, candidates {detect.SPANS}")).first()
    assert [(e.label, e.start, e.end) for e in r.entities] == [("A", 0, 7)]


def test_rewriting_and_restoring(spark):
    text = "Mail a@b.it and A@B.it, then c@d.it; site a.com, date 12/06/2025."
    d = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id int, text string")
    r = {x.doc_id: x for x in rewrite.analyse(d).collect()}
    assert r[1].anonymized_text == "Mail [EMAIL_1] and [EMAIL_1], then [EMAIL_2]; site [URL_1], date [DATE_1]."
    assert r[1].mapping == {"[EMAIL_1]": "a@b.it", "[EMAIL_2]": "c@d.it", "[URL_1]": "a.com", "[DATE_1]": "12/06/2025"}
    assert (r[1].n_entities, r[1].n_unique) == (5, 4) and r[1].by_label[0].value == "EMAIL"
    assert "".join(s.t for s in r[1].segments) == text
    assert r[2].anonymized_text == "" and r[2].n_entities == 0
    back = rewrite.analyse(d).select("doc_id", rewrite.restored(F.col("anonymized_text"), F.col("mapping"), strict=True).alias("t"))
    assert back.where("doc_id = 1").first().t == text.replace("A@B.it", "a@b.it")  # the first surface form is kept
    off = rewrite.analyse(d.where("doc_id = 1"), excluded=["EMAIL"]).first()
    assert [x.value for x in off.entities][:1] == ["b.it"]  # excluded before fusion: the domain is found instead
    one = rewrite.analyse(d.where("doc_id = 1"), reversible=False)
    assert "mapping" not in one.columns and all(s.t is None for s in one.first().segments if s.label)


def test_lenient_restore_takes_white_space_with_a_bare_name(spark):
    d = spark.createDataFrame([("x FULLNAME_1 y [ FULLNAME_2 ] $", {"[FULLNAME_1]": "A$1", "[FULLNAME_2]": "B"})], "t string, m map<string,string>")
    assert d.select(rewrite.restored(F.col("t"), F.col("m"))).first()[0] == "xA$1y B $"
    assert d.select(rewrite.restored(F.col("t"), F.col("m"), strict=True)).first()[0] == "x FULLNAME_1 y B $"


def test_redaction_of_values(spark):
    d = spark.createDataFrame([("Rossi and Rossini, 45, a Ros-\nsi.", {"[A_1]": "Rossi", "[N_1]": "45"})], "t string, m map<string,string>")
    r = d.select(rewrite.redacted(F.col("t"), F.col("m")).alias("x"), rewrite.residual(F.col("t"), F.col("m")).alias("left")).first()
    assert r.x == "█ and Rossini, 45, a █." and r.left == ["[A_1]"]


@pytest.mark.parametrize("n", [5, 900])
def test_many_candidates_in_one_document(spark, n):
    c = [("A", i * 4, i * 4 + 3, 0.9, False, "model", i) for i in range(n)]
    r = fuse.merge(spark.createDataFrame([("abc " * n, c)], f"text string, candidates {detect.SPANS}")).first()
    assert len(r.entities) == n


def test_numbering_of_long_lists_equals_that_of_short_ones(spark):
    rng = random.Random(4)
    words = ["Rossi", "ROSSI", " rossi", "Bianchi", "x  y", "X y", "z"]
    rows = []
    for i in range(60):
        text, cands = "", []
        for k in range(rng.randint(0, 25)):
            w = rng.choice(words)
            cands.append((rng.choice(["A", "B"]), len(text), len(text) + len(w), 0.9, False, "model", k))
            text += w + "|"
        rows.append((i, text, cands))
    d = spark.createDataFrame(rows, f"i int, text string, entities {detect.SPANS}")
    short, long = ({r.i: r.e for r in d.select("i", rewrite.with_placeholders(F.col("entities"), F.col("text"), t).alias("e")).collect()} for t in (None, 3))
    assert short == long
    for i, text, cands in rows:
        names, counts = {}, {}
        for got, (label, s, e, *_) in zip(short[i], cands, strict=True):
            k = (label, " ".join(text[s:e].split()).lower())
            first = k not in names
            if first:
                counts[label] = names[k] = counts.get(label, 0) + 1
            assert (got.n, got.first, got.ph) == (names[k], first, f"[{label}_{names[k]}]")


def test_model_spans_are_trimmed_grown_and_joined(spark):
    kind = detect.SPANS
    full = lambda rows: [(lab, a, b, 0.9, False, "model", i) for i, (lab, a, b) in enumerate(rows)]
    cases = [("Ada Bo scrive", [("N", 3, 6), ("N", 0, 3)], [("N", 0, 3), ("N", 4, 6)]), ("abcdef xy", [("Z", 0, 3), ("A", 2, 6), ("B", 7, 9)], [("A", 0, 6), ("B", 7, 9)]), ("ab-cd", [("X", 0, 2), ("X", 2, 5)], [("X", 0, 5)]), ("a   b", [("X", 1, 4)], []), ("", [], [])]
    d = spark.createDataFrame([(i, t, full(c)) for i, (t, c, _) in enumerate(cases)], f"i int, t string, c {kind}")
    got = {r.i: [(e.label, e.start, e.end) for e in r.s] for r in d.select("i", fuse.production_spans(F.col("c"), F.col("t")).alias("s")).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(cases)}
    with pytest.raises(Exception, match="outside"):
        spark.createDataFrame([("ab", full([("X", 0, 3)]))], f"t string, c {kind}").select(fuse.production_spans(F.col("c"), F.col("t"))).collect()
