import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from maskwright.functions import checks
from maskwright.operators import synthesis as sy


def _make(spark, n, template, seed=3):
    d = spark.range(n).withColumn("attempt", F.lit(0))
    made = sy.generators(seed, F.col("id"), F.col("attempt"))
    made = {k: f for k, f in made.items() if f"{{{k}}}" in template or template == "x"}
    return d.select("id", sy.rendered(F.lit(template), made).alias("r")).select("id", "r.*"), made


def test_every_slot_gives_values_at_their_places(spark):
    _, made = _make(spark, 1, "x")
    assert len(made) == 33
    d, _ = _make(spark, 60, " ".join(f"{s.lower()}: {{{s}}};" for s in made) + " {OTHER} end")
    d = d.select("id", "text", "entities", sy.record_fault(F.col("text"), F.col("entities")).alias("fault"))
    rows = d.collect()
    assert {r.fault for r in rows} == {None} and len({r.text for r in rows}) == 60 and all("{OTHER} end" in r.text for r in rows)
    labels = {e.label for r in rows for e in r.entities}
    assert {"GIVENNAME", "SURNAME", "GIUDICE", "AVVOCATO", "ATTORE", "CONVENUTO", "TESTIMONE", "CF", "PIVA", "IBAN", "STREET", "EMAIL", "PEC", "TELEPHONENUM", "AMOUNT", "RG", "TARGA", "IDCARDNUM", "DRIVERLICENSENUM", "ORG", "DOCID", "CATASTO", "CONTO", "CIG", "CUP", "POLIZZA", "MATRICOLA"} <= labels
    forms = {"TARGA": r"[A-Z]{2}[ -]?\d{3}[ -]?[A-Z]{2}", "CIG": r"[A-Z0-9]{10}", "CUP": r"[A-Z]\d{2}[A-Z]{2}\d{10}", "AMOUNT": r"€ \d{1,3}(\.\d{3})?,00", "TELEPHONENUM": r"\+39 3\d{2} \d{7}", "CONTO": r"\d{12}", "DATE": r"\d\d/\d\d/(19|20)\d\d"}
    assert all(re.fullmatch(forms[e.label], e.value) for r in rows for e in r.entities if e.label in forms)


def _code(given, surname, sex, date, place):
    """A tax code without its last letter, by the public rules."""
    plain = lambda s: re.sub("[^A-Za-z]", "", unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode()).upper()
    split = lambda s: ("".join(c for c in plain(s) if c not in "AEIOU"), "".join(c for c in plain(s) if c in "AEIOU"))
    (gc, gv), (sc, sv) = split(given), split(surname)
    d, m, y = date.split("/")
    return (sc + sv + "XXX")[:3] + (gc[0] + gc[2:4] if len(gc) > 3 else (gc + gv + "XXX")[:3]) + y[2:] + "ABCDEHLMPRST"[int(m) - 1] + f"{int(d) + 40 * (sex == 'F'):02d}" + place


def test_the_fields_of_a_person_agree(spark):
    d, _ = _make(spark, 300, "{FULLNAME} {CF} {DATE} {CITY} {PROVINCE} {EMAIL}|{FULLNAME} {CF} {DATE} {CITY} {PROVINCE} {EMAIL}")
    lists, omocodes = sy.Lists(), 0
    towns = {t[0]: t for t in lists.towns}
    for r in d.collect():
        people = [{e.label: e.value for e in r.entities if a <= e.start < b} for a, b in ((0, r.text.index("|")), (r.text.index("|"), len(r.text)))]
        assert people[0]["CF"] != people[1]["CF"]
        for p in people:
            sex = "M" if p["GIVENNAME"] in lists.male else "F"
            place = towns[p["CITY"]]
            want = _code(p["GIVENNAME"], p["SURNAME"], sex, p["DATE"], place[1])
            plain = "".join(str("LMNPQRSTUV".index(c)) if i in (6, 7, 9, 10, 12, 13, 14) and c in "LMNPQRSTUV" else c for i, c in enumerate(p["CF"][:15]))
            omocodes += plain != p["CF"][:15]
            assert plain == want and p["PROVINCE"] == place[2]
            assert p["EMAIL"] == "@".join([".".join(re.sub("[^a-z]", "", unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode().lower()) for x in (p["GIVENNAME"], p["SURNAME"])), "example.it"])
    assert 5 < omocodes < 90


def test_letters_without_their_marks(spark):
    cases = ["Nicolò", "D'Angelo", "Škoda", "ﬁne", "Łódź", "Straße", "ÆØ", "Ǆ", "ＡＢ", "Ⅷ", "é̀x", "", "中"]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(cases)), "i int, s string").orderBy("i").select(checks.letters_only(F.col("s"))).collect()]
    assert got == [re.sub("[^A-Za-z]", "", unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode()).upper() for s in cases]


def test_draws_are_the_same_for_any_partitioning(spark):
    d, made = _make(spark, 50, "{FULLNAME} {ORG} {NAMELIST}")
    want = sorted((r.id, r.text) for r in d.collect())
    e = spark.range(50).repartition(7).withColumn("attempt", F.lit(0)).select("id", sy.rendered(F.lit("{FULLNAME} {ORG} {NAMELIST}"), made)["text"].alias("text"))
    assert sorted(map(tuple, e.collect())) == want


def test_mix_and_distinct_texts_by_rounds(spark):
    rows = sy.category_mix(spark.range(1001).withColumnRenamed("id", "k").repartition(5), "k", {"positive": 0.4, "hard_negative": 0.3, "mixed": 0.3}, "s")
    assert {r.category: r["count"] for r in rows.groupBy("category").count().collect()} == {"positive": 400, "hard_negative": 300, "mixed": 301}
    templates = spark.createDataFrame([("positive", 0, "auto {TARGA}"), ("hard_negative", 1, "lotto {SMALL}"), ("hard_negative", 2, "codice {SMALL}"), ("mixed", 3, "{FULLNAME} guida {TARGA}")], "category string, template_id int, template string")
    small = {"SMALL": lambda s: F.array(F.struct(s.below(200, "n").cast("string").alias("text"), F.lit(None).cast("string").alias("label"))).cast(sy.PIECE)}
    out = sy.synthesise(rows, "k", templates, 5, extra=small, rounds=60)
    got = out.collect()
    assert len(got) == len({r.k for r in got}) == len({r.text for r in got}) == 1001  # 300 of the 400 texts that the second category has
    again = sy.synthesise(rows.repartition(3), "k", templates, 5, extra=small, rounds=60).collect()
    assert sorted((r.k, r.text) for r in got) == sorted((r.k, r.text) for r in again)
    assert out.where(sy.record_fault(F.col("text"), F.col("entities")).isNotNull()).count() == 0
    with pytest.raises(ValueError, match="too few"):
        sy.synthesise(rows.limit(300).withColumn("category", F.lit("hard_negative")), "k", templates, 5, extra={"SMALL": lambda s: F.array(F.struct(F.lit("x").alias("text"), F.lit(None).cast("string").alias("label"))).cast(sy.PIECE)}, rounds=2)


def test_faults_are_told(spark):
    e = "array<struct<value:string,label:string,start:int,end:int>>"
    rows = [("ab cd", [("ab", "X", 0, 2)]), ("ab cd", [("ab", "X", 1, 3)]), ("abcd", [("abc", "X", 0, 3), ("cd", "X", 2, 4)]), ("00743110158", [("00743110158", "PIVA", 0, 11)]), ("x", [])]
    got = [r[0] for r in spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, t string, e {e}").orderBy("i").select(sy.record_fault(F.col("t"), F.col("e"))).collect()]
    assert got == [None, "offset", "overlap", "VAT number", None]
