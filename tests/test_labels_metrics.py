import pytest
from pyspark.sql import functions as F

from maskwright.functions import text
from maskwright.functions.taxonomy import final_label
from maskwright.operators import bio, dataset, metrics

TR = "array<struct<type:string,start:int,end:int>>"


def lab(s):
    return s.split()


def test_labels_are_normalised_and_cut_into_spans(spark):
    d = spark.createDataFrame([(lab("B-GIVENNAME I-SURNAME B-TITLE I-FULLNAME O I-TAXNUM I-TAXNUM"), lab("I-NAME I-NAME I-EMAIL B-EMAIL I-EMAIL"))], "a array<string>, b array<string>")
    r = d.select(bio.normalised(F.col("a")).alias("a"), bio.bio_to_spans(F.col("b")).alias("b")).first()
    assert r.a == lab("B-FULLNAME I-FULLNAME O B-FULLNAME O B-PIVA I-PIVA")
    assert [tuple(x) for x in r.b] == [("NAME", 0, 2), ("EMAIL", 2, 3), ("EMAIL", 3, 5)]
    assert spark.range(1).select(final_label(F.lit("CIG")), final_label(F.lit("CIG"), legacy=True), final_label(F.lit("TITLE"))).first()[:] == ("DOCID", "CIG", None)


def test_tokens_and_projection(spark):
    d = spark.createDataFrame([("perché Ada Bo, x", [("NAME", 7, 13), ("CITY", 15, 16)])], "t string, e array<struct<label:string,start:int,end:int>>")
    r = d.select(text.tokens(F.col("t")).alias("k"), bio.span_to_bio(text.tokens(F.col("t")), F.col("e")).alias("b")).first()
    assert [x.value for x in r.k] == ["perché", "Ada", "Bo", ",", "x"] and [x.start for x in r.k] == [0, 7, 11, 13, 15]
    assert r.b == ["O", "B-NAME", "I-NAME", "O", "B-CITY"]
    # an entity that begins inside a token: no B-, unless the first token inside gets it
    e = spark.createDataFrame([("abc def", [("X", 1, 7)])], "t string, e array<struct<label:string,start:int,end:int>>")
    k = text.tokens(F.col("t"))
    assert e.select(bio.span_to_bio(k, F.col("e")), bio.span_to_bio(k, F.col("e"), True)).first()[:] == (["O", "I-X"], ["O", "B-X"])


def test_find_all_offsets_beyond_the_basic_plane(spark):
    s = "😀é ab 12\n" * 200
    r = spark.createDataFrame([(s,)], "t string").select(text.find_all(F.col("t"), r"(?U)\w+").alias("m")).first()
    assert len(r.m) == 600 and all(s[x.start : x.end] == x.value for x in r.m)


def test_chunks(spark):
    d = spark.createDataFrame([(" ".join(map(str, range(n))),) for n in (0, 1, 120, 121, 321)], "t string").select(text.word_chunks(F.col("t")).alias("c"))
    assert [len(r.c) for r in d.collect()] == [0, 1, 1, 2, 4]
    last = d.collect()[3].c[-1]
    assert last.text.split()[0] == "100" and last.text.split()[-1] == "120"


def spans(spark, rows):
    return spark.createDataFrame(rows, "doc_id int, type string, start int, end int")


def test_scores(spark):
    gold = spans(spark, [(0, "NAME", 0, 2), (0, "EMAIL", 3, 4), (1, "CF", 1, 3)])
    pred = spans(spark, [(0, "NAME", 0, 2), (0, "PHONE", 3, 4), (1, "CF", 1, 3)])
    t = metrics.totals(gold, pred).first()
    assert (t.tp, t.fp, t.fn) == (2, 1, 1) and t.f1 == pytest.approx(2 / 3)
    assert (t.macro_f1_gold, t.macro_f1_all, t.macro_f1_hit) == (pytest.approx(2 / 3), pytest.approx(0.5), pytest.approx(2 / 3))
    per = {r.type: r for r in metrics.per_type(gold, pred).collect()}
    assert per["PHONE"].support == 0 and per["PHONE"].fp == 1
    e = metrics.exact_documents(spark.createDataFrame([(0,), (1,)], "doc_id int"), gold, pred).first()
    assert (e.exact, e.exact_rate) == (1, 0.5)
    limits = spark.createDataFrame([("f1", "EMAIL", "min_value", 0.9), ("recall", "CF", "max_drop", 0.005)], "metric string, type string, kind string, value double")
    base = metrics.per_type(gold, gold)
    assert [r.type for r in metrics.gate(base, metrics.per_type(gold, pred), limits).collect()] == ["EMAIL"]
    lost = metrics.per_type(gold, pred.where("type <> 'CF'"))
    assert {r.type for r in metrics.gate(base, lost, limits).collect()} == {"EMAIL", "CF"}


def test_coverage(spark):
    rows = [(1, "n. AB12 extra", [("ID_DOC", 3, 7)], [("ID_DOC", 3, 6), ("CF", 8, 13)]), (2, "ID ZX9é", [("ID_DOC", 3, 7)], [("CF", 3, 7)])]
    t = metrics.coverage_total(metrics.coverage(spark.createDataFrame(rows, f"doc_id int, text string, gold {TR}, pred {TR}"))).first()
    assert (t.sensitive, t.covered, t.leaked, t.type_correct, t.wrong_type, t.predicted, t.collateral) == (8, 7, 1, 3, 4, 12, 5)
    assert (t.entities_full, t.documents_full) == (1, 1) and t.mask_precision == pytest.approx(7 / 12) and t.collateral_ratio == pytest.approx(5 / 8)


def test_summary(spark):
    s = lambda v: metrics.summary(spark.createDataFrame([(x,) for x in v], "x double"), "x").first()
    r = s([1.0, None, 2.0, 3.0, 4.0])
    assert (r.n, r.p05, r.median, r.mean, r.p95, r.stdev) == (4, pytest.approx(1.15), 2.5, 2.5, pytest.approx(3.85), pytest.approx(1.118033988749895))
    assert s([None]).n == 0 and s([-1.0, 1.0]).cv is None
    with pytest.raises(Exception, match="finite"):
        s([float("nan")])


def test_windows(spark):
    rows = [(0, 0, 0, 5, False, 0, 1.0), (0, 1, 0, 5, False, 0, 3.0), (0, 0, 0, 5, False, 1, 2.0), (0, 1, 0, 5, False, 1, 2.0), (0, 0, 9, 9, True, 5, 9.0)]
    w = lambda r: spark.createDataFrame(r, "doc_id int, window int, start int, end int, special boolean, label_id int, logit double")
    assert [tuple(x) for x in bio.merged_windows(w(rows)).collect()] == [(0, 0, 5, 0)]
    with pytest.raises(Exception, match="disagree"):
        bio.merged_windows(w([*rows, (0, 1, 3, 7, False, 0, 1.0)])).collect()


def test_alignment(spark):
    d = spark.createDataFrame([([None, 0, 0, 1, None], lab("B-A O"), [(0, 2), (2, 4), (5, 6)], [("GIVENNAME", 0, 4)])], "w array<int>, l array<string>, o array<struct<start:int,end:int>>, e array<struct<label:string,start:int,end:int>>")
    r = d.select(bio.aligned_words(F.col("w"), F.col("l")), bio.aligned_chars(F.col("o"), F.col("e"))).first()
    assert r[0] == [None, "B-A", "I-A", "O", None] and r[1] == ["B-FULLNAME", "I-FULLNAME", "O"]
    with pytest.raises(ValueError):
        bio.check_inventory(["O", "B-A"])


def test_selection(spark):
    rows = spark.range(500).select(F.col("id").alias("k"), (F.col("id") % 3).alias("s"), F.when(F.col("id") % 50 == 0, F.array(F.lit("R"))).otherwise(F.array(F.lit("N"))).alias("tags"))
    pick = lambda d: sorted(r.k for r in dataset.stratified(d, 60, {"R": 5}, "tags", ["s"], "z", "k").collect())
    a = pick(rows)
    assert len(a) == 60 and sum(k % 50 == 0 for k in a) >= 5 and a == pick(rows.repartition(7))
    split = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), ("c", 3)], "split string, key int")
    assert [tuple(r) for r in dataset.leakage(split, "key").collect()] == [("a", "b", 1)]
    with pytest.raises(Exception, match="both sets"):
        dataset.require_disjoint(split.where("split = 'a'"), split.where("split = 'b'"), "key").collect()
    ident = spark.range(1).select(*[dataset.identifier(F.lit("q"), f, s).alias(f"{f} {s}") for f in dataset.FAMILIES for s in ("compact-upper", "grouped-space")]).first().asDict()
    assert all(v.replace(" ", "") == ident[k.split(" ")[0] + " compact-upper"] for k, v in ident.items())


def test_generated_records_keep_their_offsets(spark):
    t = spark.createDataFrame([("t1", "Il sig. {NAME} di {CITY}.", 1.0), ("t2", "{CITY}: {NAME}, {NAME}", 3.0)], "id string, template string, weight double")
    made = dataset.generate(spark, 200, t, {"NAME": dataset.pick(["Ada", "Bo", "Élia"], F.col("digest")), "CITY": F.concat(F.lit("C"), F.col("id").cast("string"))}, "s", cap=30).collect()
    assert 30 < len(made) <= 60 and all(e.value == r.text[e.start : e.end] for r in made for e in r.entities) and len({r.text for r in made}) == len(made)


def test_skeletons_with_raw_and_final_labels(spark):
    d = spark.createDataFrame([("Dr.  Ada\nBo, x", [("TITLE", 0, 3), ("GIVENNAME", 5, 8)])], "t string, e array<struct<label:string,start:int,end:int>>")
    assert d.select(dataset.skeleton(F.col("t"), F.col("e")), dataset.skeleton(F.col("t"), F.col("e"), True)).first()[:] == ("<TITLE> <GIVENNAME> Bo, x", "<O> <FULLNAME> Bo, x")


def test_schedule_and_report(spark):
    cells = metrics.latin_square(list("AB"), 2)
    full = spark.createDataFrame(cells, "round int, position int, variant string")
    assert metrics.schedule_gaps(full, full).count() == 0 and metrics.schedule_gaps(full, full.limit(3)).count() == 1
    r = metrics.rotation(spark.createDataFrame([(k,) for k in (7, 3, 5)], "round int"), spark.createDataFrame([(k,) for k in "BAC"], "variant string")).collect()
    assert sorted(map(tuple, r)) == [(k, p, "ABC"[(i + p) % 3]) for i, k in enumerate((3, 5, 7)) for p in range(3)]


def test_regression_report_fails_closed(spark):
    def told(runs, evidence, policies=(("B", "g"),), failures=(), golden="A"):
        d = spark.createDataFrame
        out = metrics.regression_report(d(runs, "variant string, run int, status string, documents int, digest string"), d(evidence, "kind string, variant string, expected string, actual string"), d(list(policies), "variant string, gate string"), d(list(failures), "variant string, gate string"), golden)
        return {r.variant: (r.verdict, r.reasons) for r in out.collect()}

    runs = [("A", 1, "ok", 5, "x"), ("B", 1, "ok", 5, "y"), ("B", 2, "ok", 5, "y")]
    evidence = [("validation", None, "v", "v"), ("documents", None, "5", None)]
    assert told(runs, evidence) == {"A": ("passed", []), "B": ("passed", [])}
    assert told(runs, [("validation", None, "v", None), *evidence[1:]])["B"] == ("incomplete", ["missing digest"])
    assert told(runs, evidence, policies=())["B"] == ("incomplete", ["no policy"])
    assert told(runs, evidence, failures=[("B", "words.metrics_missing")])["B"] == ("failed", ["gates"])
    assert told(runs[1:], evidence)["B"] == ("incomplete", ["no golden"])
    assert told(runs, [])["A"] == ("incomplete", ["no evidence", "documents unknown"])
    assert told(runs, [*evidence, ("preprocessor", "B", "p", "q")]) == {"A": ("passed", []), "B": ("failed", ["unlike digests"])}
    odd = [("A", 1, "ok", 4, None), ("B", 1, "stopped", 5, "y"), ("B", 2, "ok", None, "z")]
    assert told(odd, evidence) == {"A": ("failed", ["documents", "predictions without a digest"]), "B": ("failed", ["a run did not end well", "runs differ", "documents unknown"])}


def test_slots_and_names(spark):
    d = spark.createDataFrame([("a {X} Ada Bo {Y}",), ("end. Ada goes",), ("Dott Rossi said",), ("привет",)], "t string")
    r = d.select(text.slots(F.col("t")).alias("s"), F.size(text.stray_names(F.col("t"))).alias("n"), text.non_latin(F.col("t")).alias("l"), text.glued(F.lit("x[CITY_1]")).alias("g")).collect()
    assert [x.s for x in r][0] == ["X", "Y"] and [x.n for x in r] == [1, 0, 1, 0] and r[3].l == "п" and r[0].g
