"""Queries: synthesised records, capacity of templates, composed validation rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cover, dataset, synthesis
from ..streaming.stateful import low_runs
from .registry import query, table

_MIX = "m AS (SELECT c_custkey, row_number() OVER (ORDER BY sha256('mix:' || c_custkey), c_custkey) AS r, count(*) OVER () AS n FROM customer), k AS (SELECT c_custkey, CASE WHEN r <= floor(n * 0.4) THEN 'positive' WHEN r <= floor(n * 0.4) + floor(n * 0.3) THEN 'hard_negative' ELSE 'mixed' END AS category FROM m)"
_SHARES = {"positive": 0.4, "hard_negative": 0.3, "mixed": 0.3}
#: what a template says besides its slots; a plate's form is a label in two categories and just a code in the third
_TEMPLATES = [
    ("positive", 0, "Sul piazzale resta un furgone con targa {TARGA}."), ("positive", 1, "La multa riguarda {TARGA}."), ("hard_negative", 2, "Il pacco porta il codice {CODE} sul lato."), ("hard_negative", 3, "Matrice {CODE}, terzo scaffale."),
    ("mixed", 4, "{FULLNAME}, C.F. {CF}, guida {TARGA} per la ditta con P.IVA {PIVA}."), ("mixed", 5, "Alla guida di {TARGA}: {FULLNAME} (C.F. {CF}); fattura a P.IVA {PIVA}."),
]


def _records(spark, sf_dir):
    rows = synthesis.category_mix(table(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", _SHARES, "mix")
    code = {"CODE": lambda s: F.array(F.struct(synthesis.plate(s, 0, 0).alias("text"), F.lit(None).cast("string").alias("label"))).cast(synthesis.PIECE)}
    return synthesis.synthesise(rows, "c_custkey", spark.createDataFrame(_TEMPLATES, "category string, template_id int, template string"), 11, extra=code)


@query(f"WITH {_MIX} SELECT category, count(*) AS n, count(*) AS n_texts FROM k GROUP BY category")
def synth_mix(spark, sf_dir):
    """Plate records for the customers: an exact mix of categories, and as many different texts as rows."""
    return _records(spark, sf_dir).groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("text").alias("n_texts"))


@query(f"WITH {_MIX} SELECT c_custkey, category, CASE category WHEN 'positive' THEN 1 WHEN 'mixed' THEN 5 ELSE 0 END AS n_entities, CAST(NULL AS VARCHAR) AS fault, true AS has_plate FROM k")
def synth_records(spark, sf_dir):
    """Every record checked: values at their places, checksums, and a plate's form in the text whatever its label."""
    t = F.col("text")
    return _records(spark, sf_dir).select("c_custkey", "category", F.size("entities").alias("n_entities"), synthesis.record_fault(t, F.col("entities")).alias("fault"), t.rlike(r"\b[A-Z]{2}[ -]?\d{3}[ -]?[A-Z]{2}\b").alias("has_plate"))


@query("""WITH p AS (SELECT o_orderpriority || o_custkey % 40 AS template, o_orderstatus || month(o_orderdate) AS structure, count(*) AS n FROM orders GROUP BY ALL)
SELECT template, sum(n)::BIGINT AS drawn, count(*) AS structures, sum(least(n, 3))::BIGINT AS kept, (sum(n) - sum(least(n, 3)))::BIGINT AS refused, sum(CASE WHEN n >= 3 THEN 1 ELSE 0 END)::BIGINT AS "full", bool_and(n >= 3) AS exhausted FROM p GROUP BY template""")
def template_report(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.concat("o_orderpriority", (F.col("o_custkey") % 40).cast("string")).alias("template"), F.concat("o_orderstatus", F.month("o_orderdate").cast("string")).alias("structure"))
    return dataset.capacity_report(o, "template", "structure", 3)


@query("""WITH t AS (SELECT o_custkey AS k, count(*) AS weight, least(count(*), 1 + o_custkey % 9) AS capacity FROM orders GROUP BY o_custkey),
r AS (SELECT *, capacity / weight::DOUBLE AS lev, sum(capacity) OVER o AS caps, sum(weight) OVER o AS weights, sum(weight) OVER () AS whole FROM t WINDOW o AS (ORDER BY capacity / weight::DOUBLE, k)),
f AS (SELECT *, caps + lev * (whole - weights) <= 3000.0 AS is_full FROM r),
s AS (SELECT *, (3000 - coalesce(max(caps) FILTER (is_full) OVER (), 0)) AS rest, whole - coalesce(max(weights) FILTER (is_full) OVER (), 0) AS remain FROM f),
g AS (SELECT *, weight::DOUBLE * (rest::DOUBLE / remain::DOUBLE) AS share FROM s),
h AS (SELECT *, row_number() OVER (PARTITION BY is_full ORDER BY floor(share) - share, k) AS rnk, sum(floor(share)) FILTER (NOT is_full) OVER () AS floors FROM g)
SELECT k, weight, capacity, CASE WHEN is_full THEN capacity ELSE floor(share)::BIGINT + CASE WHEN rnk <= rest - floors THEN 1 ELSE 0 END END AS planned FROM h""")
def template_plan(spark, sf_dir):
    """3,000 rows dealt to customers in proportion to their orders, each up to a capacity of its own."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count(F.lit(1)).alias("weight"))
    return dataset.apportioned(o.withColumn("capacity", F.least("weight", 1 + F.col("k") % 9)), "k", 3000)


_SNIPPETS = [("CF", "codice fiscale {CF}."), ("PIVA", "partita IVA {PIVA}."), ("CATASTO", "al catasto {CATASTO}."), ("DOCID", "prot. n. {DOCID}."), ("PROVINCE", "in provincia di {PROVINCE}.")]


@query("""WITH p AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents),
t AS (SELECT tag, number, row_number() OVER (ORDER BY tag, number) - 1 AS j FROM (SELECT unnest(['CF', 'PIVA', 'CATASTO', 'DOCID', 'PROVINCE']) AS tag), (SELECT unnest(range(300)) AS number))
SELECT tag, number, doc_id, CASE tag WHEN 'CATASTO' THEN 6 ELSE 2 END AS n_entities, true AS well_formed FROM t JOIN p ON i = j % n""")
def validation_build(spark, sf_dir):
    """Documents with two made snippets of a tag behind their sentences: 300 of each tag, documents in turn; each label's text must have its value's form."""
    pool = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.array().cast("array<struct<label:string,start:int,end:int>>").alias("entities"))
    d = synthesis.injected_rows(pool, "doc_id", spark.createDataFrame(_SNIPPETS, "tag string, snippet string"), 300, 6, several=2)
    forms = F.create_map(*[F.lit(x) for pair in {"CF": "[A-Z]{6}[0-9A-Z]{9}[A-Z]", "PIVA": "[0-9]{11}", "CATASTO": "[0-9]{1,3}", "DOCID": "[0-9]+(/20[0-9]{2})?", "PROVINCE": "[A-Z]{2}"}.items() for x in pair])
    ok = F.forall("entities", lambda e: (e["label"] == F.col("tag")) & F.regexp_like(F.substring("text", e["start"] + 1, e["end"] - e["start"]), F.concat(F.lit("^("), F.element_at(forms, e["label"]), F.lit(")$"))))
    return d.select("tag", "number", "doc_id", F.size("entities").alias("n_entities"), ok.alias("well_formed"))


_FEATURES = "[CASE o_custkey % 9 WHEN 0 THEN 'numeric' WHEN 1 THEN 'passport' ELSE 'driving' END, CASE o_orderkey % 7 WHEN 0 THEN 'grouped' ELSE 'compact' END, CASE WHEN o_orderkey % 50 = 3 THEN 'decoy' ELSE 'plain' END]"
_FLOORS = {"numeric": 120, "passport": 40, "grouped": 90, "decoy": 60}


def _cover_pass(n: int, level: int) -> str:
    """The rows of one pass: those for which at least `level` of the features that are short ask."""
    return f"""
, f{n} AS (SELECT b.k, b.o, x.f FROM b, unnest(b.features) AS x(f) JOIN s{n} ON s{n}.f = x.f WHERE b.k NOT IN (SELECT k FROM t{n}) AND s{n}.short > 0)
, g{n} AS (SELECT k, o, f FROM f{n} QUALIFY count(*) OVER (PARTITION BY k) >= {level})
, a{n} AS (SELECT g.k, row_number() OVER (PARTITION BY g.f ORDER BY g.o, g.k) <= s.short AS asks FROM g{n} g JOIN s{n} s ON s.f = g.f)
, t{n + 1} AS MATERIALIZED (SELECT k FROM t{n} UNION ALL SELECT k FROM a{n} GROUP BY k HAVING count(*) FILTER (asks) >= {level})
, s{n + 1} AS MATERIALIZED (SELECT w.f, w.n - (SELECT count(*) FROM b JOIN t{n + 1} t ON t.k = b.k WHERE list_contains(b.features, w.f)) AS short FROM w)"""


@query(f"""WITH b AS MATERIALIZED (SELECT o_orderkey AS k, sha256('cov:' || o_orderkey) AS o, {_FEATURES} AS features FROM orders)
, w(f, n) AS (VALUES {", ".join(f"('{f}', {n})" for f, n in _FLOORS.items())}), t0(k) AS (SELECT o_orderkey FROM orders WHERE false), s0 AS (SELECT f, n AS short FROM w)
{_cover_pass(0, 2)}{_cover_pass(1, 2)}{_cover_pass(2, 2)}{_cover_pass(3, 1)} SELECT k AS o_orderkey FROM t4""")
def cover_floors(spark, sf_dir):
    """Orders that meet floors of four features together, those that serve two at once first."""
    o = table(spark, sf_dir, "orders")
    feature = lambda c, cases, other: F.coalesce(*[F.when(c == v, n) for v, n in cases], F.lit(other))
    features = F.array(feature(F.col("o_custkey") % 9, ((0, "numeric"), (1, "passport")), "driving"), feature(F.col("o_orderkey") % 7, ((0, "grouped"),), "compact"), feature(F.col("o_orderkey") % 50, ((3, "decoy"),), "plain"))
    rows = o.select("o_orderkey", F.col("o_orderkey").cast("string").alias("skeleton"), features.alias("features"))
    return cover.cover(rows, "o_orderkey", "skeleton", "features", _FLOORS, "cov", levels=(2, 1)).select("o_orderkey")


@query("""WITH s AS (SELECT user_id, ts, event_id, value, coalesce(value < 30, false) AS low FROM events),
e AS (SELECT *, sum(CASE WHEN low THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS ended FROM s)
SELECT user_id, event_id FROM e WHERE low QUALIFY row_number() OVER (PARTITION BY user_id, ended ORDER BY ts, event_id) = 2""")
def low_sample_runs(spark, sf_dir):
    """Users' second low event in a row; any other event starts anew."""
    d = low_runs(table(spark, sf_dir, "events"), "user_id", "ts", "value", "event_id", 30.0)
    return d.select(F.col("key").cast("long").alias("user_id"), F.col("id").alias("event_id"))
