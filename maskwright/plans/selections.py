"""Queries: targeted selection, masks, record checks, label views, substitution."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..functions.arrays import unfolded
from ..operators import bio, dataset, fuse, metrics, rewrite, selection, values
from ..sources import records
from .evaluation import _BASE, _O, _TYPED, _WORDS, _gold, _labels, _pred
from .registry import query, table

# ------------------------------------------------------------ selection

_ROWS = "r AS (SELECT CAST(doc_id AS VARCHAR) AS record_id, lang || '-' || n_chars % 97 AS skeleton, CASE doc_id % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' WHEN 2 THEN 'c' END AS variant, source, n_chars, doc_id % 5 = 0 AS has_x, doc_id % 7 = 0 AS has_y, CASE WHEN n_chars < 512 THEN '0000-0511' WHEN n_chars < 1024 THEN '0512-1023' WHEN n_chars < 1536 THEN '1024-1535' ELSE '1536-plus' END AS bin FROM documents)"


def _rows(spark, sf_dir):
    tag = lambda n, name: F.when(F.col("doc_id") % n == 0, F.lit(name))
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("record_id"), F.concat("lang", F.lit("-"), (F.col("n_chars") % 97).cast("string")).alias("skeleton"), F.element_at(F.array(*map(F.lit, "abc"), F.lit(None)), (F.col("doc_id") % 4 + 1).cast("int")).alias("variant"),
        F.array_compact(F.array(tag(5, "X"), tag(7, "Y"))).alias("tags"), dataset.length_bin(F.col("n_chars")).alias("length_bin"))


def _steps(*steps: tuple[str, int, str]) -> str:
    """SQL of picks one after the other: (condition, how many, salt); each skips what was picked before."""
    out = []
    for i, (where, n, salt) in enumerate(steps):
        before = "".join(f" AND skeleton NOT IN (SELECT skeleton FROM k{j}) AND record_id NOT IN (SELECT record_id FROM k{j})" for j in range(i))
        h = f"sha256('{salt}:' || record_id)"
        out.append(f"k{i} AS (SELECT record_id, skeleton FROM (SELECT *, {h} AS h FROM r WHERE ({where}){before} QUALIFY row_number() OVER (PARTITION BY skeleton ORDER BY {h}, record_id) = 1) ORDER BY h, record_id LIMIT {n})")
    return f"WITH {_ROWS}, {', '.join(out)}"


def _picked(n: int, names: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT record_id, skeleton, '{names[i]}' AS reason FROM k{i}" for i in range(n))


@query(f"""{_steps(("variant = 'a'", 4, "s:a"), ("variant = 'b'", 3, "s:b"), ("variant = 'c'", 3, "s:c"))} {_picked(3, ["hard-negative:a", "hard-negative:b", "hard-negative:c"])}""")
def balanced_negatives(spark, sf_dir):
    picks = selection.Picks(_rows(spark, sf_dir))
    selection.balanced(picks, 10, ("a", "b", "c"), "s")
    return picks.frame().select("record_id", "skeleton", "reason")


@query(f"""{_steps(("has_x", 6, "t:protected:X"), ("has_y", 6, "t:protected:Y"), ("true", 8, "t:general"))} {_picked(3, ["replay-protected:X", "replay-protected:Y", "replay-general"])}""")
def replay_selection(spark, sf_dir):
    picks = selection.Picks(_rows(spark, sf_dir))
    selection.replay(picks, 20, 6, ["X", "Y"], "t")
    return picks.frame().select("record_id", "skeleton", "reason")


_BIN = "bin = '1536-plus' AND has_x"


@query(f"""{_steps((_BIN, 5, "u:1536-plus:X:exact-length-and-focus"), ("bin = '9999-none' AND has_y", 4, "u:9999-none:Y:exact-length-and-focus"), ("has_y", 4, "u:9999-none:Y:focus-only"))} SELECT record_id, skeleton, 'exact-length-and-focus' AS level FROM k0 UNION ALL SELECT record_id, skeleton, 'exact-length-and-focus' FROM k1 UNION ALL SELECT record_id, skeleton, 'focus-only' FROM k2""")
def control_selection(spark, sf_dir):
    """A length that no row has falls back on its focus alone."""
    picks = selection.Picks(_rows(spark, sf_dir))
    selection.control(picks, {("1536-plus", "X"): 5, ("9999-none", "Y"): 4}, "u")
    return picks.frame().select("record_id", "skeleton", "level")


@query("SELECT lang, count(*) AS n_rows, round(avg(n_chars), 6) AS mean_chars, count(*) FILTER (doc_id % 6 > 2) AS target_docs, CAST(sum(CASE WHEN doc_id % 6 > 2 THEN doc_id % 6 - 2 ELSE 0 END) AS BIGINT) AS target_entities FROM documents GROUP BY lang")
def selection_stats(spark, sf_dir):
    d = table(spark, sf_dir, "documents").selectExpr("lang", "n_chars AS chars", "greatest(0, doc_id % 6 - 2) AS target_entities")
    return selection.statistics(d, "lang").withColumn("mean_chars", F.round("mean_chars", 6))


@query("WITH s AS (SELECT source, count(*) FILTER (doc_id % 10 = 0 AND source <> 'web') AS a, count(*) AS b FROM documents GROUP BY source) SELECT source, a AS subset_rows, b AS pool_rows, round(coalesce(100.0 * a / nullif(sum(a) OVER (), 0), 0), 6) AS subset_percent, round(100.0 * b / sum(b) OVER (), 6) AS pool_percent, a = 0 AS missing FROM s")
def subset_vs_pool(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    out = selection.against_pool(d.where("doc_id % 10 = 0 AND source <> 'web'"), d, "source")
    return out.withColumns({c: F.round(c, 6) for c in ("subset_percent", "pool_percent")})


@query("SELECT doc_id, text, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def payload_fetch(spark, sf_dir):
    return selection.payloads(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id")


@query("SELECT c_custkey, i AS copy, c_mktsegment || '-' || i AS template FROM customer, range(0, 3) t(i)")
def template_rows(spark, sf_dir):
    """Every template with every copy number: a bounded cross."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("copy"))
    return c.select("c_custkey", F.col("copy").cast("long").alias("copy"), F.concat("c_mktsegment", F.lit("-"), F.col("copy").cast("string")).alias("template"))


# ------------------------------------------------------------ metrics

@query(f"{_BASE}{_O}, d AS (SELECT doc_id, count(*) FILTER (in_g AND in_p) AS tp, count(*) FILTER (NOT in_g AND in_p) AS fp, count(*) FILTER (in_g AND NOT in_p) AS fn FROM o GROUP BY doc_id) SELECT CAST(doc_id % 3 AS INT) AS pipeline, doc_id, tp, fp, fn FROM d WHERE fp > 0 OR fn > 0 QUALIFY row_number() OVER (PARTITION BY doc_id % 3 ORDER BY doc_id) <= 12")
def error_examples(spark, sf_dir):
    d = metrics._counted(metrics.outcomes(_gold(spark, sf_dir), _pred(spark, sf_dir)), "doc_id").withColumn("pipeline", (F.col("doc_id") % 3).cast("int"))
    return metrics.error_examples(d, "pipeline").select("pipeline", "doc_id", "tp", "fp", "fn")


@query(f"{_BASE}{_O} SELECT count(*) FILTER (in_g <> in_p) AS n FROM o")
def symmetric_difference(spark, sf_dir):
    return metrics.symmetric_difference(_gold(spark, sf_dir), _pred(spark, sf_dir))


@query("SELECT o_orderkey, o_orderkey % 6 <= o_custkey % 6 AS within FROM orders")
def subset_test(spark, sf_dir):
    """Whether 0..a is a subset of 0..b."""
    upto = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) % 6)
    return table(spark, sf_dir, "orders").select("o_orderkey", metrics.subset_of(upto("o_orderkey"), upto("o_custkey")).alias("within"))


_MASKS = "t AS (SELECT l_orderkey AS w, CASE WHEN l_partkey % 5 = 0 THEN NULL WHEN l_partkey % 5 = 1 THEN 'O' WHEN l_partkey % 5 = 2 THEN 'B-CF' WHEN l_partkey % 5 = 3 THEN 'I-CF' ELSE 'B-NAME' END AS g, CASE l_suppkey % 4 WHEN 0 THEN 'O' WHEN 1 THEN 'B-CF' WHEN 2 THEN 'I-CF' ELSE 'B-NAME' END AS t FROM lineitem)"


@query(f"""WITH {_MASKS}, x AS (SELECT w, g = t AS e, regexp_replace(g, '^[BI]-', '') = regexp_replace(t, '^[BI]-', '') AS s FROM t WHERE g IS NOT NULL), p AS (SELECT DISTINCT w FROM t),
c AS (SELECT w, count(*) AS supervised, count(*) FILTER (e) AS exact, count(*) FILTER (s AND NOT e) AS bio_only, count(*) FILTER (NOT s) AS mismatch, count(*) FILTER (s) AS active FROM x GROUP BY w),
a AS (SELECT coalesce(supervised, 0) AS supervised, coalesce(exact, 0) AS exact, coalesce(bio_only, 0) AS bio_only, coalesce(mismatch, 0) AS mismatch, coalesce(active, 0) AS active FROM p LEFT JOIN c USING (w)),
s AS (SELECT CAST(sum(supervised) AS BIGINT) AS supervised, CAST(sum(exact) AS BIGINT) AS exact, CAST(sum(bio_only) AS BIGINT) AS bio_only, CAST(sum(mismatch) AS BIGINT) AS mismatch, CAST(sum(active) AS BIGINT) AS active, count(*) FILTER (active = 0) AS windows_without, min(active) AS least_active, max(active) AS most_active FROM a)
SELECT *, supervised - active AS excluded, round(active * 1.0 / supervised, 9) AS coverage FROM s""")
def mask_statistics(spark, sf_dir):
    gold = "CASE WHEN l_partkey % 5 = 0 THEN NULL WHEN l_partkey % 5 = 1 THEN 'O' WHEN l_partkey % 5 = 2 THEN 'B-CF' WHEN l_partkey % 5 = 3 THEN 'I-CF' ELSE 'B-NAME' END"
    teacher = "CASE l_suppkey % 4 WHEN 0 THEN 'O' WHEN 1 THEN 'B-CF' WHEN 2 THEN 'I-CF' ELSE 'B-NAME' END"
    t = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS window", f"{gold} AS gold", f"{teacher} AS teacher")
    return metrics.mask_statistics(t).withColumn("coverage", F.round("coverage", 9))


# ------------------------------------------------------------ labels

@query(f"WITH {_WORDS}{_TYPED}, s AS (SELECT *, CASE WHEN type IS NOT NULL AND lag(type) OVER (PARTITION BY doc_id ORDER BY pos) IS DISTINCT FROM type THEN 1 ELSE 0 END AS b FROM t) SELECT doc_id, count(*) FILTER (b = 1) AS n_islands, count(*) FILTER (type IS NOT NULL) AS n_tokens FROM s GROUP BY doc_id")
def bio_islands(spark, sf_dir):
    d = _labels(spark, sf_dir).where(F.size("words") > 0).select("doc_id", bio.bio_to_spans(F.col("labels")).alias("s"))
    return d.select("doc_id", F.size("s").cast("long").alias("n_islands"), F.aggregate("s", F.lit(0), lambda a, x: a + x["end"] - x["start"]).cast("long").alias("n_tokens"))


@query(f"WITH {_WORDS}{_TYPED} SELECT type AS label, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM t WHERE type IS NOT NULL GROUP BY type")
def count_by_label(spark, sf_dir):
    d = _labels(spark, sf_dir).select("doc_id", F.explode("labels").alias("x")).where("x <> 'O'")
    return d.groupBy(bio.type_of(F.col("x")).alias("label")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("n_docs"))


# subwords made from orders: a customer's orders are words of two pieces; some pieces are special, some have no characters
_PIECES = """q AS (SELECT o_custkey AS doc_id, o_orderkey * 2 + k AS pos, CASE (o_orderkey // 3 + k) % 4 WHEN 0 THEN 'O' WHEN 1 THEN 'B-NAME' WHEN 2 THEN 'I-NAME' ELSE 'CITY' END AS label, k * 3 AS s, CASE WHEN o_orderkey % 17 = 0 THEN k * 3 ELSE k * 3 + 3 END AS e, o_orderkey % 13 = 1 AS special, o_orderkey * 10 AS base FROM orders, range(0, 2) t(k)),
z AS (SELECT *, CASE WHEN label = 'O' THEN NULL ELSE regexp_replace(label, '^[BI]-', '') END AS type, e <= s AS shut FROM q WHERE NOT special),
y AS (SELECT *, CASE WHEN type IS NOT NULL AND (label LIKE 'B-%' OR coalesce(CASE WHEN lag(shut) OVER w THEN NULL ELSE lag(type) OVER w END, '') <> type) THEN 1 ELSE 0 END AS opens FROM z WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
n AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY pos) AS no FROM y)"""


def _pieces(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).selectExpr(
        "o_custkey AS doc_id", "o_orderkey AS word_id", "o_orderkey * 2 + k AS pos", "CASE (o_orderkey div 3 + k) % 4 WHEN 0 THEN 'O' WHEN 1 THEN 'B-NAME' WHEN 2 THEN 'I-NAME' ELSE 'CITY' END AS label", "k * 3 AS start", "CASE WHEN o_orderkey % 17 = 0 THEN k * 3 ELSE k * 3 + 3 END AS `end`", "o_orderkey % 13 = 1 AS special", "o_orderkey * 10 AS base")


@query(f'WITH {_PIECES} SELECT doc_id, type, CAST(min(s + base) AS BIGINT) AS start, CAST(max(e + base) AS BIGINT) AS "end" FROM n WHERE type IS NOT NULL AND NOT shut GROUP BY doc_id, no, type')
def char_predictions(spark, sf_dir):
    p = _pieces(spark, sf_dir)
    out = bio.char_predictions(p.drop("base"), p.select("doc_id", "word_id", "base").distinct())
    return out.select("doc_id", "type", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))


@query(f'WITH {_PIECES} SELECT doc_id, type, CAST(min(pos * 3) AS BIGINT) AS start, CAST(max(pos * 3 + e - s) AS BIGINT) AS "end" FROM n WHERE type IS NOT NULL AND NOT shut GROUP BY doc_id, no, type')
def simple_char_spans(spark, sf_dir):
    p = _pieces(spark, sf_dir).select("doc_id", "pos", "label", (F.col("pos") * 3).alias("start"), (F.col("pos") * 3 + F.col("end") - F.col("start")).alias("end"), "special")
    return bio.simple_spans(p)


@query("SELECT o_orderkey, i AS \"window\", CAST(i * 24 AS INT) AS first, CAST(least(i * 24 + 32, o_custkey % 200) AS INT) AS \"end\" FROM (SELECT o_orderkey, o_custkey, CAST(unnest(range(0, CAST(greatest(0, ceil((o_custkey % 200 - 32) / 24.0)) AS BIGINT) + 1)) AS INT) AS i FROM orders WHERE o_custkey % 200 > 0)")
def subword_windows(spark, sf_dir):
    return unfolded(table(spark, sf_dir, "orders"), bio.subword_windows((F.col("o_custkey") % 200).cast("int"), 32, 8), "o_orderkey")


_DIGEST = "CAST('0x' || substr(sha256('0:' || doc_id), 1, 8) AS BIGINT) % 100"
_KIND = "CAST('0x' || substr(sha256('0:' || doc_id || ':entity'), 1, 8) AS BIGINT) % 100 % 3"
# a sharp s has two capitals
_UPPER = "upper(replace(w, 'ß', 'SS'))"
_TITLE = "CASE WHEN w LIKE 'ß%' THEN 'Ss' ELSE upper(substr(w, 1, 1)) END || lower(substr(w, 2))"
_TOKEN = "CAST('0x' || substr(sha256('0:' || doc_id || ':' || (pos - 1)), 1, 8) AS BIGINT) % 100 % 3"


@query(f"""WITH {_WORDS}{_TYPED}, c AS (SELECT doc_id, {_DIGEST} AS r, {_KIND} AS k FROM documents),
x AS (SELECT doc_id, pos, w, CASE WHEN r < 35 THEN 0 WHEN r < 45 THEN 1 WHEN r < 53 THEN {_TOKEN} WHEN r < 75 AND label <> 'O' THEN k ELSE 3 END AS how FROM n JOIN c USING (doc_id)),
y AS (SELECT doc_id, string_agg(CASE how WHEN 0 THEN lower(w) WHEN 1 THEN {_UPPER} WHEN 2 THEN {_TITLE} ELSE w END, ' ' ORDER BY pos) AS recased FROM x GROUP BY doc_id)
SELECT doc_id, coalesce(recased, '') AS recased FROM documents LEFT JOIN y USING (doc_id)""")
def recase(spark, sf_dir):
    d = _labels(spark, sf_dir)
    return d.select("doc_id", F.array_join(bio.recased(F.col("words"), F.col("labels"), F.col("doc_id")), " ").alias("recased"))


# ------------------------------------------------------------ records and texts

@query("SELECT doc_id, text ILIKE '%the%' OR text ILIKE '%QU%' AS found FROM documents")
def keyword_search(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", records.mentions(F.col("text"), ["THE", "qu"]).alias("found"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 1 THEN 'offsets' WHEN 2 THEN 'unlike lengths' WHEN 3 THEN 'checksum' END AS error FROM customer")
def record_errors(spark, sf_dir):
    k = F.col("c_custkey")
    code = F.when(k % 4 == 3, "00743110158").otherwise("00743110157")
    body = F.concat(F.lit("VAT "), code, F.lit(" of "), F.col("c_name"))
    entity = F.array(F.struct(code.alias("value"), F.lit("PIVA").alias("label"), F.when(k % 4 == 1, 3).otherwise(4).alias("start"), F.lit(15).alias("end")))
    tokens = F.array(F.lit("VAT"), code)
    labels = F.when(k % 4 == 2, F.array(F.lit("O"))).otherwise(F.array(F.lit("O"), F.lit("B-PIVA")))
    return table(spark, sf_dir, "customer").select("c_custkey", records.record_error(body, entity, tokens, labels).alias("error"))


_LINES = {
    0: "to_json(named_struct('tokens', split('VAT ' || o_orderkey, ' '), 'bio_labels', array('O', 'B-PIVA'), 'source_text', 'VAT ' || o_orderkey))",
    1: "to_json(named_struct('mbert_tokens', array('a', 'b', 'c'), 'mbert_token_classes', array('O', 'O', 'B-CITY'), 'language', 'en'))",
    2: "to_json(named_struct('source_text', 'Lives in Roma, ' || o_orderkey, 'entities', array(named_struct('value', 'Roma', 'label', 'CITY', 'start', 9, 'end', 13)), 'language', 'it'))",
    3: "'{\"tokens\": [\"a\"], \"bio_labels\": [\"O\", \"O\"]}'", 4: "'{\"tokens\": [' || o_orderkey", 5: "to_json(named_struct('text', o_orderkey))", 6: "'[1, 2]'", 7: "to_json(named_struct('tokens', array('a'), 'bio_labels', array('B-NOWHERE')))",
}


@query("""SELECT o_orderkey, CASE o_orderkey % 8 WHEN 1 THEN 'token' WHEN 2 THEN 'spans' WHEN 0 THEN 'native' WHEN 3 THEN 'native' WHEN 7 THEN 'native' END AS dialect,
CASE o_orderkey % 8 WHEN 3 THEN 'unlike lengths' WHEN 4 THEN 'not JSON' WHEN 5 THEN 'no known dialect' WHEN 6 THEN 'no known dialect' WHEN 7 THEN 'unknown label' END AS reason,
CASE o_orderkey % 8 WHEN 0 THEN 'O B-PIVA' WHEN 1 THEN 'O O B-CITY' WHEN 2 THEN 'O O B-CITY O O' WHEN 3 THEN 'O O' WHEN 7 THEN 'B-NOWHERE' END AS labels, CASE WHEN o_orderkey % 8 IN (0, 2, 3, 7) THEN 'it' WHEN o_orderkey % 8 = 1 THEN 'en' END AS language FROM orders""")
def mixed_dialects(spark, sf_dir):
    """Lines of all dialects in one table, with broken and useless ones between them."""
    k = F.col("o_orderkey") % 8
    line = F.coalesce(*[F.when(k == n, F.expr(x)) for n, x in _LINES.items()])
    d = records.parsed_lines(table(spark, sf_dir, "orders").select("o_orderkey", line.alias("line")), "line")
    return d.select("o_orderkey", "dialect", F.col("_reject_reason").alias("reason"), F.array_join("labels", " ").alias("labels"), "language")


@query("SELECT count(*) AS n_rows, count(*) FILTER (doc_id % 9 = 0) AS n_incomplete, count(*) FILTER (doc_id % 4 = 0) AS n_misaligned FROM documents")
def jsonl_shape(spark, sf_dir):
    d = table(spark, sf_dir, "documents").selectExpr("if(doc_id % 9 = 0, NULL, lang) AS language", "array(1, 2) AS tokens", "if(doc_id % 4 = 0, array(1), array(1, 1)) AS labels")
    return records.shape(d, ["language", "tokens"], ("tokens", "labels"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(text, '[0-9]{3,}', '#', 'g'), '[A-Z]{2,}', '#', 'g') AS masked, CAST(len(regexp_extract_all(text, '[0-9]{3,}')) + len(regexp_extract_all(regexp_replace(text, '[0-9]{3,}', '#', 'g'), '[A-Z]{2,}')) AS INT) AS n FROM documents")
def substitution_counts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", rewrite.substituted(F.col("text"), ["[0-9]{3,}", "[A-Z]{2,}"], "#").alias("s")).select("doc_id", F.col("s.text").alias("masked"), "s.n")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS n_stray FROM customer")
def stray_name_scan(spark, sf_dir):
    """One name in every third text; court names, titles that end a sentence, capitals and slots are none."""
    k = F.col("c_custkey")
    t = F.concat(F.lit("Il Tribunale Ordinario e il Codice Civile; avanti al Dott. {FULLNAME} ROSSI, "), F.when(k % 3 == 0, "parla Mario Verdi oggi.").when(k % 3 == 1, "parla Mario. Verdi oggi.").otherwise("parla l'avv oggi."))
    return table(spark, sf_dir, "customer").select("c_custkey", F.size(text.stray_names(t, ("il", "tribunale", "ordinario", "codice", "civile"))).alias("n_stray"))


_TITLES = ", ".join(f"'{t}'" for t in text.TITLES)
_WORD_SQL = text.WORD.replace("'", "''")


@query(rf"""WITH w AS (SELECT doc_id, unnest(v) AS w, unnest(range(len(v))) AS i FROM (SELECT doc_id, regexp_extract_all(regexp_replace(text, '\{{\w+\}}', ' ', 'g'), '{_WORD_SQL}') AS v FROM documents)),
b AS (SELECT doc_id, i, w, regexp_replace(string_split(w, chr(39))[-1], '^\.+|\.+$', '', 'g') AS x FROM w),
c AS (SELECT DISTINCT lower(x) AS x FROM b WHERE regexp_matches(x, '^\p{{Ll}}')),
f AS (SELECT *, regexp_matches(x, '^\p{{Lu}}') AND regexp_matches(x, '\p{{Ll}}') AND x NOT IN ({", ".join(f"'{t.capitalize()}'" for t in text.TITLES)}) AS named FROM b),
p AS (SELECT doc_id, w AS a, named AS na, x AS xa, lead(w) OVER o AS b, lead(named) OVER o AS nb, lead(x) OVER o AS xb FROM f WINDOW o AS (PARTITION BY doc_id ORDER BY i))
SELECT doc_id, a, b FROM p WHERE nb AND NOT regexp_matches(a, '[.:;!?]$') AND lower(xb) NOT IN (SELECT x FROM c) AND (na AND lower(xa) NOT IN (SELECT x FROM c) OR NOT na AND regexp_replace(a, '\.+$', '') IN ({_TITLES}))""")
def stray_names_found(spark, sf_dir):
    """Names by form in the documents; words that also stand in lower case somewhere in them are common."""
    d = table(spark, sf_dir, "documents")
    return dataset.stray_name_rows(d, "doc_id", "text", dataset.common_words(d, ascii_slots=True), ascii_slots=True)


@query("""WITH s AS (SELECT l_orderkey AS doc_id, l_linenumber AS o, CAST((l_linenumber - 1) * 10 + l_partkey % 3 AS INT) AS a, CAST((l_linenumber - 1) * 10 + 5 + l_suppkey % 4 AS INT) AS b FROM lineitem)
SELECT doc_id, CAST((o - 1) * 10 + 1 AS INT) AS start, CAST((o - 1) * 10 + 8 AS INT) AS "end" FROM s WHERE a < (o - 1) * 10 + 8""")
def merge_trim_extend(spark, sf_dir):
    """Spans on text of seven-letter words between blanks (ten characters a word): trimmed, then grown to the whole word."""
    line = F.expr("struct(CAST(l_linenumber AS INT) AS o, CAST(l_partkey % 3 AS INT) AS a, CAST(l_suppkey % 4 AS INT) AS b)")  # what is shuffled; spans are made of it afterwards
    d = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.collect_list(line).alias("l"))
    d = d.withColumn("c", F.expr("transform(l, x -> named_struct('label', 'X', 'start', (x.o - 1) * 10 + x.a, 'end', (x.o - 1) * 10 + 5 + x.b, 'score', 0.9D, 'validated', false, 'source', 'model', 'ord', x.o))"))
    t = F.lit(" abcdefg  " * 8)
    grown = fuse.extended(fuse.trimmed(F.array_sort("c", lambda a, b: a["start"] - b["start"]), t), t)
    return unfolded(d, grown, "doc_id").select("doc_id", "start", "end")


@query(r"""WITH v AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]{6,}'))) AS w FROM benchmark),
t AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+')) AS w FROM documents)
SELECT doc_id, count(*) AS n, sum(length(w))::BIGINT AS chars, count(DISTINCT lower(w)) AS n_values FROM t WHERE lower(w) IN (SELECT w FROM v) GROUP BY doc_id""")
def redact_dictionary(spark, sf_dir):
    """All long words of the benchmark's items as a dictionary, redacted in the documents as whole words."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]{6,})"))).alias("w"))
    v = words.select(F.lower("w").alias("value")).distinct().select(F.col("value").alias("ph"), "value")
    d = values.redact_values(table(spark, sf_dir, "documents").select("doc_id", "text"), v, mask="", breaks=False).where(F.size("found") > 0)
    taken = F.length("text") - F.length("redacted")
    return d.select("doc_id", F.size("found").cast("long").alias("n"), taken.cast("long").alias("chars"), F.size(F.array_distinct(F.transform("found", lambda s: s["ph"]))).cast("long").alias("n_values"))


@query("""WITH s AS (SELECT l_orderkey AS doc_id, l_linenumber AS o, substr('BAC', CAST(l_suppkey % 3 AS INT) + 1, 1) AS label, CAST((l_linenumber - 1) * 10 + l_partkey % 3 AS INT) AS a, CAST((l_linenumber - 1) * 10 + 5 + l_suppkey % 4 AS INT) AS b FROM lineitem)
SELECT doc_id, min(least(label, 'B')) AS label, CAST((o - 1) * 10 + 1 AS INT) AS start, CAST((o - 1) * 10 + 8 AS INT) AS "end" FROM s GROUP BY doc_id, o""")
def model_spans(spark, sf_dir):
    """Two spans on each seven-letter word, cut at different letters and with labels of their own: they grow to the word, and the label that sorts first names it."""
    at = lambda label, start, end: f"named_struct('label', {label}, 'start', (x.o - 1) * 10 + {start}, 'end', (x.o - 1) * 10 + {end}, 'score', 0.9D, 'validated', false, 'source', 'model', 'ord', x.o)"
    line = F.expr("struct(CAST(l_linenumber AS INT) AS o, CAST(l_partkey % 3 AS INT) AS a, CAST(l_suppkey % 4 AS INT) AS b, CAST(l_suppkey % 3 AS INT) AS k)")  # what is shuffled; spans are made of it afterwards
    d = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.collect_list(line).alias("l"))
    d = d.withColumn("c", F.expr(f"""flatten(transform(l, x -> array({at("substr('BAC', x.k + 1, 1)", 'x.a', '5 + x.b')}, {at("'B'", '3', '6')})))"""))
    return unfolded(d, fuse.production_spans(F.col("c"), F.lit(" abcdefg  " * 8)), "doc_id").select("doc_id", "label", "start", "end")


@query("SELECT c_custkey, 'To ' || c_name || 'and B C ' || '.' AS restored FROM customer")
def restore_compat(spark, sf_dir):
    """Without brackets a name also takes the white space around it; inside brackets white space goes."""
    t = F.lit("To FULLNAME_1 and [ FULLNAME_2 ] .")
    m = F.create_map(F.lit("[FULLNAME_1]"), F.concat(F.lit(" "), F.col("c_name")), F.lit("[FULLNAME_2]"), F.lit("B C"))
    return table(spark, sf_dir, "customer").select("c_custkey", rewrite.restored(t, m).alias("restored"))
