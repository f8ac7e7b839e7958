"""Queries: counts, selection, dedup, leakage, synthesis."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.arrays import unfolded
from ..functions.text import slots
from ..operators import dataset, metrics
from ..operators.quantiles import quantiles
from ..sources.records import literal_spans
from .registry import query, table


@query("SELECT doc_id FROM documents ORDER BY sha256('v1:' || doc_id), doc_id LIMIT 50")
def topk_hash(spark, sf_dir):
    return dataset.top_salted(table(spark, sf_dir, "documents").select("doc_id"), 50, "v1", "doc_id")


@query("SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('v2:' || doc_id), doc_id) AS r FROM documents) WHERE r <= 20")
def topn_salted(spark, sf_dir):
    return dataset.top_salted_by(table(spark, sf_dir, "documents").select("doc_id", "lang"), ["lang"], 20, "v2", "doc_id")


_STRUCT = "o_orderpriority || '#' || substr(o_orderstatus, 1, 1) || '|' || o_custkey % 5"


@query(f"SELECT o_orderkey, {_STRUCT} AS structure FROM orders QUALIFY row_number() OVER (PARTITION BY {_STRUCT} ORDER BY o_orderkey) <= 25")
def cap_per_structure(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    s = dataset.structure_key(F.col("o_orderpriority"), F.array(F.substring("o_orderstatus", 1, 1), (F.col("o_custkey") % 5).cast("string")))
    return dataset.first_by(o.select("o_orderkey", s.alias("structure")), ["structure"], F.col("o_orderkey"), limit=25)


@query(f"SELECT {_STRUCT} AS structure, count(*) AS n FROM orders GROUP BY 1")
def structure_key(spark, sf_dir):
    s = dataset.structure_key(F.col("o_orderpriority"), F.array(F.substring("o_orderstatus", 1, 1), (F.col("o_custkey") % 5).cast("string")))
    return table(spark, sf_dir, "orders").groupBy(s.alias("structure")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS n_rows, count(DISTINCT text) AS n_distinct, count(*) - count(DISTINCT text) AS n_duplicates FROM documents")
def dup_count(spark, sf_dir):
    return dataset.duplicates(table(spark, sf_dir, "documents"), "text")


@query("""SELECT c_custkey, sha256('{"entities":[{"value":"' || c_name || '","label":"FULLNAME","start":0,"end":' || length(c_name) || '}],"language":"it","source_text":"' || c_name || ' paga","template_id":null}') AS record_id FROM customer""")
def record_id(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    e = F.array(F.struct(F.col("c_name").alias("value"), F.lit("FULLNAME").alias("label"), F.lit(0).alias("start"), F.length("c_name").alias("end")))
    return c.select("c_custkey", dataset.record_id(F.concat("c_name", F.lit(" paga")), e, F.lit("it"), F.lit(None).cast("string")).alias("record_id"))


@query("SELECT c_custkey, 'Il <FULLNAME> paga a <O> ora' AS skeleton, sha256('Il <FULLNAME> paga a <O> ora') AS skeleton_hash FROM customer")
def skeleton_hash(spark, sf_dir):
    name, n = F.col("c_name"), F.length("c_name")
    text = F.concat(F.lit("Il  "), name, F.lit(" paga a "), name, F.lit("\n ora"))
    e = F.array(F.struct(F.lit("TITLE").alias("label"), (n + 12).alias("start"), (2 * n + 12).alias("end")), F.struct(F.lit("GIVENNAME").alias("label"), F.lit(4).alias("start"), (n + 4).alias("end")))
    d = table(spark, sf_dir, "customer").select("c_custkey", text.alias("t"), e.alias("e"))
    return d.select("c_custkey", dataset.skeleton(F.col("t"), F.col("e"), True).alias("skeleton"), dataset.skeleton_hash(F.col("t"), F.col("e"), True).alias("skeleton_hash"))


@query("SELECT min_by(doc_id, (sha256('v3:' || doc_id), doc_id)) AS doc_id FROM documents GROUP BY regexp_replace(text, '[0-9]', '#', 'g')")
def unique_skeletons(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.regexp_replace("text", "[0-9]", "#").alias("s"))
    return dataset.first_by(d, ["s"], dataset.salted("v3", F.col("doc_id")), F.col("doc_id")).select("doc_id")


@query(r"WITH d AS (SELECT doc_id, text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS skeleton FROM documents), o AS (SELECT * FROM d WHERE doc_id % 3 = 0) SELECT doc_id FROM d WHERE doc_id % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM o WHERE o.text = d.text) AND NOT EXISTS (SELECT 1 FROM o WHERE o.skeleton = d.skeleton)")
def novel_anti(spark, sf_dir):
    none = F.array().cast("array<struct<label:string,start:int,end:int>>")
    d = table(spark, sf_dir, "documents").select("doc_id", "text", dataset.skeleton_hash(F.col("text"), none).alias("skeleton"))
    return dataset.novel(d.where("doc_id % 3 <> 0"), d.where("doc_id % 3 = 0"), ("text", "skeleton")).select("doc_id")


@query("WITH d AS (SELECT DISTINCT source AS split, text FROM documents) SELECT a.split AS split_a, b.split AS split_b, count(DISTINCT a.text) AS n_shared FROM d a JOIN d b ON a.text = b.text AND a.split < b.split GROUP BY 1, 2")
def leakage_pairs(spark, sf_dir):
    return dataset.leakage(table(spark, sf_dir, "documents").select(F.col("source").alias("split"), "text"), "text")


@query("SELECT doc_id, lang FROM documents WHERE doc_id % 2 = 0")
def disjoint_gate(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return dataset.require_disjoint(d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1"), "doc_id").select("doc_id", "lang")


# one floor, then quotas by language, then a top-up; the SQL states the three steps one by one
@query("""WITH d AS (SELECT doc_id, lang, doc_id % 17 = 0 AS rare, sha256('v4:' || doc_id) AS h FROM documents), f AS (SELECT doc_id, lang FROM d WHERE rare ORDER BY h, doc_id LIMIT 12),
s AS (SELECT lang, count(*) AS n FROM documents GROUP BY lang), t AS (SELECT lang, count(*) AS n FROM f GROUP BY lang),
q AS (SELECT s.lang, greatest(0, CAST(round_even(200.0 * s.n / (SELECT count(*) FROM documents), 0) AS BIGINT) - coalesce(t.n, 0)) AS q FROM s LEFT JOIN t USING (lang)),
r AS (SELECT d.doc_id, d.lang, h, row_number() OVER (PARTITION BY d.lang ORDER BY h, d.doc_id) AS r FROM d WHERE doc_id NOT IN (SELECT doc_id FROM f)),
a AS (SELECT doc_id, lang, 0 AS p, sha256('v4:' || doc_id) AS h FROM f UNION ALL SELECT doc_id, lang, CASE WHEN r <= q THEN 1 ELSE 2 END, h FROM r JOIN q USING (lang))
SELECT doc_id, lang FROM a ORDER BY p, h, doc_id LIMIT 200""")
def stratified_subset(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 17 == 0, F.array(F.lit("RARE"), F.lit("NAME"))).otherwise(F.array(F.lit("NAME"))).alias("tags"))
    return dataset.stratified(d, 200, {"RARE": 12}, "tags", ["lang"], "v4", "doc_id").select("doc_id", "lang")


@query("WITH u AS (SELECT o_orderkey, CAST('0x' || substr(sha256('v5:' || o_orderkey), 1, 8) AS BIGINT) / 4294967296.0 * 10 AS u FROM orders) SELECT o_orderkey, CASE WHEN u < 1 THEN 'a' WHEN u < 4 THEN 'b' WHEN u < 6 THEN 'c' ELSE 'd' END AS id FROM u")
def weighted_choice(spark, sf_dir):
    choices = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("c", 2.0), ("d", 4.0)], "id string, weight double")
    return dataset.weighted_choice(table(spark, sf_dir, "orders").select("o_orderkey"), choices, "v5", "o_orderkey").select("o_orderkey", "id")


@query("SELECT c_custkey, 'Il sig. ' || c_name || ' di ' || c_mktsegment || ' (' || c_name || ').' AS text, 3 AS n, CAST(8 + length(c_name) + 4 AS INT) AS second_start, CAST(8 + length(c_name) + 4 + length(c_mktsegment) AS INT) AS second_end FROM customer")
def template_fill(spark, sf_dir):
    values = F.create_map(F.lit("NAME"), F.col("c_name"), F.lit("ORG"), F.col("c_mktsegment"))
    r = table(spark, sf_dir, "customer").select("c_custkey", dataset.filled(F.lit("Il sig. {NAME} di {ORG} ({NAME})."), values).alias("r"))
    return r.select("c_custkey", "r.text", F.size("r.entities").alias("n"), F.get("r.entities", F.lit(1))["start"].alias("second_start"), F.get("r.entities", F.lit(1))["end"].alias("second_end"))


def _sym(key: str, alphabet: str, n: int) -> str:
    return f"list_aggregate(list_transform(range({n}), lambda i: substr('{alphabet}', CAST(CAST('0x' || substr(sha256('0:' || {key} || ':0'), CAST(2 * i + 1 AS INT), 2) AS INT) % {len(alphabet)} + 1 AS INT), 1)), 'string_agg', '')"


@query(f"WITH k AS (SELECT c_custkey, 'c' || c_custkey AS k FROM customer), v AS (SELECT c_custkey, {_sym('k || chr(58) || chr(108) || chr(49)', dataset.PLATE_LETTERS, 2)} AS a, {_sym('k || chr(58) || chr(100)', '0123456789', 5)} AS b, {_sym('k || chr(58) || chr(108) || chr(50)', dataset.PLATE_LETTERS, 2)} AS c FROM k) SELECT c_custkey, a || b || c AS compact, a || '-' || b || '-' || c AS grouped, lower(a || b || c) AS low FROM v")
def d2_identifier(spark, sf_dir):
    k = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))
    one = lambda surface: dataset.identifier(k, "cie-2l5d2l", surface)
    return table(spark, sf_dir, "customer").select("c_custkey", one("compact-upper").alias("compact"), one("grouped-hyphen").alias("grouped"), one("compact-lower").alias("low"))


@query(r"""WITH d AS (SELECT doc_id, text, len(string_split_regex(text, '[.!?] ')) AS n, CAST('0x' || substr(sha256('v6:' || doc_id), 1, 8) AS BIGINT) AS h FROM documents)
SELECT doc_id, length(text) + 13 AS n_chars, n, h % n + 1 AS at FROM d""")
def inject_boundary(spark, sf_dir):
    digest = dataset.salted("v6", F.col("doc_id"))
    d = table(spark, sf_dir, "documents")
    t = dataset.injected(F.col("text"), F.lit("Nota a parte"), digest)
    n = F.size(F.split("text", r"(?<=[.!?]) ", -1))
    at = F.size(F.split(F.regexp_extract(t, r"(?s)^(.*?)(?:^|(?<=[.!?]) )?Nota a parte", 1), r"(?<=[.!?]) ", -1))
    return d.select("doc_id", F.length(t).cast("long").alias("n_chars"), n.cast("long").alias("n"), (F.pmod(dataset.number(digest), n) + 1).alias("at"))


@query("SELECT CASE WHEN n_chars < 512 THEN '0000-0511' WHEN n_chars < 1024 THEN '0512-1023' WHEN n_chars < 1536 THEN '1024-1535' ELSE '1536-plus' END AS bin, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1")
def length_bins(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy(dataset.length_bin(F.col("n_chars")).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("SELECT source, lang, count(*) AS n FROM documents GROUP BY ROLLUP (source, lang)")
def count_by_source_lang(spark, sf_dir):
    return table(spark, sf_dir, "documents").rollup("source", "lang").agg(F.count(F.lit(1)).alias("n"))


@query("WITH t AS (SELECT DISTINCT l_orderkey, l_returnflag || l_linestatus AS tag FROM lineitem) SELECT tag, count(*) AS n_rows, round(100.0 * count(*) / (SELECT count(DISTINCT l_orderkey) FROM lineitem), 6) AS percent FROM t GROUP BY tag")
def tag_row_share(spark, sf_dir):
    """Rows that hold a tag, once each, and their share."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.concat("l_returnflag", "l_linestatus")).alias("tags"))
    total = rows.agg(F.count(F.lit(1)).alias("total"))
    n = rows.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n_rows"))
    return n.crossJoin(F.broadcast(total)).select("tag", "n_rows", F.round(100.0 * F.col("n_rows") / F.col("total"), 6).alias("percent"))


@query("SELECT doc_id, CAST(length(text) AS INT) AS n FROM documents ORDER BY length(text) DESC, doc_id LIMIT 200")
def longest_docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.length("text").alias("n")).orderBy(F.desc("n"), "doc_id").limit(200)


@query("SELECT w, count(*) AS n FROM (SELECT unnest(string_split(lower(text), ' ')) AS w FROM documents) GROUP BY w ORDER BY n DESC, w LIMIT 40")
def most_common_tags(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select(F.explode(F.split(F.lower("text"), " ")).alias("w"))
    return w.groupBy("w").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").limit(40)


@query("SELECT 'documents' AS origin, doc_id AS id, text, lang FROM documents UNION ALL SELECT 'benchmark', item_id, text, NULL FROM benchmark")
def union_sources(spark, sf_dir):
    a = table(spark, sf_dir, "documents").select(F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), "text", "lang")
    b = table(spark, sf_dir, "benchmark").select(F.lit("benchmark").alias("origin"), F.col("item_id").alias("id"), "text")
    return a.unionByName(b, allowMissingColumns=True)


@query("SELECT l_shipdate AS day FROM lineitem WHERE l_returnflag = 'A' UNION SELECT l_shipdate FROM lineitem WHERE l_returnflag = 'R'")
def tag_union(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_shipdate").alias("day"))
    return t.where("l_returnflag = 'A'").select("day").union(t.where("l_returnflag = 'R'").select("day")).distinct()


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'unknown slots: EXTRA' END AS error FROM customer")
def slot_except(spark, sf_dir):
    t = F.when(F.col("c_custkey") % 2 == 0, "a {NAME} and {EXTRA} here").otherwise("a {NAME} here")
    return table(spark, sf_dir, "customer").select("c_custkey", dataset.template_error(t, ["NAME", "CITY"]).alias("error"))


@query("SELECT c_custkey, 2 AS n_slots, 'NAME' AS first FROM customer")
def slot_scan(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", slots(F.concat(F.lit("{NAME} x {CITY}"), "c_name")).alias("s")).select("c_custkey", F.size("s").alias("n_slots"), F.get("s", F.lit(0)).alias("first"))


@query("WITH p AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS i FROM benchmark) SELECT o_orderkey, item_id FROM (SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) % (SELECT count(*) FROM benchmark) AS i FROM orders) JOIN p USING (i)")
def round_robin(spark, sf_dir):
    return dataset.round_robin(table(spark, sf_dir, "orders").select("o_orderkey"), table(spark, sf_dir, "benchmark").select("item_id"), "o_orderkey", "item_id")


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'sentenza-n' WHEN 1 THEN 'protocollo' WHEN 2 THEN 'rg' END AS variant FROM orders")
def hard_negatives(spark, sf_dir):
    k = F.col("o_orderkey")
    head = F.element_at(F.array(*map(F.lit, ("Vista la sentenza n. ", "Agli atti prot. ", "Iscritto a R.G. ", "Numero "))), (k % 4 + 1).cast("int"))
    d = table(spark, sf_dir, "orders").select("o_orderkey", head.alias("h"), F.concat(head, k.cast("string"), F.lit("/2024 in atti")).alias("t"))
    e = F.array(F.struct(F.lit("DOCID").alias("label"), F.length("h").alias("start"), (F.length("h") + F.length(k.cast("string")) + 5).alias("end")))
    context = d.select("o_orderkey", "t", F.transform(e, lambda x: F.struct(x["label"].alias("label"), (x["start"] - F.when(k % 4 < 3, F.length(F.regexp_extract("h", r"(\S+(?: n\.)?) $", 0))).otherwise(0)).alias("start"), x["end"].alias("end"))).alias("e"))
    return context.select("o_orderkey", dataset.hard_negative(F.col("t"), F.col("e")).alias("variant"))


@query('SELECT c_custkey, 0 AS start, CAST(length(c_name) AS INT) AS "end", \'GIVENNAME\' AS label FROM customer')
def literal_decode(spark, sf_dir):
    lit = F.concat(F.lit("[[0, "), F.length("c_name").cast("string"), F.lit(", 'GIVENNAME_1']]"))
    return unfolded(table(spark, sf_dir, "customer"), literal_spans(lit), "c_custkey")


_P = ", ".join(f"CAST(floor(quantile_cont(CAST(n_chars AS DOUBLE), {p})) AS BIGINT) AS p{round(100 * p)}" for p in (0.5, 0.9, 0.95, 0.99))
_OVER = ", ".join(f"round(100.0 * avg(CASE WHEN n_chars > {t} THEN 1.0 ELSE 0 END), 6) AS over_{t}" for t in (128, 256, 512))


@query(f"SELECT count(n_chars) AS n, max(n_chars) AS longest, {_OVER}, {_P} FROM documents")
def length_shares(spark, sf_dir):
    return metrics.length_report(table(spark, sf_dir, "documents"), "n_chars")


@query("SELECT l_suppkey, l_returnflag, count(*) AS n, round(quantile_cont(l_extendedprice, 0.1), 6) AS p10, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.999), 6) AS p999 FROM lineitem GROUP BY ALL")
def price_quantiles(spark, sf_dir):
    """Exact quantiles of many groups at once."""
    q = quantiles(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_suppkey", "l_returnflag"], [0.1, 0.5, 0.999])
    return q.select("l_suppkey", "l_returnflag", "n", *[F.round(F.get("quantiles", F.lit(i)), 6).alias(n) for i, n in enumerate(("p10", "p50", "p999"))])


@query("""SELECT ts_start AS start, event_type, count(*) AS n FROM (SELECT time_bucket(INTERVAL 1 DAY, ts) AS ts_start, event_type FROM events) GROUP BY 1, 2""")
def windowed_counts(spark, sf_dir):
    """The batch form of the streaming count."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.date_trunc("day", "ts").cast(e.schema["ts"].dataType).alias("start"), "event_type").agg(F.count(F.lit(1)).alias("n"))
