"""Building of datasets: identity and skeletons, deduplication, salted and stratified selection, leakage gates, synthesis.

Every choice follows a salted SHA-256 order, so it is the same on any cluster and for any partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import unfolded
from ..functions.taxonomy import final_label
from ..functions.text import collapse, find_all, let, slots
from ..sources.scratch import release, written
from .names import name_rows, small_words
from .scan import running

PLATE_LETTERS = "ABCDEFGHJKLMNPRSTVWXYZ"


def salted(salt: str, *key: Column) -> Column:
    return F.sha2(F.concat_ws(":", F.lit(salt), *[k.cast("string") for k in key]), 256)


def number(digest: Column, digits: int = 8, at: int = 1) -> Column:
    """A number from hexadecimal digits of a digest."""
    return F.conv(F.substring(digest, at, digits), 16, 10).cast("long")


def pick(pool: list[str], digest: Column, at: int = 1) -> Column:
    return F.element_at(F.array(*map(F.lit, pool)), (F.pmod(number(digest, 8, at), F.lit(len(pool))) + 1).cast("int"))


# ------------------------------------------------------------ identity

def record_id(text: Column, entities: Column, language: Column, template: Column) -> Column:
    """SHA-256 of the canonical JSON of (entities, language, source_text, template_id), keys in order, nulls written."""
    body = F.struct(entities.alias("entities"), language.alias("language"), text.alias("source_text"), template.alias("template_id"))
    return F.sha2(F.to_json(body, {"ignoreNullFields": "false"}), 256)


def skeleton(text: Column, entities: Column, normalise: bool = False) -> Column:
    """Text with entities (label, start, end) replaced by <LABEL> and white space collapsed; normalise uses final labels (<O> for dropped ones)."""
    name = (lambda e: F.coalesce(final_label(e["label"]), F.lit("O"))) if normalise else (lambda e: e["label"])

    def render(by):
        before = lambda i: F.coalesce(F.get(by, i - 1)["end"], F.lit(0))
        body = F.array_join(F.transform(by, lambda e, i: F.concat(F.substring(text, before(i) + 1, e["start"] - before(i)), F.lit("<"), name(e), F.lit(">"))), "")
        end = F.coalesce(F.try_element_at(by, F.lit(-1))["end"], F.lit(0))
        return collapse(F.concat(body, F.substring(text, end + 1, F.length(text))))

    return let(F.array_sort(F.transform(entities, lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["label"].alias("label")))), render)


def skeleton_hash(text: Column, entities: Column, normalise: bool = False) -> Column:
    return F.sha2(skeleton(text, entities, normalise), 256)


def structure_key(template: Column, labels: Column) -> Column:
    return F.concat(template.cast("string"), F.lit("#"), F.array_join(labels, "|"))


def length_bin(n: Column) -> Column:
    return F.when(n < 512, "0000-0511").when(n < 1024, "0512-1023").when(n < 1536, "1024-1535").otherwise("1536-plus")


def hard_negative(text: Column, entities: Column) -> Column:
    """The first of three surface variants (ruling number, protocol, register) that a document-code entity has in its value or the 40 characters before it."""
    variants = (("sentenza-n", r"(?U)\bsent(?:enza)?\.?\s*n\.", r"(?U)\bsent(?:enza)?\.?\s*n\.\s*$"), ("protocollo", r"(?U)\bprot(?:ocollo)?\.?", r"(?U)\bprot(?:ocollo)?\.?\s*$"), ("rg", r"(?U)(?:^|\s)r\.?\s*g\.?(?:\s|$)", r"(?U)(?:^|\s)r\.?\s*g\.?\s*$"))
    codes = F.filter(entities, lambda e: F.coalesce(final_label(e["label"]) == "DOCID", F.lit(False)))
    value = lambda e: F.trim(F.lower(F.substring(text, e["start"] + 1, e["end"] - e["start"])))
    from_ = lambda e: F.greatest(F.lit(0), e["start"] - 40)
    context = lambda e: F.lower(F.substring(text, from_(e) + 1, e["end"] - from_(e)))
    has = lambda inner, outer: F.exists(codes, lambda e: value(e).rlike(inner) | context(e).rlike(outer))
    return F.coalesce(*[F.when(has(i, o), F.lit(n)) for n, i, o in variants])


def target_entities(text: Column, entities: Column) -> Column:
    """How many identity-document entities are exactly "n." and seven digits."""
    hit = lambda e: F.coalesce(final_label(e["label"]) == "ID_DOC", F.lit(False)) & F.substring(text, e["start"] + 1, e["end"] - e["start"]).rlike(r"(?iU)^\s*n\.\s*\d{7}\s*$")
    return F.size(F.filter(entities, hit))


# ------------------------------------------------------------ dedup, caps, leakage

def first_by(rows: DataFrame, keys: list[str], *order: Column, limit: int = 1) -> DataFrame:
    """The first `limit` rows of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= limit).drop("_rank")


def top_salted(rows: DataFrame, n: int, salt: str, key: str) -> DataFrame:
    """The n rows with the smallest salted hashes (a bounded heap in each task, then one merge)."""
    return rows.withColumn("_order", salted(salt, F.col(key))).orderBy("_order", key).limit(n).drop("_order")


def top_salted_by(rows: DataFrame, strata: list[str], n: int, salt: str, key: str) -> DataFrame:
    return first_by(rows, strata, salted(salt, F.col(key)), F.col(key), limit=n)


def duplicates(rows: DataFrame, *keys: str) -> DataFrame:
    t = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return t.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count(F.lit(1)).alias("n_distinct"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n_duplicates"))


def novel(train: DataFrame, observed: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Rows that share none of the keys with observed: one anti-join for each key, no nested loop."""
    for k in keys:
        train = train.join(observed.select(k).where(F.col(k).isNotNull()).distinct(), k, "left_anti")
    return train


def leakage(rows: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Pairs of splits that share values of key, with how many."""
    d = rows.select(split, key).where(F.col(key).isNotNull()).distinct()
    a, b = d.select(F.col(split).alias("split_a"), key), d.select(F.col(split).alias("split_b"), key)
    return a.join(b, key).where("split_a < split_b").groupBy("split_a", "split_b").agg(F.count_distinct(key).alias("n_shared"))


def require_disjoint(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """a, or an error when executed if it shares a value of key with b. The check is a filter, so no choice of columns drops it."""
    shared = b.select(F.col(key), F.lit(True).alias("_seen")).distinct()
    j = a.join(shared, key, "left")
    message = F.concat(F.lit(f"{key} in both sets: "), F.col(key).cast("string"))
    return j.where(F.when(F.col("_seen"), F.raise_error(message).cast("boolean")).otherwise(F.lit(True))).select(*a.columns)


def stratified(rows: DataFrame, n: int, floors: dict[str, int], tags: str, strata: list[str], salt: str, key: str) -> DataFrame:
    """n rows: floors of tags first (the rarest tag first, rows already chosen count), then stratum quotas by share, then a top-up; all in salted order.

    Choices are made on a written table of key, tags and strata. One pass over it for each floor, as each depends on the ones before; strata are ranked in two phases. What is
    chosen is written, so plans don't grow; whole rows are fetched in the end. key must be unique.
    """
    base = written(rows.select(key, *[c for c in (tags, *strata) if c != key], salted(salt, F.col(key)).alias("_order")), "strata")
    seen = {r.t: r.n for r in base.select(F.explode(F.array_distinct(tags)).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = written(base.limit(0), "floors")
    for tag in sorted((t for t in floors if seen.get(t)), key=lambda t: (seen[t], t)):
        have = chosen.where(F.array_contains(tags, tag)).count()
        if have < floors[tag]:
            rest = base.where(F.array_contains(tags, tag)).join(chosen.select(key), key, "left_anti")
            before, chosen = chosen, written(chosen.unionByName(rest.orderBy("_order", key).limit(floors[tag] - have)), "floors")
            release(before)
    total = base.count()
    sizes = base.groupBy(*strata).agg(F.count(F.lit(1)).alias("_size"))
    taken = chosen.groupBy(*strata).agg(F.count(F.lit(1)).alias("_taken"))
    quota = sizes.join(taken, strata, "left").select(*strata, F.greatest(F.lit(0), F.bround(F.lit(n) * F.col("_size") / F.lit(max(1, total)), 0).cast("long") - F.coalesce("_taken", F.lit(0))).alias("_quota"))
    ranked = running(base.join(chosen.select(key), key, "left_anti"), strata, ["_order", key], "_rank").join(quota, strata)
    priority = F.when(F.col("_rank") <= F.col("_quota"), 1).otherwise(2)
    everything = chosen.select(key, "_order", F.lit(0).alias("_priority")).unionByName(ranked.select(key, "_order", priority.alias("_priority")))
    kept = running(everything, [], ["_priority", "_order", key], "_n").where(F.col("_n") <= n)
    return rows.join(kept.select(key), key, "left_semi")


def round_robin(rows: DataFrame, pool: DataFrame, order: str, pool_order: str, most: int = 100_000) -> DataFrame:
    """Row i with entry i mod n of the pool, both numbered in order (ties in any order, fixed once). A pool of up to `most` rows is broadcast.

    Both are numbered in two phases over sorted ranges, so neither stands in one task.
    """
    n = pool.count()
    if not n:
        raise ValueError("an empty pool")
    p = running(pool, [], [pool_order], "_i").withColumn("_i", F.col("_i") - 1)
    r = running(rows, [], [order], "_i").withColumn("_i", (F.col("_i") - 1) % n)
    return r.join(F.broadcast(p) if n <= most else p, "_i").drop("_i")


# ------------------------------------------------------------ synthesis

def weighted_choice(rows: DataFrame, choices: DataFrame, salt: str, key: str, weight: str = "weight") -> DataFrame:
    """One of the choices (a table of up to 10,000 rows: id, weight) for each row, by inverse distribution of a hashed uniform.

    A guide table makes it an equality join: the line of weights is cut into as many cells as there are choices, and a row meets the choices that reach into its
    cell, two on average.
    """
    n = choices.count()
    if n > 10_000:
        raise ValueError("too many choices for a broadcast join")
    w = Window.orderBy("id")
    total = float(choices.agg(F.sum(weight)).first()[0] or 0)
    cell = lambda x: F.least(F.floor(x * F.lit(n / total)), F.lit(n - 1)).cast("long")
    c = choices.where(F.col(weight) > 0).withColumn("_to", F.sum(weight).over(w)).withColumn("_from", F.col("_to") - F.col(weight))
    c = c.withColumn("_cell", F.explode(F.sequence(cell(F.col("_from")), cell(F.col("_to")))))
    u = number(salted(salt, F.col(key)), 8) / float(1 << 32) * F.lit(total)
    d = rows.withColumn("_u", u).withColumn("_cell", cell(F.col("_u")))
    return d.join(F.broadcast(c), "_cell").where((F.col("_u") >= F.col("_from")) & (F.col("_u") < F.col("_to"))).drop("_u", "_from", "_to", "_cell")


def capacity_report(records: DataFrame, template: str, structure: str, cap: int) -> DataFrame:
    """What templates give under a cap on rows of one structure: template, drawn, structures, kept, refused, full (structures at the cap) and exhausted (all of them are full).

    Counts of structures are summed up in the task that reads them, so a template with a third of all rows is no hot group.
    """
    per = records.groupBy(template, structure).agg(F.count(F.lit(1)).alias("n"))
    out = per.groupBy(template).agg(F.sum("n").alias("drawn"), F.count(F.lit(1)).alias("structures"), F.sum(F.least("n", F.lit(cap).cast("long"))).alias("kept"), F.sum((F.col("n") >= cap).cast("long")).alias("full"))
    return out.select(template, "drawn", "structures", "kept", (F.col("drawn") - F.col("kept")).alias("refused"), "full", (F.col("full") == F.col("structures")).alias("exhausted"))


def apportioned(templates: DataFrame, key: str, n: int, weight: str = "weight", capacity: str = "capacity") -> DataFrame:
    """templates with `planned`: how many of n rows each gives, in proportion to its weight but never more than its capacity; what the full ones can't take goes to the others.

    A template is full if all those that fill up before it (in the order of capacity / weight) and its own share at that level still fit into n. Parts of rows go
    to the largest remainders (ties by key). Together they give n, or all capacity there is: the early stop. No template goes through the driver: the order is a running sum over sorted ranges.
    """
    t = templates.where((F.col(weight) > 0) & (F.col(capacity) > 0))
    level = F.col(capacity) / F.col(weight).cast("double")
    r = running(t.withColumn("_level", level), [], ["_level", key], "_at", {"_caps": F.col(capacity).cast("long"), "_weights": F.col(weight).cast("double")})
    whole = float(t.agg(F.coalesce(F.sum(F.col(weight).cast("double")), F.lit(0.0))).first()[0])
    full = F.col("_caps") + F.col("_level") * (F.lit(whole) - F.col("_weights")) <= F.lit(float(n))
    r = written(r.withColumn("_full", full), "levels")
    taken = r.where("_full").agg(F.coalesce(F.max("_caps"), F.lit(0)).alias("c"), F.coalesce(F.max("_weights"), F.lit(0.0)).alias("w")).first()
    rest, left = n - taken.c, whole - taken.w
    share = F.col(weight).cast("double") * F.lit(rest / left if left > 0 else 0.0)
    r = r.withColumn("_share", F.when(F.col("_full"), F.col(capacity).cast("double")).otherwise(share)).withColumn("_floor", F.floor("_share"))
    over = rest - int(r.where("not _full").agg(F.coalesce(F.sum("_floor"), F.lit(0))).first()[0])
    open_ = running(r.where("not _full").withColumn("_part", F.col("_floor") - F.col("_share")), [], ["_part", key], "_rank").select(F.col(key).alias("_key"), "_rank")
    out = r.join(open_, F.col(key) == F.col("_key"), "left").withColumn("planned", F.col("_floor") + F.coalesce((F.col("_rank") <= over).cast("long"), F.lit(0)))
    out = templates.join(out.select(F.col(key).alias("_key"), "planned"), F.col(key) == F.col("_key"), "left")
    return out.select(*templates.columns, F.coalesce("planned", F.lit(0)).alias("planned"))


def sentence_ends(text: Column, entities: Column) -> Column:
    """Places behind a sentence end and its white space that lie in no entity, and the text's end."""
    ends = F.transform(find_all(text, r"[.!?](?U)\s+"), lambda m: m["end"])
    free = F.filter(ends, lambda p: ~F.exists(entities, lambda e: (e["start"] < p) & (e["end"] > p)))
    return F.array_distinct(F.array_append(free, F.length(text)))


def with_insertions(text: Column, entities: Column, insertions: Column) -> Column:
    """(text, entities: label, start, end): several texts put in at once.

    insertions: at, text, entities (label, start, end in the inserted text); several at one place stand in the list's order. An entity that begins where something is put in comes after it;
    one that an insertion would cut is an error. Spans move by the running sum of the lengths put in before them.
    """
    numbered = F.transform(insertions, lambda x, i: F.struct(x["at"].cast("int").alias("at"), i.alias("i"), x["text"].alias("text"), x["entities"].alias("entities")))
    span = lambda e, by: F.struct(e["label"].alias("label"), (e["start"] + by).cast("int").alias("start"), (e["end"] + by).cast("int").alias("end"))

    def put(ins):
        def with_sums(sums):
            cut = F.exists(entities, lambda e: F.exists(ins, lambda x: (x["at"] > e["start"]) & (x["at"] < e["end"])))
            moved = F.transform(entities, lambda e: span(e, F.get(sums, F.size(F.filter(ins, lambda x: x["at"] <= e["start"])))))
            new = F.flatten(F.transform(ins, lambda x, i: F.transform(x["entities"], lambda e: span(e, x["at"] + F.get(sums, i)))))
            before = lambda i: F.coalesce(F.get(ins, i - 1)["at"], F.lit(0))
            body = F.array_join(F.transform(ins, lambda x, i: F.concat(F.substring(text, before(i) + 1, x["at"] - before(i)), x["text"])), "")
            tail = F.substring(text, F.coalesce(F.try_element_at(ins, F.lit(-1))["at"], F.lit(0)) + 1, F.length(text))
            whole = F.struct(F.concat(body, tail).alias("text"), F.array_sort(F.concat(moved, new), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["end"] - b["end"])).alias("entities"))
            return F.when(cut, F.raise_error(F.lit("an insertion cuts an entity")).cast("struct<text:string,entities:array<struct<label:string,start:int,end:int>>>")).otherwise(whole)

        return let(F.aggregate(ins, F.array(F.lit(0)), lambda a, x: F.array_append(a, F.element_at(a, F.lit(-1)) + F.length(x["text"]))), with_sums)

    return let(F.array_sort(numbered), put)


def filled(template: Column, values: Column) -> Column:
    """(text, entities): a template's slots replaced by values (map of slot to value), with the offsets of each."""
    parts, names = F.split(template, r"\{\w+\}", -1), slots(template)
    value = lambda s: F.coalesce(F.try_element_at(values, s), F.lit(""))
    sizes = F.transform(names, lambda s, i: F.length(F.get(parts, i)) + F.length(value(s)))

    def entity(s, i):
        start = F.aggregate(F.slice(sizes, 1, i), F.lit(0), lambda a, x: a + x) + F.length(F.get(parts, i))
        return F.struct(s.alias("label"), start.cast("int").alias("start"), (start + F.length(value(s))).cast("int").alias("end"), value(s).alias("value"))

    text = F.concat(F.array_join(F.transform(names, lambda s, i: F.concat(F.get(parts, i), value(s))), ""), F.try_element_at(parts, F.lit(-1)))
    return F.struct(text.alias("text"), F.transform(names, entity).alias("entities"))


def common_words(corpus: DataFrame, text: str = "text", least: int = 1, ascii_slots: bool = False) -> DataFrame:
    """word: the words that stand in lower case in `least` texts of a corpus at least, slots left out. A capitalised word that also occurs in lower case is no name by its form."""
    return small_words(corpus, text, least > 1, ascii_slots).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("word")


def stray_name_rows(templates: DataFrame, key: str, text: str, common: DataFrame, ascii_slots: bool = False) -> DataFrame:
    """key, a, b: the names in templates, by anti-joins with a table of common words of any size."""
    pairs = name_rows(templates, key, text, ascii_slots)
    for side in ("second", "first"):
        pairs = pairs.join(common, F.lower(side) == F.col("word"), "left_anti")
    return pairs.select(key, "a", "b")


def template_error(template: Column, allowed: list[str], common: tuple[str, ...] | Column = ()) -> Column:
    """Why a template can't be used, or null. common: words in lower case that are no names when capitalised."""
    from ..functions.text import non_latin, stray_names

    unknown = F.array_except(slots(template), F.array(*map(F.lit, allowed)))
    return F.coalesce(F.when(F.size(slots(template)) == 0, F.lit("no slots")), F.when(F.size(unknown) > 0, F.concat(F.lit("unknown slots: "), F.array_join(unknown, ","))), F.when(non_latin(template).isNotNull(), F.lit("letters of another script")), F.when(F.size(stray_names(template, common)) > 0, F.lit("a name in the text")))


def symbols(key: Column, seed: int, alphabet: str, n: int) -> Column:
    """n symbols from bytes of sha256(seed:key:0): n is at most 32."""
    d = F.sha2(F.concat(F.lit(f"{seed}:"), key, F.lit(":0")), 256)
    byte = lambda i: F.conv(F.substring(d, 2 * i + 1, F.lit(2)), 16, 10).cast("int")
    one = lambda i: F.substring(F.lit(alphabet), F.pmod(byte(i), F.lit(len(alphabet))) + 1, F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), one), "")


#: identifier families: parts of (name in the key, letters or digits, length), and the groups of the printed form
FAMILIES = {
    "numeric-7": ((("digits", "d", 7),), (3, 4)),
    "cie-2l5d2l": ((("l1", "l", 2), ("d", "d", 5), ("l2", "l", 2)), (2, 5, 2)),
    "passport-2l7d": ((("l", "l", 2), ("d", "d", 7)), (2, 7)),
    "driving-2l7d1l": ((("l1", "l", 2), ("d", "d", 7), ("l2", "l", 1)), (2, 7, 1)),
}


def identifier(key: Column, family: str, surface: str = "compact-upper", seed: int = 0) -> Column:
    """A made-up identifier; surface: compact-upper, compact-lower, grouped-space, grouped-hyphen."""
    parts, groups = FAMILIES[family]
    value = F.concat(*[symbols(F.concat(key, F.lit(f":{n}")), seed, PLATE_LETTERS if kind == "l" else "0123456789", k) for n, kind, k in parts])
    if surface == "compact-lower":
        return F.lower(value)
    if surface == "compact-upper":
        return value
    at, out = 1, []
    for g in groups:
        out.append(F.substring(value, at, g))
        at += g
    return F.concat_ws({"grouped-space": " ", "grouped-hyphen": "-"}[surface], *out)


def decoy(key: Column, seed: int = 0) -> Column:
    return F.concat(symbols(F.concat(key, F.lit(":letters")), seed, PLATE_LETTERS, 3), F.lit("-"), symbols(F.concat(key, F.lit(":digits")), seed, "0123456789", 4), F.lit("-X"))


def injected(text: Column, sentence: Column, digest: Column) -> Column:
    """The sentence put behind one of the text's sentence ends (chosen by the digest), or at the end."""
    parts = F.split(text, r"(?<=[.!?]) ", -1)
    at = F.pmod(number(digest), F.size(parts)).cast("int") + 1
    return F.array_join(F.concat(F.slice(parts, 1, at), F.array(sentence), F.slice(parts, at + 1, F.size(parts))), " ")


def plate(digest: Column) -> Column:
    """A vehicle plate: two letters, three digits, two letters; half compact, 35 % with spaces, the rest with hyphens."""
    letter = lambda at: F.substring(F.lit(PLATE_LETTERS), (F.pmod(number(digest, 4, at), F.lit(len(PLATE_LETTERS))) + 1).cast("int"), F.lit(1))
    a, b = F.concat(letter(1), letter(5)), F.concat(letter(9), letter(13))
    d = F.lpad(F.pmod(number(digest, 6, 17), F.lit(1000)).cast("string"), 3, "0")
    style = F.pmod(number(digest, 6, 25), F.lit(100))
    return F.when(style < 50, F.concat(a, d, b)).when(style < 85, F.concat_ws(" ", a, d, b)).otherwise(F.concat_ws("-", a, d, b))


def generate(spark, n: int, templates: DataFrame, generators: dict[str, Column], salt: str, cap: int = 25) -> DataFrame:
    """n drawn records (id, text, entities, template_id): weighted templates (id, template, weight), filled slots, at most `cap` of one structure, distinct texts.

    generators are expressions over the column `digest`, one for each slot.
    """
    rows = weighted_choice(spark.range(n).withColumnRenamed("id", "seq"), templates, salt, "seq").select(F.col("seq").alias("id"), F.col("id").alias("template_id"), "template")
    rows = rows.withColumn("digest", salted(salt + ":values", F.col("id")))
    values = F.create_map(*[x for k, g in generators.items() for x in (F.lit(k), g)])
    rows = rows.withColumn("record", filled(F.col("template"), values)).select("id", "template_id", "record.text", "record.entities")
    rows = rows.withColumn("structure", structure_key(F.col("template_id"), F.transform("entities", lambda e: e["label"])))
    return first_by(first_by(rows, ["structure"], F.col("id"), limit=cap), ["text"], F.col("id")).drop("structure")
