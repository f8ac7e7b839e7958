"""Entity metrics on long span tables (doc_id, type, start, end): scores, agreement, coverage, gates, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quantiles import quantiles
from .scan import running
from .sweep import coverage  # noqa: F401  one of the metrics

KEY = ["doc_id", "type", "start", "end"]


def true_positives(gold: DataFrame, pred: DataFrame, key: list[str] = KEY) -> DataFrame:
    return gold.select(*key).distinct().join(pred.select(*key).distinct(), key)


def false_positives(gold: DataFrame, pred: DataFrame, key: list[str] = KEY) -> DataFrame:
    return pred.select(*key).distinct().join(gold.select(*key).distinct(), key, "left_anti")


def false_negatives(gold: DataFrame, pred: DataFrame, key: list[str] = KEY) -> DataFrame:
    return false_positives(pred, gold, key)


def outcomes(gold: DataFrame, pred: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Every span of either side once, with in_gold and in_pred; one shuffle of each side."""
    both = gold.select(*key, F.lit(1).alias("g"), F.lit(0).alias("p")).unionByName(pred.select(*key, F.lit(0).alias("g"), F.lit(1).alias("p")))
    return both.groupBy(*key).agg((F.max("g") == 1).alias("in_gold"), (F.max("p") == 1).alias("in_pred"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def _scored(counts: DataFrame) -> DataFrame:
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn), "support": tp + fn})


def _counted(o: DataFrame, *by: str) -> DataFrame:
    one = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    g, p = F.col("in_gold"), F.col("in_pred")
    return o.groupBy(*by).agg(one(g & p).alias("tp"), one(~g & p).alias("fp"), one(g & ~p).alias("fn"))


def per_type(gold: DataFrame, pred: DataFrame, *by: str) -> DataFrame:
    return _scored(_counted(outcomes(gold, pred, [*by, *KEY]) if by else outcomes(gold, pred), *by, "type"))


def totals(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """Micro scores and three macro F1: over types with gold spans, over types of either side, over types with hits or misses."""
    types = per_type(gold, pred)
    micro = _scored(types.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")]))
    mean = lambda cond: F.coalesce(F.avg(F.when(cond, F.col("f1"))), F.lit(0.0))
    macro = types.agg(mean(F.col("support") > 0).alias("macro_f1_gold"), mean(F.lit(True)).alias("macro_f1_all"), mean((F.col("tp") > 0) | (F.col("fn") > 0)).alias("macro_f1_hit"))
    return micro.crossJoin(macro)  # one row each


def token_accuracy(labels: DataFrame) -> DataFrame:
    """labels: gold, pred of each first subword."""
    return labels.agg(F.count(F.lit(1)).alias("n_tokens"), F.coalesce(F.avg((F.col("gold") == F.col("pred")).cast("double")), F.lit(0.0)).alias("accuracy"))


def agreement(golden: DataFrame, candidate: DataFrame) -> DataFrame:
    """Spans agreed, new and removed, by type."""
    o = outcomes(golden, candidate)
    n = lambda c: F.sum(c.cast("long"))
    g, c = F.col("in_gold"), F.col("in_pred")
    return o.groupBy("type").agg(n(g).alias("golden"), n(c).alias("candidate"), n(g & c).alias("agreed"), n(c & ~g).alias("new"), n(g & ~c).alias("removed"))


def exact_documents(docs: DataFrame, golden: DataFrame, candidate: DataFrame) -> DataFrame:
    """Number and share of documents (doc_id) whose spans are the same on both sides."""
    o = outcomes(golden, candidate).groupBy("doc_id").agg(F.bool_and(F.col("in_gold") & F.col("in_pred")).alias("same"))
    every = docs.select("doc_id").distinct().join(o, "doc_id", "left").select(F.coalesce("same", F.lit(True)).alias("same"))
    return every.agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("same").cast("long")).alias("exact")).withColumn("exact_rate", ratio(F.col("exact"), F.col("documents")))


def paired(gold: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Span classes of two systems on the same gold: both, only one or neither right; wrong in both or in one."""
    parts = None
    for flag, side in (("g", gold), ("a", first), ("b", second)):
        x = side.select(*KEY, *[F.lit(int(f == flag)).alias(f) for f in "gab"])
        parts = x if parts is None else parts.unionByName(x)
    o = parts.groupBy(*KEY).agg(*[F.max(f).alias(f) for f in "gab"])
    names = {"111": "both_right", "110": "only_first_right", "101": "only_second_right", "100": "neither_found", "011": "both_wrong", "010": "only_first_wrong", "001": "only_second_wrong"}
    code = F.concat(*[F.col(f).cast("string") for f in "gab"])
    label = F.coalesce(*[F.when(code == k, F.lit(v)) for k, v in names.items()])
    return o.groupBy(label.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def paired_documents(docs: DataFrame, gold: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """Documents of two systems on the same gold: (outcome, n) of which are exact, and of which has fewer span errors; each group of outcomes adds up to all documents (doc_id)."""
    parts = None
    for flag, side in (("g", gold), ("a", first), ("b", second)):
        x = side.select(*KEY, *[F.lit(int(f == flag)).alias(f) for f in "gab"])
        parts = x if parts is None else parts.unionByName(x)
    spans = parts.groupBy(*KEY).agg(*[F.max(f).alias(f) for f in "gab"])
    errors = spans.groupBy("doc_id").agg(*[F.sum((F.col("g") != F.col(f)).cast("long")).alias(f) for f in "ab"])
    d = docs.select("doc_id").distinct().join(errors, "doc_id", "left").na.fill(0, ["a", "b"])
    a, b = F.col("a"), F.col("b")
    exact = F.when((a == 0) & (b == 0), "both_exact").when(a == 0, "only_first_exact").when(b == 0, "only_second_exact").otherwise("neither_exact")
    fewer = F.when(a < b, "first_fewer_errors").when(b < a, "second_fewer_errors").otherwise("equal_errors")
    return d.select(F.explode(F.array(exact, fewer)).alias("outcome")).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def paired_checked(first: DataFrame, second: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Rows of two runs joined by doc_id; a document that one lacks, or unlike values of columns, is an error."""
    a = first.select("doc_id", *[F.col(c).alias(f"{c}_1") for c in columns], F.lit(True).alias("has_1"))
    b = second.select("doc_id", *[F.col(c).alias(f"{c}_2") for c in columns], F.lit(True).alias("has_2"))
    j = a.join(b, "doc_id", "full_outer")
    ok = F.col("has_1").isNotNull() & F.col("has_2").isNotNull()
    for c in columns:
        ok = ok & F.col(f"{c}_1").eqNullSafe(F.col(f"{c}_2"))
    return j.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("the runs don't match")).cast("boolean"))).select("doc_id", *[F.col(f"{c}_1").alias(c) for c in columns])


def gate(golden: DataFrame, candidate: DataFrame, limits: DataFrame) -> DataFrame:
    """Failures of a candidate's per-type scores against golden's.

    limits: metric (f1, recall), type (null: all types), kind (max_drop, min_value), value. Limits are inclusive; a type that the
    candidate lacks counts as 0.
    """
    long = lambda d, name: d.select("type", F.expr("stack(2, 'f1', f1, 'recall', recall) as (metric, value)")).withColumnRenamed("value", name)
    both = long(golden, "was").join(long(candidate, "now"), ["type", "metric"], "full_outer").na.fill(0.0, ["was", "now"])
    limits = limits.select(F.col("metric"), F.col("type").alias("for_type"), "kind", F.col("value").alias("limit"))
    j = both.join(F.broadcast(limits), ["metric"]).where(F.col("for_type").isNull() | (F.col("for_type") == F.col("type")))
    actual = F.when(F.col("kind") == "max_drop", F.col("was") - F.col("now")).otherwise(F.col("now"))
    failed = F.when(F.col("kind") == "max_drop", actual > F.col("limit") + 1e-12).otherwise(actual < F.col("limit") - 1e-12)
    return j.where(failed).select("type", "metric", "kind", actual.alias("actual"), "limit")


def coverage_total(per_document: DataFrame) -> DataFrame:
    names = ["sensitive", "covered", "leaked", "type_correct", "wrong_type", "predicted", "collateral", "entities", "entities_full"]
    t = per_document.agg(*[F.sum(F.col(c).cast("long")).alias(c) for c in names], F.count(F.lit(1)).alias("documents"), F.sum(F.col("document_full").cast("long")).alias("documents_full"))
    share = lambda a, b: F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))  # noqa: E731  null on empty
    return t.withColumns({"coverage": share("covered", "sensitive"), "mask_precision": share("covered", "predicted"), "collateral_ratio": share("collateral", "sensitive")})


def without_number_prefix(spans: DataFrame, text: str = "text", types: tuple[str, ...] = ("ID_DOC",)) -> DataFrame:
    """Spans of the given types without a leading "n.", "n°", "nr." or "numero"."""
    value = F.substring(F.col(text), F.col("start") + 1, F.col("end") - F.col("start"))
    prefix = F.length(F.regexp_extract(value, r"(?iu)^(?:numero|nr\.|n\.|n°)\s*", 0))
    return spans.withColumn("start", F.when(F.col("type").isin(*types), F.least(F.col("end"), F.col("start") + prefix)).otherwise(F.col("start")))


def stress(gold: DataFrame, pred: DataFrame, docs: DataFrame) -> DataFrame:
    """Counts by category and overall (category null): docs has doc_id, category."""
    o = docs.select("doc_id", "category").join(outcomes(gold, pred), "doc_id", "left")
    d = o.groupBy("category", "doc_id").agg(*[F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias(n) for n, c in (("tp", F.col("in_gold") & F.col("in_pred")), ("fp", ~F.col("in_gold") & F.col("in_pred")), ("fn", F.col("in_gold") & ~F.col("in_pred")))])
    t = d.rollup("category").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], F.count(F.lit(1)).alias("documents"), F.sum(((F.col("fp") == 0) & (F.col("fn") == 0)).cast("long")).alias("exact"), F.sum((F.col("fp") > 0).cast("long")).alias("with_fp"))
    s = _scored(t).withColumn("exact_rate", ratio(F.col("exact"), F.col("documents")))
    return s.select("category", "documents", "tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "exact_rate")], "exact", "with_fp")


def summary(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """count, min, p05, median, mean, p95, max, population deviation and its ratio to the mean; nulls ignored, non-finite values an error."""
    q = quantiles(rows, value, list(by), [0.05, 0.5, 0.95]).select(*[F.col(b).alias(f"q_{b}") for b in by], "quantiles")
    x = rows.select(*by, F.col(value).alias("x"))
    out = x.groupBy(*by).agg(F.count("x").alias("n"), F.min("x").alias("min"), F.avg("x").alias("mean"), F.max("x").alias("max"), F.stddev_pop("x").alias("stdev"))
    same = F.lit(True)
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"q_{b}"))
    at = lambda i, name: F.get("quantiles", F.lit(i)).alias(name)
    out = out.join(q, same, "left").select(*by, "n", "min", at(0, "p05"), at(1, "median"), "mean", at(2, "p95"), "max", "stdev")
    return out.withColumn("cv", F.try_divide(F.col("stdev"), F.abs(F.col("mean"))))


def length_report(rows: DataFrame, length: str, over: tuple[int, ...] = (128, 256, 512), probs: tuple[float, ...] = (0.5, 0.9, 0.95, 0.99)) -> DataFrame:
    """One row: how many, the greatest, truncated percentiles (p50, ...) and the percentages over each threshold."""
    names = [f"p{round(100 * p)}" for p in probs]
    q = quantiles(rows, length, [], list(probs)).select(*[F.floor(F.get("quantiles", F.lit(i))).alias(n) for i, n in enumerate(names)])
    share = lambda t: F.round(100.0 * F.avg((F.col(length) > t).cast("double")), 6)
    t = rows.agg(F.count(length).alias("n"), F.max(length).alias("longest"), *[share(t).alias(f"over_{t}") for t in over])
    return t.join(q, F.lit(True), "left")  # one row each


def deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """Change of f1 and recall by type; a missing side counts as 0."""
    a = before.select("type", F.col("f1").alias("f1_before"), F.col("recall").alias("recall_before"))
    b = after.select("type", F.col("f1").alias("f1_after"), F.col("recall").alias("recall_after"))
    j = a.join(b, "type", "full_outer").na.fill(0.0)
    return j.select("type", (F.col("f1_after") - F.col("f1_before")).alias("f1_change"), (F.col("recall_after") - F.col("recall_before")).alias("recall_change"))


def latin_square(variants: list[str], rounds: int) -> list[tuple[int, int, str]]:
    """(round, position, variant): each variant once a round, and evenly over positions."""
    n = len(variants)
    return [(r, p, variants[(p + r) % n]) for r in range(rounds) for p in range(n)]


def rotation(rounds: DataFrame, variants: DataFrame, round_: str = "round", variant: str = "variant") -> DataFrame:
    """(round, position, variant) for any tables of rounds and variants, each in order: round r has variant (r + position) mod n at each of n positions."""
    n = variants.count()
    v = running(variants.select(F.col(variant).alias("variant")), [], ["variant"], "_v").select((F.col("_v") - 1).alias("_v"), "variant")
    r = running(rounds.select(F.col(round_).alias("round")), [], ["round"], "_r")
    cells = r.select("round", (F.col("_r") - 1).alias("_r"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("position")) if n else r.select("round", "_r", F.col("_r").alias("position")).limit(0)
    return cells.withColumn("_v", (F.col("_r") + F.col("position")) % F.lit(max(n, 1))).join(v, "_v").select("round", "position", "variant")


def schedule_gaps(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Cells (round, position, variant) that don't occur exactly once."""
    seen = actual.groupBy("round", "position", "variant").agg(F.count(F.lit(1)).alias("n"))
    return expected.join(seen, ["round", "position", "variant"], "left").na.fill(0, ["n"]).where("n <> 1")


def regression_report(runs: DataFrame, evidence: DataFrame, policies: DataFrame, failures: DataFrame, golden: str) -> DataFrame:
    """One row for each variant: verdict, reasons (in order), runs. It fails closed: only a variant with whole evidence, a policy and no failed gate has `passed`.

    runs: variant, run, status, documents, digest (of its predictions). evidence: kind (validation, preprocessor, documents, ...), variant (null: for all), expected, actual; documents is compared with the runs'
    counts. policies: variant, gate (a limit that applies to it). failures: variant, gate, as gate_report gives them (a view that one side lacks is a failure of gate `<view>.metrics_missing`).

    Three values: `failed` if something was measured and is wrong (a run that didn't end, unlike digests or counts, a failed gate, predictions that differ between runs), else
    `incomplete` if something that must be known is not (a null or missing digest, no evidence at all, no policy, no golden), else `passed`. The golden variant needs no policy.
    """
    word = lambda c, text: F.when(c, F.lit(text))
    n = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("long")), F.lit(0))
    r = runs.groupBy("variant").agg(F.count(F.lit(1)).alias("runs"), n(~F.col("status").eqNullSafe(F.lit("ok"))).alias("not_ok"), F.count_distinct("digest").alias("digests"), n(F.col("digest").isNull()).alias("no_digest"), F.min("documents").alias("fewest"), F.max("documents").alias("most"), n(F.col("documents").isNull()).alias("uncounted"))
    own = evidence.where("kind <> 'documents'")
    every = r.select("variant")
    shared = own.where("variant is null").drop("variant")
    # evidence for all variants is counted once; what concerns one variant is joined to it
    def told(rows, *by):
        out = rows.groupBy(*by) if by else rows.groupBy()
        return out.agg(F.count(F.lit(1)).alias("known"), n(F.col("expected") != F.col("actual")).alias("unlike"), n(F.col("expected").isNull() | F.col("actual").isNull()).alias("absent"))

    common = told(shared).first()
    wanted = evidence.where("kind = 'documents' and variant is null").agg(F.max("expected").cast("long")).first()[0]
    e = told(own.where("variant is not null"), "variant")
    p = policies.groupBy("variant").agg(F.count("gate").alias("policies"))
    f = failures.groupBy("variant").agg(F.count(F.lit(1)).alias("failures"))
    has_golden = not every.where(F.col("variant") == golden).isEmpty()
    j = r.join(e, "variant", "left").join(p, "variant", "left").join(f, "variant", "left").na.fill(0, ["known", "unlike", "absent", "policies", "failures"])
    wrong = F.array_compact(F.array(
        word(F.col("not_ok") > 0, "a run did not end well"), word(F.col("digests") > 1, "runs differ"), word((F.col("unlike") + F.lit(common.unlike)) > 0, "unlike digests"),
        word((F.col("fewest") != F.col("most")) | (F.col("fewest") != F.lit(wanted).cast("long")), "documents"), word(F.col("failures") > 0, "gates")))
    unknown = F.array_compact(F.array(
        word(F.lit(not has_golden), "no golden"), word(F.col("no_digest") > 0, "predictions without a digest"), word(F.col("known") + F.lit(common.known) == 0, "no evidence"), word(F.col("absent") + F.lit(common.absent) > 0, "missing digest"),
        word(F.lit(wanted is None) | (F.col("uncounted") > 0), "documents unknown"), word((F.col("policies") == 0) & (F.col("variant") != F.lit(golden)), "no policy")))
    out = j.select("variant", "runs", wrong.alias("_wrong"), unknown.alias("_unknown"))
    verdict = F.when(F.size("_wrong") > 0, "failed").when(F.size("_unknown") > 0, "incomplete").otherwise("passed")
    return out.select("variant", verdict.alias("verdict"), F.concat("_wrong", "_unknown").alias("reasons"), "runs")


def cumulative(rows: DataFrame, ts: str, *by: str, until: Column | None = None) -> DataFrame:
    """rows with how many of their key there are up to them. until: each key whose last point is earlier gets one more point there, with its last count (other columns null)."""
    out = running(rows, list(by), [ts], "cumulative")
    if until is None:
        return out
    last = rows.groupBy(*by).agg(F.max(ts).alias(ts), F.count(F.lit(1)).alias("cumulative")).where(F.col(ts) < until)
    return out.unionByName(last.withColumn(ts, until), allowMissingColumns=True)


def gate_report(golden: dict[str, DataFrame], candidate: dict[str, DataFrame], limits: dict[str, float | dict[str, float]]) -> DataFrame:
    """Failures (gate, type, actual, bound) of a candidate against golden, for each view of spans.

    golden and candidate: view name ("" is the main one) to (gold, pred) scores of per_type(). limits: max_micro_f1_drop, max_macro_f1_drop, min_micro_f1,
    min_macro_f1, max_per_tag_f1_drop, min_per_tag_f1, max_per_tag_recall_drop; the last three are a number for all types or one for each. Limits are inclusive. A type that
    one side lacks counts as 0; macro is the mean over the types of each side. A view that only one side has fails.
    """
    spark = next(iter(golden.values())).sparkSession
    out = None
    for view in sorted(set(golden) | set(candidate)):
        prefix = f"{view}." if view else ""
        if view not in golden or view not in candidate:
            rows = spark.createDataFrame([(f"{prefix}metrics_missing", None, 0.0, 1.0)], "gate string, type string, actual double, bound double")
        else:
            rows = _view_failures(spark, golden[view], candidate[view], limits, prefix)
        out = rows if out is None else out.unionByName(rows)
    return out


def _view_failures(spark, golden: DataFrame, candidate: DataFrame, limits: dict, prefix: str) -> DataFrame:
    def long(d, name):
        t = d.select("type", F.expr("stack(2, 'per_tag_f1', f1, 'per_tag_recall', recall) as (metric, value)"))
        micro = _scored(d.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tp", "fp", "fn")])).select(F.lit(None).cast("string").alias("type"), F.lit("micro_f1").alias("metric"), F.col("f1").alias("value"))
        macro = d.agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("value")).select(F.lit(None).cast("string").alias("type"), F.lit("macro_f1").alias("metric"), "value")
        return t.unionByName(micro).unionByName(macro).withColumnRenamed("value", name)

    a, b = long(golden, "was"), long(candidate, "now").withColumnsRenamed({"type": "t2", "metric": "m2"})
    both = a.join(b, F.col("type").eqNullSafe(F.col("t2")) & (F.col("metric") == F.col("m2")), "full_outer")
    both = both.select(F.coalesce("type", "t2").alias("type"), F.coalesce("metric", "m2").alias("metric"), F.coalesce("was", F.lit(0.0)).alias("was"), F.coalesce("now", F.lit(0.0)).alias("now"))
    rows = []
    for name, limit in limits.items():
        drop = name.startswith("max_")
        metric = name.removeprefix("max_").removeprefix("min_").removesuffix("_drop")
        for t, v in limit.items() if isinstance(limit, dict) else [(None, limit)]:
            rows.append((name, metric, t, drop, float(v)))
    policy = spark.createDataFrame(rows, "gate string, metric string, for_type string, drop boolean, bound double")
    j = both.join(F.broadcast(policy), "metric").where(F.col("for_type").isNull() | (F.col("for_type") == F.col("type")))
    actual = F.when(F.col("drop"), F.col("was") - F.col("now")).otherwise(F.col("now"))
    failed = F.when(F.col("drop"), actual > F.col("bound")).otherwise(actual < F.col("bound"))
    return j.where(failed).select(F.concat(F.lit(prefix), "gate").alias("gate"), "type", actual.alias("actual"), "bound")


def mask_statistics(tokens: DataFrame, raw: bool = False) -> DataFrame:
    """Which supervised tokens a teacher may teach. tokens: window, gold, teacher (BIO labels; gold null where unsupervised).

    A token is active if both have the same type, or with raw always; exact ones agree in full, bio_only ones in type alone.
    """
    kind = lambda c: F.regexp_replace(F.col(c), "^[BI]-", "")
    t = tokens.where(F.col("gold").isNotNull()).select("window", (F.col("gold") == F.col("teacher")).alias("exact"), (kind("gold") == kind("teacher")).alias("same"))
    n = lambda c: F.sum(c.cast("long"))
    active = F.lit(True) if raw else F.col("same")
    per = tokens.select("window").distinct().join(t.groupBy("window").agg(F.count(F.lit(1)).alias("supervised"), n(F.col("exact")).alias("exact"), n(F.col("same") & ~F.col("exact")).alias("bio_only"), n(~F.col("same")).alias("mismatch"), n(active).alias("active")), "window", "left").na.fill(0)
    total = per.agg(*[F.sum(c).alias(c) for c in ("supervised", "exact", "bio_only", "mismatch", "active")], n(F.col("active") == 0).alias("windows_without"), F.min("active").alias("least_active"), F.max("active").alias("most_active"))
    return total.withColumns({"excluded": F.col("supervised") - F.col("active"), "coverage": F.try_divide(F.col("active").cast("double"), F.col("supervised"))})


def error_examples(outcomes: DataFrame, *by: str, limit: int = 12, order: str = "doc_id") -> DataFrame:
    """The first `limit` documents with errors of each group: outcomes has tp, fp, fn."""
    w = Window.partitionBy(*by).orderBy(order)
    return outcomes.where((F.col("fp") > 0) | (F.col("fn") > 0)).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")


def symmetric_difference(a: DataFrame, b: DataFrame, key: list[str] = KEY) -> DataFrame:
    """How many spans only one side has."""
    return outcomes(a, b, key).agg(F.sum((F.col("in_gold") != F.col("in_pred")).cast("long")).alias("n"))


def subset_of(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def report_text(rows: DataFrame, columns: list[str], width: int = 12) -> str:
    """A fixed-width table of a small result."""
    cell = lambda v: f"{v:.4f}" if isinstance(v, float) else "" if v is None else str(v)
    lines = ["".join(c[:width].ljust(width + 1) for c in columns).rstrip()]
    return "\n".join(lines + ["".join(cell(r[c])[:width].ljust(width + 1) for c in columns).rstrip() for r in rows.select(*columns).collect()])


def latest(versions: list[str]) -> str | None:
    """The highest version by its numbers."""
    import re

    return max(versions, key=lambda v: tuple(map(int, re.findall(r"\d+", v))), default=None)
