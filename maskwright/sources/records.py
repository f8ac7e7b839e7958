"""Readers of the three record dialects, strict or permissive, and sinks."""

from __future__ import annotations

import functools
import hashlib
import uuid
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checks
from ..functions.taxonomy import admitted
from ..functions.text import tokens as words
from ..operators.bio import span_to_bio

TOKEN_DIALECT = "mbert_tokens array<string>, mbert_token_classes array<string>, language string, source_text string, masked_text string"
NATIVE_DIALECT = "tokens array<string>, bio_labels array<string>, source_text string, entities array<struct<value:string,label:string,start:int,end:int>>, language string, template_id string, meta string"


def _unified(raw: DataFrame, dialect: str) -> DataFrame:
    if dialect == "token":
        return raw.select(F.col("mbert_tokens").alias("tokens"), F.col("mbert_token_classes").alias("labels"), F.coalesce("language", F.lit("?")).alias("language"), "source_text")
    return raw.select("tokens", F.col("bio_labels").alias("labels"), F.coalesce("language", F.lit("it")).alias("language"), "source_text", "entities", "template_id")


def reject_reason(tokens: Column, labels: Column) -> Column:
    """Why a row of tokens and labels can't be used, or null."""
    types = F.filter(F.transform(labels, lambda x: F.regexp_replace(x, "^[BI]-", "")), lambda t: t != "O")
    return F.coalesce(
        F.when(tokens.isNull() | labels.isNull(), F.lit("missing arrays")), F.when(F.size(tokens) == 0, F.lit("no tokens")), F.when(F.size(tokens) != F.size(labels), F.lit("unlike lengths")),
        F.when(F.exists(types, lambda t: ~admitted(t) & ~t.isin("TITLE", "TRIBUNAL")), F.lit("unknown label")))


def checked(rows: DataFrame, reason: Column, mode: str) -> DataFrame:
    """permissive drops rejected rows, report keeps them with _reject_reason, strict fails on the first."""
    out = rows.withColumn("_reject_reason", reason)
    if mode == "report":
        return out
    if mode == "permissive":
        return out.where(F.col("_reject_reason").isNull()).drop("_reject_reason")
    return _strict(out).drop("_reject_reason")  # a filter: no choice of columns drops it


def record_error(text: Column, entities: Column, tokens: Column, labels: Column) -> Column:
    """Why a record can't be used, or null: arrays and labels, offsets that don't give the value, codes whose checksum fails."""
    value = lambda e: F.substring(text, e["start"] + 1, e["end"] - e["start"])
    codes = (("CF", checks.cf_ok), ("PIVA", checks.piva_ok), ("IBAN", checks.iban_ok), ("CREDITCARDNUMBER", checks.luhn_ok))
    wrong = lambda e: F.coalesce(*[F.when((e["label"] == k) & ~ok(e["value"]), F.lit(True)) for k, ok in codes], F.lit(False))
    return F.coalesce(
        reject_reason(tokens, labels), F.when(F.exists(entities, lambda e: ~admitted(e["label"])), F.lit("unknown label")), F.when(F.exists(entities, lambda e: F.coalesce(value(e) != e["value"], F.lit(True))), F.lit("offsets")),
        F.when(F.exists(entities, wrong), F.lit("checksum")))


def shape(rows: DataFrame, required: list[str], arrays: tuple[str, str] | None = None) -> DataFrame:
    """Rows, rows that lack a required field, rows whose two arrays differ in length."""
    lost = [c for c in required if c not in rows.columns]
    if lost:
        raise ValueError(f"columns are missing: {lost}")
    bad = F.lit(False)
    for c in required:
        bad = bad | F.col(c).isNull()
    unlike = F.size(arrays[0]) != F.size(arrays[1]) if arrays else F.lit(False)
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), n(bad).alias("n_incomplete"), n(F.coalesce(unlike, F.lit(True))).alias("n_misaligned"))


def require_shape(rows: DataFrame, expected: int, required: list[str], arrays: tuple[str, str] | None = None) -> DataFrame:
    """rows, if they are as many as expected, complete and aligned: an action, before anything is returned."""
    got = shape(rows, required, arrays).first()
    if tuple(got) != (expected, 0, 0):
        raise ValueError(f"expected {expected} whole rows, found {got.asDict()}")
    return rows


def read_parquet(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Just these columns; a missing one is an error before any row is read."""
    rows = spark.read.parquet(path)
    lost = [c for c in columns if c not in rows.columns]
    if lost:
        raise ValueError(f"{path} lacks {lost}")
    return rows.select(*columns)


def read_splits(spark: SparkSession, paths: dict[str, str], **how) -> dict[str, DataFrame]:
    """Each split by itself; splits needn't share a schema."""
    return {name: read_parquet(spark, p, how["columns"]) if p.endswith(".parquet") else read_jsonl(spark, p, **how) for name, p in paths.items()}


def verify_sources(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """Files (path, length, sha256) that are missing, new or changed against a manifest."""
    now = manifest(spark, path).withColumnsRenamed({"length": "length_now", "sha256": "sha256_now"})
    j = expected.join(now, "path", "full_outer")
    state = F.when(F.col("sha256_now").isNull(), "missing").when(F.col("sha256").isNull(), "new").when((F.col("sha256") != F.col("sha256_now")) | (F.col("length") != F.col("length_now")), "changed")
    return j.select("path", state.alias("state")).where(F.col("state").isNotNull())


def mentions(text: Column, words: Iterable[str]) -> Column:
    """Whether a text holds one of the words, in any case."""
    low = F.lower(text)
    return F.exists(F.array(*[F.lit(w.lower()) for w in words]), lambda w: F.contains(low, w))


def read_jsonl(spark: SparkSession, path: str, dialect: str = "native", language: str | None = None, mode: str = "permissive", limit: int | None = None, seed: int = 0) -> DataFrame:
    """One dialect's records; limit takes the first rows in the order of a seeded hash of the whole row."""
    raw = spark.read.schema(TOKEN_DIALECT if dialect == "token" else NATIVE_DIALECT).json(path)
    rows = checked(_unified(raw, dialect), reject_reason(F.col("tokens"), F.col("labels")), mode)
    rows = rows if language is None else rows.where(F.col("language") == language)
    if limit is None:
        return rows
    return rows.withColumn("_order", F.sha2(F.concat(F.lit(f"{seed}:"), F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})), 256)).orderBy("_order").limit(limit).drop("_order")


_ENTITIES = "array<struct<value:string,label:string,start:int,end:int>>"


def parsed_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Lines of JSON in any mix of the three dialects, each parsed once and read by its own fields: the other columns and line, dialect, tokens, labels, language, source_text, entities, template_id, _reject_reason.

    A line with source_text and entities is of the spans dialect unless it has tokens and bio_labels too; its tokens and labels follow from its spans. A line that isn't JSON, or has the
    fields of no dialect, has no dialect; a field of another type counts as missing.
    """
    keep = [c for c in lines.columns if c != column]
    d = lines.select(*keep, F.col(column).alias("line"), F.try_parse_json(F.col(column)).alias("_v"))
    get = lambda name, kind: F.try_variant_get("_v", f"$.{name}", kind)
    has = lambda *names: functools.reduce(lambda a, b: a & b, [get(n, "variant").isNotNull() & ~F.coalesce(F.is_variant_null(get(n, "variant")), F.lit(False)) for n in names])
    dialect = F.when(has("tokens", "bio_labels"), "native").when(has("mbert_tokens", "mbert_token_classes"), "token").when(has("source_text", "entities"), "spans")
    d = d.withColumn("dialect", dialect).withColumns({"source_text": get("source_text", "string"), "entities": get("entities", _ENTITIES)})
    own = F.col("dialect")
    spans = own == "spans"
    pieces = words(F.col("source_text"))
    tokens = F.when(own == "native", get("tokens", "array<string>")).when(own == "token", get("mbert_tokens", "array<string>")).when(spans, F.transform(pieces, lambda t: t["value"]))
    labels = F.when(own == "native", get("bio_labels", "array<string>")).when(own == "token", get("mbert_token_classes", "array<string>")).when(spans, span_to_bio(pieces, F.col("entities")))
    d = d.withColumns({"tokens": tokens, "labels": labels, "language": F.when(own.isNotNull(), F.coalesce(get("language", "string"), F.when(own == "token", "?").otherwise("it"))), "template_id": get("template_id", "string")})
    reason = F.coalesce(F.when(F.col("_v").isNull(), F.lit("not JSON")), F.when(own.isNull(), F.lit("no known dialect")), reject_reason(F.col("tokens"), F.col("labels")))
    return d.withColumn("_reject_reason", reason).drop("_v")


def read_mixed(spark: SparkSession, path: str, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(records, rejects) of files whose lines may be of any dialect. rejects: file, line, _reject_reason; strict fails on the first of them instead. Empty lines are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "").select("value", F.col("_metadata.file_path").alias("file"))
    parsed = parsed_lines(lines)
    if strict:
        parsed = _strict(parsed)
    return parsed.where(F.col("_reject_reason").isNull()).drop("_reject_reason", "line", "file"), parsed.where(F.col("_reject_reason").isNotNull()).select("file", "line", "_reject_reason")


def _strict(parsed: DataFrame) -> DataFrame:
    fail = F.raise_error(F.concat(F.lit("rejected row: "), F.col("_reject_reason"))).cast("boolean")
    return parsed.where(F.when(F.col("_reject_reason").isNull(), F.lit(True)).otherwise(fail))


def read_span_parquet(spark: SparkSession, path: str, text: str = "unmasked_text", spans: str = "span_labels") -> DataFrame:
    """Parquet whose spans are a literal list of [start, end, 'LABEL_n']."""
    return spark.read.parquet(path).select(F.col(text).alias("source_text"), literal_spans(F.col(spans)).alias("entities"))


def literal_spans(literal: Column) -> Column:
    rows = F.from_json(F.translate(literal, "()'", '[]"'), "array<array<string>>")
    one = lambda r: F.struct(F.get(r, F.lit(0)).cast("int").alias("start"), F.get(r, F.lit(1)).cast("int").alias("end"), F.regexp_replace(F.get(r, F.lit(2)), r"_\d+$", "").alias("label"))
    return F.transform(rows, one)


def dialect_of(columns: list[str]) -> str:
    """Raw spans win over token labels."""
    names = set(columns)
    for dialect, needed in (("spans", {"source_text", "entities"}), ("native", {"tokens", "bio_labels"}), ("token", {"mbert_tokens", "mbert_token_classes"})):
        if needed <= names:
            return dialect
    raise ValueError(f"no known dialect in {sorted(names)}")


def read_texts(spark: SparkSession, path: str, glob: str = "*.txt") -> DataFrame:
    """Whole files as documents: UTF-8 with or without mark, else UTF-16, else Latin-1."""
    @F.pandas_udf("string")
    def decoded(content: pd.Series) -> pd.Series:
        def one(b):
            for code in ("utf-8-sig", "utf-16", "latin-1"):
                try:
                    return bytes(b).decode(code)
                except UnicodeDecodeError:
                    pass

        return content.map(one)

    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", decoded("content").alias("text"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("errorifexists").option("ignoreNullFields", "false").json(path)


def publish(rows: DataFrame, path: str) -> bool:
    """Writes once: an existing folder with the same rows is left, with others is an error. True if it wrote."""
    spark = rows.sparkSession
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(jpath):
        old = spark.read.schema(rows.schema).json(path)
        if content_hash(old) != content_hash(rows):
            raise ValueError(f"{path} holds other rows")
        return False
    staging = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex[:12]}"  # a failed attempt doesn't stand in a retry's way
    write_jsonl(rows, staging)
    if not fs.rename(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(staging), jpath):
        raise OSError(f"could not publish {path}")
    return True


def content_hash(rows: DataFrame) -> str:
    """A hash of a table's rows whatever their order."""
    line = F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256)
    parts = [F.conv(F.substring(line, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)").alias(f"h{i}") for i in range(8)]  # all 256 bits, summed in eight parts
    got = rows.select(*parts).agg(F.count(F.lit(1)), *[F.coalesce(F.sum(f"h{i}"), F.lit(0)) for i in range(8)]).first()
    return hashlib.sha256(":".join(map(str, got)).encode()).hexdigest()


def options(*layers: dict, defaults: dict | None = None) -> dict:
    """The first layer that has a value wins (environment, file, defaults); lists may be comma-separated, booleans written in words."""

    def value(v):
        if isinstance(v, str) and v.strip().lower() in ("1", "true", "yes", "on", "0", "false", "no", "off"):
            return v.strip().lower() in ("1", "true", "yes", "on")
        return [x.strip() for x in v.split(",") if x.strip()] if isinstance(v, str) and "," in v else v

    out = dict(defaults or {})
    for layer in reversed(layers):
        out |= {k: value(v) for k, v in layer.items() if v is not None}
    return out
