"""The corpus pipeline: quality rules, exact dedup, near-duplicate join, repeated passages, packing.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and reread as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm import exact_dedup, jaccard_join, packing, quality_rules, suffix_dedup
from maskwright.llm.common import materialise, scratch_since, text_or_empty
from maskwright.llm.encoders import tokenizer_path

_before: list = []


def _stage(function):
    """Deletes the scratch tables of the stage before, whose result has been written by now."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _before:
            _before.pop()()
        made = scratch_since()
        out = function(spark, docs, sf_dir)
        _before.append(made)
        return out

    run.__name__, run.__doc__ = function.__name__, function.__doc__
    return run


def _packed(docs: DataFrame, **keys: Column) -> DataFrame:
    """row (a struct of the columns of docs, whatever their names) and keys: values by which verdicts on rows are joined."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), *[k.alias(n) for n, k in keys.items()])


def _columns(rows: DataFrame, columns: list[str], **new: Column) -> DataFrame:
    return rows.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in columns])


def _keep(docs: DataFrame, kept: DataFrame, once: bool = False, **keys: Column) -> DataFrame:
    """The rows of docs whose keys stand in kept (null equals null). once: of rows with equal keys one only."""
    kept = kept.select(*[F.col(k).alias(f"kept_{k}") for k in keys]).distinct()
    rows = _packed(docs, **keys)
    same = [F.col(k).eqNullSafe(F.col(f"kept_{k}")) for k in keys]
    rows = rows.join(kept, functools.reduce(lambda a, b: a & b, same), "left_semi")
    return _columns(rows.dropDuplicates(list(keys)) if once else rows, docs.columns)


def _hash() -> Column:
    return F.xxhash64(text_or_empty())


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: each row by its own text and language, so rows that share a doc_id are judged apart.

    Null texts fail the base rules; a null language is one of its own; null doc_ids and repeated rows are rows like others; an empty table stays empty.
    """
    verdicts = quality_rules.quality(docs, more=("text_hash",))
    return _keep(docs, verdicts.where("kept"), doc_id=F.col("doc_id"), lang=quality_rules.language(), text_hash=_hash())


@_stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays (null before all others), and of several such rows one.

    Null and empty texts are equal; an empty table stays empty.
    """
    verdicts = materialise(exact_dedup.dedup(docs, more=("text_hash",)), "exact-verdicts")
    again = not verdicts.where("not kept").join(verdicts.where("kept").select(F.col("doc_id").alias("d"), F.col("text_hash").alias("h")), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("h")), "left_semi").isEmpty()
    return _keep(docs, verdicts.where("kept"), once=again, doc_id=F.col("doc_id"), text_hash=_hash())


@_stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents the one with the smallest doc_id stays; of rows that share a doc_id, the first by a hash of their text.

    Documents without words are linked with nothing and stay, as do null doc_ids' rows that come first; rows equal in doc_id and text are one document, and stay or go together.
    """
    rows = suffix_dedup.numbered(docs)
    first = jaccard_join.join(rows.select(F.col("_id").alias("doc_id"), F.col("_text").alias("text")))[0].where(F.col("doc_id") == F.col("component_id"))
    return _columns(rows.join(first.select(F.col("doc_id").alias("_id")), "_id", "left_semi"), docs.columns)


@_stage
def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated strings of 100 bytes go from the texts; a character that a cut leaves in part goes too. Every document stays, even if nothing of it is left.

    Null texts stay null; repeated and null doc_ids as in suffix_dedup; an empty table stays empty.
    """
    text = F.when(F.col("n_removed") > 0, _decoded("kept")).otherwise(F.col("row.text"))
    new = {"text": text}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_removed") > 0, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return _columns(suffix_dedup.dedup(docs), docs.columns, **new)


def _decoded(name: str):
    @F.pandas_udf("string")
    def decode(raw):
        return raw.map(lambda b: bytes(b).decode("utf-8", "ignore"))

    return decode(name)


@_stage
def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all pieces in sequences of at most 2048 tokens. A null text is empty and holds the end id alone; repeated and null doc_ids are documents of their own."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("quality rules", quality), ("exact dedup", exact), ("n-gram Jaccard join", near), ("suffix-array dedup", passages), ("best-fit packing", pack)]

#: no stage but the second can be put in SQL that runs over whole tables; tests/llm/test_pipeline.py has a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, f"pipeline-{i}", own=False)
    return docs
