"""Exact dedup of incoming texts against an immutable snapshot.

A snapshot keeps one row per distinct digest (exact buckets) and one static binary fuse filter per
bucket. Incoming rows are first grouped among themselves by digest (partial sums before the shuffle,
so a group of any size costs each task one row), then each distinct digest is screened by the filter of
its bucket; only what passes joins the exact buckets, and there the bytes of both representatives are compared.

A class is known by its digest, and its representative by doc_id and a number of its row, so rows that share a doc_id
but not a text are told apart, and of rows that share both just one is kept.

Edge cases: a null text counts as empty, empty texts are equal to each other; a null doc_id is smaller than all others (keep_id is
null for its class); repeated rows are counted and returned each, and one of them is kept; other columns of the input are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import fuse_filter
from .common import materialise, text_or_empty

KEYS_PER_BUCKET = 16_384


def normalised(name: str = "text"):
    return F.regexp_replace(text_or_empty(name), r"[\x20\x09-\x0D]+", " ")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, a number for each row (fixed once the table is written), text_sha256 of the normalised text, and the 64-bit filter key."""
    d = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.sha2(normalised(), 256).alias("text_sha256"), F.xxhash64(text_or_empty()).alias("text_hash"))
    return d.withColumn("key", F.xxhash64("text_sha256"))


def groups(digest_rows: DataFrame) -> DataFrame:
    """text_sha256, key, keep (doc_id and row of the representative: the smallest, nulls first) and n of each class."""
    return digest_rows.groupBy("text_sha256", "key").agg(F.min(F.struct("doc_id", "row")).alias("keep"), F.count(F.lit(1)).alias("n"))


@dataclass
class Snapshot:
    """classes: text_sha256, key, keep, n. filters: bucket, filter. Both are written tables."""

    classes: DataFrame
    filters: DataFrame
    buckets: int


def _build(table: pa.Table) -> pa.Table:
    return pa.table({"bucket": table.column("bucket").slice(0, 1), "filter": pa.array([fuse_filter.build(np.asarray(table.column("key")).view(np.uint64))], pa.binary())})


def build_snapshot(digest_rows: DataFrame) -> Snapshot:
    """Fixes the digests of `digest_rows` as an immutable snapshot."""
    classes = materialise(groups(digest_rows), "snapshot-classes")
    buckets = max(1, -(-classes.count() // KEYS_PER_BUCKET))
    filters = classes.select(F.pmod("key", F.lit(buckets)).alias("bucket"), "key").groupBy("bucket").applyInArrow(_build, "bucket long, filter binary")
    return Snapshot(classes, materialise(filters, "snapshot-filters"), buckets)


def _probe(rows: pa.Table, filters: pa.Table) -> pa.Table:
    rows = rows.select(["text_sha256", "key", "keep", "n"])
    if not filters.num_rows:
        return rows.slice(0, 0)
    return rows.filter(pa.array(fuse_filter.contains(filters.column("filter")[0].as_py(), np.asarray(rows.column("key")).view(np.uint64))))


def screen(batch_groups: DataFrame, snapshot: Snapshot) -> DataFrame:
    """The distinct incoming digests that the filters let pass: all that are in the snapshot, and about 1 in 256 others.

    A small snapshot with a large batch is dealt to more tasks than it has buckets: each takes a share of the digests and a copy of the filter.
    """
    shares = max(1, -(-batch_groups.count() // (4 * KEYS_PER_BUCKET * snapshot.buckets)))
    rows = batch_groups.withColumns({"bucket": F.pmod("key", F.lit(snapshot.buckets)), "share": F.pmod(F.xxhash64("key", F.lit(1)), F.lit(shares))})
    filters = snapshot.filters.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(shares - 1).cast("long"))))
    return rows.groupBy("bucket", "share").cogroup(filters.groupBy("bucket", "share")).applyInArrow(_probe, batch_groups.select("text_sha256", "key", "keep", "n").schema)


def match(batch_groups: DataFrame, snapshot: Snapshot, docs: DataFrame) -> DataFrame:
    """text_sha256, old, new (representatives with equal digests), their counts and whether their bytes are the same."""
    old = snapshot.classes.select("text_sha256", F.col("keep").alias("old"), F.col("n").alias("old_n"))
    pairs = materialise(screen(batch_groups, snapshot).withColumnsRenamed({"keep": "new", "n": "new_n"}).drop("key").join(old, "text_sha256"), "exact-hits")
    wanted = pairs.select(F.col("text_sha256").alias("digest"), F.explode(F.array("old.doc_id", "new.doc_id")).alias("wanted_id"))
    texts = docs.select("doc_id", normalised().alias("bytes")).withColumn("text_sha256", F.sha2("bytes", 256))
    found = texts.join(wanted.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("wanted_id")) & (F.col("text_sha256") == F.col("digest")))
    return pairs.join(found.groupBy("digest").agg((F.min("bytes") == F.max("bytes")).alias("same")).withColumnRenamed("digest", "text_sha256"), "text_sha256", "left").withColumn("same", F.coalesce("same", F.lit(False)))


def dedup(docs: DataFrame, snapshot_to=None, more: tuple[str, ...] = ()) -> DataFrame:
    """Every row of docs with the class it belongs to: doc_id, keep_id, group_size, kept, text_sha256; more may name text_hash (xxhash64 of the text as it is).

    Rows with doc_id up to `snapshot_to` form the snapshot, the rest the incoming batch; by default the
    median doc_id. The result doesn't depend on the cut. The smallest doc_id of a class is kept.
    """
    if snapshot_to is None:
        snapshot_to = docs.select(F.percentile_approx("doc_id", 0.5, 1000)).first()[0]
    rows = materialise(digests(docs).withColumn("old", F.coalesce(F.col("doc_id") <= F.lit(snapshot_to), F.lit(True))), "digests")
    snapshot = build_snapshot(rows.where("old"))
    batch = materialise(groups(rows.where("not old")), "batch-classes")
    hits = materialise(match(batch, snapshot, docs).where("same"), "byte-equal")
    # classes of more than one row, once for each side of the cut
    merged = hits.select("text_sha256", F.least("old", "new").alias("keep"), (F.col("old_n") + F.col("new_n")).alias("n"))
    sides = [merged.select("text_sha256", F.lit(v).alias("old"), "keep", "n") for v in (True, False)]
    for v, own in ((True, snapshot.classes), (False, batch)):
        sides.append(own.where("n > 1").join(hits.select("text_sha256"), "text_sha256", "left_anti").select("text_sha256", F.lit(v).alias("old"), "keep", "n"))
    classes = materialise(sides[0].unionByName(sides[1]).unionByName(sides[2]).unionByName(sides[3]), "classes")
    out = rows.join(classes, ["text_sha256", "old"], "left")
    alone = F.col("keep").isNull()
    return out.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), (alone | (F.col("keep.row") == F.col("row"))).alias("kept"), "text_sha256", *more)


def op1_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, first_value(doc_id) OVER o AS keep_id, count(*) OVER w AS group_size, row_number() OVER o = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256), o AS (PARTITION BY text_sha256 ORDER BY doc_id NULLS FIRST)
"""
