"""Connected components of an edge table, by alternating large and small stars on joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import collect_garbage, materialise


def _state(edges: DataFrame) -> tuple:
    return edges.select(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v (longs). Returns a written table (id, component) of all ids in edges; component is the smallest id reachable.

    No neighbourhood is gathered: a vertex of any degree costs partial minima and a join that adaptive execution can split.
    """
    e = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "star")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # a vertex's edges to smaller ones stay represented by those of its neighbours' stars
        e = materialise(large.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "large-star")
        down = materialise(e.groupBy("u").agg(F.min("v").alias("m")), "star")
        small = e.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialise(small.unionByName(down.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "small-star")
        now = _state(e)
        collect_garbage(edges.sparkSession)
        if now == before:
            break
        before = now
    roots = e.select(F.col("v").alias("id")).distinct()
    return materialise(e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots.select("id", F.col("id").alias("component"))), "components")
