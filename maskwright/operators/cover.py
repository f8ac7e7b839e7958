"""Selection of rows that together meet floors of several features at once.

Threshold greedy in few passes: at each level, rows that hold at least that many features still short are candidates. In salted order, each feature asks for as many candidates as it is short of, and a
row is taken if at least `level` of its features ask for it. The last level is 1, so floors are met wherever there are rows. Candidates of each feature are numbered in two phases over
sorted ranges, so a feature that a third of all rows hold is no hot group; what has been taken is a written table, and only one count for each feature reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import release, written
from .dataset import salted
from .scan import running


def without(rows: DataFrame, taken: DataFrame | None, *keys: str) -> DataFrame:
    """rows that share none of the keys with taken."""
    for k in keys if taken is not None else ():
        rows = rows.join(taken.select(k).where(F.col(k).isNotNull()).distinct(), k, "left_anti")
    return rows


def distinct_skeletons(rows: DataFrame, key: str, skeleton: str, order: str = "_order") -> DataFrame:
    """Of rows with one skeleton the first in order: partial minima, no window."""
    first = rows.groupBy(skeleton).agg(F.min(F.struct(order, key)).alias("_first")).select(F.col("_first")[key].alias(key))
    return rows.join(first, key, "left_semi")


def cover(rows: DataFrame, key: str, skeleton: str, features: str, floors: dict[str, int], salt: str, levels: tuple[int, ...] = (4, 2, 1), forbidden: DataFrame | None = None, strict: bool = True) -> DataFrame:
    """A written table (key, skeleton, features) of rows with unlike skeletons that meets every floor; strict: an error names the floors that can't be met.

    key must be unique. features is an array column (null: none). forbidden: rows whose key or skeleton may not be used. The result depends on nothing but keys, skeletons, features and the salt.
    """
    if levels[-1] != 1 or list(levels) != sorted(levels, reverse=True):
        raise ValueError("levels fall and end with 1")
    base = rows.select(key, skeleton, F.filter(F.array_distinct(F.coalesce(features, F.array().cast("array<string>"))), lambda f: f.isin(*floors)).alias("features"), salted(salt, F.col(key)).alias("_order")).where(F.size("features") > 0)
    base = written(without(base, forbidden, key, skeleton), "cover-rows")
    taken, short = None, {f: n for f, n in floors.items() if n > 0}
    for level in levels:
        while short:
            open_ = F.array(*map(F.lit, short))
            free = without(base, taken, key, skeleton).withColumn("_open", F.array_intersect("features", open_)).where(F.size("_open") >= level)
            need = F.create_map(*[F.lit(x) for pair in short.items() for x in pair])
            asked = running(free.select(key, "_order", F.explode("_open").alias("_feature")), ["_feature"], ["_order", key], "_n").where(F.col("_n") <= F.element_at(need, F.col("_feature")))
            chosen = asked.groupBy(key).agg(F.count(F.lit(1)).alias("_asks")).where(F.col("_asks") >= level).select(key)
            more = distinct_skeletons(base.join(chosen, key, "left_semi"), key, skeleton).select(key, skeleton, "features")
            before = taken
            taken = written(more if taken is None else taken.unionByName(more), "covered")
            have = {r.f: r.n for r in taken.select(F.explode("features").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row for each floor
            left = {f: n - have.get(f, 0) for f, n in floors.items() if n > have.get(f, 0)}
            still = left == short
            if before is not None:
                release(before)
            short = left
            if still:  # no row was taken
                break
    if strict and short:
        raise ValueError(f"floors that can't be met: {short}")
    release(base)
    return taken if taken is not None else rows.select(key, skeleton, F.col(features).alias("features")).limit(0)
