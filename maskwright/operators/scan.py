"""Numbers and running sums of any key in two phases, without a window over a whole key.

1. The rows are sorted into ranges of (keys, order) and written with the number of their range and their place in it.
2. Within a range, a window over (range, key) gives the sums so far. A key that several ranges hold gets, for each of them, what the ranges before
   it summed up: the first and last keys of ranges only, so at most two rows a range, are put together and joined back by a broadcast of that size.

A key with a third of all rows is thus spread over a third of the ranges.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written


def _same(keys: list[str], other: str) -> Column:
    return functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"{other}{k}")) for k in keys], F.lit(True))


def running(rows: DataFrame, keys: list[str], order: list[str | Column], number: str | None = "number", sums: dict[str, str | Column] | None = None, parts: int | None = None) -> DataFrame:
    """rows with their number in the key's order (from 1) and running sums, the row itself included.

    keys may be empty (one key for all rows) and null (a key of its own). Rows that are equal in keys and order stand in any order, fixed once. Null values add nothing. order: names
    or columns, sortable as given (asc or desc columns too). parts: how many ranges; by default as many as shuffle partitions.
    An empty table gives an empty result.
    """
    sums = {n: F.col(c) if isinstance(c, str) else c for n, c in (sums or {}).items()}
    by = [*[F.col(k) for k in keys], *[F.col(o) if isinstance(o, str) else o for o in order]]
    ranged = rows.repartitionByRange(parts, *by) if parts else rows.repartitionByRange(*by)
    sorted_ = ranged.sortWithinPartitions(*by).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id(), **{f"_v_{n}": F.coalesce(c, F.lit(0)) for n, c in sums.items()}})
    t = written(sorted_, "ranges")
    sums = {n: F.sum(f"_v_{n}") for n in sums} | ({number: F.count(F.lit(1))} if number else {})
    w = Window.partitionBy("_part", *keys).orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    local = t.withColumns({n: c.over(w) for n, c in sums.items()})
    # what of each key stands in each range, for keys in more than one: they are the first or last of their ranges
    held = t.groupBy("_part", *keys).agg(F.min("_at").alias("_first"), F.max("_at").alias("_last"), *[c.alias(n) for n, c in sums.items()])
    ends = t.groupBy("_part").agg(F.min("_at").alias("_a"), F.max("_at").alias("_b")).withColumnRenamed("_part", "_p")
    edge = written(held.join(ends, (F.col("_part") == F.col("_p")) & ((F.col("_first") == F.col("_a")) | (F.col("_last") == F.col("_b")))).select("_part", *keys, *sums), "range-ends")
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = edge.select(F.col("_part").alias("c_part"), *[F.col(k).alias(f"c_{k}") for k in keys], *[F.sum(n).over(before).alias(f"c_{n}") for n in sums])
    carried = carried.where(functools.reduce(lambda a, b: a | b, [F.col(f"c_{n}").isNotNull() for n in sums]))  # only keys that began in an earlier range
    j = local.join(F.broadcast(carried), (F.col("_part") == F.col("c_part")) & _same(keys, "c_"), "left")
    return j.select(*[F.col(f"`{c}`") for c in rows.columns], *[(F.col(n) + F.coalesce(F.col(f"c_{n}"), F.lit(0).cast(local.schema[n].dataType))).alias(n) for n in sums])
