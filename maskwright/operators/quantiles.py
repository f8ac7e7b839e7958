"""Exact quantiles of any number of groups by refining histograms, in PASSES scans.

Values become 64-bit integers in the same order. Each pass counts, for every group and every prefix of wanted values, how many values have which
next DIGIT bits, and goes on with the digit in which a wanted rank lies. What is shuffled are counts, added up in the task that reads the values first;
what is kept between passes is one row for each group and prefix.

That pays for large groups only: those of at most SORTED values are sorted and numbered by a window in one pass, as their histograms would be as many rows as
the values. So no task holds more than SORTED values of a group.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import release, written

DIGIT = 16
PASSES = 64 // DIGIT
BROADCAST_ROWS = 200_000
SORTED = 500_000


def ordered_key(value: Column, kind: T.DataType) -> Column:
    """A 64-bit integer that orders like the value: integers, dates and decimals as they are, doubles as their exponent and fraction (their IEEE bits, in effect)."""
    if isinstance(kind, T.IntegralType):
        return value.cast("long")
    if isinstance(kind, T.DateType):
        return F.unix_date(value).cast("long")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value)
    if isinstance(kind, T.DecimalType) and kind.precision <= 18:
        return (value * F.lit(10**kind.scale).cast("decimal(19,0)")).cast("long")
    if not isinstance(kind, T.FractionalType):
        raise TypeError(f"quantiles of {kind.simpleString()}")
    x = F.abs(value.cast("double"))
    least = 2.0**-1022
    e = F.floor(F.log2(F.greatest(x, F.lit(least))))
    e = e - (F.pow(F.lit(2.0), e) > x).cast("long")  # log2 may be rounded to the next whole number
    e = F.greatest(e + (F.pow(F.lit(2.0), e + 1) <= x).cast("long"), F.lit(-1022))
    fraction = F.lit(2.0**52)
    normal = (e + 1023) * F.lit(1 << 52) + ((x / F.pow(F.lit(2.0), e) - 1) * fraction).cast("long")
    tiny = (x / F.lit(2.0**-1022) * fraction).cast("long")
    key = F.when(x < least, tiny).otherwise(normal)
    return F.when(value < 0, -key).otherwise(key)


def _together(by: list[str], more: list[Column], other: str = "t_") -> Column:
    return functools.reduce(lambda a, b: a & b, [*[F.col(b).eqNullSafe(F.col(f"{other}{b}")) for b in by], *more], F.lit(True))


def _ranks(n: Column, probs: list[float]) -> Column:
    """The ranks on both sides of each quantile's place among n values."""
    return F.array_distinct(F.flatten(F.array(*[F.array(F.floor((n - 1) * F.lit(q)), F.least(F.floor((n - 1) * F.lit(q)) + 1, n - 1)) for q in probs])))


def _sorted_values(rows: DataFrame, by: list[str], probs: list[float]) -> DataFrame:
    """by, total, x and rank of the values at the wanted ranks, by one sort of all groups."""
    w = Window.partitionBy(*by).orderBy("v")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    at = rows.select(*by, F.col("v").alias("x"), (F.row_number().over(w) - 1).cast("long").alias("rank"), F.count(F.lit(1)).over(whole).alias("total"))
    return at.where(F.array_contains(_ranks(F.col("total"), probs), F.col("rank"))).select(*by, "total", "x", "rank")


def quantiles(rows: DataFrame, value: str, by: list[str], probs: list[float], sorted_values: int = SORTED) -> DataFrame:
    """by, n (values that aren't null) and an array `quantiles`: linear interpolation between the values of ranks floor and ceiling of (n - 1) p.

    Groups without values have none (no row); null keys are a group. Values that aren't finite are an error. Dates and timestamps aren't interpolated: give p for which (n - 1) p is whole, or cast them.
    """
    kind = rows.schema[value].dataType
    v = F.col(value)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        v = F.when(F.isnan(v) | (F.abs(v) == float("inf")), F.raise_error(F.lit("not a finite number")).cast(kind)).otherwise(v)
    ordered_key(v, kind)  # an error for types that have none
    valued = rows.where(F.col(value).isNotNull()).select(*by, v.alias("v"))
    large = written(valued.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > sorted_values).select(*[F.col(b).alias(f"l_{b}") for b in by], F.lit(True).alias("l_")), "quantile-groups")
    if large.isEmpty():
        return _interpolated(_sorted_values(valued, by, probs), kind, by, probs)
    few = F.broadcast(large)  # at most one group for each sorted_values rows
    is_large = _together(by, [], "l_")
    some = _refined(valued.join(few, is_large, "left_semi"), kind, by, probs)
    rest = _sorted_values(valued.join(few, is_large, "left_anti"), by, probs)
    return _interpolated(rest.unionByName(some), kind, by, probs)


def _refined(valued: DataFrame, kind: T.DataType, by: list[str], probs: list[float]) -> DataFrame:
    """The same by histograms."""
    keyed = valued.withColumn("key", ordered_key(F.col("v"), kind))
    # the ranks each group wants, with the prefix that leads to them
    wanted, tables = None, []
    for p in range(PASSES):
        shift = 64 - DIGIT * (p + 1)
        digit = F.shiftright("key", shift) if p == 0 else F.shiftright("key", shift).bitwiseAND(F.lit((1 << DIGIT) - 1))
        prefix = F.shiftright("key", shift + DIGIT) if p else F.lit(0).cast("long")
        here = keyed.select(*by, "v", prefix.alias("prefix"), digit.alias("digit"))
        if p:
            t = wanted.select(*[F.col(b).alias(f"t_{b}") for b in by], F.col("prefix").alias("t_prefix")).distinct()
            t = F.broadcast(t) if wanted.count() <= BROADCAST_ROWS else t
            here = here.join(t, _together(by, [F.col("prefix") == F.col("t_prefix")]), "left_semi")
        counts = here.groupBy(*by, "prefix", "digit").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"))
        w = Window.partitionBy(*by, "prefix").orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)  # at most 2 ** DIGIT digits
        counts = counts.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0)))
        if p == 0:
            total = Window.partitionBy(*by, "prefix")
            found = counts.withColumn("total", F.sum("n").over(total)).withColumn("ranks", F.transform(_ranks(F.col("total"), probs), lambda r: F.struct(r.alias("rank"), r.alias("left"))))
        else:
            t = wanted.select(*[F.col(b).alias(f"t_{b}") for b in by], F.col("prefix").alias("t_prefix"), "total", "ranks")
            found = counts.join(t, _together(by, [F.col("prefix") == F.col("t_prefix")])).select(*by, "prefix", "digit", "n", "least", "before", "total", "ranks")
        inside = lambda r: (r["left"] >= F.col("before")) & (r["left"] < F.col("before") + F.col("n"))
        found = found.withColumn("ranks", F.transform(F.filter("ranks", inside), lambda r: F.struct(r["rank"].alias("rank"), (r["left"] - F.col("before")).alias("left")))).where(F.size("ranks") > 0)
        wanted = written(found.select(*by, (F.shiftleft("prefix", DIGIT) + F.col("digit")).alias("prefix") if p else F.col("digit").alias("prefix"), "least", "total", "ranks"), "quantile-ranks")
        tables.append(wanted)
        if len(tables) > 1:
            release(tables.pop(0))
    return wanted.select(*by, "total", F.col("least").alias("x"), F.explode("ranks.rank").alias("rank"))


def _interpolated(values: DataFrame, kind: T.DataType, by: list[str], probs: list[float]) -> DataFrame:
    if isinstance(kind, T.NumericType):
        values = values.withColumn("x", F.col("x").cast("double"))
    of = values.groupBy(*by).agg(F.first("total").alias("n"), F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("at"))  # at most two values for each p

    def one(q):
        place = (F.col("n") - 1) * F.lit(q)
        low = F.floor(place)
        a, b = F.element_at("at", low), F.element_at("at", F.least(low + 1, F.col("n") - 1))
        return a if not isinstance(kind, T.NumericType) else a * (1 - (place - low)) + b * (place - low)

    return of.where("n is not null").select(*by, "n", F.array(*[one(q) for q in probs]).alias("quantiles"))
