"""Selection of records for targeted training: unique skeletons, balanced variants, protected floors, matched controls.

Rows have record_id, skeleton and whatever the selections ask for. Every pick follows a salted order, skips records and
skeletons that were picked before, and holds at most as many rows as were asked for. Picks are written tables of ids and skeletons; only their counts go to the driver.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import release, written
from .cover import cover, distinct_skeletons, without
from .dataset import salted
from .scan import running

PICK = "record_id string, skeleton string, reason string, focus string, level string"
LEVELS = ("exact-length-and-focus", "focus-only", "length-only", "uniform-fallback")


class Picks:
    """What has been picked so far."""

    def __init__(self, rows: DataFrame, forbidden: DataFrame | None = None):
        self.rows = rows.withColumn("record_id", F.col("record_id").cast("string"))
        self.made: DataFrame | None = None
        keys = [F.col(k).cast("string").alias(k) for k in ("record_id", "skeleton")]
        self.allowed = self.rows if forbidden is None else written(without(self.rows, forbidden.select(*keys), "record_id", "skeleton"), "allowed")

    def free(self) -> DataFrame:
        return without(self.allowed, self.made, "record_id", "skeleton")

    def take(self, n: int, salt: str, reason: str, focus: str, where: Column | None = None, level: str | None = None, all_or_error: bool = True) -> int:
        """Picks n rows with unlike skeletons in salted order; fewer only if all_or_error is off."""
        if n < 0:
            raise ValueError("a pick can't be negative")
        if not n:
            return 0
        pool = self.free() if where is None else self.free().where(where)
        pool = pool.select("record_id", "skeleton", salted(salt, F.col("record_id")).alias("_order"))
        first = running(distinct_skeletons(pool, "record_id", "skeleton"), [], ["_order", "record_id"], "_n").where(F.col("_n") <= n)
        got = first.select("record_id", "skeleton", *[F.lit(v).cast("string").alias(k) for k, v in (("reason", reason), ("focus", focus), ("level", level))])
        before, self.made = self.made, written(got if self.made is None else self.made.unionByName(got), "picks")
        taken = self.made.count() - (before.count() if before is not None else 0)
        if before is not None:
            release(before)
        if all_or_error and taken < n:
            raise ValueError(f"{salt}: {n} records wanted, {taken} free")
        return taken

    def cover(self, floors: dict[str, int], salt: str, column: str = "tags", reason: str = "cover") -> int:
        """Picks rows that meet the floors of several tags at once (see cover.cover); the number of rows picked."""
        got = cover(self.free(), "record_id", "skeleton", column, floors, salt)
        got = got.select("record_id", "skeleton", F.lit(reason).alias("reason"), F.concat_ws("+", "features").alias("focus"), F.lit(None).cast("string").alias("level"))
        taken = got.count()
        self.made = written(got if self.made is None else self.made.unionByName(got), "picks")
        return taken

    def frame(self) -> DataFrame:
        return self.made if self.made is not None else self.rows.sparkSession.createDataFrame([], PICK)


def balanced(picks: Picks, n: int, variants: tuple[str, ...], salt: str, column: str = "variant", focus: str = "DOCID") -> None:
    """n hard negatives in equal shares of the variants; the first ones take what is left over."""
    share, more = divmod(n, len(variants))
    for i, v in enumerate(variants):
        picks.take(share + (i < more), f"{salt}:{v}", f"hard-negative:{v}", focus, F.col(column) == v)


def replay(picks: Picks, n: int, floor: int, protected: Iterable[str], salt: str) -> None:
    """`floor` rows of each protected tag (column `tags`), then any rows, n in all."""
    tags = list(protected)
    if floor * len(tags) > n:
        raise ValueError(f"{n} rows can't hold {floor} of each of {len(tags)} tags")
    for t in tags:
        picks.take(floor, f"{salt}:protected:{t}", f"replay-protected:{t}", t, F.array_contains("tags", t))
    picks.take(n - floor * len(tags), f"{salt}:general", "replay-general", "GENERAL")


def replay_with_floors(picks: Picks, n: int, floors: dict[str, int], salt: str, column: str = "features") -> None:
    """Rows that meet the floors of features (identifier family, surface, context, ...) together, then any rows, n in all."""
    taken = picks.cover(floors, f"{salt}:floors", column, "replay-floors")
    if taken > n:
        raise ValueError(f"the floors take {taken} rows of {n}")
    picks.take(n - taken, f"{salt}:general", "replay-general", "GENERAL")


def control(picks: Picks, quotas: dict[tuple[str, str], int], salt: str) -> None:
    """As many rows as quotas say for each (length_bin, focus): alike in both, else in focus, else in length, else any."""
    for (length, focus), quota in sorted(quotas.items()):
        same_length, same_focus = F.col("length_bin") == length, F.lit(True) if focus == "GENERAL" else F.array_contains("tags", focus)
        left = quota
        for level, where in zip(LEVELS, (same_length & same_focus, same_focus, same_length, None), strict=True):
            left -= picks.take(left, f"{salt}:{length}:{focus}:{level}", f"control-match:{focus}:{length}", focus, where, level, all_or_error=False)
        if left:
            raise ValueError(f"no control for {left} rows of {length}, {focus}")


def quotas_of(selected: DataFrame) -> dict[tuple[str, str], int]:
    """Counts by (length_bin, focus) of a selection: a few bins by a few tags."""
    return {(r.length_bin, r.focus): r.n for r in selected.groupBy("length_bin", "focus").agg(F.count(F.lit(1)).alias("n")).collect()}


def statistics(selected: DataFrame, *by: str) -> DataFrame:
    """Rows, mean characters, and rows with target entities of a selection; columns chars, target_entities."""
    return selected.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"), F.avg("chars").alias("mean_chars"), F.sum((F.col("target_entities") > 0).cast("long")).alias("target_docs"), F.sum("target_entities").alias("target_entities"))


def against_pool(subset: DataFrame, pool: DataFrame, key: str) -> DataFrame:
    """Shares of each value of key in a subset and in the pool, side by side, in percent; `missing` where the subset has none."""
    side = lambda d, n: d.groupBy(key).agg(F.count(F.lit(1)).alias(f"{n}_rows"))
    both = side(subset, "subset").join(side(pool, "pool"), key, "full_outer").na.fill(0, ["subset_rows", "pool_rows"])
    total = both.agg(F.sum("subset_rows").alias("s"), F.sum("pool_rows").alias("p"))  # one row
    share = lambda a, t: F.coalesce(F.try_divide(100.0 * F.col(a), F.col(t)), F.lit(0.0))
    return both.crossJoin(F.broadcast(total)).select(key, "subset_rows", "pool_rows", share("subset_rows", "s").alias("subset_percent"), share("pool_rows", "p").alias("pool_percent"), (F.col("subset_rows") == 0).alias("missing"))


def payloads(rows: DataFrame, selected: DataFrame, key: str) -> DataFrame:
    """Whole rows of the selected keys: keys are chosen on narrow columns first, and a second scan fetches the rest."""
    return rows.join(selected.select(key).distinct(), key, "left_semi")
