"""Detection on streams: the same column expressions, windowed counts with late data. What needs state of its own is in stateful.py."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rewrite import analyse

def analysed(stream: DataFrame, text: str = "text", **options) -> DataFrame:
    """analyse() on a stream: stateless, nothing is shuffled. Grouped IBANs and long candidate lists work as in batches."""
    return analyse(stream, text, **options)


def windowed_counts(stream: DataFrame, ts: str, key: str, width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return stream.withWatermark(ts, late).groupBy(w.alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")
