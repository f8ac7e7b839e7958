"""Arrays of structs to rows."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unfolded(rows: DataFrame, array: Column | str, *keep: str | Column, pos: str | None = None) -> DataFrame:
    """keep, and the fields of each struct of the array as columns (elements whose fields are all null are left out); pos adds the element's place.

    The outer form is meant: with the inner one Spark infers a filter on the array's size, and with it copies the whole computation of
    the array into the plan again and again.
    """
    array = F.col(array) if isinstance(array, str) else array
    fields = rows.select(array.alias("a")).schema["a"].dataType.elementType.fieldNames()
    made = F.inline_outer(array) if pos is None else F.posexplode_outer(array).alias(pos, "_element")
    out = rows.select(*keep, made)
    if pos is not None:
        out = out.where(F.col(pos).isNotNull())
        return out.select(*[c for c in out.columns if c != "_element"], "_element.*")
    return out.where(functools.reduce(lambda a, b: a | b, [F.col(f"`{f}`").isNotNull() for f in fields]))
