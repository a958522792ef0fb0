"""Joins by groups. A group may be null, as in GROUP BY, so groups are compared as equal where both are null."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def names(by: Sequence[str] | str | None) -> list[str]:
    return [by] if isinstance(by, str) else list(by or ())


def join(a: DataFrame, b: DataFrame, by: Sequence[str], on: Sequence[str] = (), how: str = "inner") -> DataFrame:
    """``a`` joined with ``b`` on the groups ``by``, null or not, and on the columns ``on``, which hold no nulls. Each
    key column comes out once. Without any columns, ``b`` has one row, which every row of ``a`` meets."""
    keys = [*by, *on]
    if not keys:
        return a.crossJoin(F.broadcast(b))
    far = b.withColumnsRenamed({c: f"{c}_far_" for c in keys})
    same = [F.col(c).eqNullSafe(F.col(f"{c}_far_")) for c in by] + [F.col(c) == F.col(f"{c}_far_") for c in on]
    out = a.join(far, reduce(and_, same), how)
    if how in ("left_anti", "left_semi"):
        return out
    if how == "full_outer":
        out = out.withColumns({c: F.coalesce(c, f"{c}_far_") for c in keys})
    return out.drop(*(f"{c}_far_" for c in keys))
