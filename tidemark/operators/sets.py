"""Exact sets: union, difference in both directions and the built-in theta sketches for the rest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import groups
from tidemark.functions.groups import names as _names


def members(df: DataFrame, value: str, *, by: Sequence[str] | str | None = None) -> DataFrame:
    """(groups..., member): a set as rows, of any size."""
    return df.where(F.col(value).isNotNull()).select(*_names(by), F.col(value).cast("string").alias("member")).distinct()


def union(*sets: DataFrame) -> DataFrame:
    out = sets[0]
    for s in sets[1:]:
        out = out.unionByName(s)
    return out.distinct()


def difference(current: DataFrame, previous: DataFrame, *, by: Sequence[str] | str | None = None) -> DataFrame:
    """(groups..., member, change): ``added`` or ``removed``."""
    by = _names(by)
    added = groups.join(current, previous, by, ["member"], "left_anti").withColumn("change", F.lit("added"))
    return added.unionByName(groups.join(previous, current, by, ["member"], "left_anti").withColumn("change", F.lit("removed")))


def changes(windowed: DataFrame, window: str, value: str, step: str) -> DataFrame:
    """(window, member, change) between each window and the one ``step`` (an interval such as '1 day') before; windows
    that exist on one side only count as empty on the other."""
    here = windowed.where(F.col(value).isNotNull()).select(F.col(window).alias("w_"), F.col(value).cast("string").alias("member")).distinct()
    shifted = here.withColumn("w_", F.col("w_") + F.expr(f"INTERVAL {step}"))
    span = here.agg(F.max("w_").alias("last_"))
    both = here.withColumn("c_", F.lit(1)).join(shifted.withColumn("p_", F.lit(1)), ["w_", "member"], "full_outer").where("c_ is null or p_ is null")
    both = both.crossJoin(F.broadcast(span)).where("w_ <= last_")  # one row
    return both.select(F.col("w_").alias(window), "member", F.when(F.col("p_").isNull(), "added").otherwise("removed").alias("change"))


def theta_overlap(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """One row of approximate sizes: union, intersection and difference (a less b)."""
    x = a.agg(F.expr(f"theta_sketch_agg({value})").alias("a_"))
    y = b.agg(F.expr(f"theta_sketch_agg({value})").alias("b_"))
    e = lambda f: F.expr(f"theta_sketch_estimate(theta_{f}(a_, b_))")
    return x.crossJoin(y).select(e("union").alias("n_union"), e("intersection").alias("n_intersection"), e("difference").alias("n_difference"))
