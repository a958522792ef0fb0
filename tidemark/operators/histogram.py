"""Exponential histograms whose buckets hold sketches of any family, and the hybrid of exact and layered buckets.

Rows go to the buckets of the L1 rule (see ``ordered``); each bucket's sketch is built by plain aggregation, and any
interval's sketch is the merge of the buckets that belong to it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import groups
from tidemark.operators import matrix, ordered, registry, universal
from tidemark.operators.universal import UnivConfig
from tidemark.sources.scratch import Scratch


def sketches(df: DataFrame, column: str, family: str, time: str, *, k: int, window: float, by: Sequence[str] = ()) -> DataFrame:
    """(groups..., bucket, start, end, sketch columns...): a sketch of ``column`` in every bucket."""
    dealt = ordered.l1_buckets(df.select(*by, time, column), time, k=k, window=window, by=by)
    spans = _spans(dealt, time, by)
    return groups.join(registry.family(family).build(dealt.drop(time), column, [*by, "bucket"]), spans, by, ["bucket"])


def _spans(dealt: DataFrame, time: str, by: Sequence[str]) -> DataFrame:
    t = F.col(time).cast("timestamp").cast("double")
    return dealt.groupBy(*by, "bucket").agg(F.min(t).alias("start"), F.max(t).alias("end"))


def merged(built: DataFrame, family: str, start: float, end: float, *, by: Sequence[str] = ()) -> DataFrame:
    """One sketch (of each group) of the buckets that belong to the interval, in seconds."""
    return registry.family(family).merged(ordered.interval(built, start, end).drop("bucket", "start", "end"), by)


def cover(built: DataFrame, start: float, end: float, *, by: Sequence[str] = ()) -> DataFrame:
    """(groups..., min_time, max_time, covered): whether the buckets reach over the interval."""
    return built.groupBy(*by).agg(F.min("start").alias("min_time"), F.max("end").alias("max_time")).withColumn("covered", (F.col("min_time") <= start) & (F.col("max_time") >= end))


def hybrid(df: DataFrame, key: str, time: str, config: UnivConfig = UnivConfig(), *, k: int, window: float, most_keys: int | None = None, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:  # noqa: B008
    """(maps, layered): exact counts (groups..., bucket, start, end, key_, w_) of the buckets with up to ``most_keys``
    distinct keys (by default half of a layered sketch's cells), and layered sketches of the others. The counts are
    written once."""
    most = config.layers * config.rows * config.cols // 2 if most_keys is None else most_keys
    t = F.col(time).cast("timestamp").cast("double")
    dealt = ordered.l1_buckets(df.where(F.col(key).isNotNull()).select(*by, time, key), time, k=k, window=window, by=by)
    counts = Scratch(df.sparkSession).save(dealt.groupBy(*by, "bucket", F.col(key).alias("key_")).agg(F.count("*").alias("w_"), F.min(t).alias("a_"), F.max(t).alias("b_")))
    sizes = counts.groupBy(*by, "bucket").agg((F.count("*") <= most).alias("small_"), F.min("a_").alias("start"), F.max("b_").alias("end"))
    marked = groups.join(counts.drop("a_", "b_"), sizes, by, ["bucket"])
    return marked.where("small_").drop("small_"), universal.build(marked.where("not small_"), "key_", config, weight="w_", by=[*by, "bucket", "start", "end"])


def hybrid_metrics(maps: DataFrame, layered: DataFrame, start: float, end: float, config: UnivConfig = UnivConfig(), *, by: Sequence[str] = ()) -> DataFrame:  # noqa: B008
    """(groups..., n, l1, l2, entropy, card, tier): exact where only maps belong to the interval, else from their counts
    and the layered sketches together."""
    near_maps, near_layered = ordered.interval(maps, start, end), ordered.interval(layered, start, end)
    touched = near_layered.groupBy(*by).agg(F.count("*").alias("some_"))  # without groups, one row
    marked = groups.join(near_maps, touched, by, how="left")
    exact = universal.exact_metrics(marked.where("coalesce(some_, 0) = 0"), "key_", weight="w_", by=by)
    mixed = universal.build(marked.where("some_ > 0"), "key_", config, weight="w_", by=by)
    whole = universal.roll_up(near_layered.drop("bucket", "start", "end").unionByName(mixed), config, by=by)
    out = exact.where("n is not null").withColumn("tier", F.lit("map"))
    return out.unionByName(universal.ask(whole, config, by=by).where("n > 0").withColumn("tier", F.lit("sketch")))
