"""Heavy hitters: exact, by Count-Min or by Count Sketch, and the bounded heap semantics.

The sketch forms take two passes: build, then estimate all distinct keys and keep the k best; candidates from several
sketches are estimated anew on the merged one. Top-k is a bounded sort (TakeOrderedAndProject) or, by group, a row
number with a group limit. Ties rank by key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.groups import names
from tidemark.operators import matrix
from tidemark.operators.matrix import MatrixConfig


def largest(df: DataFrame, key: str, value: str, k: int, *, by: Sequence[str] | str | None = None, least: bool = False) -> DataFrame:
    """The k rows with the largest value (of each group), or with the ``least``."""
    if k < 1:
        raise ValueError("k is at least 1")
    by = names(by)
    order = [F.asc(value) if least else F.desc(value), F.asc(key)]
    if not by:
        return df.orderBy(*order).limit(k)
    return df.withColumn("r_", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("r_") <= k).drop("r_")


def exact(df: DataFrame, key: str, k: int, *, weight: str | None = None, by: Sequence[str] | str | None = None) -> DataFrame:
    counts = matrix.summed(df, key, weight, by).withColumnsRenamed({"key_": key, "w_": "cnt"})
    return largest(counts, key, "cnt", k, by=by)


def sketched(df: DataFrame, key: str, k: int, config: MatrixConfig, *, weight: str | None = None, by: Sequence[str] | str | None = None) -> DataFrame:
    """(groups..., key, est); Count Sketch estimates are cut to whole numbers, as the heap holds them."""
    sketch = matrix.build(df, key, config, weight=weight, by=by)
    return from_sketch(sketch, df, key, k, config, by=by)


def from_sketch(sketch: DataFrame, candidates: DataFrame, key: str, k: int, config: MatrixConfig, *, by: Sequence[str] | str | None = None) -> DataFrame:
    est = matrix.query(sketch, candidates, key, config, by=by)
    return largest(est.withColumn("est", F.col("est").cast("long")), key, "est", k, by=by)


def merge(sketches: Sequence[DataFrame], candidates: Sequence[DataFrame], key: str, k: int, config: MatrixConfig) -> tuple[DataFrame, DataFrame]:
    """The merged sketch and the k best of all candidates' keys, estimated on it. Candidates are rows with the key: what the
    sketches were built of gives the k best of all keys; heaps give the best of what they kept, since a key below the end of
    every heap may be among the best of the whole."""
    whole = matrix.merge(*sketches)
    keys = candidates[0].select(key)
    for c in candidates[1:]:
        keys = keys.unionByName(c.select(key))
    return whole, from_sketch(whole, keys, key, k, config)


def positive_rounded(df: DataFrame, key: str, k: int, config: MatrixConfig, *, weight: str) -> DataFrame:
    """Heavy hitters by weights that are rounded and of which only positive ones count."""
    kept = df.withColumn("w1_", F.round(weight).cast("long")).where("w1_ > 0")
    return sketched(kept, key, k, config, weight="w1_")


def max_topk(df: DataFrame, key: str, value: str, k: int = 100) -> DataFrame:
    """The k keys with the largest single value."""
    return largest(df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(value).alias("est")), key, "est", k)


def builtin(df: DataFrame, key: str, k: int) -> DataFrame:
    """Spark's own one-pass summary (approx_top_k); (key, cnt)."""
    return df.agg(F.expr(f"approx_top_k({key}, {k})").alias("a_")).select(F.explode("a_").alias("e_")).select(F.col("e_.item").alias(key), F.col("e_.count").alias("cnt"))


def rebuild(sketch: DataFrame, config: MatrixConfig, hh_keys: DataFrame, key: str, k: int, *, change: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The sketch after a ``change`` (cells, as ``matrix.delta`` gives them) and the k best of the keys sent along with it,
    estimated on the new sketch: heavy hitters that arrive as changed cells and key names alone."""
    whole = sketch if change is None else matrix.apply_delta(sketch, change)
    return whole, from_sketch(whole, hh_keys, key, k, config)


def from_folded(folded: DataFrame, candidates: DataFrame, key: str, k: int, config: MatrixConfig, *, by: Sequence[str] | str | None = None) -> DataFrame:
    """(groups..., key, est): the k best candidates by a folded sketch, which estimates what the unfolded one does."""
    return from_sketch(folded.drop("fold_col"), candidates, key, k, config, by=by)
