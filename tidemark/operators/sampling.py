"""Sampled updates (Nitro): each (row, matrix row) is kept with probability p by a hash coin and counts 1/p.

One digest of the row's id serves the coins of five matrix rows. The coin depends on the row's id alone, so results don't depend on partitions or retries, and two sketches of the same
rate merge. Estimates are medians and unbiased.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import hashing
from tidemark.functions.groups import names as _names
from tidemark.operators import matrix
from tidemark.operators.matrix import MatrixConfig

COUNT_LIKE = {"count", "sum", "frequency", "l1", "topk"}


def coins(ident: Column, rows: int) -> Column:
    """Words from which ``coin`` reads: one digest for each five matrix rows."""
    held = [hashing.key_words(ident, "md5", f"coin{k}:") for k in range(-(-rows // hashing.FAST_ROWS))]
    return held[0] if len(held) == 1 else F.concat(*held)


def coin(words: Column, row: Column, p: float) -> Column:
    five = row % hashing.FAST_ROWS
    word = F.get(words, (row / hashing.FAST_ROWS).cast("int") * 3 + (five / 2).cast("int"))
    bits = F.when(five % 2 == 0, F.shiftright(word, 24)).otherwise(word.bitwiseAND(F.lit(0xFFFFFF)))
    return bits.cast("double") / float(1 << 24) < p


def check_rate(p: float) -> None:
    if not 0 < p <= 1:
        raise ValueError("the rate lies above 0 and up to 1")


def build(df: DataFrame, ident: str, key: str, config: MatrixConfig, p: float, *, by: Sequence[str] | str | None = None) -> DataFrame:
    """(groups..., row, col, cnt) with cnt as a double: kept updates over p."""
    check_rate(p)
    by = _names(by)
    few = df.where(F.col(key).isNotNull() & F.col(ident).isNotNull()).select(*by, coins(F.col(ident), config.rows).alias("c_"), F.col(key).alias("key_"))
    # the coin comes before the key's hash, so only the sample is hashed
    many = few.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(config.rows - 1)))).where(coin(F.col("c_"), F.col("row"), p))
    h = hashing.key_words(F.col("key_"), config.profile, config.salt) if config.fast else hashing.row_digest(F.col("key_"), F.col("row"), config.profile, config.salt)
    col = hashing.fast_col(F.col("h_"), F.col("row"), config.cols) if config.fast else hashing.regular_col(F.col("h_"), config.cols)
    sign = hashing.fast_sign(F.col("h_"), F.col("row")) if config.fast else hashing.regular_sign(F.col("h_"))
    w = sign if config.signed else F.lit(1).cast("long")
    placed = many.withColumn("h_", h).select(*by, "row", col.alias("col"), w.alias("w_"))
    return placed.groupBy(*by, "row", "col").agg((F.sum("w_") / p).alias("cnt")).where("cnt <> 0")


def merge(sketches: Sequence[DataFrame], rates: Sequence[float], *, by: Sequence[str] | str | None = None) -> DataFrame:
    if len(set(rates)) != 1:
        raise ValueError("sketches of different rates can't be merged")
    return matrix.merge(*sketches, by=by)


def estimate(sketch: DataFrame, probes: DataFrame, key: str, config: MatrixConfig, *, by: Sequence[str] | str | None = None) -> DataFrame:
    return matrix.query(sketch, probes, key, config, how="median", by=by)


def rescale(value: Column, p: Column | float, what: str = "count") -> Column:
    """What a sampled figure stands for: counts over p, quantiles as they are; rates outside (0, 1] count as 1."""
    if what not in COUNT_LIKE:
        return value
    p = F.lit(p) if not isinstance(p, Column) else p
    return value / F.when((p > 0) & (p <= 1), p).otherwise(1.0)
