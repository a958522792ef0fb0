"""One interface over the sketch families, one-shot aggregates, and sharded building.

``FAMILIES`` names each family's build, merge and questions, so that windows, shards and subpopulations can hold any of
them. A question that a family can't answer, or a merge it doesn't have, raises when the plan is made.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import cardinality, matrix, quantiles, topk, universal
from tidemark.operators.matrix import MatrixConfig


@dataclass(frozen=True)
class Family:
    """``build(df, column, by)``, ``merge(sketch, by)`` to fewer groups, and ``questions`` by name."""

    build: Callable[[DataFrame, str, Sequence[str]], DataFrame]
    merge: Callable[[DataFrame, Sequence[str]], DataFrame] | None
    questions: dict[str, Callable[..., DataFrame]] = field(default_factory=dict)
    norms: tuple[str, ...] = ("l1",)

    def ask(self, question: str, sketch: DataFrame, *args: Any, **options: Any) -> DataFrame:
        if question not in self.questions:
            raise ValueError(f"no answer to {question}; there is {', '.join(sorted(self.questions)) or 'none'}")
        return self.questions[question](sketch, *args, **options)

    def merged(self, sketch: DataFrame, by: Sequence[str] = ()) -> DataFrame:
        if self.merge is None:
            raise ValueError("this family has no merge")
        return self.merge(sketch, by)


def _matrix(config: MatrixConfig) -> Family:
    def count(sketch: DataFrame, probes: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
        return matrix.query(sketch, probes, key, config, by=by)

    asked: dict[str, Callable[..., DataFrame]] = {"count": count}
    if config.signed:
        asked["l2"] = lambda sketch, by=(): matrix.l2_squared(sketch, by=by).withColumn("l2", F.sqrt("l2_sqr")).drop("l2_sqr")
    return Family(lambda df, c, by: matrix.build(df, c, config, by=by), lambda s, by: matrix.roll_up(s, by=by), asked, ("l1", "l2") if config.signed else ("l1",))


def _univ(config: universal.UnivConfig) -> Family:
    def one(name: str) -> Callable[..., DataFrame]:
        return lambda sketch, by=(): universal.ask(sketch, config, by=by).select(*by, name)

    asked: dict[str, Callable[..., DataFrame]] = {n: one(n) for n in ("l1", "l2", "entropy", "card")}
    asked["metrics"] = lambda sketch, by=(): universal.ask(sketch, config, by=by)
    return Family(lambda df, c, by: universal.build(df, c, config, by=by), lambda s, by: universal.roll_up(s, config, by=by), asked, ("l1", "l2"))


#: Share of the rows that a sample keeps.
SAMPLE_RATE = 0.1

FAMILIES: dict[str, Family] = {
    "count_min": _matrix(MatrixConfig()),
    "count_sketch": _matrix(matrix.count_sketch(rows=5, cols=2048)),
    "hll": Family(lambda df, c, by: cardinality.hll(df, c, by=by), lambda s, by: cardinality.hll_merge(s, by=by), {"card": lambda s, by=(): cardinality.hll_classic(s, by=by), "card_ertl": lambda s, by=(): cardinality.hll_ertl(s, by=by)}),
    "kmv": Family(lambda df, c, by: cardinality.kmv(df, c, by=by), lambda s, by: cardinality.kmv_merge(s, by=by), {"card": lambda s, by=(): cardinality.kmv_estimate(s, by=by)}),
    "ddsketch": Family(lambda df, c, by: quantiles.ddsketch(df, c, by=by), lambda s, by: quantiles.dd_merge(s, by=by), {"quantile": lambda s, qs, by=(): quantiles.dd_quantiles(s, qs, by=by), "summary": lambda s, by=(): quantiles.dd_summary(s, by=by)}),
    "kll": Family(
        lambda df, c, by: quantiles.kll(df, c, by=by),
        lambda s, by: quantiles.kll_merge(s, by=by),
        {"quantile": lambda s, qs, by=(): quantiles.kll_quantiles(s, qs, by=by), "rank": lambda s, at, by=(): quantiles.kll_rank(s, at, by=by), "cdf": lambda s, by=(): quantiles.kll_cdf(s, by=by)},
    ),
    "univmon": _univ(universal.UnivConfig()),
    "pyramid": _univ(universal.PYRAMID),
    "hip": Family(lambda df, c, by: cardinality.hll(df, c, by=by), None),
    "uniform": Family(lambda df, c, by: quantiles.uniform_sample(df.select(*by, c), c, SAMPLE_RATE, by=by, total="seen"), None, {"sample": lambda s, by=(): s}),
}


def family(name: str, norm: str = "l1") -> Family:
    if name not in FAMILIES:
        raise ValueError(f"unknown family {name}")
    if norm not in FAMILIES[name].norms:
        raise ValueError(f"{name} has no {norm} norm")
    return FAMILIES[name]


def sharded(df: DataFrame, column: str, name: str, shards: int, *, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(the shards' own sketches, the whole): rows are dealt to shards by a hash of group and key, each shard's sketch is a delta that any
    reader may add up, and nothing below a threshold stays behind. Spark's map-side sums do the same within a build."""
    if shards < 1:
        raise ValueError("at least one shard")
    dealt = df.select(*by, column, F.pmod(F.xxhash64(*by, column), F.lit(shards)).cast("int").alias("shard"))
    parts = family(name).build(dealt, column, ["shard", *by])
    return parts, family(name).merged(parts, by)


def _or_none(df: DataFrame, column: str, make: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
    kept = df.where(F.col(column).isNotNull())
    return None if kept.isEmpty() else make(kept)


def aggregate_count(df: DataFrame, key: str, config: MatrixConfig = MatrixConfig()) -> DataFrame | None:  # noqa: B008
    """A Count-Min sketch of how often keys occur; None for no rows, as for the others below."""
    return _or_none(df, key, lambda d: matrix.build(d, key, config))


def aggregate_sum(df: DataFrame, key: str, value: str, config: MatrixConfig = MatrixConfig()) -> DataFrame | None:  # noqa: B008
    return _or_none(df, key, lambda d: matrix.build(d, key, config, weight=value))


def aggregate_kll(df: DataFrame, value: str, k: int = 200) -> DataFrame | None:
    return _or_none(df, value, lambda d: quantiles.kll(d, value, k=k))


def aggregate_topk(df: DataFrame, key: str, value: str, k: int, config: MatrixConfig = MatrixConfig()) -> DataFrame | None:  # noqa: B008
    return _or_none(df, key, lambda d: topk.positive_rounded(d, key, k, config, weight=value))


def aggregate_keyed_kll(df: DataFrame, key: str, value: str) -> DataFrame | None:
    from tidemark.operators import subpopulation

    return _or_none(df, key, lambda d: subpopulation.keyed(d, key, value))
