"""Counter-matrix sketches as rows: Count-Min, Count Sketch, their L2 form and the folded forms.

A sketch is the relation (groups..., row, col, cnt), with no row for a zero cell. Building, merging and querying are
aggregations and joins: every input row is hashed where it is read and its cells are summed in the map task, so a build has
one shuffle of at most rows x cols x groups x tasks rows, whatever the input and its keys. Null keys don't count; null
groups are groups like any others.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import groups, hashing
from tidemark.functions.groups import names as _names


@dataclass(frozen=True)
class MatrixConfig:
    """rows x cols counters; ``signed``: Count Sketch; ``fast``: one digest a key, else one a row."""

    rows: int = 3
    cols: int = 4096
    signed: bool = False
    fast: bool = True
    profile: str = "md5"
    salt: str = ""

    def __post_init__(self) -> None:
        if self.rows < 1 or self.cols < 1:
            raise ValueError("a matrix has at least one row and one column")
        if self.fast and (self.rows > hashing.FAST_ROWS or self.cols > 1 << 20):
            raise ValueError("the fast path serves 5 rows of up to 2^20 columns; use fast=False")
        if self.profile not in hashing.PROFILES:
            raise ValueError(f"unknown hash profile {self.profile}")

    def same_shape(self, other: MatrixConfig) -> None:
        """Raises unless sketches of both configurations can be merged: everything must agree, columns too."""
        if self != other:
            raise ValueError(f"cannot combine {self} and {other}")


def count_min(**options) -> MatrixConfig:
    return MatrixConfig(**options)


def count_sketch(**options) -> MatrixConfig:
    return replace(MatrixConfig(**options), signed=True)


def hashed(df: DataFrame, key: str | Column, config: MatrixConfig) -> DataFrame:
    """``df`` with a column ``h_`` that every later step of the fast path shares."""
    key = F.col(key) if isinstance(key, str) else key
    if not config.fast:
        return df.withColumn("h_", hashing.canonical(key))
    a, b = hashing.key_halves(key, config.profile, config.salt)
    # the halves are columns of their own, so that each digest is made once
    return df.withColumns({"a_": a, "b_": b}).withColumn("h_", hashing.words(F.col("a_"), F.col("b_"))).drop("a_", "b_")


def cells(df: DataFrame, config: MatrixConfig) -> DataFrame:
    """A row for each row of ``df`` (which has ``h_``) and matrix row, with row, col and, if signed, sign_."""
    many = df.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(config.rows - 1))))
    if config.fast:
        many = many.withColumn("col", hashing.fast_col(F.col("h_"), F.col("row"), config.cols))
        return many.withColumn("sign_", hashing.fast_sign(F.col("h_"), F.col("row"))) if config.signed else many
    many = many.withColumn("h_", hashing.row_digest(F.col("h_"), F.col("row"), config.profile, config.salt))
    many = many.withColumn("col", hashing.regular_col(F.col("h_"), config.cols))
    return many.withColumn("sign_", hashing.regular_sign(F.col("h_"))) if config.signed else many


def _weight(weight: str | Column | None) -> Column:
    return F.lit(1).cast("long") if weight is None else F.col(weight) if isinstance(weight, str) else weight


def summed(df: DataFrame, key: str, weight: str | Column | None = None, by: Sequence[str] | str | None = None) -> DataFrame:
    """(groups..., key_, w_): exact weights by key; null keys go. This shuffles keys; sketches don't need it."""
    return weighted(df, key, weight, by).groupBy(*_names(by), "key_").agg(F.sum("w_").alias("w_"))


def weighted(df: DataFrame, key: str, weight: str | Column | None = None, by: Sequence[str] | str | None = None) -> DataFrame:
    """(groups..., key_, w_) of every row with a key."""
    return df.where(F.col(key).isNotNull()).select(*_names(by), F.col(key).alias("key_"), _weight(weight).alias("w_"))


def build(df: DataFrame, key: str, config: MatrixConfig, *, weight: str | Column | None = None, by: Sequence[str] | str | None = None) -> DataFrame:
    """The sketch of a column: a bulk insert of every row with its weight (1 if none is given)."""
    return from_counts(weighted(df, key, weight, by), config, by=by)


def from_counts(counts: DataFrame, config: MatrixConfig, *, by: Sequence[str] | str | None = None) -> DataFrame:
    """The sketch of (groups..., key_, w_); keys may repeat."""
    return _added(hashed(counts, "key_", config), config, _names(by))


def from_hashes(df: DataFrame, config: MatrixConfig, *, hash_column: str, weight: str | None = None, by: Sequence[str] | str | None = None) -> DataFrame:
    """The sketch of digests that were computed before."""
    h = F.col(hash_column)
    given = df.where(h.isNotNull()).select(*_names(by), (hashing.words(*hashing.halves(h)) if config.fast else h).alias("h_"), _weight(weight).alias("w_"))
    return _added(given, config, _names(by))


def _added(given: DataFrame, config: MatrixConfig, by: list[str]) -> DataFrame:
    w = F.col("sign_") * F.col("w_") if config.signed else F.col("w_")
    return cells(given, config).groupBy(*by, "row", "col").agg(F.sum(w).alias("cnt")).where("cnt <> 0")


def merge(*sketches: DataFrame, configs: Sequence[MatrixConfig] = (), by: Sequence[str] | str | None = None) -> DataFrame:
    """The sum of sketches; ``configs``, if given, must agree."""
    for c in configs[1:]:
        configs[0].same_shape(c)
    out = sketches[0]
    for s in sketches[1:]:
        out = out.unionByName(s)
    return roll_up(out, by=by)


def roll_up(sketch: DataFrame, *, by: Sequence[str] | str | None = None) -> DataFrame:
    """One sketch for each of fewer groups."""
    return sketch.groupBy(*_names(by), "row", "col").agg(F.sum("cnt").alias("cnt")).where("cnt <> 0")


#: Cells of a sketch without groups up to which probes get it whole; some tens of megabytes.
BROADCAST_CELLS = 1 << 20


def over_rows(found: DataFrame, keys: Sequence[str | Column], rows: int, value: Column, how: dict[str, str]) -> DataFrame:
    """(keys..., estimates...) of (keys..., row, value): one pass gives any number of aggregates over a key's counters."""
    per = found.groupBy(*keys).agg(*(F.max(F.when(F.col("row") == r, value)).alias(f"v{r}_") for r in range(rows)))
    held = F.array(*(F.col(f"v{r}_") for r in range(rows)))
    ordered = F.array_sort(held)
    middle = (F.get(ordered, F.lit((rows - 1) // 2)) + F.get(ordered, F.lit(rows // 2))) / 2
    total = sum((F.col(f"v{r}_") for r in range(1, rows)), F.col("v0_"))
    made = {"min": F.array_min(held), "max": F.array_max(held), "median": middle.cast("double"), "sum": total, "mean": total / rows}
    if unknown := set(how.values()) - made.keys():
        raise ValueError(f"no such aggregate: {', '.join(sorted(unknown))}")
    return per.select(*(c for c in per.columns if c not in {f"v{r}_" for r in range(rows)}), *(made[h].alias(n) for n, h in how.items()))


def query(sketch: DataFrame, probes: DataFrame, key: str, config: MatrixConfig, *, how: str | dict[str, str] | None = None, by: Sequence[str] | str | None = None, est: str = "est") -> DataFrame:
    """(groups..., key, est) for every distinct probe. ``how`` defaults to the minimum for Count-Min and the median of
    the signed counters for Count Sketch; ``max``, ``sum`` and ``mean`` are there as well, and several at a time by name.
    Cells without a row are 0. A sketch without groups has a bounded size and is broadcast; others are joined."""
    how = how or ("median" if config.signed else "min")
    by = _names(by)
    asked = probes.where(F.col(key).isNotNull()).select(*by, F.col(key).alias("key_")).distinct()
    held = F.broadcast(sketch) if not by and config.rows * config.cols <= BROADCAST_CELLS else sketch
    found = groups.join(cells(hashed(asked, "key_", config), config), held, by, ["row", "col"], "left")
    cnt = F.coalesce("cnt", F.lit(0))
    cnt = cnt * F.col("sign_") if config.signed else cnt
    return over_rows(found, [*by, F.col("key_").alias(key)], config.rows, cnt, how if isinstance(how, dict) else {est: how})


def l2_squared(sketch: DataFrame, *, by: Sequence[str] | str | None = None, name: str = "l2_sqr") -> DataFrame:
    """Median over rows of the summed squares of a row's counters; signed weights may be negative. Always derived from
    the merged cells, so it is right after a merge."""
    by = _names(by)
    rows = sketch.groupBy(*by, "row").agg(F.sum(F.col("cnt") * F.col("cnt")).alias("s_"))
    return rows.groupBy(*by).agg(F.median("s_").alias(name))


def row_norms(sketch: DataFrame, *, by: Sequence[str] | str | None = None) -> DataFrame:
    """(groups..., row, l1, l2_sqr) of every matrix row."""
    return sketch.groupBy(*_names(by), "row").agg(F.sum(F.abs("cnt")).alias("l1"), F.sum(F.col("cnt") * F.col("cnt")).alias("l2_sqr"))


def delta(current: DataFrame, previous: DataFrame, *, threshold: int = 1, by: Sequence[str] | str | None = None) -> DataFrame:
    """Cells that changed by ``threshold`` or more, as (groups..., row, col, cnt)."""
    keys = [*_names(by), "row", "col"]
    both = groups.join(current.select(*keys, F.col("cnt").alias("c_")), previous.select(*keys, F.col("cnt").alias("p_")), _names(by), ["row", "col"], "full_outer")
    d = F.coalesce("c_", F.lit(0)) - F.coalesce("p_", F.lit(0))
    return both.select(*keys, d.alias("cnt")).where((F.abs("cnt") >= threshold) & (F.col("cnt") != 0))


def apply_delta(sketch: DataFrame, change: DataFrame, *, by: Sequence[str] | str | None = None) -> DataFrame:
    return merge(sketch, change, by=by)


def dense(sketch: DataFrame, config: MatrixConfig) -> DataFrame:
    """Every cell, zeros too; bounded by the matrix."""
    spark = sketch.sparkSession
    grid = spark.range(config.rows * config.cols).select((F.col("id") / config.cols).cast("int").alias("row"), (F.col("id") % config.cols).alias("col"))
    return grid.join(sketch, ["row", "col"], "left").select("row", "col", F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt"))


# Folded sketches: the same cells, stored cols >> level wide; each entry keeps its full column.


def fold_width(config: MatrixConfig, level: int) -> int:
    if config.cols & (config.cols - 1):
        raise ValueError("folding needs a power of two of columns")
    if not 0 <= level < config.cols.bit_length():
        raise ValueError("no such fold level")
    return config.cols >> level


def fold(sketch: DataFrame, config: MatrixConfig, level: int) -> DataFrame:
    """(..., row, fold_col, col, cnt). Folding adds no error, and unfolding to any level only names columns anew."""
    return sketch.withColumn("fold_col", F.col("col").bitwiseAND(F.lit(fold_width(config, level) - 1).cast("long")))


def unfold(folded: DataFrame, config: MatrixConfig, level: int = 0) -> DataFrame:
    return fold(folded.drop("fold_col"), config, level)


def hierarchical_merge(*folded: DataFrame, config: MatrixConfig, level: int = 0, by: Sequence[str] | str | None = None) -> DataFrame:
    """Any number of folded sketches of any levels, merged at ``level``."""
    return fold(merge(*(f.drop("fold_col") for f in folded), by=by), config, level)


def fold_cells(folded: DataFrame) -> DataFrame:
    """(row, fold_col, entries, collided) of every cell that isn't empty."""
    return folded.groupBy("row", "fold_col").agg(F.count("*").alias("entries")).withColumn("collided", F.col("entries") > 1)


def fold_stats(folded: DataFrame) -> DataFrame:
    """One row: total_entries, cells and collided_cells."""
    c = fold_cells(folded)
    return c.agg(F.coalesce(F.sum("entries"), F.lit(0)).alias("total_entries"), F.count("*").alias("cells"), F.coalesce(F.sum(F.col("collided").cast("long")), F.lit(0)).alias("collided_cells"))
