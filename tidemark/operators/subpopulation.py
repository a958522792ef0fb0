"""Subpopulation queries over any subset of dimensions (Hydra), several metrics at a time.

Every row counts for all non-empty subsets of its dimensions. A subset's key names each dimension, so equal values of two
dimensions never meet, and a null value is kept apart from an absent dimension. Each subset key is hashed to one cell in
every row of a small grid; inner sketches are built for each cell; a query takes the median over its cells. Rows fan out
and are summed up by cell where they are read, so a build has one shuffle, of at most grid x inner sketch x tasks rows.

Inner sketches: Count-Min and Count Sketch (frequency), HyperLogLog (cardinality), DDSketch and KLL (cdf, quantile),
layered sketches (l1, l2, entropy, cardinality), plain sums, and, where exact answers are wanted, weighted values. All but
the last are bounded by the grid. Grids of one kind and shape merge.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import cardinality, matrix, quantiles, universal
from tidemark.operators.matrix import MatrixConfig
from tidemark.operators.universal import UnivConfig

MOST_DIMENSIONS = 10
GRID = MatrixConfig(rows=3, cols=32, fast=False, salt="hydra")
CELL = ["hrow", "hcol"]
SUPPORTED = {
    "count_min": {"frequency"},
    "count_sketch": {"frequency"},
    "hll": {"cardinality"},
    "ddsketch": {"cdf", "quantile"},
    "kll": {"cdf", "quantile"},
    "values": {"cdf", "quantile"},
    "univmon": {"l1", "l2", "entropy", "cardinality"},
}


def part(name: str, value: Column) -> Column:
    """One dimension of a subset key; ``;``, ``=`` and backslashes of the value are escaped, and null is ``\\N``."""
    safe = F.regexp_replace(value.cast("string"), r"([\\;=])", r"\\$1")
    return F.concat(F.lit(f"{name}="), F.coalesce(safe, F.lit("\\N")))


def _few(dims: Sequence[str]) -> None:
    if not 1 <= len(dims) <= MOST_DIMENSIONS:
        raise ValueError(f"between 1 and {MOST_DIMENSIONS} dimensions")


def fanned(df: DataFrame, dims: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """(subset, keep...): a row for each row and non-empty subset of its dimensions."""
    _few(dims)
    named = df.select(*keep, *(part(d, F.col(d)).alias(f"p{i}_") for i, d in enumerate(dims)))
    many = named.withColumn("mask_", F.explode(F.sequence(F.lit(1), F.lit((1 << len(dims)) - 1))))
    chosen = [F.when(F.col("mask_").bitwiseAND(F.lit(1 << i)) != 0, F.col(f"p{i}_")) for i in range(len(dims))]
    return many.select(F.concat_ws(";", *chosen).alias("subset"), *keep)


def subsets(df: DataFrame, dims: Sequence[str], measures: Sequence[Column], keep: Sequence[str] = ()) -> DataFrame:
    """(subset, keep..., measures...) for every subset of ``dims`` but the empty one, exactly."""
    _few(dims)
    # the kept columns stay in every grouping set
    sets = [[d for i, d in enumerate(dims) if mask >> i & 1] for mask in range(1, 1 << len(dims))]
    out = df.groupingSets([[*(F.col(c) for c in (*s, *keep))] for s in sets], *dims, *keep).agg(*measures, *(F.grouping(d).alias(f"g_{d}") for d in dims))
    names = F.concat_ws(";", *(F.when(F.col(f"g_{d}") == 0, part(d, F.col(d))) for d in dims))
    return out.withColumn("subset", names).drop(*dims, *(f"g_{d}" for d in dims))


def grid_cells(df: DataFrame, grid: MatrixConfig = GRID) -> DataFrame:
    """Adds hrow and hcol to (subset, ...)."""
    many = matrix.cells(matrix.hashed(df, "subset", grid), grid)
    return many.withColumnsRenamed({"row": "hrow", "col": "hcol"}).drop("h_", "sign_")


def probes(subset_keys: DataFrame, grid: MatrixConfig = GRID) -> DataFrame:
    return grid_cells(subset_keys.select("subset").distinct(), grid)


def _over_cells(asked: DataFrame, found: DataFrame, keys: Sequence[str], values: dict[str, str], grid: MatrixConfig, zero: bool = False) -> DataFrame:
    """(subset, keys..., values...): medians over a subset's cells; a cell without a row is 0 if ``zero``, else left out."""
    both = probes(asked, grid).join(found, CELL, "left" if zero else "inner")
    return both.groupBy("subset", *keys).agg(*(F.median(F.coalesce(c, F.lit(0)) if zero else F.col(c)).alias(n) for n, c in values.items()))


# Frequency


def frequency(df: DataFrame, dims: Sequence[str], key: str, inner: MatrixConfig, *, weight: str | None = None, grid: MatrixConfig = GRID) -> DataFrame:
    """(hrow, hcol, row, col, cnt): a matrix sketch of ``key`` in every cell."""
    w = F.lit(1).cast("long") if weight is None else F.col(weight)
    many = df.where(F.col(key).isNotNull()).withColumns({"key_": F.col(key), "w_": w})
    return matrix.from_counts(grid_cells(fanned(many, dims, ["key_", "w_"]), grid), inner, by=CELL)


def query_frequency(sketch: DataFrame, asked: DataFrame, key: str, inner: MatrixConfig, *, grid: MatrixConfig = GRID) -> DataFrame:
    """(subset, key, est) of the asked (subset, key)."""
    cells = grid_cells(asked.select("subset", key).distinct(), grid)
    est = matrix.query(sketch, cells, key, inner, by=CELL, est="e_")
    return cells.join(est, [*CELL, key]).groupBy("subset", key).agg(F.median("e_").alias("est"))


# Sums


def counts(df: DataFrame, dims: Sequence[str], *, grid: MatrixConfig = GRID, measures: dict[str, Column] | None = None) -> DataFrame:
    """(hrow, hcol, measures...): sums in every cell; several heads share one fan-out."""
    measures = measures or {"n": F.lit(1).cast("long")}
    many = fanned(df.withColumns({f"{n}_m_": c for n, c in measures.items()}), dims, [f"{n}_m_" for n in measures])
    return grid_cells(many, grid).groupBy(*CELL).agg(*(F.sum(f"{n}_m_").alias(n) for n in measures))


def query_counts(sketch: DataFrame, asked: DataFrame, heads: Sequence[str] = ("n",), *, grid: MatrixConfig = GRID) -> DataFrame:
    """(subset, heads...): medians over the cells; an unknown head raises."""
    if missing := set(heads) - set(sketch.columns):
        raise ValueError(f"no such head: {', '.join(sorted(missing))}")
    return _over_cells(asked, sketch, [], {h: h for h in heads}, grid, zero=True)


# Distinct counts


def distinct(df: DataFrame, dims: Sequence[str], key: str, *, p: int = 12, grid: MatrixConfig = GRID) -> DataFrame:
    """(hrow, hcol, reg, rho): a HyperLogLog in every cell."""
    ranked = cardinality.ranked(df, key, p, dims)
    return grid_cells(fanned(ranked, dims, ["reg", "rho"]), grid).groupBy(*CELL, "reg").agg(F.max("rho").alias("rho"))


def query_distinct(sketch: DataFrame, asked: DataFrame, *, p: int = 12, grid: MatrixConfig = GRID) -> DataFrame:
    return _over_cells(asked, cardinality.hll_classic(sketch, p=p, by=CELL, name="e_"), [], {"est": "e_"}, grid, zero=True)


# Distributions


def dd_cells(df: DataFrame, dims: Sequence[str], value: str, *, alpha: float = 0.01, grid: MatrixConfig = GRID) -> DataFrame:
    """(hrow, hcol, bucket, cnt, lo, hi, total): a DDSketch in every cell."""
    return quantiles.ddsketch(grid_cells(fanned(df, dims, [value]), grid), value, alpha=alpha, by=CELL)


def kll_cells(df: DataFrame, dims: Sequence[str], value: str, *, k: int = 200, grid: MatrixConfig = GRID) -> DataFrame:
    """(hrow, hcol, kll)."""
    return quantiles.kll(grid_cells(fanned(df.where(F.col(value).isNotNull()), dims, [value]), grid), value, k=k, by=CELL)


def values(df: DataFrame, dims: Sequence[str], value: str, *, grid: MatrixConfig = GRID) -> DataFrame:
    """(hrow, hcol, value, w): the weighted values of every cell, exact and as large as they are many."""
    few = df.where(F.col(value).isNotNull()).withColumn("value_", F.col(value).cast("double"))
    return grid_cells(fanned(few, dims, ["value_"]), grid).groupBy(*CELL, F.col("value_").alias("value")).agg(F.count("*").alias("w"))


def query_cdf(sketch: DataFrame, asked: DataFrame, at: Sequence[float], *, kind: str = "values", alpha: float = 0.01, grid: MatrixConfig = GRID) -> DataFrame:
    """(subset, x, fraction): the median over cells of the share of values up to x."""
    if kind == "ddsketch":
        got = quantiles.dd_rank(sketch, at, alpha=alpha, by=CELL)
    elif kind == "kll":
        got = quantiles._of_kll(sketch, "rank", at, "kll", "x", "fraction", "double")
    else:
        got = quantiles.rank(sketch, at, by=CELL)
    return _over_cells(asked, got.select(*CELL, "x", "fraction"), ["x"], {"fraction": "fraction"}, grid)


def query_quantile(sketch: DataFrame, asked: DataFrame, qs: Sequence[float], *, kind: str = "values", alpha: float = 0.01, grid: MatrixConfig = GRID) -> DataFrame:
    """(subset, q, value): the median over cells of their quantiles."""
    if kind == "ddsketch":
        got = quantiles.dd_quantiles(sketch, qs, alpha=alpha, by=CELL)
    elif kind == "kll":
        got = quantiles.kll_quantiles(sketch, qs, by=CELL)
    else:
        got = quantiles.quantiles(sketch, qs, by=CELL)
    return _over_cells(asked, got.select(*CELL, "q", "value"), ["q"], {"value": "value"}, grid)


# Universal metrics


def univ_cells(df: DataFrame, dims: Sequence[str], key: str, config: UnivConfig, *, weight: str | None = None, grid: MatrixConfig = GRID) -> DataFrame:
    """A stored layered sketch in every cell."""
    w = F.lit(1).cast("long") if weight is None else F.col(weight)
    many = df.where(F.col(key).isNotNull()).withColumns({"k_": F.col(key), "w0_": w})
    return universal.build(grid_cells(fanned(many, dims, ["k_", "w0_"]), grid), "k_", config, weight="w0_", by=CELL)


def query_univ(sketch: DataFrame, asked: DataFrame, config: UnivConfig, what: Sequence[str] = ("l1", "l2", "entropy", "card"), *, grid: MatrixConfig = GRID) -> DataFrame:
    """(subset, figures...): medians over the cells."""
    return _over_cells(asked, universal.ask(sketch, config, by=CELL), [], {w: w for w in what}, grid, zero=True)


# All kinds


def merge(kind: str, *sketches: DataFrame, config: UnivConfig | None = None) -> DataFrame:
    """The grid of all rows of several grids of one kind and shape (``counts`` for sums)."""
    out = sketches[0]
    for s in sketches[1:]:
        if set(s.columns) != set(out.columns):
            raise ValueError("grids of different heads can't be merged")
        out = out.unionByName(s)
    if kind in ("count_min", "count_sketch"):
        return matrix.roll_up(out, by=CELL)
    if kind == "hll":
        return cardinality.hll_merge(out, by=CELL)
    if kind == "ddsketch":
        return quantiles.dd_merge(out, by=CELL)
    if kind == "kll":
        return quantiles.kll_merge(out, by=CELL)
    if kind == "univmon":
        return universal.roll_up(out, config or UnivConfig(), by=CELL)
    if kind == "values":
        return out.groupBy(*CELL, "value").agg(F.sum("w").alias("w"))
    if kind == "counts":
        return out.groupBy(*CELL).agg(*(F.sum(c).alias(c) for c in out.columns if c not in CELL))
    raise ValueError(f"unknown kind {kind}")


def query(kind: str, what: str, *args, **options) -> DataFrame:
    """Dispatch by inner sketch and question, with the arguments of the question's own function (sketch, asked, ...);
    pairs that make no sense raise when the plan is made."""
    if what not in SUPPORTED.get(kind, ()):
        raise ValueError(f"{kind} can't answer {what}")
    if kind == "univmon":
        return query_univ(*args, what=["card" if what == "cardinality" else what], **options)
    if what in ("cdf", "quantile"):
        return {"cdf": query_cdf, "quantile": query_quantile}[what](*args, kind=kind, **options)
    return {"frequency": query_frequency, "cardinality": query_distinct}[what](*args, **options)


# KLL by key, without a fan-out


def keyed(df: DataFrame, key: str, value: str, *, rows: int = 3, cols: int = 32, k: int = 200) -> DataFrame:
    """(hrow, hcol, kll): KLL sketches by hashed key."""
    grid = MatrixConfig(rows=rows, cols=cols, fast=False, salt="keyed")
    return quantiles.kll(grid_cells(df.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("subset"), value), grid), value, k=k, by=CELL)


def keyed_merge(*sketches: DataFrame) -> DataFrame:
    return merge("kll", *sketches)


def keyed_quantiles(sketch: DataFrame, keys: DataFrame, key: str, qs: Sequence[float], *, rows: int = 3, cols: int = 32) -> DataFrame:
    grid = MatrixConfig(rows=rows, cols=cols, fast=False, salt="keyed")
    asked = keys.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("subset"))
    got = _over_cells(asked, quantiles.kll_quantiles(sketch, qs, by=CELL).select(*CELL, "q", "value"), ["q"], {"value": "value"}, grid)
    return got.withColumnRenamed("subset", key)
