"""Universal monitoring: one layered sketch answers any sum of g(frequency), so L1, L2, entropy and distinct count.

Layer i holds the keys whose first i sampling bits are all 1. Each layer has a Count Sketch and its k heaviest keys by
estimate. The g-sum has the closed form: the sum over layers i and heavy keys of 2^i (1 - 2 bit_(i+1)) g, where the last
layer counts plainly. The distinct count leaves out heavy keys of up to 1 % of their layer's L2, which are mostly noise.

A stored sketch is one relation (groups..., layer, row, col, key_, cnt): the cells, with row -1 of layer 0 for the sum of
all weights, and, as row -2, the heavy keys with their estimates, as text and cut to whole numbers. Sketches merge, and
stored or merged ones answer all questions: a merge adds the cells and estimates the keys of either anew.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import groups, hashing
from tidemark.functions.groups import names as _names
from tidemark.operators import matrix
from tidemark.operators.matrix import MatrixConfig

TOTAL, HEAVY = -1, -2


@dataclass(frozen=True)
class UnivConfig:
    """``mouse_cols``, if given, is the width of the layers from ``elephants`` on (the pyramid)."""

    layers: int = 8
    rows: int = 5
    cols: int = 2048
    k: int = 32
    elephants: int | None = None
    mouse_cols: int = 512

    def __post_init__(self) -> None:
        if not 1 <= self.layers <= 32:
            raise ValueError("between 1 and 32 layers")

    def matrix(self) -> MatrixConfig:
        return MatrixConfig(rows=self.rows, cols=self.cols, signed=True)

    def width(self) -> Column:
        return F.lit(self.cols) if self.elephants is None else F.when(F.col("layer") < self.elephants, self.cols).otherwise(self.mouse_cols)


PYRAMID = UnivConfig(layers=16, rows=3, cols=2048, elephants=8)


def bottom(key: Column, layers: int) -> Column:
    """The deepest layer of a key: its number of leading 1 bits, at most layers - 1."""
    h = hashing.hex_slice(hashing.digest(key, "md5", "layer:"), 1, 8)
    # leading ones are leading zeros of the complement
    ones = F.lit(32) - F.when(h == 0xFFFFFFFF, 0).otherwise(F.length(F.bin(F.lit(0xFFFFFFFF) - h)))
    return F.least(ones, F.lit(layers - 1)).cast("int")


def layered(counts: DataFrame, config: UnivConfig, by: Sequence[str] = ()) -> DataFrame:
    """(groups..., layer, bottom, key_, w_): each key in every layer down to its bottom."""
    deep = counts.withColumn("bottom", bottom(F.col("key_"), config.layers))
    return deep.withColumn("layer", F.explode(F.sequence(F.lit(0), F.col("bottom")))).select(*by, "layer", "bottom", "key_", "w_")


def _placed(many: DataFrame, config: UnivConfig) -> DataFrame:
    cells = matrix.cells(matrix.hashed(many, "key_", config.matrix()), config.matrix())
    return cells.withColumn("col", hashing.fast_col(F.col("h_"), F.col("row"), config.width().cast("long")))


def _cells(df: DataFrame, key: str, config: UnivConfig, weight: str | Column | None, by: list[str]) -> DataFrame:
    """(groups..., layer, row, col, cnt) in one pass and one shuffle, the sum of weights among them."""
    deep = layered(matrix.weighted(df, key, weight, by).withColumn("key_", F.col("key_").cast("string")), config, by)
    deep = matrix.hashed(deep, "key_", config.matrix())
    rows = F.sequence(F.when(F.col("layer") == 0, TOTAL).otherwise(0), F.lit(config.rows - 1))
    many = deep.withColumn("row", F.explode(rows))
    real = F.col("row") >= 0
    col = F.when(real, hashing.fast_col(F.col("h_"), F.col("row"), config.width().cast("long"))).otherwise(0)
    sign = F.when(real, hashing.fast_sign(F.col("h_"), F.col("row"))).otherwise(1)
    return many.select(*by, "layer", "row", col.alias("col"), (sign * F.col("w_")).alias("v_")).groupBy(*by, "layer", "row", "col").agg(F.sum("v_").alias("cnt")).where("cnt <> 0")


def _stored(cells: DataFrame, keys: DataFrame, config: UnivConfig, by: list[str]) -> DataFrame:
    """The cells and, of the keys, the heaviest."""
    held = [*by, "layer", "row", "col", "key_", "cnt"]
    heavy = heaviest(cells, keys, config, by=by).withColumns({"row": F.lit(HEAVY), "col": F.lit(None).cast("long"), "cnt": F.col("est")})
    whole = cells.withColumns({"col": F.col("col").cast("long"), "key_": F.lit(None).cast("string"), "cnt": F.col("cnt").cast("long")})
    return whole.select(*held).unionByName(heavy.select(*held))


def build(df: DataFrame, key: str, config: UnivConfig, *, weight: str | Column | None = None, by: Sequence[str] | str | None = None) -> DataFrame:
    """The stored sketch of a column. The cells take one pass; finding the heavy keys takes a second one over the distinct
    keys, which are the candidates."""
    by = _names(by)
    keys = df.where(F.col(key).isNotNull()).select(*by, F.col(key).cast("string").alias("key_")).distinct()
    return _stored(_cells(df, key, config, weight, by), layered(keys.withColumn("w_", F.lit(0)), config, by), config, by)


def merge(*sketches: DataFrame, config: UnivConfig, by: Sequence[str] | str | None = None) -> DataFrame:
    """One sketch (of each group) of all the given ones."""
    out = sketches[0]
    for s in sketches[1:]:
        out = out.unionByName(s)
    return roll_up(out, config, by=by)


def roll_up(sketch: DataFrame, config: UnivConfig, *, by: Sequence[str] | str | None = None) -> DataFrame:
    """One sketch for each of fewer groups."""
    by = _names(by)
    cells = sketch.where(F.col("row") > HEAVY).groupBy(*by, "layer", "row", "col").agg(F.sum("cnt").alias("cnt")).where("cnt <> 0")
    keys = sketch.where(F.col("row") == HEAVY).select(*by, "layer", "key_").distinct()
    return _stored(cells, keys.withColumn("bottom", bottom(F.col("key_"), config.layers)), config, by)


def heaviest(cells: DataFrame, keys: DataFrame, config: UnivConfig, *, by: Sequence[str] | str | None = None) -> DataFrame:
    """(groups..., layer, bottom, key_, est): the k heaviest of the given (groups..., layer, bottom, key_) by estimate."""
    by = _names(by)
    real = cells.where("row >= 0")
    if not by and config.layers * config.rows * config.cols <= matrix.BROADCAST_CELLS:
        real = F.broadcast(real)
    found = groups.join(_placed(keys, config), real, by, ["layer", "row", "col"], "left")
    est = matrix.over_rows(found, [*by, "layer", "bottom", "key_"], config.rows, F.coalesce("cnt", F.lit(0)) * F.col("sign_"), {"est": "median"})
    order = Window.partitionBy(*by, "layer").orderBy(F.desc("est"), "key_")
    return est.withColumn("est", F.col("est").cast("long")).withColumn("r_", F.row_number().over(order)).where(F.col("r_") <= config.k).drop("r_")


def _layers(sketch: DataFrame, config: UnivConfig, by: list[str]) -> DataFrame:
    """A row for each layer (of each group): n (in layer 0), l2 and the heavy keys, at most k of them, as ``top``."""
    row, square = F.col("row"), F.col("cnt").cast("double") * F.col("cnt")
    sums = [F.coalesce(F.sum(F.when(row == r, square)), F.lit(0.0)).alias(f"q{r}_") for r in range(config.rows)]
    got = sketch.groupBy(*by, "layer").agg(*sums, F.sum(F.when(row == TOTAL, F.col("cnt"))).alias("n"), F.collect_list(F.when(row == HEAVY, F.struct("key_", "cnt"))).alias("top"))
    ordered = F.array_sort(F.array(*(f"q{r}_" for r in range(config.rows))))
    l2 = F.sqrt((F.get(ordered, F.lit((config.rows - 1) // 2)) + F.get(ordered, F.lit(config.rows // 2))) / 2)
    return got.select(*by, "layer", "n", l2.alias("l2"), "top")


def g_sums(sketch: DataFrame, config: UnivConfig, gs: dict[str, Callable[[Column], Column]], *, by: Sequence[str] | str | None = None, threshold: Sequence[str] = ()) -> DataFrame:
    """(groups..., n, sums...): for each named g the sum over all keys' frequencies, all in one pass over the sketch. Those
    named in ``threshold`` leave out keys of up to 1 % of their layer's L2."""
    by = _names(by)
    many = _layers(sketch, config, by).select(*by, "layer", "n", "l2", F.explode_outer("top").alias("t_"))
    est = F.col("t_.cnt").cast("double")
    deeper = bottom(F.col("t_.key_"), config.layers) > F.col("layer")  # the next sampling bit is 1
    factor = F.pow(F.lit(2.0), F.col("layer")) * F.when(F.col("layer") == config.layers - 1, 1).when(deeper, -1).otherwise(1)
    least = F.floor(F.col("l2") * 0.01)
    sums = [F.sum(F.when(est > (least if n in threshold else 0), factor * g(est)).otherwise(0.0)).alias(n) for n, g in gs.items()]
    return many.groupBy(*by).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), *sums)


def ask(sketch: DataFrame, config: UnivConfig, *, by: Sequence[str] | str | None = None) -> DataFrame:
    """(groups..., n, l1, l2, entropy, card) of a stored sketch."""
    got = g_sums(sketch, config, {"l1": lambda c: c, "l2s_": lambda c: c * c, "xlog_": lambda c: c * F.log2(c), "card": lambda c: F.lit(1.0)}, by=by, threshold=["card"])
    entropy = F.log2(F.col("n").cast("double")) - F.col("xlog_") / F.col("n")
    return got.select(*_names(by), "n", "l1", F.sqrt(F.greatest("l2s_", F.lit(0.0))).alias("l2"), F.when(F.col("n") > 0, entropy).otherwise(0.0).alias("entropy"), "card")


def metrics(df: DataFrame, key: str, config: UnivConfig = UnivConfig(), *, weight: str | Column | None = None, by: Sequence[str] | str | None = None) -> DataFrame:  # noqa: B008
    """``ask`` of a sketch of ``df``."""
    return ask(build(df, key, config, weight=weight, by=by), config, by=by)


def exact_metrics(df: DataFrame, key: str, *, weight: str | Column | None = None, by: Sequence[str] | str | None = None) -> DataFrame:
    """The same figures from exact counts, which small groups and short ranges can afford."""
    by = _names(by)
    c = matrix.summed(df, key, weight, by)
    x = F.col("w_").cast("double")
    got = c.groupBy(*by).agg(F.sum("w_").alias("n"), F.sum("w_").cast("double").alias("l1"), F.sqrt(F.sum(x * x)).alias("l2"), F.sum(x * F.log2(x)).alias("x_"), F.count("*").cast("double").alias("card"))
    return got.select(*by, "n", "l1", "l2", (F.log2(F.col("n").cast("double")) - F.col("x_") / F.col("n")).alias("entropy"), "card")
