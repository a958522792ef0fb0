"""Quantiles, ranks and cumulative distributions: DDSketch as rows, exact forms, KLL built-ins and uniform samples.

A DDSketch is (groups..., bucket, cnt, lo, hi, total): the count of a logarithmic bucket with the least and greatest value
in it and their sum, so that minimum, maximum and sum survive merges. Running sums go over buckets, of which there are at most a few thousand, never
over the input.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import groups, hashing
from tidemark.functions.groups import names as _names
from tidemark.sources.scratch import Scratch

#: Values beyond these have no bucket.
LEAST, MOST = 2.2250738585072014e-308, 1.7976931348623157e308


def gamma(alpha: float) -> float:
    if not 0 < alpha < 1:
        raise ValueError("alpha lies between 0 and 1")
    return (1 + alpha) / (1 - alpha)


def ddsketch(df: DataFrame, value: str, *, alpha: float = 0.01, by: Sequence[str] | str | None = None) -> DataFrame:
    """Values that are null, not finite, zero or negative don't count."""
    by = _names(by)
    return bucketed(df, value, by, alpha).groupBy(*by, "bucket").agg(F.count("*").alias("cnt"), F.min("v_").alias("lo"), F.max("v_").alias("hi"), F.sum("v_").alias("total"))


def bucketed(df: DataFrame, value: str, by: Sequence[str] = (), alpha: float = 0.01) -> DataFrame:
    """(groups..., v_, bucket) of the rows that count."""
    few = df.select(*by, F.col(value).cast("double").alias("v_")).where((F.col("v_") >= LEAST) & (F.col("v_") <= MOST) & ~F.isnan("v_"))
    return few.withColumn("bucket", F.floor(F.ln("v_") * F.lit(1 / log(gamma(alpha)))).cast("int"))


def dd_merge(*sketches: DataFrame, alphas: Sequence[float] = (), by: Sequence[str] | str | None = None) -> DataFrame:
    if any(abs(a - alphas[0]) >= 1e-12 for a in alphas):
        raise ValueError("sketches of different alpha can't be merged")
    out = sketches[0]
    for s in sketches[1:]:
        out = out.unionByName(s)
    return out.groupBy(*_names(by), "bucket").agg(F.sum("cnt").alias("cnt"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("total").alias("total"))


def dd_delta(current: DataFrame, previous: DataFrame, *, threshold: int = 1, by: Sequence[str] | str | None = None) -> DataFrame:
    """Buckets that grew by ``threshold`` or more, with what was added; falls count as none. Merged into the previous
    sketch, a delta of threshold 1 gives the current one."""
    by = _names(by)
    before = previous.select(*by, "bucket", F.col("cnt").alias("p_"), F.col("total").alias("t_"))
    both = groups.join(current, before, by, ["bucket"], "left").withColumns({"cnt": F.col("cnt") - F.coalesce("p_", F.lit(0)), "total": F.col("total") - F.coalesce("t_", F.lit(0.0))})
    return both.where(F.col("cnt") >= max(1, threshold)).drop("p_", "t_")


def dd_summary(sketch: DataFrame, *, by: Sequence[str] | str | None = None) -> DataFrame:
    return sketch.groupBy(*_names(by)).agg(F.sum("cnt").alias("n"), F.min("lo").alias("min"), F.max("hi").alias("max"), F.sum("total").alias("sum"))


def dd_rank(sketch: DataFrame, at: Sequence[float], *, alpha: float = 0.01, by: Sequence[str] | str | None = None) -> DataFrame:
    """(groups..., x, rank, fraction): the count of the buckets whose representative is up to x."""
    by = _names(by)
    r = F.coalesce(F.sum(F.when(F.pow(F.lit(gamma(alpha)), F.col("bucket")) * (1 + alpha) <= F.col("x"), F.col("cnt"))), F.lit(0))
    return sketch.withColumn("x", _asked(at)).groupBy(*by, "x").agg(r.alias("rank"), (r / F.sum("cnt")).alias("fraction"))


def _asked(qs: Sequence[float]) -> Column:
    return F.explode(F.array(*[F.lit(float(q)) for q in qs]))


def dd_quantiles(sketch: DataFrame, qs: Sequence[float], *, alpha: float = 0.01, by: Sequence[str] | str | None = None, portable: bool = False) -> DataFrame:
    """(groups..., q, value). The value of a bucket is gamma^bucket (1 + alpha), held within minimum and maximum; ranks
    are ceil(q n). ``portable`` uses floor(q (n - 1)) and gamma^(bucket + 1/2). Groups without values give no row."""
    by = _names(by)
    g = gamma(alpha)
    own = [F.col(c) for c in by]
    order = Window.partitionBy(*own).orderBy("bucket") if own else Window.partitionBy(F.lit(0)).orderBy("bucket")
    whole = Window.partitionBy(*own) if own else Window.partitionBy(F.lit(0))
    run = sketch.withColumns({"c_": F.sum("cnt").over(order), "n_": F.sum("cnt").over(whole), "min_": F.min("lo").over(whole), "max_": F.max("hi").over(whole)}).withColumn("q", _asked(qs))
    if portable:
        need = F.floor(F.col("q") * (F.col("n_") - 1)) + 1
        rep = F.pow(F.lit(g), F.col("bucket") + 0.5)
    else:
        need = F.greatest(F.lit(1), F.ceil(F.col("q") * F.col("n_")))
        rep = F.pow(F.lit(g), F.col("bucket")) * (1 + alpha)
    first = run.where(F.col("c_") >= need).groupBy(*by, "q").agg(F.min("bucket").alias("bucket"), F.first("min_").alias("min_"), F.first("max_").alias("max_"))
    value = F.when(F.col("q") <= 0, F.col("min_")).when(F.col("q") >= 1, F.col("max_")).otherwise(F.least(F.greatest(rep, F.col("min_")), F.col("max_")))
    return first.select(*by, "q", value.alias("value"))


def counts(df: DataFrame, value: str, *, weight: str | None = None, by: Sequence[str] | str | None = None) -> DataFrame:
    """(groups..., value, w): weights by distinct value; null values don't count."""
    w = F.lit(1).cast("long") if weight is None else F.col(weight)
    return df.where(F.col(value).isNotNull()).groupBy(*_names(by), F.col(value).cast("double").alias("value")).agg(F.sum(w).alias("w"))


def cdf(weighted: DataFrame, *, by: Sequence[str] | str | None = None) -> DataFrame:
    """(groups..., value, w, cum, fraction): the cumulative distribution, one row a distinct value.

    Without groups the running sum has two levels, so that no task orders all values: the values are dealt by range and
    written once, the totals of the ranges (a row a shuffle partition) are summed up, and each range goes on from there.
    """
    by = _names(by)
    if by:
        order = Window.partitionBy(*by).orderBy("value")
        out = weighted.withColumns({"cum": F.sum("w").over(order), "n_": F.sum("w").over(Window.partitionBy(*by))})
        return out.select(*by, "value", "w", "cum", (F.col("cum") / F.col("n_")).alias("fraction"))
    spark = weighted.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = Scratch(spark).save(weighted.select("value", "w").repartitionByRange(n, "value").withColumn("part_", F.spark_partition_id()))
    totals = ranged.groupBy("part_").agg(F.sum("w").alias("t_"))
    before = totals.select("part_", (F.sum("t_").over(Window.orderBy("part_")) - F.col("t_")).alias("before_"), F.sum("t_").over(Window.partitionBy()).alias("n_"))
    cum = F.col("before_") + F.sum("w").over(Window.partitionBy("part_").orderBy("value"))
    return ranged.join(F.broadcast(before), "part_").withColumn("cum", cum).select("value", "w", "cum", (F.col("cum") / F.col("n_")).alias("fraction"))


def rank(weighted: DataFrame, at: Sequence[float], *, by: Sequence[str] | str | None = None) -> DataFrame:
    """(groups..., x, rank, fraction): the weight of values up to x, by plain aggregation."""
    by = _names(by)
    xs = weighted.withColumn("x", _asked(at))
    r = F.coalesce(F.sum(F.when(F.col("value") <= F.col("x"), F.col("w"))), F.lit(0))
    return xs.groupBy(*by, "x").agg(r.alias("rank"), (r / F.sum("w")).alias("fraction"))


def quantiles(weighted: DataFrame, qs: Sequence[float], *, by: Sequence[str] | str | None = None) -> DataFrame:
    """(groups..., q, value): the first value whose fraction reaches q."""
    by = _names(by)
    return cdf(weighted, by=by).withColumn("q", _asked(qs)).where(F.col("fraction") >= F.col("q")).groupBy(*by, "q").agg(F.min("value").alias("value"))


def quantiles_interpolated(weighted: DataFrame, qs: Sequence[float], *, by: Sequence[str] | str | None = None) -> DataFrame:
    """(groups..., q, value), linear between the steps of the distribution."""
    return _interpolated(cdf(weighted, by=by), qs, _names(by))


def _interpolated(distribution: DataFrame, qs: Sequence[float], by: list[str]) -> DataFrame:
    steps = distribution.withColumn("q", _asked(qs))
    up, down = F.col("fraction") >= F.col("q"), F.col("fraction") < F.col("q")
    got = steps.groupBy(*by, "q").agg(
        F.min(F.when(up, F.struct("fraction", "value"))).alias("b_"), F.max(F.when(down, F.struct("fraction", "value"))).alias("a_"), F.max("value").alias("top_")
    )
    a, b = F.col("a_"), F.col("b_")
    line = a["value"] + (F.col("q") - a["fraction"]) / (b["fraction"] - a["fraction"]) * (b["value"] - a["value"])
    return got.select(*by, "q", F.when(b.isNull(), F.col("top_")).when(a.isNull(), b["value"]).otherwise(line).alias("value"))


def kll(df: DataFrame, value: str, *, k: int = 200, by: Sequence[str] | str | None = None, name: str = "kll", kind: str = "double") -> DataFrame:
    """Spark's KLL sketch as a binary column, of ``kind`` double, float or bigint; its bytes depend on how rows meet, since
    its coins aren't seeded, and its error bound doesn't."""
    if not 8 <= k <= 65535 or kind not in ("double", "float", "bigint"):
        raise ValueError("k lies between 8 and 65535 and kind is double, float or bigint")
    return df.groupBy(*_names(by)).agg(F.expr(f"kll_sketch_agg_{kind}(cast({value} as {kind}), {k})").alias(name))


def kll_merge(sketches: DataFrame, *, by: Sequence[str] | str | None = None, name: str = "kll", kind: str = "double") -> DataFrame:
    return sketches.groupBy(*_names(by)).agg(F.expr(f"kll_merge_agg_{kind}({name})").alias(name))


def _of_kll(sketches: DataFrame, function: str, at: Sequence[float], name: str, x: str, out: str, kind: str) -> DataFrame:
    """A row for each point asked; Spark takes the points as constants only."""
    point = lambda v: f"cast({v!r}D as {kind})" if function == "rank" else f"{v!r}D"
    each = F.array(*[F.struct(F.lit(float(v)).alias(x), F.expr(f"kll_sketch_get_{function}_{kind}({name}, {point(float(v))})").alias(out)) for v in at])
    return sketches.withColumn("n", F.expr(f"kll_sketch_get_n_{kind}({name})")).where("n > 0").withColumn("e_", F.explode(each)).withColumns({x: F.col("e_")[x], out: F.col("e_")[out]})


def kll_quantiles(sketches: DataFrame, qs: Sequence[float], *, by: Sequence[str] | str | None = None, name: str = "kll", kind: str = "double") -> DataFrame:
    """(groups..., n, q, value); no row for a sketch without values."""
    return _of_kll(sketches, "quantile", qs, name, "q", "value", kind).select(*_names(by), "n", "q", "value")


def kll_rank(sketches: DataFrame, at: Sequence[float], *, by: Sequence[str] | str | None = None, name: str = "kll", kind: str = "double") -> DataFrame:
    """(groups..., x, rank): about how many values are up to x."""
    return _of_kll(sketches, "rank", at, name, "x", "rank", kind).select(*_names(by), "x", (F.col("rank") * F.col("n")).alias("rank"))


def kll_cdf(sketches: DataFrame, *, steps: int = 256, by: Sequence[str] | str | None = None, name: str = "kll", kind: str = "double") -> DataFrame:
    """(groups..., value, w, cum, fraction): a sketch's distribution in ``steps`` equal steps of rank, of which those with
    the same value are one; it can be asked like an exact one."""
    by = _names(by)
    got = kll_quantiles(sketches, [i / steps for i in range(steps + 1)], by=by, name=name, kind=kind)
    whole = got.groupBy(*by, F.col("value").cast("double").alias("value")).agg(F.max("q").alias("fraction"), F.max("n").alias("n_"))
    before = F.coalesce(F.lag("fraction").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("value")), F.lit(0.0))
    return whole.select(*by, "value", ((F.col("fraction") - before) * F.col("n_")).alias("w"), (F.col("fraction") * F.col("n_")).alias("cum"), "fraction")


def kll_quantiles_interpolated(sketches: DataFrame, qs: Sequence[float], *, steps: int = 256, by: Sequence[str] | str | None = None, name: str = "kll", kind: str = "double") -> DataFrame:
    """(groups..., q, value), linear between the steps of the sketch's distribution."""
    return _interpolated(kll_cdf(sketches, steps=steps, by=by, name=name, kind=kind), qs, _names(by))


#: Priorities have 52 bits, of which these tell buckets apart.
PRIORITY_BITS = 16


def uniform_sample(df: DataFrame, ident: str, rate: float, *, by: Sequence[str] | str | None = None, seed: str = "", total: str | None = None) -> DataFrame:
    """The ceil(rate n) rows (of each group) with the least priority, a hash of ``ident``; the column prio stays, so that
    samples merge, and ``total``, if named, is the number of rows seen.

    A histogram of the priorities says which bucket holds the last row of the sample; rows of lower buckets are in, and only
    rows of that one are ranked, so no task orders more than a 65,536th of a group's rows."""
    if not 0 < rate <= 1:
        raise ValueError("rate lies above 0 and up to 1")
    by = _names(by)
    out = df.withColumn("prio", hashing.hex_slice(hashing.digest(F.col(ident), "md5", seed), 1, 13))
    return _least(out, ident, F.ceil(F.lit(rate) * F.col("n_")), by, total)


def _least(out: DataFrame, ident: str, need: Column, by: list[str], total: str | None) -> DataFrame:
    """The ``need`` rows (of each group) with the least priority; ``need`` may use the number of rows, n_."""
    out = out.withColumn("b_", F.shiftright("prio", 52 - PRIORITY_BITS))
    filled = out.groupBy(*by, "b_").agg(F.count("*").alias("c_"))
    whole = Window.partitionBy(*(by or [F.lit(0)]))
    run = filled.withColumns({"n_": F.sum("c_").over(whole), "cum_": F.sum("c_").over(whole.orderBy("b_"))}).withColumn("need_", F.least(need, F.col("n_")))
    # the first bucket that reaches the need is the only one of which fewer rows may be wanted than it holds
    before = F.col("cum_") - F.col("c_")
    border = run.where((F.col("cum_") >= F.col("need_")) & (before < F.col("need_"))).select(*by, F.col("b_").alias("last_"), "n_", (F.col("need_") - before).alias("need_"))
    near = groups.join(out, border, by).where(F.col("b_") <= F.col("last_"))
    order = Window.partitionBy(*by, "b_").orderBy("prio", ident)
    kept = near.withColumn("r_", F.row_number().over(order)).where((F.col("b_") < F.col("last_")) | (F.col("r_") <= F.col("need_")))
    return (kept.withColumn(total, F.col("n_")) if total else kept).drop("r_", "n_", "b_", "last_", "need_")


def merge_samples(samples: Sequence[DataFrame], seen: Sequence[int], rates: Sequence[float], ident: str) -> DataFrame:
    """The least-priority rows of the union, as many as one sample of all would hold."""
    if len(set(rates)) != 1:
        raise ValueError("samples of different rates can't be merged")
    out = samples[0]
    for s in samples[1:]:
        out = out.unionByName(s)
    return _least(out, ident, F.lit(int(-(-sum(seen) * rates[0] // 1))), [], None)
