"""Distinct counts: HyperLogLog (classic, Ertl and HIP) and KMV, both as rows.

A HyperLogLog is (groups..., reg, rho), one row for each register above zero; merging takes the maximum. KMV is
(groups..., hash), the k smallest distinct hashes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import groups, hashing
from tidemark.functions.groups import names as _names

P = 14


def alpha(m: int) -> float:
    return {16: 0.673, 32: 0.697, 64: 0.709}.get(m, 0.7213 / (1 + 1.079 / m))


def bits(p: int) -> int:
    """Bits of the 64-bit hash behind the register index, and the highest rank less 1."""
    if not 4 <= p <= 18:
        raise ValueError("precision is 4 to 18")
    return 64 - p


def reg_rho(h: Column, p: int) -> tuple[Column, Column]:
    """Register and rank by the first 64 bits of a digest: the index, then the zeros ahead of the first 1."""
    q = bits(p)
    rest = h.bitwiseAND(F.lit((1 << q) - 1))
    rank = F.when(rest >= 1 << q - 1, 1)
    for k in range(2, 9):  # nearly all ranks are small, and comparing is cheaper than counting digits
        rank = rank.when(rest >= 1 << q - k, k)
    rank = rank.when(rest == 0, q + 1).otherwise(F.lit(q + 1) - F.length(F.bin(rest)))
    return F.shiftrightunsigned(h, q).cast("int"), rank.cast("int")


def of_words(h: Column) -> Column:
    """The first 64 bits again."""
    return F.shiftleft(F.get(h, F.lit(0)), 16).bitwiseOR(F.shiftrightunsigned(F.get(h, F.lit(1)), 32))


def ranked(df: DataFrame, key: str, p: int, by: Sequence[str | Column], profile: str = "md5") -> DataFrame:
    """(groups..., reg, rho) of every row with a key."""
    reg, rho = reg_rho(F.col("h_"), p)
    few = df.where(F.col(key).isNotNull()).select(*by, hashing.key_halves(F.col(key), profile)[0].alias("h_"))
    return few.select(*(c for c in few.columns if c != "h_"), reg.alias("reg"), rho.alias("rho"))


def hll(df: DataFrame, key: str, *, p: int = P, by: Sequence[str] | str | None = None, profile: str = "md5") -> DataFrame:
    """The sketch of a column; null keys don't count. Every row is hashed where it is read; the one shuffle moves registers."""
    by = _names(by)
    return ranked(df, key, p, by, profile).groupBy(*by, "reg").agg(F.max("rho").alias("rho"))


def hll_merge(*sketches: DataFrame, by: Sequence[str] | str | None = None) -> DataFrame:
    out = sketches[0]
    for s in sketches[1:]:
        out = out.unionByName(s)
    return out.groupBy(*_names(by), "reg").agg(F.max("rho").alias("rho"))


def hll_delta(current: DataFrame, previous: DataFrame, *, by: Sequence[str] | str | None = None) -> DataFrame:
    """Registers that rose; merging them into the previous sketch gives the current one."""
    by = _names(by)
    both = groups.join(current, previous.withColumnRenamed("rho", "p_"), by, ["reg"], "left")
    return both.where(F.col("p_").isNull() | (F.col("rho") > F.col("p_"))).select(*by, "reg", "rho")


#: From here on, the 32-bit range would be nearly full; part of the classic algorithm, with the modulus below.
LARGE, RANGE = 143165576.533, 2147483647.0


def hll_classic(sketch: DataFrame, *, p: int = P, by: Sequence[str] | str | None = None, name: str = "est", whole: bool = True, large: bool = False) -> DataFrame:
    """Raw estimate with linear counting for small ranges; cut to a whole number unless ``whole`` is false. ``large`` adds
    the classic correction for hashes of 32 bits beyond 143 million; ours have 64, so it only serves to reproduce figures of
    sketches that apply it."""
    bits(p)
    m = 1 << p
    s = F.coalesce(F.sum(F.pow(F.lit(2.0), -F.col("rho"))), F.lit(0.0)) + (m - F.count("*"))
    got = sketch.groupBy(*_names(by)).agg(s.alias("s_"), (m - F.count("*")).alias("z_"))
    raw = F.lit(alpha(m) * m * m) / F.col("s_")
    high = F.when((raw > LARGE) & (raw < RANGE), -RANGE * F.log(1 - raw / RANGE)).otherwise(raw) if large else raw
    est = F.when((raw <= 2.5 * m) & (F.col("z_") > 0), m * F.log(F.lit(float(m)) / F.col("z_"))).otherwise(high)
    return got.select(*_names(by), (est.cast("long") if whole else est).alias(name))


#: Terms of Ertl's two series; the later ones vanish in doubles.
TERMS = 60


def hll_ertl(sketch: DataFrame, *, p: int = P, by: Sequence[str] | str | None = None, name: str = "est") -> DataFrame:
    """Ertl's improved estimate (arXiv:1702.01284). With C_k the number of registers of rank k and q the largest but one,
    the denominator is m sigma(C_0 / m) + sum of C_k 2^-k + m tau(1 - C_(q+1) / m) 2^-q, so one aggregation suffices."""
    m, q = 1 << p, bits(p)
    low = F.col("rho") <= q
    got = sketch.groupBy(*_names(by)).agg(F.count("*").alias("n_"), F.coalesce(F.sum(F.when(low, F.pow(F.lit(2.0), -F.col("rho")))), F.lit(0.0)).alias("s_"), F.sum(F.when(low, 0.0).otherwise(1.0)).alias("full_"))
    steps = F.sequence(F.lit(1), F.lit(TERMS))
    two = lambda k: F.pow(F.lit(2.0), k)
    x, y = 1 - F.col("n_") / m, 1 - F.col("full_") / m
    sigma = F.aggregate(steps, x, lambda a, k: a + F.pow(x, two(k)) * two(k - 1))
    tau = F.aggregate(steps, 1 - y, lambda a, k: a - F.pow(1 - F.pow(y, two(-k)), F.lit(2.0)) * two(-k)) / 3
    z = F.col("s_") + F.when((y > 0) & (y < 1), m * tau * 2.0**-q).otherwise(0.0) + m * sigma
    # without any register, sigma has no bound and the estimate is 0
    est = F.when(F.col("n_") == 0, 0.0).otherwise(F.lit(m * m / (2 * log(2))) / z)
    return got.select(*_names(by), F.round(est).cast("long").alias(name))


def hip(df: DataFrame, key: str, time: str, *, by: Sequence[str] | str | None = None, p: int = P, profile: str = "md5") -> DataFrame:
    """(groups..., est): the historic inverse probability estimate, from the register changes in order of time.

    A change adds m over the sum of 2^-register before it. Only the first time that a register takes a rank matters, so rows
    shrink to at most registers x ranks x groups before the one shuffle of the input; changes are running maxima. Rows of the
    same time come by register and rank. The estimate has no merge."""
    by = _names(by)
    m = 1 << p
    few = ranked(df, key, p, [*by, F.col(time).alias("t_")], profile).groupBy(*by, "reg", "rho").agg(F.min("t_").alias("t_"))
    before = Window.partitionBy(*by, "reg").orderBy("t_", "rho").rowsBetween(Window.unboundedPreceding, -1)
    changes = few.withColumn("old_", F.coalesce(F.max("rho").over(before), F.lit(0))).where("rho > old_")
    drop = F.pow(F.lit(2.0), -F.col("rho")) - F.pow(F.lit(2.0), -F.col("old_"))
    so_far = Window.partitionBy(*(by or [F.lit(0)])).orderBy("t_", "reg", "rho").rowsBetween(Window.unboundedPreceding, -1)
    steps = changes.withColumn("s_", m + F.coalesce(F.sum(drop).over(so_far), F.lit(0.0)))
    return steps.groupBy(*by).agg(F.sum(F.lit(float(m)) / F.col("s_")).alias("est"))


def hip_state(df: DataFrame, key: str, time: str, *, by: Sequence[str] | str | None = None, p: int = P, profile: str = "md5") -> tuple[DataFrame, DataFrame]:
    """(groups..., reg, rho) and (groups..., est) of the same rows: what an envelope of HIP holds."""
    return hll(df, key, p=p, by=by, profile=profile), hip(df, key, time, by=by, p=p, profile=profile)


def refuse_merge(*_: DataFrame) -> DataFrame:
    raise ValueError("HIP estimates can't be merged")


def kmv(df: DataFrame, key: str, *, k: int = 4096, by: Sequence[str] | str | None = None, profile: str = "md5") -> DataFrame:
    """The k smallest distinct 52-bit hashes of each group. Each task keeps no more than k of a group before the shuffle."""
    by = _names(by)
    hashes = df.where(F.col(key).isNotNull()).select(*by, F.shiftrightunsigned(hashing.key_halves(F.col(key), profile)[0], 12).alias("hash"))
    return _smallest(hashes.mapInArrow(lambda it: _bottom(it, by, k), hashes.schema), k, by)


#: Hashes that a task holds before it passes them on.
HELD = 1 << 21


def _bottom(batches: Iterator[pa.RecordBatch], by: list[str], k: int) -> Iterator[pa.RecordBatch]:
    """The k smallest distinct hashes of each group among a task's rows; many groups leave in several parts."""
    waiting: list[pa.RecordBatch] = []

    def least() -> pa.Table:
        t = pa.Table.from_batches(waiting).group_by([*by, "hash"]).aggregate([])
        t = t.take(pc.sort_indices(t, sort_keys=[(c, "ascending") for c in (*by, "hash")])).combine_chunks()
        new = np.zeros(t.num_rows, dtype=bool)
        new[:1] = True
        for c in by:  # a null is a group like any other
            codes = pc.dictionary_encode(t.column(c), null_encoding="encode").combine_chunks().indices.to_numpy(zero_copy_only=False)
            new[1:] |= codes[1:] != codes[:-1]
        starts = np.flatnonzero(new)
        place = np.arange(t.num_rows) - np.repeat(starts, np.diff(np.append(starts, t.num_rows)))
        return t.filter(pa.array(place < k)).combine_chunks()

    fresh, most = 0, max(4 * k, 1 << 16)
    for batch in batches:
        if batch.num_rows:
            waiting.append(batch)
            fresh += batch.num_rows
        if fresh > most:
            held = least()
            waiting, fresh = held.to_batches(), 0
            most = max(4 * k, 1 << 16, held.num_rows)
            if held.num_rows > HELD:
                yield from waiting
                waiting = []
    if waiting:
        yield from least().to_batches()


def _smallest(hashes: DataFrame, k: int, by: list[str]) -> DataFrame:
    few = hashes.distinct()
    if not by:
        return few.orderBy("hash").limit(k)
    return few.withColumn("r_", F.row_number().over(Window.partitionBy(*by).orderBy("hash"))).where(F.col("r_") <= k).drop("r_")


def kmv_merge(*sketches: DataFrame, k: int = 4096, by: Sequence[str] | str | None = None, ks: Sequence[int] = ()) -> DataFrame:
    """The k smallest hashes of all; ``ks``, if given, are the sketches' own k, which must all be this one."""
    if any(x != k for x in ks):
        raise ValueError("sketches of different k can't be merged")
    out = sketches[0]
    for s in sketches[1:]:
        out = out.unionByName(s)
    return _smallest(out, k, _names(by))


def kmv_estimate(sketch: DataFrame, *, k: int = 4096, by: Sequence[str] | str | None = None, name: str = "est") -> DataFrame:
    """Exact below k hashes, else (k - 1) over the largest as a fraction."""
    est = F.when(F.count("*") < k, F.count("*").cast("double")).otherwise((k - 1) / (F.max("hash").cast("double") / float(1 << 52)))
    return sketch.groupBy(*_names(by)).agg(est.alias(name))


def builtin(df: DataFrame, key: str, *, by: Sequence[str] | str | None = None, rsd: float = 0.02) -> DataFrame:
    """Spark's own sketches side by side: HLL++, DataSketches HLL and theta."""
    return df.groupBy(*_names(by)).agg(
        F.approx_count_distinct(key, rsd).alias("hll_plus_plus"), F.hll_sketch_estimate(F.hll_sketch_agg(key)).alias("hll"), F.expr(f"theta_sketch_estimate(theta_sketch_agg({key}))").alias("theta")
    )
