"""Algorithms whose result depends on the order of arrival: Elastic, Coco and exponential histograms.

Elastic, Coco and the L2 rule are ordered folds over one group's rows, so rows are grouped by what the algorithm partitions
by anyway (bucket, table part, stream) and sorted by time; the fold holds only the sketch's own bounded state and passes on
the rest as it comes. Groups come as Arrow batches of a sorted partition, never whole. The L1 rule has a closed form and
needs no fold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import groups, hashing
from tidemark.operators import matrix
from tidemark.operators.matrix import MatrixConfig


def fold(df: DataFrame, group: str, order: Sequence[str], start: Callable[[], Any], step: Callable[[Any, tuple], None], finish: Callable[[Any], list[tuple]], name: str, schema: str, spill: Callable[[Any], list[tuple]] | None = None) -> DataFrame:
    """Runs ``step`` over each group's rows in order; ``finish`` gives the group's output rows (``schema``), led by the group
    as ``name``. After each batch, ``spill`` may give rows and take them out of the state. A null group is one like any
    other."""
    from pyspark.sql.pandas.types import to_arrow_schema

    few = df.withColumnRenamed(group, "g_").repartition("g_").sortWithinPartitions("g_", *order)
    names = [c for c in few.columns if c != "g_"]
    kind = T.StructType([T.StructField(name, few.schema["g_"].dataType), *T.StructType.fromDDL(schema).fields])
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, key, open_ = None, None, False

        def made(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

        for batch in batches:
            rows: list[tuple] = []
            for g, row in zip(batch.column("g_").to_pylist(), zip(*(batch.column(c).to_pylist() for c in names), strict=True), strict=True):
                if not open_ or (g != key and not (g != g and key != key)):  # NaN is one group
                    if open_:
                        rows += [(key, *r) for r in finish(state)]
                    state, key, open_ = start(), g, True
                step(state, row)
            if open_ and spill is not None:
                rows += [(key, *r) for r in spill(state)]
            yield from made(rows)
        if open_:
            yield from made([(key, *r) for r in finish(state)])

    return few.mapInArrow(run, kind)


ELASTIC = MatrixConfig(rows=3, cols=4096)
ELASTIC_KIND = "heavy_key string, positive long, evicted boolean, light_key string, light long"


def elastic(df: DataFrame, key: str, time: str, *, buckets: int = 8, ratio: int = 8) -> DataFrame:
    """(bucket, heavy_key, positive, evicted, light_key, light): the heavy part, and what went to the light part by key.
    A key that loses its bucket is flushed to the light part under its own name. Votes reset with the new key."""
    b = hashing.hex_slice(hashing.digest(F.col(key), "md5", "elastic:"), 1, 8) % buckets
    few = df.where(F.col(key).isNotNull()).select(b.alias("b_"), F.col(time).alias("t_"), F.col(key).cast("string").alias("k_"))

    def start() -> dict:
        return {"key": None, "pos": 0, "neg": 0, "evicted": False, "light": {}}

    def step(s: dict, row: tuple) -> None:
        k = row[1]
        if s["key"] is None:
            s |= {"key": k, "pos": 1}
        elif s["key"] == k:
            s["pos"] += 1
        else:
            s["neg"] += 1
            if s["neg"] // s["pos"] < ratio:
                s["light"][k] = s["light"].get(k, 0) + 1
            else:
                s["light"][s["key"]] = s["light"].get(s["key"], 0) + s["pos"]
                s |= {"key": k, "pos": 1, "neg": 1, "evicted": True}

    def spill(s: dict) -> list[tuple]:
        """Light counts leave with each batch: what stays is the bucket."""
        light = [(None, 0, False, k, n) for k, n in s["light"].items()]
        s["light"] = {}
        return light

    return fold(few, "b_", ["t_", "k_"], start, step, lambda s: [(s["key"], s["pos"], s["evicted"], None, 0), *spill(s)], "bucket", ELASTIC_KIND, spill)


def elastic_light(built: DataFrame, config: MatrixConfig = ELASTIC) -> DataFrame:
    """The light part as a Count-Min sketch."""
    return matrix.build(built.where("light_key is not null"), "light_key", config, weight="light")


def elastic_query(built: DataFrame, probes: DataFrame, key: str, config: MatrixConfig = ELASTIC) -> DataFrame:
    """(key, est): the heavy votes, with the light estimate if the bucket was ever lost; else the light estimate."""
    light = matrix.query(elastic_light(built, config), probes.select(F.col(key).cast("string").alias(key)), key, config, est="l_")
    heavy = built.where("heavy_key is not null").select(F.col("heavy_key").alias(key), "positive", "evicted")
    est = F.when(F.col("positive").isNull(), F.col("l_")).when(F.col("evicted"), F.col("positive") + F.col("l_")).otherwise(F.col("positive"))
    return light.join(F.broadcast(heavy), key, "left").select(key, est.alias("est"))  # a row a bucket


def elastic_merge(*built: DataFrame, config: MatrixConfig = ELASTIC) -> DataFrame:
    """All heavy parts flushed to the light part, as one Count-Min sketch."""
    parts = [elastic_light(b, config) for b in built]
    parts += [matrix.build(b.where("heavy_key is not null"), "heavy_key", config, weight="positive") for b in built]
    return matrix.merge(*parts)


def coco(df: DataFrame, key: str, *, weight: str | None = None, width: int = 64, depth: int = 5, parts: int = 8, seed: int = 7) -> DataFrame:
    """(part, depth, slot, full_key, val): CocoSketch tables, one for each part of the keys; a full bucket takes a new key
    with probability v / val. Keys are summed first and come in order of their hash; the coin is a seeded generator."""
    digest = hashing.digest(F.col("key_"), "md5", "coco:")
    few = matrix.summed(df, key, weight).withColumn("h_", digest).select((hashing.hex_slice(F.col("h_"), 1, 4) % parts).alias("p_"), "h_", F.col("key_").cast("string").alias("k_"), F.col("w_").cast("long").alias("w_")).where("w_ > 0")

    def start() -> dict:
        return {"keys": [[None] * width for _ in range(depth)], "val": np.zeros((depth, width), dtype=np.int64), "rng": np.random.default_rng(seed)}

    def step(s: dict, row: tuple) -> None:
        h, k, w = row
        at = [int(h[4 + 5 * d : 9 + 5 * d], 16) % width for d in range(depth)]
        for d, c in enumerate(at):
            if s["keys"][d][c] == k:
                s["val"][d, c] += w
                return
        for d, c in enumerate(at):
            if s["keys"][d][c] is None:
                s["keys"][d][c], s["val"][d, c] = k, w
                return
        d = int(np.argmin([s["val"][d, c] for d, c in enumerate(at)]))
        s["val"][d, at[d]] += w
        if s["rng"].random() < w / s["val"][d, at[d]]:
            s["keys"][d][at[d]] = k

    def finish(s: dict) -> list[tuple]:
        return [(d, c, s["keys"][d][c], int(s["val"][d, c])) for d in range(depth) for c in range(width) if s["keys"][d][c] is not None]

    return fold(few, "p_", ["h_", "k_"], start, step, finish, "part", "depth long, slot long, full_key string, val long")


def coco_estimate(table: DataFrame, partial: str, predicate: Callable | None = None) -> DataFrame:
    """One row: the sum over buckets whose key contains ``partial``, or for which ``predicate(full, partial)`` holds."""
    full, p = F.col("full_key"), F.lit(partial)
    return table.where(predicate(full, p) if predicate else full.contains(p)).agg(F.coalesce(F.sum("val"), F.lit(0)).alias("est"))


def coco_merge(*tables: DataFrame, **options) -> DataFrame:
    """All tables' buckets inserted anew."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return coco(out, "full_key", weight="val", **options)


class ExponentialHistogram:
    """Buckets of a sliding window: (first, last, count, square); equal sizes merge as they age.

    ``norm`` l1: the oldest two of a size merge when it has k/2 + 2 of them. l2: a pair merges while the sum of its squares
    is at most the newer buckets' squares over k. Buckets that end before the window expire.
    """

    def __init__(self, k: int, window: float, norm: str = "l1"):
        if k < 1 or norm not in ("l1", "l2"):
            raise ValueError("k is at least 1 and norm l1 or l2")
        self.k, self.window, self.norm = k, window, norm
        self.buckets: list[list[float]] = []  # oldest first: start, end, count, sum

    def update(self, time: float, value: float = 1.0) -> None:
        self.expire(time)
        self.buckets.append([time, time, 1, value])
        self._merge()

    def expire(self, time: float) -> None:
        keep = 0
        while keep < len(self.buckets) and self.buckets[keep][1] < time - self.window:
            keep += 1
        del self.buckets[:keep]

    def _join(self, i: int) -> None:
        a, b = self.buckets[i], self.buckets.pop(i + 1)
        self.buckets[i] = [min(a[0], b[0]), max(a[1], b[1]), a[2] + b[2], a[3] + b[3]]

    def _merge(self) -> None:
        if self.norm == "l1":
            end = len(self.buckets)
            while end:
                start = end
                size = self.buckets[end - 1][2]
                while start and self.buckets[start - 1][2] == size:
                    start -= 1
                if end - start < self.k / 2 + 2:
                    break
                self._join(start)
                end = start + 1
        else:
            newer, i = 0.0, len(self.buckets) - 2  # newer: the squares behind the pair
            while i >= 0:
                a, b = self.buckets[i][3] ** 2, self.buckets[i + 1][3] ** 2
                if a + b <= newer / self.k:
                    self._join(i)
                else:
                    newer += b
                i -= 1

    def query(self, start: float, end: float) -> tuple[int, float]:
        """(count, sum) of the buckets that touch the interval."""
        use = [b for b in self.buckets if b[1] >= start and b[0] <= end]
        return int(sum(b[2] for b in use)), float(sum(b[3] for b in use))

    def cover(self, start: float, end: float) -> bool:
        return bool(self.buckets) and self.buckets[0][0] <= start and self.buckets[-1][1] >= end


def l1_levels(n: Column, k: int) -> Column:
    """The levels of an L1 histogram after ``n`` rows, newest first: (start, size, first): from row ``start`` on, counted
    from the newest, buckets have ``size`` rows, and the first of them has number ``first``.

    A level of which the ``t``-th bucket comes (t = k/2 + 2, rounded up) gives its two oldest to the next level. So with x
    buckets that ever came, floor((x - t + 2) / 2) pairs have gone on, if that is above 0."""
    t = -(-k // 2) + 2
    gone = lambda x: F.greatest(F.lit(0).cast("long"), F.floor((x - (t - 2)) / 2).cast("long"))
    first = F.struct(n.alias("x"), F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("number"), F.array().cast("array<struct<start:bigint,size:bigint,first:bigint>>").alias("held"))

    def level(a: Column, j: Column) -> Column:
        size = F.pow(F.lit(2.0), j).cast("long")
        left = a["x"] - 2 * gone(a["x"])
        own = F.array(F.struct(a["at"].alias("start"), size.alias("size"), a["number"].alias("first")))
        more = F.when(left > 0, F.concat(a["held"], own)).otherwise(a["held"])
        return F.struct(gone(a["x"]).alias("x"), (a["at"] + left * size).alias("at"), (a["number"] + left).alias("number"), more.alias("held"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(62)), first, level, lambda a: a["held"])


def l1_buckets(df: DataFrame, time: str, *, k: int, window: float, by: Sequence[str] | str | None = None, pane: float = 86400.0) -> DataFrame:
    """``df`` with the column bucket: each row's bucket of its group's L1 histogram, 0 for the newest; rows in buckets that
    end before the window, which the newest row ends, go, and rows without a time.

    Rows are numbered from the newest by the counts of panes of ``pane`` seconds, and within a pane, so no task orders more
    than one pane of a group. Levels meet the numbered rows last, so that they are neither sorted nor shuffled with them, and
    the ends of buckets, the oldest of which holds half of a group, are an aggregate. Rows of the same time have no order
    among them."""
    if k < 1:
        raise ValueError("k is at least 1")
    by = groups.names(by)
    rows = df.where(F.col(time).isNotNull()).withColumn("t_", F.col(time).cast("timestamp").cast("double")).withColumn("pane_", F.floor(F.col("t_") / pane))
    panes = rows.groupBy(*by, "pane_").agg(F.count("*").alias("c_"), F.max("t_").alias("m_"))
    whole = Window.partitionBy(*(by or [F.lit(0)]))
    newer = F.sum("c_").over(whole.orderBy(F.desc("pane_"))) - F.col("c_")
    panes = panes.select(*by, "pane_", newer.alias("newer_"), F.sum("c_").over(whole).alias("n_"), F.max("m_").over(whole).alias("last_"))
    panes = panes.withColumn("levels_", l1_levels(F.col("n_"), k)).drop("n_")
    ranked = rows.withColumn("i_", F.row_number().over(Window.partitionBy(*by, "pane_").orderBy(F.desc("t_"))))
    met = groups.join(ranked, panes, by, ["pane_"]).withColumn("r_", F.col("newer_") + F.col("i_"))
    level = F.element_at(F.filter("levels_", lambda x: x["start"] < F.col("r_")), -1)
    made = met.withColumn("l_", level).withColumn("bucket", F.col("l_.first") + F.floor((F.col("r_") - 1 - F.col("l_.start")) / F.col("l_.size")).cast("long"))
    made = made.drop("pane_", "newer_", "levels_", "i_", "r_", "l_")
    live = made.groupBy(*by, "bucket").agg(F.max("t_").alias("end_"), F.max("last_").alias("z_")).where(F.col("end_") >= F.col("z_") - window).drop("end_", "z_")
    return groups.join(made, live, by, ["bucket"], "left_semi").drop("t_", "last_")


def exponential_histogram(df: DataFrame, group: str, time: str, *, k: int, window: float, value: str | None = None, norm: str = "l1") -> DataFrame:
    """(group, start, end, cnt, total): each group's buckets after all its rows, in seconds of time."""
    v = F.lit(1.0) if value is None else F.col(value).cast("double")
    few = df.where(F.col(time).isNotNull()).select(F.col(group), F.col(time).alias("time_"), v.alias("v_"))
    if norm == "l1":
        t = F.col("time_").cast("timestamp").cast("double")
        made = l1_buckets(few, "time_", k=k, window=window, by=group).groupBy(group, "bucket")
        return made.agg(F.min(t).alias("start"), F.max(t).alias("end"), F.count("*").alias("cnt"), F.sum("v_").alias("total")).drop("bucket")
    few = few.select(F.col(group).alias("g0_"), F.col("time_").cast("timestamp").cast("double").alias("t_"), "v_")
    return fold(few, "g0_", ["t_", "v_"], lambda: ExponentialHistogram(k, window, norm), lambda s, r: s.update(r[0], r[1]), lambda s: [tuple(b) for b in s.buckets], group, "start double, end double, cnt long, total double")


def interval(buckets: DataFrame, start: float, end: float) -> DataFrame:
    """The rows of (..., start, end) whose bucket belongs to the interval: it touches it, and, where the interval starts
    inside, its larger part does."""
    inside = (F.col("end") >= start) & (F.col("start") <= end)
    return buckets.where(inside & ((F.col("start") >= start) | (F.lit(start) - F.col("start") <= F.col("end") - F.lit(start))))
