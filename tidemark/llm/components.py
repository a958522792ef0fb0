"""Connected components over edge tables, by alternating large and small stars.

Nothing but counts reaches the driver. A node's edges are dealt to SALTS parts, so that a node with very many edges is
spread over as many tasks, both where its least neighbour is found and where that is told to all of its edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch


SALTS = 64


def _told(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with ``m``, the least v of their u; no task meets more than a part of a node's edges."""
    dealt = edges.withColumn("salt", F.pmod(F.hash("v"), F.lit(SALTS)))
    part = dealt.groupBy("u", "salt").agg(F.min("v").alias("p"))
    least = part.groupBy("u").agg(F.min("p").alias("m"))
    return dealt.join(part.select("u", "salt").join(least, "u"), ["u", "salt"])


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _told(both).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    """Repeated edges are left to the caller."""
    edge = lambda u: F.struct(F.col(u).alias("u"), F.col("m").alias("v"))
    made = F.when(F.col("v") != F.col("m"), F.array(edge("u"), edge("v"))).otherwise(F.array(edge("u")))
    return _told(e).select(F.explode(made).alias("e")).select("e.*")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, comp) of every node that isn't its component's smallest; ``edges`` has long columns u and v.

    Loops and repeated edges do no harm; an edge with a null end is dropped.
    """
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = scratch.save(e)
    seen = None
    while True:
        r = e.agg(F.count("*").alias("n"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40))).alias("s")).first()
        if not r.n or (r.n, r.s) == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("comp"))
        seen = (r.n, r.s)
        new = scratch.save(_small_star(_large_star(e)).distinct())
        scratch.drop(e)
        e = new
