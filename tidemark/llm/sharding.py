"""Contiguous shards of equal bytes by global prefix sums.

The rows, reduced to an id and a size, are ranged over partitions by id and written with each partition's own running sums.
Each partition gives one total; the running sum of these totals (one row a partition, the only thing the driver holds)
turns a partition's own sums into global ones, and a row goes to the shard in whose equal target its middle byte lies. What
is returned are columns of the written rows, so it doesn't matter how they are read, joined or coalesced afterwards.

Null texts count no bytes, so each row has a size of at least 1. Rows are ordered by id, nulls first, then by size and
checksum; rows equal in all of these are interchangeable. Repeated ids are rows of their own. An empty table gives no
rows. A row larger than a target can leave a neighbouring shard empty. Columns of ``docs`` besides the two named don't
matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import Scratch, table

LAW = "bytes"


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the running sums of a partition: the bytes up to a row's end, and the rows before it."""
    at = row = 0
    for batch in batches:
        end = at + np.cumsum(batch.column("size").to_numpy(zero_copy_only=False).astype(np.int64))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(end), pa.array(row + np.arange(len(end), dtype=np.int64))], names=[*batch.schema.names, "end_", "row_"])
        if len(end):
            at, row = int(end[-1]), row + len(end)


def byte_shards(docs: DataFrame, shards: int = 16, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, size, text_crc32, shard and slot (the row's place in its shard) of every row of ``docs``."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    body = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    few = docs.select(F.col(key).alias("key_"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    # a salt spreads rows that share an id
    few = few.withColumn("salt_", F.monotonically_increasing_id() % 64)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("key_").asc_nulls_first(), "size", "text_crc32"]
    ranged = few.repartitionByRange(n, *order, "salt_").sortWithinPartitions(*order).drop("salt_").withColumn("part_", F.spark_partition_id())
    held = scratch.save(ranged.mapInArrow(_running, T.StructType([*ranged.schema.fields, T.StructField("end_", T.LongType()), T.StructField("row_", T.LongType())])))
    starts, at, row = [], 0, 0
    for r in held.groupBy("part_").agg(F.max("end_").alias("bytes"), F.count("*").alias("rows")).orderBy("part_").collect():
        starts.append((r.part_, at, row))
        at, row = at + r.bytes, row + r.rows
    # a row a partition
    placed = held.join(F.broadcast(spark.createDataFrame(starts, "part_ int, bytes_ long, rows_ long")), "part_")
    # the middle of the row, in halves of a byte; decimals where the product has no room in 64 bits
    kind = "decimal(38,0)" if 2 * shards * max(at, 1) >= 1 << 63 else "bigint"
    shard = F.expr(f"least((cast({shards} as {kind}) * cast(2 * (bytes_ + end_) - size as {kind})) div cast({2 * max(at, 1)} as {kind}), {shards - 1})").cast("int")
    dealt = placed.select("key_", "size", "text_crc32", shard.alias("shard"), (F.col("rows_") + F.col("row_")).alias("row_"))
    # shards are contiguous, so one number for each shard turns a row's place into its slot
    first = {r.shard: r.first for r in dealt.groupBy("shard").agg(F.min("row_").alias("first")).collect()}
    begins = F.create_map(*[F.lit(x) for k in sorted(first) for x in (k, first[k])]) if first else F.create_map(F.lit(0), F.lit(0))
    return dealt.select(F.col("key_").alias(key), "size", "text_crc32", "shard", (F.col("row_") - begins[F.col("shard")]).cast("long").alias("slot"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of 16 and slot; sizes are near equal."""
    made = byte_shards(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
