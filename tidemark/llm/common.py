"""What the operators of this subpackage share: shared scratch tables and bounded Arrow slices."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources import scratch

#: Characters of text that one slice of an Arrow batch holds, unless a single text is longer.
SLICE_BYTES = 2 << 20
#: Bytes of an Arrow batch, unless a single row is longer.
BATCH_BYTES = 4 << 20


#: What operators remember in a worker process, and how each forgets it.
_forget: dict[str, Callable[[], None]] = {}


def remembers(name: str, forget: Callable[[], None]) -> None:
    _forget[name] = forget


def take_turn(name: str) -> None:
    """Python workers outlive a stage: what other operators remember in this one goes before ``name`` starts."""
    dropped = [f() for other, f in _forget.items() if other != name]
    if dropped:
        pa.default_memory_pool().release_unused()


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches count rows, however long; from now on they end by bytes, too, unless the session says how."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(BATCH_BYTES))


class Scratch(scratch.Scratch):
    """Intermediate tables; see ``tidemark.sources.scratch``."""

    def __init__(self, spark: SparkSession):
        bounded_batches(spark)
        super().__init__(spark)


#: Ids that a join may broadcast, some tens of megabytes; more are joined by a shuffle.
FEW_IDS = 1_000_000


def if_few(ids: DataFrame) -> DataFrame:
    """The saved one-column table of ids, marked for broadcast if it has been counted to be small."""
    return F.broadcast(ids) if ids.count() <= FEW_IDS else ids


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each piece holds about ``most`` bytes of ``column``, one row at least."""
    n = batch.num_rows
    if not n:
        return
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    part = (np.cumsum(size) - size) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), n]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(a, b - a)


def crc32_of_id(doc_id: Column | str) -> Column:
    """crc32 of the id written as text, by which rows are held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def per_text(function: Callable[[str | None], Any], kind: T.DataType, arrow: pa.DataType, name: str = "") -> Callable[[Column], Column]:
    """A column function that calls ``function`` on each text of an Arrow batch."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        take_turn(name)
        for texts in batches:
            yield pa.array([function(t) for t in texts.to_pylist()], type=arrow)

    # Spark finds the kind of an Arrow function in its annotations, which have to be the classes themselves
    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    held = F.arrow_udf(run, kind)
    return lambda column: held(column.cast("string"))
