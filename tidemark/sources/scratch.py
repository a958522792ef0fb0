"""Intermediate tables in the folder that driver and executors share.

The folder is ``spark.checkpoint.dir``. Where that is unset, a temporary one is made, which only a local master can see, so
on a cluster this raises. Tables go when their owner drops them, or at the end of the driver's process.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_live: list[Scratch] = []


def shared_dir(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
            held = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = held.get()
    return base.rstrip("/")


class Scratch:
    """Tables written to cut lineage; a lost executor costs no more than a reread."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/tidemark-{uuid.uuid4().hex}"
        self.count = 0
        _live.append(self)

    def save(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.base}/{self.count:04d}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tidemark_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        for t in tables:
            if path := getattr(t, "_tidemark_path", None):
                self._delete(path)

    def _delete(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def close(self) -> None:
        """Deletes all its tables."""
        if self in _live:
            _live.remove(self)
        if self.count:
            self._delete(self.base)


@contextlib.contextmanager
def passing() -> Iterator[None]:
    """Deletes at its end the tables of every Scratch that was made within: for work whose result has been written."""
    before = [*_live]
    yield
    for s in [x for x in _live if x not in before]:
        s.close()


@atexit.register
def clean() -> None:
    """Deletes the tables of every Scratch; results that were not written anywhere can't be read afterwards."""
    for s in [*_live]:
        with contextlib.suppress(Exception):  # the session may have ended before
            s.close()
