"""Reading tables and streams, and keeping sketches as Parquet with their configuration beside every row group."""

from __future__ import annotations

import json
from dataclasses import asdict
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.matrix import MatrixConfig
from tidemark.operators.universal import UnivConfig

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stream(spark: SparkSession, path: str, schema=None, *, files_a_trigger: int = 100) -> DataFrame:
    """A stream of the Parquet files of a folder."""
    schema = schema if schema is not None else spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def save_sketch(sketch: DataFrame, config: Any, path: str, *, mode: str = "errorifexists") -> None:
    """Writes the rows with the configuration as a column, which dictionary encoding makes nearly free. A configuration is
    that of a matrix, of a layered sketch or a dictionary (say, of an HLL's precision or a DDSketch's alpha)."""
    sketch.withColumn("config", F.lit(_told(config))).write.mode(mode).parquet(path)


def load_sketch(spark: SparkSession, path: str, config: Any = None) -> tuple[DataFrame, Any]:
    """The sketch and its configuration; raises if files of several configurations, or of another than asked, are there."""
    df = spark.read.parquet(path)
    held = [r.config for r in df.select("config").distinct().limit(2).collect()]
    if len(held) > 1:
        raise ValueError("sketches of several configurations share the path")
    if held and config is not None and held[0] != _told(config):
        raise ValueError(f"the sketch has {held[0]}, not {config}")
    return df.drop("config"), _read(held[0]) if held else config


CONFIGS = {c.__name__: c for c in (MatrixConfig, UnivConfig)}


def _told(config: Any) -> str:
    kind = type(config).__name__
    return json.dumps({"kind": kind, "is": asdict(config) if kind in CONFIGS else dict(config)}, sort_keys=True)


def _read(told: str) -> Any:
    held = json.loads(told)
    return CONFIGS.get(held["kind"], dict)(**held["is"])
