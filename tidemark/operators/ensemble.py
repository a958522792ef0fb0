"""Several sketches of one column in a single pass over one shared digest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import hashing
from tidemark.operators import cardinality, matrix
from tidemark.operators.matrix import MatrixConfig


class Ensemble:
    """Named matrix sketches of one shape and one HyperLogLog, all fed by the same digest."""

    def __init__(self, *, p: int = cardinality.P, **members: MatrixConfig):
        if not members:
            raise ValueError("an ensemble has members")
        shapes = {(c.rows, c.cols, c.fast, c.profile, c.salt) for c in members.values()}
        if len(shapes) != 1 or not next(iter(members.values())).fast:
            raise ValueError("members share rows, columns and the fast path of one hash profile")
        self.members, self.p = members, p

    def build(self, df: DataFrame, key: str, *, weight: str | None = None) -> DataFrame:
        """(sketch, row, col, cnt): row is -1 for the HyperLogLog, whose col is the register and cnt the rank."""
        shape = next(iter(self.members.values()))
        counts = matrix.hashed(matrix.weighted(df, key, weight), "key_", shape)
        reg, rho = cardinality.reg_rho(cardinality.of_words(F.col("h_")), self.p)
        structs = [F.struct(F.lit("hll").alias("sketch"), F.lit(-1).alias("row"), reg.cast("long").alias("col"), rho.cast("long").alias("v"))]
        for r in range(shape.rows):
            row = F.lit(r)
            for name, c in self.members.items():
                sign = hashing.fast_sign(F.col("h_"), row) if c.signed else F.lit(1)
                structs.append(F.struct(F.lit(name).alias("sketch"), row.alias("row"), hashing.fast_col(F.col("h_"), row, c.cols).alias("col"), (sign * F.col("w_")).cast("long").alias("v")))
        many = counts.select(F.explode(F.array(*structs)).alias("e_")).select("e_.*")
        return many.groupBy("sketch", "row", "col").agg(F.when(F.col("sketch") == "hll", F.max("v")).otherwise(F.sum("v")).alias("cnt"))

    def get(self, built: DataFrame, name: str) -> DataFrame:
        """One member as a sketch of its own."""
        if name == "hll":
            return built.where("sketch = 'hll'").select(F.col("col").cast("int").alias("reg"), F.col("cnt").cast("int").alias("rho"))
        if name not in self.members:
            raise ValueError(f"no member {name}")
        return built.where(F.col("sketch") == name).drop("sketch")

    def estimate(self, built: DataFrame, name: str, probes: DataFrame, key: str, *, est: str = "est") -> DataFrame:
        if name == "hll":
            raise ValueError("the HyperLogLog estimates no frequencies")
        return matrix.query(self.get(built, name), probes, key, self.members[name], est=est)

    def cardinality(self, built: DataFrame) -> DataFrame:
        return cardinality.hll_classic(self.get(built, "hll"), p=self.p)

    def __len__(self) -> int:
        return len(self.members) + 1

    def names(self) -> Sequence[str]:
        return [*self.members, "hll"]
