"""Documents to tokens: toxic documents, near duplicates and benchmark passages go, secrets are masked, the rest is encoded.

Every stage but the last returns the columns of documents: doc_id, text, lang, source and n_chars. Other columns of the
input, whatever their names, are left out by the first stage. The second stage numbers the rows, so rows that share an id
or have none are compared like any others.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import decontamination, near_duplicates, secrets, sentencepiece_codec, toxicity
from tidemark.llm.common import Scratch, if_few, per_text, table
from tidemark.sources.scratch import passing

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below one half; null and empty texts stay."""
    docs = docs.select(*COLUMNS)
    model = toxicity.learn(docs, toxicity.training_rows(table(spark, sf_dir, "labels")))
    return toxicity.toxicity_scores(docs, model, score="score_").where("score_ < 0.5").drop("score_")


def duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of near duplicates on 5-word shingles, that with the smallest id; null ids come last."""
    scratch = Scratch(spark)
    # written, since numbers may differ when rows are computed again
    rows = scratch.save(docs.select(*COLUMNS).withColumn("row_", F.monotonically_increasing_id()))
    made = near_duplicates.near_duplicates(rows, k=5, percent=80, key="row_").select(F.col("id_").alias("row_"), "component_id")
    made = scratch.save(made.join(rows.select("row_", "doc_id"), "row_"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_"))
    kept = made.groupBy("component_id").agg(first.alias("first")).select(F.col("first.row_").alias("row_"))
    gone = scratch.save(made.select("row_").join(kept, "row_", "left_anti").select(F.col("row_").alias("gone_")))
    scratch.drop(made)
    return rows.join(if_few(gone), rows.row_ == gone.gone_, "left_anti").select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.without_benchmark(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def masked(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by the kind in brackets; n_chars follows where a text changed."""
    mask = per_text(secrets.redact, T.StringType(), pa.string(), "secrets")
    made = docs.select(*COLUMNS).withColumn("new_", mask(F.col("text")))
    size = F.when(F.col("new_") != F.col("text"), F.length("new_").cast("long")).otherwise(F.col("n_chars")).alias("n_chars")
    return made.select("doc_id", F.col("new_").alias("text"), "lang", "source", size)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the ids, their number, and whether the ids read back as the text."""
    made = sentencepiece_codec.encode_texts(docs, sentencepiece_codec.default_model(), keys=("doc_id", "lang", "source", "text"))
    return made.select("doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("reads_back"))


STAGES = [("toxicity", toxic), ("near duplicates", duplicates), ("benchmark", benchmark), ("secrets", masked), ("encoding", encoded)]
#: MinHash, Aho-Corasick and BPE merges have no SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    scratch = Scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        if k == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        with passing():  # the next stage reads what is written here, and nothing of what was made on the way
            made = scratch.save(stage(spark, docs, sf_dir))
        scratch.drop(docs)
        docs = made
    return docs
