"""Language identification by rank-order profiles.

A language's profile is its ``PROFILE`` most frequent letter n-grams (one to three letters, words padded with one blank),
by rank. A text's own n-grams are ranked the same way, and the language with the least out-of-place distance (the sum of
rank differences, ``PROFILE`` for n-grams that the profile lacks) is its language; ties go to the smaller name. The score
is one less the distance over its largest value.

Profiles are learned from a bounded sample: ``SAMPLE`` labelled texts a language in expectation, chosen by a hash of the
id, each distinct text once. Where a column has more than ``LANGUAGES`` of them, the most frequent ones have profiles, ties
by name; texts marked as another get one of these, like any text. Rows with a null language or text teach nothing. Texts that
are null or have no letters get ``und`` and the score 0, as does everything when there is nothing to learn from. Very long
texts are counted in blocks, wholly. Repeated rows are rows of their own, empty tables give no rows, and columns that aren't
asked for don't matter, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import Scratch, bounded_batches, crc32_of_id, slices, table

PROFILE, SAMPLE, LANGUAGES, SIZES = 300, 400, 1000, (1, 2, 3)
BLOCK = 1 << 20
LETTERS = re.compile(r"[^\W\d_]+")
NONE = "und"


def ngram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the text's n-grams (16 bits a letter, letters beyond folded in) and their counts."""
    codes, counts = [], []
    words = LETTERS.finditer(text.lower())
    block: list[str] = []
    held = 0

    def close() -> None:
        a = np.frombuffer(f" {' '.join(block)} ".encode("utf-32-le", "replace"), dtype=np.uint32)
        a = ((a & 0xFFFF) ^ (a >> 16)).astype(np.uint64)
        blank = a == 32
        made = []
        code = np.zeros(len(a), dtype=np.uint64)
        inner = np.zeros(len(a), dtype=bool)  # a blank inside
        for k in range(max(SIZES)):
            if k:
                inner = inner[:-1] | blank[k - 1 : -1] if k > 1 else inner[:-1]
                code = code[:-1]
            code = (code << np.uint64(16)) | a[k:]
            if not len(code):
                break
            if k + 1 in SIZES:
                use = ~inner
                if k == 0:
                    use = use & ~blank
                elif k == 1:
                    use = use & ~(blank[:-1] & blank[1:])
                made.append(code[use])
        u, n = np.unique(np.concatenate(made), return_counts=True)
        codes.append(u)
        counts.append(n)
        block.clear()

    for m in words:
        block.append(m[0])
        held += len(m[0]) + 1
        if held > BLOCK:
            close()
            held = 0
    if block:
        close()
    if not codes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(codes) == 1:
        return codes[0], counts[0]
    u, at = np.unique(np.concatenate(codes), return_inverse=True)
    return u, np.bincount(at, weights=np.concatenate(counts)).astype(np.int64)


def most_frequent(codes: np.ndarray, counts: np.ndarray, k: int = PROFILE) -> np.ndarray:
    """The k most frequent codes by rank, ties by code."""
    if len(codes) > k:
        least = np.partition(counts, len(counts) - k)[len(counts) - k]
        sure = counts > least
        tied = np.flatnonzero(counts == least)[: k - int(sure.sum())]  # codes are sorted
        keep = np.sort(np.concatenate([np.flatnonzero(sure), tied]))
        codes, counts = codes[keep], counts[keep]
    return codes[np.lexsort((codes, -counts))]


class Profiles:
    """Ranked n-grams by language, laid out for lookups of many n-grams at once."""

    def __init__(self, ranked: dict[str, list[int]]):
        self.names = sorted(k for k, v in ranked.items() if v)
        held = [np.array(ranked[k], dtype=np.uint64) for k in self.names]
        self.codes = np.unique(np.concatenate(held)) if held else np.zeros(0, np.uint64)
        #: Rank of each code in each language; -1: not in it.
        self.rank = np.full((len(self.names), len(self.codes)), -1, dtype=np.int64)
        for i, codes in enumerate(held):
            self.rank[i, np.searchsorted(self.codes, codes)] = np.arange(len(codes))

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.names:
            return NONE, 0.0
        own = most_frequent(*ngram_counts(text))
        if not len(own):
            return NONE, 0.0
        at = np.minimum(np.searchsorted(self.codes, own), len(self.codes) - 1)
        rank = np.where(self.codes[at] == own, self.rank[:, at], -1)
        distance = np.where(rank >= 0, np.minimum(np.abs(rank - np.arange(len(own))), PROFILE), PROFILE).sum(axis=1)
        best = int(np.argmin(distance))
        return self.names[best], 1 - float(distance[best]) / (PROFILE * len(own))


def learn_profiles(docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Profiles:
    """Profiles of the languages of ``docs``."""
    scratch = Scratch(docs.sparkSession)
    rows = docs.select(F.col(key).alias("key_"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where("text is not null and lang is not null")
    # a row a language, a bounded number
    there = scratch.save(rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES))
    chosen = rows.join(F.broadcast(there), "lang").where(F.pmod(F.xxhash64("key_"), F.lit(1_000_000)) * F.col("n") < SAMPLE * 1_000_000)
    some = scratch.save(chosen.select("text", "lang").distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                held: dict[str, list] = {}
                for t, name in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                    held.setdefault(name, []).append(ngram_counts(t))
                for name, got in held.items():
                    u, at = np.unique(np.concatenate([c for c, _ in got]), return_inverse=True)
                    n = np.bincount(at, weights=np.concatenate([n for _, n in got]), minlength=len(u)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(u)), pa.array(u.view(np.int64)), pa.array(n)], names=["lang", "code", "n"])

    counts = some.mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    # codes compare as unsigned
    order = Window.partitionBy("lang").orderBy(F.desc("n"), F.expr("code < 0"), "code")
    top = counts.withColumn("r", F.row_number().over(order)).where(F.col("r") <= PROFILE)
    ranked: dict[str, list[int]] = {}
    for r in sorted(top.select("lang", "code", "r").collect(), key=lambda r: (r.lang, r.r)):
        ranked.setdefault(r.lang, []).append(r.code % (1 << 64))
    scratch.drop(some, there)
    return Profiles(ranked)


def identify(docs: DataFrame, profiles: Profiles, *, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The key columns, lang_pred and score of every row of ``docs``."""
    bounded_batches(docs.sparkSession)
    few = docs.select(*keys, F.col(text).cast("string").alias("text_"))
    kind = T.StructType([*few.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text_"):
                made = [profiles.predict(t) for t in batch.column("text_").to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([a for a, _ in made], type=pa.string()), pa.array([b for _, b in made], type=pa.float64())], names=kind.names)

    return few.mapInArrow(run, kind)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language, learned from two thirds of the documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    third = crc32_of_id("doc_id") % 3
    profiles = learn_profiles(docs.where(third != 1))
    return identify(docs, profiles).select("doc_id", (third == 1).alias("held_out"), "lang_pred", "score")
