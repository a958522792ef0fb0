"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding lower-cases, replaces look-alike letters of other scripts and digits or signs that stand for letters, and turns
everything else into single spaces. Lexicon entries are whole words or beginnings of words with a weight; a hit inside an
exception phrase doesn't count. A text's score is a logistic function of its summed weights, as they are and relative to
the number of its words.

The lexicon is learned from labelled rows: of the words and word beginnings (3 to 8 letters) in toxic texts, those whose
log-likelihood ratio against the clean texts is beyond chance. Their weight is the log odds. Exception phrases are pairs of
words around a hit that clean texts repeat and toxic ones don't. Learning takes a bounded sample, ``MOST_TOXIC`` and
``MOST_CLEAN`` rows in expectation, chosen by a hash of the id; classes are weighed back to their true shares.

Rows without a label or with a null one teach nothing; a document with several labels counts as toxic from a mean of one
half. Rows of documents that share a labelled id, and repeated rows, teach as often as they occur. Null and empty texts have
no hits and get the score of such texts. Without labels, or without documents, every score is 0. Texts of any length are
folded and matched whole. A column that has the name asked for the score is replaced; others stay.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import Scratch, bounded_batches, crc32_of_id, per_text, slices, table, take_turn

MOST_TOXIC, MOST_CLEAN = 3000, 6000
#: Least log-likelihood ratio of an entry, and least share of toxic texts among those that have it.
LEAST_RATIO, LEAST_PRECISION = 30.0, 0.7
#: Least number of toxic texts that hold an entry.
LEAST_TEXTS = 3
STEMS = range(3, 9)

_LIKE = "аaеeоoрpсcхxуyіiјjѕsԁdһhкkмmтtвbнhαaεeοoρpνvιiκkτtυuχxωwΑaΒbΕeΖzΗhΙiΚkΜmΝnΟoΡpΤtΥyΧxАaВbЕeКkМmНhОoРpСcТtХxІiЅsЈjɑaɡgıiⅼlո" + "n"
FOLD = {ord(_LIKE[i]): _LIKE[i + 1] for i in range(0, len(_LIKE) - 1, 2)} | {ord(a): b for a, b in zip("013457", "oieast", strict=True)} | {ord(c): None for c in "​‌‍⁠﻿­"} | {0xFF21 + i: chr(97 + i) for i in range(26)} | {0xFF41 + i: chr(97 + i) for i in range(26)}
SIGNS = re.compile(r"(?<=[^\W\d_])[$@!](?=[^\W\d_])")
OTHER = re.compile(r"[\W\d_]+")


def fold(text: str | None) -> str:
    """Folded words between single spaces, one at either end; a single space if there are none."""
    if not text:
        return " "
    text = text.lower().translate(FOLD)
    if "$" in text or "@" in text or "!" in text:
        text = SIGNS.sub(lambda m: {"$": "s", "@": "a", "!": "i"}[m[0]], text)
    return f" {OTHER.sub(' ', text).strip()} ".replace("  ", " ")


def terms_of(folded: str) -> set[str]:
    """Whole words as `` word `` and word beginnings as `` begin``."""
    out: set[str] = set()
    for w in set(folded.split()):
        if len(w) >= STEMS.start:
            out.add(f" {w} ")
            out.update(f" {w[:k]}" for k in STEMS if k <= len(w))
    return out


@dataclass
class ToxicityModel:
    lexicon: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()
    #: Intercept, and weights of the summed and the relative weights.
    logistic: tuple[float, float, float] | None = None

    def __post_init__(self) -> None:
        self._automaton = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_automaton": None}

    def hits(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of the entries; a word counts once, by the longest entry."""
        if not self.lexicon:
            return []
        if self._automaton is None:
            a = ahocorasick.Automaton()
            for t, w in self.lexicon.items():
                a.add_word(t, (len(t), w))
            for t in self.exceptions - self.lexicon.keys():
                a.add_word(t, (len(t), None))
            a.make_automaton()
            self._automaton = a
        found: dict[int, tuple[int, int, float]] = {}
        spared: list[tuple[int, int]] = []
        for end, (size, weight) in self._automaton.iter(folded):
            start = end + 1 - size
            if weight is None:
                spared.append((start, end + 1))
            elif start not in found or found[start][1] <= end:
                found[start] = (start, end + 1, weight)
        return [h for h in found.values() if not any(a <= h[0] and h[1] <= b for a, b in spared)]

    def features(self, text: str | None) -> tuple[float, float]:
        folded = fold(text)
        total = sum(w for _, _, w in self.hits(folded))
        return math.log1p(total), math.log1p(100 * total / max(1, folded.count(" ") - 1))

    def score(self, text: str | None) -> float:
        if self.logistic is None:
            return 0.0
        a, b, c = self.logistic
        x, y = self.features(text)
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, a + b * x + c * y))))


def choose_terms(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int) -> dict[str, float]:
    """Entries and weights from the numbers of texts that hold each candidate."""

    def part(k: float, n: float) -> float:
        return k * math.log(n) if k else 0.0

    rated = []
    base = n_toxic / max(1, n_toxic + n_clean)
    for t, a in toxic.items():
        b = clean.get(t, 0)
        p, q = a / n_toxic, b / max(1, n_clean)
        if p <= q or a / n_toxic < LEAST_PRECISION / (1 - LEAST_PRECISION) * (b / max(1, n_clean)):
            continue
        both = (a + b) / (n_toxic + n_clean)
        ratio = 2 * (part(a, p / both) + part(n_toxic - a, (1 - p) / (1 - both) if a < n_toxic else 1) + part(b, q / both if b else 1) + part(n_clean - b, (1 - q) / (1 - both) if b < n_clean else 1))
        if ratio >= LEAST_RATIO and a * (1 - base) >= LEAST_PRECISION * (a * (1 - base) + b * base):
            rated.append((ratio, len(t), t, math.log((a + 0.5) / (n_toxic + 1)) - math.log((b + 0.5) / (n_clean + 1))))
    chosen: dict[str, float] = {}
    begun: set[str] = set()  # every beginning of a chosen entry
    for _, _, t, w in sorted(rated, key=lambda r: (-round(r[0], 6), -r[1], r[2])):
        if t in begun or any(t[:k] in chosen for k in range(2, len(t))):
            continue
        chosen[t] = w
        begun.update(t[:k] for k in range(2, len(t)))
    return chosen


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    """Ridge logistic regression by Newton's method; the two slopes are kept at 0 or above."""
    use = [0, 1, 2]
    full = np.column_stack([np.ones(len(x)), x])
    while True:
        a, b = full[:, use], np.zeros(len(use))
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
            ridge = np.array([1e-6, 0.02, 0.02])[use]
            grad = a.T @ (weight * (p - y)) + ridge * b
            step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(ridge + 1e-9), grad)
            b = b - np.clip(step, -4, 4)
            if np.abs(step).max() < 1e-7:
                break
        low = [k for k, v in zip(use, b, strict=True) if k and v < 0]
        if not low:
            out = np.zeros(3)
            out[use] = b
            return tuple(map(float, out))
        use = [k for k in use if k not in low]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    take_turn("toxicity")
    counts: dict[bool, Counter] = {True: Counter(), False: Counter()}

    def out() -> Iterator[pa.RecordBatch]:
        for y, n in counts.items():
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(list(n)), pa.array([y] * len(n)), pa.array(list(n.values()), type=pa.int64())], names=["term", "toxic", "n"])
                n.clear()

    for whole in batches:
        for batch in slices(whole, "text"):
            for t, y in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                counts[y].update(terms_of(fold(t)))
                if sum(map(len, counts.values())) > 200_000:
                    yield from out()
    yield from out()


def _texts(toxic: bool) -> Column:
    """The number of toxic or clean texts, from rows of toxic and n."""
    return F.coalesce(F.sum(F.when(F.col("toxic") == toxic, F.col("n"))), F.lit(0)).cast("long")


def candidates(held: DataFrame, n_toxic: int, n_clean: int) -> DataFrame:
    """term, a, b: terms with the numbers of toxic and clean texts that hold them, where their log-likelihood ratio suffices."""

    def part(x: Column) -> Column:
        return F.when(x > 0, x * F.log(x)).otherwise(0.0)

    a, b, c, d = F.col("a").cast("double"), F.col("b").cast("double"), F.lit(float(n_toxic)), F.lit(float(n_clean))
    ratio = 2 * (part(a) + part(c - a) + part(b) + part(d - b) + part(c + d) - part(c) - part(d) - part(a + b) - part(c + d - a - b))
    made = held.select("text", "toxic").mapInArrow(_counted, "term string, toxic boolean, n long").groupBy("term").agg(_texts(True).alias("a"), _texts(False).alias("b"))
    # choose_terms computes the ratio again; what rounding may change is left to it
    return made.where((F.col("a") >= LEAST_TEXTS) & (a * d > b * c) & (ratio >= LEAST_RATIO - 1e-3))


def learn(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic") -> ToxicityModel:
    """The model of the given labelled rows."""
    scratch = Scratch(docs.sparkSession)
    marks = labels.select(F.col(key).alias("key_"), F.col(label).cast("double").alias("mark")).where("key_ is not null and mark is not null")
    marks = marks.groupBy("key_").agg((F.avg("mark") >= 0.5).alias("toxic"))
    there = {r.toxic: r.n for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not there.get(True) or not there.get(False):
        return ToxicityModel()
    share = F.when(F.col("toxic"), MOST_TOXIC / there[True]).otherwise(MOST_CLEAN / there[False])
    # bounded by the two parameters, a few tens of bytes a row
    some = marks.where(F.pmod(F.xxhash64("key_"), F.lit(1_000_000)) < share * 1_000_000)
    held = scratch.save(docs.select(F.col(key).alias("key_"), F.col(text).cast("string").alias("text")).join(F.broadcast(some), "key_").select("text", "toxic"))
    n = {r.toxic: r.n for r in held.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not n.get(True) or not n.get(False):
        return ToxicityModel()

    rows = list(candidates(held, n[True], n[False]).toLocalIterator())
    model = ToxicityModel(choose_terms({r.term: r.a for r in rows}, {r.term: r.b for r in rows}, n[True], n[False]))
    model.exceptions = _exceptions(held, model)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [model.features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in made], type=pa.float64()), pa.array([b for _, b in made], type=pa.float64()), batch.column("toxic")], names=["a", "b", "toxic"])

    got = held.mapInArrow(features, "a double, b double, toxic boolean").collect()  # bounded by the two parameters
    got.sort(key=lambda r: (r.toxic, r.a, r.b))  # so that sums don't depend on partitions
    y = np.array([r.toxic for r in got], dtype=float)
    weight = np.where(y == 1, there[True] / n[True], there[False] / n[False]) * len(y) / (there[True] + there[False])
    model.logistic = fit_logistic(np.array([(r.a, r.b) for r in got]), y, weight)
    scratch.drop(held)
    return model


def _exceptions(held: DataFrame, model: ToxicityModel) -> frozenset[str]:
    """Pairs of words around hits that at least five clean texts hold, and toxic ones hardly."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for batch in batches:
            for t, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
                folded, got = fold(t), set()
                for a, _, _ in model.hits(folded):
                    end = folded.index(" ", a + 1)
                    if (after := folded.find(" ", end + 1)) > 0:
                        got.add(folded[a : after + 1])
                    if (before := folded.rfind(" ", 0, a)) >= 0:
                        got.add(folded[before : end + 1])
                n.update((p, toxic) for p in got)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in n]), pa.array([y for _, y in n]), pa.array(list(n.values()), type=pa.int64())], names=["phrase", "toxic", "n"])

    made = held.mapInArrow(run, "phrase string, toxic boolean, n long").groupBy("phrase").agg(_texts(False).alias("clean"), _texts(True).alias("bad"))
    return frozenset(r.phrase for r in made.where("clean >= 5 and bad * 20 <= clean").collect())


def toxicity_scores(docs: DataFrame, model: ToxicityModel, *, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with a column ``score``."""
    bounded_batches(docs.sparkSession)
    return docs.withColumn(score, per_text(model.score, T.DoubleType(), pa.float64(), "toxicity")(F.col(text)))


def training_rows(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """Labels that may be learned from: those whose crc32 of the id isn't a multiple of 5."""
    return labels.where(crc32_of_id(key) % 5 != 0)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, training_rows(table(spark, sf_dir, "labels")))
    made = toxicity_scores(docs, model)
    return made.select("doc_id", (crc32_of_id("doc_id") % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
