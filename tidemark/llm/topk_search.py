"""Exact top-k inner-product search by a three-phase uniform threshold.

A score is the sum of ``LISTS`` partial scores, one for each range of dimensions. Phase one gathers local score lists: for
every query, each block of candidates gives the rows that lead one of its lists (blocks take the lists in turn, so a fourth
of the products is made), with their whole scores; the k-th best of all of them is a cutoff that no final answer lies below.
Phase two: the cutoffs go to all partitions, which make the lists one after another. An entry is collected while it
suffices: some list of it has, or by the lengths of the vectors still can have, the cutoff over the number of lists, and what
is known of its score and the most that the remaining lists can add reach the cutoff. Phase three: where few entries are
left, only their remaining scores are resolved, and those at the cutoff or above, at most k a partition and query, are merged.

Queries go out in scans of up to ``SCAN_BYTES`` of vectors, each two passes over the candidates, and within a scan in blocks
of ``QUERIES``; so what is broadcast is bounded, whatever the tables' size. A vector component x counts as floor(1024 x).
Vectors that are null or hold a null or non-finite component take no part; shorter vectors count as padded with zeros. A
query id that occurs more than once is asked once, with its smallest vector; candidates that share the query's id are its
own. Null query ids ask nothing; candidates with a null id take no part. Repeated candidate ids are rows of their own. Scores
are exact as 64-bit integers. Equal scores rank by the smaller id. Empty tables give no rows. Columns besides the two named
don't matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, table

LISTS, QUERIES = 4, 2048
#: Bytes of query vectors that one scan of the candidates serves.
SCAN_BYTES = 32 << 20
#: Share of entries up to which remaining scores are resolved one by one and not as a product of matrices.
FEW = 0.05
#: Scores held at once, queries times candidates.
CELLS = 1 << 21


def quantized(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """id_ and v_ (array<long>) of the vectors that take part."""
    x = F.col(vector).cast("array<double>")
    fine = x.isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    return vectors.where(fine & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id_"), F.transform(x, lambda e: F.floor(F.lit(1024.0) * e).cast("long")).alias("v_"))


def _matrix(vectors: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of one width, padded with zeros; longer rows are cut to ``width``, beyond which the queries are zero."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    size = np.asarray(vectors.value_lengths(), dtype=np.int64)
    width = int(size.max(initial=0)) if width is None else width
    if len(size) and (size == width).all():
        return flat.reshape(len(size), width)
    out = np.zeros((len(size), width), dtype=np.int64)
    row = np.repeat(np.arange(len(size)), size)
    col = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    out[row[col < width], col[col < width]] = flat[col < width]
    return out


class _Scores:
    """Exact partial scores of a block of queries and one of candidates, list by list."""

    def __init__(self, q: np.ndarray, c: np.ndarray):
        self.cuts = np.linspace(0, q.shape[1], LISTS + 1).astype(int)
        # doubles hold every sum exactly, and their product is fast, unless the numbers are very large
        small = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(1, q.shape[1]) < 2**53
        self.q, self.c = (q.astype(np.float64), c.astype(np.float64)) if small else (q, c)

    def part(self, j: int) -> np.ndarray:
        a, b = self.cuts[j], self.cuts[j + 1]
        return self.q[:, a:b] @ self.c[:, a:b].T

    def lengths(self) -> tuple[np.ndarray, np.ndarray]:
        """Lengths by list of the queries and of the candidates: their product is the most that a partial score can be."""
        length = lambda x: np.stack([np.sqrt((x[:, a:b].astype(np.float64) ** 2).sum(axis=1)) for a, b in zip(self.cuts, self.cuts[1:], strict=False)])
        return length(self.q), length(self.c)

    def pairs(self, i: np.ndarray, k: np.ndarray, lists: range) -> np.ndarray:
        """Scores of single pairs over the given lists, a bounded number at a time."""
        a, b = self.cuts[lists.start], self.cuts[lists.stop]
        step = max(1, CELLS // max(1, b - a))
        out = [np.einsum("ij,ij->i", self.q[i[s : s + step], a:b], self.c[k[s : s + step], a:b]) for s in range(0, len(i), step)]
        return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


LOWEST = np.iinfo(np.int64).min


def _blocks(batches: Iterator[pa.RecordBatch], queries: int, width: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    step = max(1, CELLS // max(1, min(queries, QUERIES)))
    for batch in batches:
        for a in range(0, batch.num_rows, step):
            part = batch.slice(a, step)
            yield part.column("id_").to_numpy(), _matrix(part.column("v_"), width)


class _Merged:
    """The k best (query, score, id) of each query over the blocks of a partition, ties to the smaller id."""

    def __init__(self, k: int):
        self.k = k
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = self.kept = 0

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        self.waiting.append((query, score, ids))
        self.size += len(query)
        if self.size > CELLS + self.kept:
            self.compact()

    def compact(self) -> None:
        query, score, ids = (np.concatenate(x) for x in zip(*self.waiting, strict=True))
        order = np.lexsort((ids, ~score, query))  # the complement turns the order round without overflow
        query = query[order]
        starts = np.flatnonzero(np.diff(query, prepend=-1))
        place = np.arange(len(query)) - np.repeat(starts, np.diff(np.append(starts, len(query))))
        keep = place < self.k
        order = order[keep]
        self.waiting = [(query[keep], score[order], ids[order])]
        self.size = self.kept = len(order)

    def out(self, query_ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not self.waiting:
            return
        self.compact()
        query, score, ids = self.waiting[0]
        for a in range(0, len(query), 1 << 16):
            b = a + (1 << 16)
            yield pa.RecordBatch.from_arrays([pa.array(query_ids[query[a:b]]), pa.array(ids[a:b]), pa.array(score[a:b])], names=["query_id", "id", "score"])


KIND = "query_id long, id long, score long"


def _leaders(batches: Iterator[pa.RecordBatch], query_ids: np.ndarray, q: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """Phase one: whole scores of the rows that lead a list of their block."""
    best = _Merged(k)
    for turn, (ids, c) in enumerate(_blocks(batches, len(q), q.shape[1])):
        n = min(k + 1, len(ids))  # one more, for the query's own row
        for first in range(0, len(q), QUERIES):
            scores = _Scores(q[first : first + QUERIES], c)
            part = scores.part(turn % LISTS)
            j = np.argpartition(part, len(ids) - n, axis=1)[:, len(ids) - n :].ravel()
            i = np.repeat(np.arange(len(part)), n)
            other = ids[j] != query_ids[first + i]
            i, j = i[other], j[other]
            best.add(first + i, scores.pairs(i, j, range(LISTS)), ids[j])
    yield from best.out(query_ids)


def _resolved(batches: Iterator[pa.RecordBatch], query_ids: np.ndarray, q: np.ndarray, cutoff: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """Phases two and three: entries that the cutoff lets through, scores resolved."""
    best = _Merged(k)
    for ids, c in _blocks(batches, len(q), q.shape[1]):
        for first in range(0, len(q), QUERIES):
            i, j, score = _sufficient(_Scores(q[first : first + QUERIES], c), cutoff[first : first + QUERIES])
            use = (score >= cutoff[first + i]) & (ids[j] != query_ids[first + i])
            best.add(first + i[use], score[use], ids[j[use]])
    yield from best.out(query_ids)


def _sufficient(scores: _Scores, cutoff: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Queries, candidates and whole scores of the entries that may reach the cutoff; none that does is left out."""
    need = np.where(cutoff == LOWEST, -np.inf, cutoff.astype(np.float64))[:, None]
    spare = np.where(np.isfinite(need), 1e-9 * np.abs(need), 0.0) + 1e-6  # for what doubles round
    need, share = need - spare, np.ceil(need / LISTS) - spare  # an answer has a list with at least the share
    lq, lc = scores.lengths()
    total = scores.part(0)
    sent = total >= share
    for done in range(1, LISTS + 1):
        alive = total + (lq[done:].T @ lc[done:]) * (1 + 1e-9) >= need
        if done < LISTS:
            alive &= sent | (lq[done:].max(axis=0)[:, None] * (lc[done:].max(axis=0) * (1 + 1e-9))[None] >= share)
        else:
            alive &= sent
        if done == LISTS or alive.mean() <= FEW:
            break
        part = scores.part(done)
        total, sent = total + part, sent | (part >= share)
    i, j = np.nonzero(alive)
    known = total[i, j].astype(np.int64)
    return i, j, known + scores.pairs(i, j, range(done, LISTS)) if done < LISTS else known


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), the candidate's id as ``key`` and score: each query's k best rows of ``vectors``."""
    spark = vectors.sparkSession
    scratch = Scratch(spark)
    given = quantized(vectors, key, vector)
    asked = scratch.save(quantized(queries, key, vector).groupBy("id_").agg(F.min("v_").alias("v_")))
    n, width = asked.agg(F.count("*"), F.coalesce(F.max(F.size("v_")), F.lit(0))).first()
    scans = max(1, -(-n * 8 * max(1, width) // SCAN_BYTES))
    out: DataFrame | None = None
    for b in range(scans):
        # about as many each, whatever ids there are
        rows = asked.where(F.pmod(F.xxhash64("id_"), F.lit(scans)) == b).orderBy("id_").toArrow()
        if not rows.num_rows:
            continue
        q, query_ids = _matrix(rows.column("v_")), rows.column("id_").to_numpy()
        led = given.mapInArrow(lambda it, q=q, query_ids=query_ids: _leaders(it, query_ids, q, k), KIND)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
        last = led.withColumn("r", F.row_number().over(order)).where(F.col("r") == k)
        held = {r.query_id: r.score for r in last.select("query_id", "score").collect()}  # a row a query of the scan
        cutoff = np.array([held.get(x, LOWEST) for x in query_ids.tolist()], dtype=np.int64)
        found = given.mapInArrow(lambda it, q=q, query_ids=query_ids, cutoff=cutoff: _resolved(it, query_ids, q, cutoff, k), KIND)
        top = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(key), "score")
        top = scratch.save(top) if scans > 1 else top
        out = top if out is None else out.unionByName(top)
    return out if out is not None else spark.createDataFrame([], f"query_id long, rank int, {key} long, score long")


def is_query(key: str = "vec_id") -> Column:
    return F.col(key) % 100 == 0


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best rows for every vector whose id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(is_query()))


SQL = """
WITH given AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM given q JOIN given c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
