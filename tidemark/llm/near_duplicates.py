"""Near-duplicate documents by circulant MinHash.

A text's words (ASCII lower-cased, cut at ASCII white space) give its set of k-word shingles. One permutation scrambles
the shingles; a second one, circularly shifted by 1, 2, 3, ..., gives every coordinate of the signature. Bands of
coordinates put sets into buckets: two sets at the threshold of 0.8 share none with a probability of about one in ten
million. Sets in a bucket are compared in full; links join components.

Equal sets are one class first, whatever their number. In a bucket, the smallest member meets all others; where that links
them all, as it does in most, the bucket is done. The sets of the other buckets come together in blocks, of a bounded number
of members and of bytes, in which exact intersections of all members are a matrix product, and only edges that join them
leave the task. So no pairs are written out and no link between different sets of a bucket is lost.

Texts with fewer than k words have one shingle of them all; null texts and texts without words have the empty set and are
linked with nothing. Rows that share an id are one document. A null id is never linked: its component is null, and it is
kept. An empty table gives no rows. Texts of any length are taken whole; a task that compares holds two blocks of sets, or
two sets, if these are longer. Columns besides the two named don't matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, if_few, remembers, slices, table, take_turn
from tidemark.llm.components import components

ROWS, BANDS = 5, 40
#: Members of a bucket that are compared in one matrix product, and bytes of their sets, on an average.
BLOCK, BLOCK_BYTES = 1024, 8 << 20
REMEMBERED = 200_000
_words: dict[bytes, int] = {}
remembers("near_duplicates", _words.clear)


def _mix64(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _word(w: bytes) -> int:
    if len(_words) >= REMEMBERED:
        _words.clear()
    h = xxhash.xxh3_64_intdigest(w)
    if len(w) <= 40:
        _words[w] = h
    return h


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct k-word shingles."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.zeros(0, np.uint64)
    get = _words.get
    w = np.fromiter([get(x) or _word(x) for x in words], dtype=np.uint64, count=len(words))
    size = min(k, len(w))
    h = np.full(len(w) - size + 1, size, dtype=np.uint64)
    for j in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[j : len(w) - size + 1 + j]
    return np.unique(_mix64(h))


_SHIFT = np.arange(1, ROWS * BANDS + 1, dtype=np.uint32)[:, None]


def signature(held: np.ndarray) -> np.ndarray:
    """The least value of each shifted permutation over a set of shingles."""
    x = (held >> np.uint64(32)).astype(np.uint32)  # the first permutation: shingles are mixed already
    out = np.full(ROWS * BANDS, 0xFFFFFFFF, dtype=np.uint32)
    for a in range(0, len(x), 1024):
        h = x[None, a : a + 1024] - _SHIFT
        h ^= h >> np.uint32(16)
        h *= np.uint32(0x85EBCA6B)
        h ^= h >> np.uint32(13)
        h *= np.uint32(0xC2B2AE35)
        h ^= h >> np.uint32(16)
        np.minimum(out, h.min(axis=1), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key a band."""
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in sig.reshape(BANDS, ROWS).T:
        h = h * np.uint64(0x9E3779B97F4A7C15) + _mix64(r.astype(np.uint64) + np.uint64(1))
    return _mix64(h).view(np.int64)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))


def _signed(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    take_turn("near_duplicates")
    for whole in batches:
        for batch in slices(whole, "text_"):
            sets = [shingles(t, k) for t in batch.column("text_").to_pylist()]
            bands = [band_keys(signature(s)) if len(s) else np.zeros(0, np.int64) for s in sets]
            digest = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("id_"), pa.array([len(s) for s in sets], type=pa.int64()), pa.array(digest, type=pa.binary()), _lists(bands)], names=["id_", "n_", "digest_", "bands_"])


def _sets(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    take_turn("near_duplicates")
    for whole in batches:
        for batch in slices(whole, "text_"):
            yield pa.RecordBatch.from_arrays([batch.column("id_"), _lists([shingles(t, k) for t in batch.column("text_").to_pylist()])], names=["id_", "set_"])


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (u, v) whose full sets are similar."""
    a = sets.select(F.col("id_").alias("u"), F.col("set_").alias("su"))
    b = sets.select(F.col("id_").alias("v"), F.col("set_").alias("sv"))
    both = F.size(F.array_intersect("su", "sv"))
    near = F.least(F.size("su"), F.size("sv")) * 100 >= F.greatest(F.size("su"), F.size("sv")) * percent
    return pairs.join(a, "u").join(b, "v").where(near & (both * 100 >= (F.size("su") + F.size("sv") - both) * percent)).select("u", "v")


def _local_links(sets: list[np.ndarray], first: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """All similar pairs of a list of sets; with ``first`` above 0, those between the first sets and the others only."""
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    u, at, n = np.unique(flat, return_inverse=True, return_counts=True)
    shared = np.flatnonzero(n > 1)
    place = np.full(len(u), -1, dtype=np.int64)
    place[shared] = np.arange(len(shared))
    row, col = np.repeat(np.arange(len(sets)), size), place[at]
    row, col = row[col >= 0], col[col >= 0]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    a, b = (slice(None), slice(None)) if not first else (slice(0, first), slice(first, None))
    both = np.zeros((len(sets[a]), len(sets[b])), dtype=np.float32)
    for start in range(0, len(shared), 4096):  # whole numbers below 2^24 are exact
        lo, hi = np.searchsorted(col, [start, start + 4096])
        held = np.zeros((len(sets), min(4096, len(shared) - start)), dtype=np.float32)
        held[row[lo:hi], col[lo:hi] - start] = 1
        both += held[a] @ held[b].T
    i, j = np.nonzero(both * 100 >= percent * (size[a][:, None] + size[b][None] - both) - 1e-3)
    j = j + first
    fine = (i < j) | bool(first)
    return i[fine], j[fine]


def _spanning(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """For rows sorted by bucket and pair of blocks, edges that join what is similar there and not yet linked."""

    def edges(rep: list[int], linked: list[bool], side: list[bool], sets: list[np.ndarray]) -> list[tuple[int, int]]:
        if len(rep) < 2:
            return []
        order = sorted(range(len(rep)), key=lambda k: side[k])
        first = side.count(False) if any(side) else 0
        if any(side) and not first:
            return []
        parent = list(range(len(order)))

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        hub = None  # members that are linked to the bucket's smallest are one component already
        for k, o in enumerate(order):
            if linked[o]:
                if hub is not None:
                    parent[k] = hub
                else:
                    hub = k
        out = []
        for i, j in zip(*(x.tolist() for x in _local_links([sets[o] for o in order], first, percent)), strict=True):
            if (x := find(i)) != (y := find(j)):
                parent[x] = y
                out.append((rep[order[i]], rep[order[j]]))
        return out

    key, held = None, ([], [], [], [])
    made: list[tuple[int, int]] = []
    for batch in batches:
        flat = batch.column("set_")
        values, offsets = flat.values.to_numpy().view(np.uint64), flat.offsets.to_numpy()
        columns = [batch.column(c).to_pylist() for c in ("band", "bi", "bj", "rep", "ok", "side")]
        for r, (band, bi, bj, rep, ok, side) in enumerate(zip(*columns, strict=True)):
            if (band, bi, bj) != key:
                made += edges(*held)
                key, held = (band, bi, bj), ([], [], [], [])
            for column, value in zip(held, (rep, ok, side, values[offsets[r] : offsets[r + 1]]), strict=True):
                column.append(value)
        if made:
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in made]), pa.array([v for _, v in made])], names=["u", "v"])
            made = []
    if made := edges(*held):
        yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in made]), pa.array([v for _, v in made])], names=["u", "v"])


def _within_buckets(rest: DataFrame, linked: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges within buckets whose members aren't all linked to the smallest one.

    Such a bucket's sets meet in one task, or, beyond BLOCK members, block by block, each pair of blocks in a task; there
    all intersections are one matrix product. Only a spanning set of edges leaves the task, never pairs.
    """
    ok = linked.select(F.col("u").alias("pivot"), F.col("v").alias("rep"), F.lit(True).alias("ok"))
    members = rest.where("rep <> pivot").join(ok, ["pivot", "rep"], "left").select("band", "rep", "n_", F.coalesce("ok", F.lit(False)).alias("ok"))
    sizes = members.groupBy("band").agg(F.count("*").alias("m"), F.sum("n_").alias("n_"), F.sum(F.col("ok").cast("long")).alias("n_ok"), F.sum(F.pmod(F.xxhash64("rep", "ok"), F.lit(1 << 40))).alias("of"))
    # several bands often hold the same members
    mixed = sizes.where("m > 1 and n_ok < m").groupBy("m", "n_", "n_ok", "of").agg(F.min("band").alias("band"))
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("n_") * 8 / BLOCK_BYTES)).cast("int")
    own = F.pmod(F.hash("rep"), F.col("blocks")).cast("int")
    dealt = members.drop("n_").join(mixed.select("band", blocks.alias("blocks")), "band").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # one block's pairs within itself, and those with every other block
    dealt = dealt.select("band", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"), "rep", "ok", (F.col("own") > F.col("other")).alias("side"))
    full = dealt.join(sets.withColumnRenamed("id_", "rep"), "rep").repartition("band", "bi", "bj").sortWithinPartitions("band", "bi", "bj")
    return full.mapInArrow(lambda it: _spanning(it, percent), "u long, v long")


def near_duplicates(docs: DataFrame, *, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """id_, n_shingles and component_id of every row of ``docs``."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    few = docs.select(F.col(key).cast("long").alias("id_"), F.col(text).cast("string").alias("text_"))
    signed = scratch.save(few.mapInArrow(lambda it: _signed(it, k), "id_ long, n_ long, digest_ binary, bands_ array<long>"))
    classes = scratch.save(signed.where("digest_ is not null and id_ is not null").groupBy("digest_").agg(F.min("id_").alias("rep_")))
    first = signed.select("id_", "n_", "bands_").join(classes.select(F.col("rep_").alias("id_")), "id_", "left_semi")
    # rows that share an id may have several sets; the longest one counts for what a block holds
    buckets = first.select(F.col("id_").alias("rep"), "n_", F.explode("bands_").alias("band")).groupBy("rep", "band").agg(F.max("n_").alias("n_"))
    least = buckets.groupBy("band").agg(F.min("rep").alias("pivot"), F.count("*").alias("m")).where("m > 1").drop("m")
    rest = scratch.save(buckets.join(least, "band"))  # buckets of two or more
    pairs = scratch.save(rest.where("rep <> pivot").select(F.col("pivot").alias("u"), F.col("rep").alias("v")).distinct())
    active = scratch.save(pairs.select(F.col("u").alias("id_")).unionByName(pairs.select(F.col("v").alias("id_"))).distinct())
    sets = scratch.save(few.join(if_few(active), "id_", "left_semi").mapInArrow(lambda it: _sets(it, k), "id_ long, set_ array<long>"))
    linked = scratch.save(_linked(pairs, sets, percent))
    edges = linked.unionByName(_within_buckets(rest, linked, sets, percent))
    comps = components(edges, scratch)
    scratch.drop(rest, pairs, active, sets, linked)
    of = classes.join(comps, F.col("rep_") == F.col("node"), "left").select("digest_", F.coalesce("comp", "rep_").alias("comp_"))
    # rows that share an id are one document, with the smallest component of its texts
    return signed.join(of, "digest_", "left").select("id_", F.col("n_").alias("n_shingles"), F.when(F.col("id_").isNotNull(), F.coalesce("comp_", "id_")).alias("component_id"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of near duplicates on 4-word shingles."""
    made = near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)
    return made.select(F.col("id_").alias("doc_id"), "n_shingles", "component_id", F.coalesce(F.col("id_") == F.col("component_id"), F.lit(True)).alias("kept"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
x AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
e AS (SELECT u, v FROM x JOIN n a ON a.doc_id = u JOIN n b ON b.doc_id = v WHERE 100 * common >= 80 * (a.n + b.n - common)),
r AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, e.v FROM r JOIN e ON e.u = r.v),
c AS (SELECT u AS doc_id, min(v) AS component_id FROM r GROUP BY u)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM documents d LEFT JOIN n USING (doc_id) JOIN c USING (doc_id)
"""
