"""Benchmark decontamination by SimHash over item-sized windows.

Words are runs of letters and digits, lower-cased. An item of w words is compared with the windows of w words of a text
(with the whole text, if that is shorter) by the weighted Jaccard similarity of their 5-word shingles, the weight being how
often a shingle occurs; an item or a text of fewer words is one shingle. A window that reaches the threshold is a match.

Windows get a 64-bit SimHash of their weighted shingles. It is cut into RADIUS + 1 blocks, each with a table of the items
of that size; whatever lies within RADIUS bits of an item agrees with it in a whole block at least, so the tables give all
such items, and full comparison decides. At a similarity of 0.8 the expected distance is 10 bits and its deviation 3, so
a match is beyond 24 bits once in a million times at the threshold itself, and never for equal windows.

A window without a single shingle of an item has similarity 0 to it. So only windows around words that share a shingle
with some item are fingerprinted; this loses nothing and is what makes all window sizes affordable.

Equal items are one text, whose matches are given to all of them by a join. Texts of items go out in blocks of about ITEMS
texts and CHARS characters. Where one block suffices, documents are scanned once. Where it doesn't, the scans don't grow with
the blocks: a first one gives the shingles of documents that a bounded Bloom filter of all items' shingles lets through,
which are joined with the items' shingles; a second one fetches the documents that share a shingle with some block, and
only these are compared, block by block.

Null or empty texts and items match nothing. Repeated items and documents match as rows of their own, those with a null id,
too. Empty tables give no matches. Columns besides those named don't matter, but the items' key must be named otherwise than
the documents'. Texts and items of any length are compared whole, in blocks of windows.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import Scratch, bounded_batches, if_few, per_text, remembers, slices, table, take_turn

SHINGLE, LEAST, RADIUS = 5, 0.8, 24
ITEMS, CHARS = 20_000, 16 << 20
REMEMBERED = 200_000
#: Bits of the Bloom filter for each shingle, and at most.
BITS_EACH, BITS_MOST = 32, 1 << 28
WORD = re.compile(r"[^\W_]+")
#: Bit ranges of the RADIUS + 1 blocks.
BLOCKS = [(k * 64 // (RADIUS + 1), (1 << (k + 1) * 64 // (RADIUS + 1) - k * 64 // (RADIUS + 1)) - 1) for k in range(RADIUS + 1)]
_words: dict[str, int] = {}
remembers("decontamination", _words.clear)


def _word(w: str) -> int:
    if len(_words) >= REMEMBERED:
        _words.clear()
    h = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
    if len(w) <= 40:
        _words[w] = h
    return h


def word_hashes(text: str | None) -> np.ndarray:
    words = WORD.findall(text.lower()) if text else []
    get = _words.get
    return np.fromiter([get(x) or _word(x) for x in words], dtype=np.uint64, count=len(words))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, size, dtype=np.uint64)
    for j in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[j : n + j]
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


def signs(shingles: np.ndarray) -> np.ndarray:
    """+1 or -1 for each of 64 bits of each shingle."""
    h = shingles * np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return ((h[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.int32) * 2 - 1


def sign_sum(shingles: np.ndarray) -> np.ndarray:
    return sum((signs(shingles[a : a + 65_536]).sum(axis=0, dtype=np.int64) for a in range(0, len(shingles), 65_536)), np.zeros(64, np.int64))


_POWERS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def fingerprints(sums: np.ndarray) -> np.ndarray:
    return ((sums > 0) * _POWERS).sum(axis=1, dtype=np.uint64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Weighted Jaccard similarity of two lists of shingles."""
    u, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = np.bincount(at[: len(a)], minlength=len(u)), np.bincount(at[len(a) :], minlength=len(u))
    return float(np.minimum(x, y).sum() / np.maximum(x, y).sum()) if len(u) else 0.0


class ItemIndex:
    """Items by size, with a table of fingerprints for each block of bits."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.ids: list[int | None] = []
        self.shingles: list[np.ndarray] = []
        self.prints: list[int] = []
        sized: dict[int, list[int]] = defaultdict(list)  # words: items
        for key, text in items:
            words = word_hashes(text)
            if len(words):
                sized[len(words)].append(len(self.ids))
                self.ids.append(key)
                own = shingle_hashes(words, min(SHINGLE, len(words)))
                self.shingles.append(own)
                self.prints.append(int(fingerprints(sign_sum(own)[None])[0]))
        #: For each shingle size: the sorted shingles of its items and, for each, the items' numbers of words.
        self.known: dict[int, tuple[np.ndarray, list[list[int]]]] = {}
        for size in {min(SHINGLE, n) for n in sized}:
            held: dict[int, set[int]] = defaultdict(set)
            for n, of in sized.items():
                if min(SHINGLE, n) == size:
                    for i in of:
                        for s in self.shingles[i].tolist():
                            held[s].add(n)
            keys = np.array(sorted(held), dtype=np.uint64)
            self.known[size] = keys, [sorted(held[k]) for k in keys.tolist()]
        self.tables: dict[int, list[dict[int, list[int]]]] = {}
        for n, of in sized.items():
            tables: list[dict[int, list[int]]] = [defaultdict(list) for _ in BLOCKS]
            for i in of:
                for (at, mask), held in zip(BLOCKS, tables, strict=True):
                    held[self.prints[i] >> at & mask].append(i)
            self.tables[n] = [dict(t) for t in tables]

    def within(self, n: int, fingerprint: int) -> list[int]:
        """All items of n words whose fingerprint is within RADIUS bits."""
        some: set[int] = set()
        for (at, mask), held in zip(BLOCKS, self.tables[n], strict=True):
            some.update(held.get(fingerprint >> at & mask, ()))
        return [i for i in some if (self.prints[i] ^ fingerprint).bit_count() <= RADIUS]

    def matches(self, text: str | None) -> list[tuple[int | None, int, float]]:
        """(item id, first word, similarity) of the best window of every item that matches."""
        words = word_hashes(text)
        best: dict[int, tuple[float, int]] = {}
        if not len(words):
            return []
        for size, (keys, sizes) in self.known.items():
            own = shingle_hashes(words, size)
            if not len(own):
                continue
            at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
            hit = np.flatnonzero(keys[at] == own)
            if not len(hit):
                continue
            places: dict[int, list[int]] = defaultdict(list)
            for p, k in zip(hit.tolist(), at[hit].tolist(), strict=True):
                for n in sizes[k]:
                    places[n].append(p)
            for n, near in places.items():
                self._windows(own, n, n - size + 1, np.array(near), best)
        return [(self.ids[i], start, s) for i, (s, start) in sorted(best.items())]

    def _windows(self, own: np.ndarray, n: int, width: int, near: np.ndarray, best: dict[int, tuple[float, int]]) -> None:
        """Compares the windows of ``width`` shingles that hold a shingle at one of the places."""
        last = max(0, len(own) - width)
        cover = np.zeros(last + 2, dtype=np.int64)  # starts of windows, as differences
        np.add.at(cover, np.clip(near - width + 1, 0, last), 1)
        np.add.at(cover, np.clip(near, 0, last) + 1, -1)
        starts = np.flatnonzero(np.cumsum(cover[:-1]) > 0)
        for run in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
            for block in np.split(run, range(4096, len(run), 4096)):
                a, b = int(block[0]), int(block[-1])
                # the first window's sum, and from one window to the next a shingle more and one less
                steps = signs(own[a + width : b + width]).astype(np.int64) - signs(own[a:b]) if b > a else np.zeros((0, 64), np.int64)
                prints = fingerprints(sign_sum(own[a : a + width]) + np.concatenate([np.zeros((1, 64), np.int64), np.cumsum(steps, axis=0)]))
                for start, f in zip(block.tolist(), prints.tolist(), strict=True):
                    for i in self.within(n, f):
                        s = similarity(own[start : start + width], self.shingles[i])
                        if s >= LEAST and (i not in best or s > best[i][0]):
                            best[i] = s, start


class _Items:
    """The distinct texts of the items, numbered and dealt to blocks."""

    def __init__(self, items: DataFrame, key: str, text: str):
        self.scratch = Scratch(items.sparkSession)
        given = items.select(F.col(key).alias("item_"), F.col(text).cast("string").alias("text_")).where("text_ is not null")
        texts = given.select("text_").distinct()
        n, chars = texts.agg(F.count("*"), F.coalesce(F.sum(F.length("text_")), F.lit(0))).first()
        self.blocks = max(1, -(-n // ITEMS), -(-chars // CHARS))
        # written, since numbers may differ when they are made again
        self.texts = self.scratch.save(texts.select(F.monotonically_increasing_id().alias("no_"), "text_", F.pmod(F.xxhash64("text_"), F.lit(self.blocks)).cast("int").alias("block_")))
        self.owners = given.join(self.texts, "text_").select("no_", "item_")

    def index(self, block: int) -> ItemIndex:
        """A block's texts, a bounded number."""
        return ItemIndex([(r.no_, r.text_) for r in self.texts.where(F.col("block_") == block).orderBy("no_").collect()])

    def near(self, docs: DataFrame) -> DataFrame:
        """``docs`` (with text_) that share a shingle with some block, with those ``blocks_``; written."""

        def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            take_turn("decontamination")
            for batch in batches:
                for t, block in zip(batch.column("text_").to_pylist(), batch.column("block_").to_pylist(), strict=True):
                    words = word_hashes(t)
                    if len(words):
                        held = np.unique(shingle_hashes(words, min(SHINGLE, len(words)))).view(np.int64)
                        n = len(held)
                        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array([min(SHINGLE, len(words))] * n, type=pa.int32()), pa.array([block] * n, type=pa.int32())], names=["s_", "size_", "block_"])

        shingles = self.scratch.save(self.texts.select("text_", "block_").mapInArrow(of_items, "s_ long, size_ int, block_ int").distinct())
        sizes = [r.size_ for r in shingles.select("size_").distinct().collect()]  # five at most
        some = _Bloom.of(shingles)

        def of_docs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            take_turn("decontamination")
            for whole in batches:
                for batch in slices(whole, "text_"):
                    digests, found = [], []
                    for t, d in zip(batch.column("text_").to_pylist(), batch.column("digest_").to_pylist(), strict=True):
                        words = word_hashes(t)
                        own = np.unique(np.concatenate([shingle_hashes(words, z) for z in sizes])) if len(words) and sizes else np.zeros(0, np.uint64)
                        own = own[some.may_hold(own)]
                        digests += [d] * len(own)
                        found.append(own)
                    if digests:
                        yield pa.RecordBatch.from_arrays([pa.array(digests, type=pa.string()), pa.array(np.concatenate(found).view(np.int64))], names=["digest_", "s_"])

        marked = docs.where("text_ is not null").withColumn("digest_", F.md5("text_"))
        hits = marked.select("text_", "digest_").mapInArrow(of_docs, "digest_ string, s_ long")
        wanted = hits.join(shingles.select("s_", "block_"), "s_").select("digest_", "block_").distinct().groupBy("digest_").agg(F.collect_list("block_").alias("blocks_"))
        return self.scratch.save(marked.join(self.scratch.save(wanted), "digest_"))


class _Bloom:
    """A bounded set of bits; what it doesn't hold is certainly not among the shingles."""

    def __init__(self, bits: int):
        self.mask = np.uint64(bits - 1)
        self.held = np.zeros(bits >> 6, dtype=np.uint64)

    def _places(self, h: np.ndarray) -> list[np.ndarray]:
        step = (h >> np.uint64(32)) | np.uint64(1)
        return [(h + np.uint64(k) * step) & self.mask for k in range(8)]

    @classmethod
    def of(cls, shingles: DataFrame) -> _Bloom:
        n = shingles.count()
        out = cls(min(BITS_MOST, max(1 << 10, 1 << (n * BITS_EACH).bit_length())))

        def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = np.concatenate(out._places(batch.column("s_").to_numpy().view(np.uint64)))
                bit = np.uint64(1) << (at & np.uint64(63))
                yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).view(np.int64)), pa.array(bit.view(np.int64))], names=["word", "bit"])

        # a row a word of the filter, which is bounded
        made = shingles.select("s_").mapInArrow(words, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
        out.held[made.column("word").to_numpy()] = made.column("bits").to_numpy().view(np.uint64)
        return out

    def may_hold(self, h: np.ndarray) -> np.ndarray:
        fine = np.ones(len(h), dtype=bool)
        for at in self._places(h):
            fine &= (self.held[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0
        return fine


def _matched(few: DataFrame, index: ItemIndex) -> DataFrame:
    """The columns of ``few`` but its last, the text, and no_, start_word and similarity of every match."""
    kind = T.StructType([*few.schema.fields[:-1], T.StructField("no_", T.LongType()), T.StructField("start_word", T.LongType()), T.StructField("similarity", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_turn("decontamination")
        for batch in batches:
            rows = [(j, *m) for j, t in enumerate(batch.column("text_").to_pylist()) for m in index.matches(t)]
            if rows:
                at, ids, start, s = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at)) for c in batch.columns[:-1]), pa.array(ids, type=pa.int64()), pa.array(start, type=pa.int64()), pa.array(s, type=pa.float64())], names=kind.names)

    return few.mapInArrow(run, kind)


def benchmark_matches(docs: DataFrame, items: DataFrame, *, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each row of ``docs`` and item that match: ``key``, ``item``, start_word and similarity."""
    if key == item:
        raise ValueError("documents and items need keys of different names")
    held = _Items(items, item, item_text)
    few = docs.select(F.col(key).alias("key_"), F.col(text).cast("string").alias("text_"))
    if held.blocks == 1:
        found = _matched(few, held.index(0))
    else:
        near = held.near(few)
        found = None
        for b in range(held.blocks):  # over the few documents that share a shingle with the block
            made = held.scratch.save(_matched(near.where(F.array_contains("blocks_", b)).select("key_", "text_"), held.index(b)))
            found = made if found is None else found.unionByName(made)
    return found.join(held.owners, "no_").select(F.col("key_").alias(key), F.col("item_").alias(item), "start_word", "similarity")


def without_benchmark(docs: DataFrame, items: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that match no item."""
    held = _Items(items, item, item_text)
    if held.blocks == 1:
        index = held.index(0)
        return docs.where(per_text(lambda t: not index.matches(t), T.BooleanType(), pa.bool_(), "decontamination")(F.col(text)))
    near = held.near(docs.select(F.col(text).cast("string").alias("text_")).distinct())
    gone = None
    for b in range(held.blocks):
        made = held.scratch.save(_matched(near.where(F.array_contains("blocks_", b)).select("digest_", "text_"), held.index(b)).select(F.col("digest_").alias("gone_")).distinct())
        gone = made if gone is None else gone.unionByName(made)
    gone = held.scratch.save(gone.distinct())
    return docs.join(if_few(gone), F.md5(F.col(text).cast("string")) == gone.gone_, "left_anti")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark item, with the item and the place."""
    return benchmark_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL = r"""
WITH d AS (SELECT doc_id AS k, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id AS k, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark WHERE text IS NOT NULL),
bs AS (SELECT k, len(w) AS n, least(5, len(w)) AS z, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
bc AS (SELECT k, n, z, s, count(*) AS c FROM bs GROUP BY ALL),
ds AS (SELECT k, z, i - 1 AS p, len(w) - z + 1 AS m, array_to_string(w[i:i + z - 1], ' ') AS s FROM (SELECT d.*, z, unnest(range(1, len(w) - z + 2)) AS i FROM d, (SELECT DISTINCT z FROM bs) WHERE len(w) >= z)),
hit AS (SELECT DISTINCT ds.k AS doc, bc.k AS item, bc.n, bc.z, m, p FROM ds JOIN bc USING (z, s)),
st AS (SELECT DISTINCT doc, item, n, z, least(greatest(t, 0), greatest(m - (n - z + 1), 0)) AS t FROM (SELECT *, unnest(range(p - (n - z), p + 1)) AS t FROM hit)),
win AS (SELECT st.doc, st.item, st.t, ds.s, count(*) AS c FROM st JOIN ds ON ds.k = st.doc AND ds.z = st.z AND ds.p BETWEEN st.t AND st.t + st.n - st.z GROUP BY ALL),
sz AS (SELECT doc, item, t, sum(c) AS a FROM win GROUP BY ALL),
sh AS (SELECT doc, item, t, sum(least(win.c, bc.c)) AS common FROM win JOIN bc ON bc.k = win.item AND bc.s = win.s GROUP BY ALL),
sim AS (SELECT sz.doc, sz.item, sz.t, common / (a + bn.n - common) AS s FROM sz JOIN sh USING (doc, item, t) JOIN (SELECT k, sum(c) AS n FROM bc GROUP BY k) bn ON bn.k = sz.item)
SELECT doc AS doc_id, item AS item_id, CAST(t AS BIGINT) AS start_word, CAST(s AS DOUBLE) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY doc, item ORDER BY s DESC, t) AS r FROM sim WHERE s >= 0.8) WHERE r = 1
"""
