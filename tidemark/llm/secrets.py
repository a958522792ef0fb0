"""Secret scans: an Aho-Corasick keyword prefilter, regular expressions anchored at its hits, then checksums.

Kinds, in their order: ``assign`` (a keyword, a colon or equals sign and a value of 12 characters or more), ``access``
(AKIA keys of 18 or more), ``hex`` (lower-case runs of 16 or more), ``github`` and ``npm`` (prefixed tokens whose last
six characters are the base-62 CRC-32 of the 30 before them; others with the prefix are dropped). Matches of a kind are
leftmost and don't overlap; a match that fails its length is dropped but still consumes its characters. Spans count code
points and exclude their end. ``hex`` has no keyword that a prefilter could look for, so its expression runs over the text.
Null and empty texts have no spans; texts of any length are scanned whole. Repeated rows are rows of their own, an empty table
gives no rows, and columns that aren't asked for don't matter, whatever their names.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import bounded_batches, slices, table

KINDS = ("assign", "access", "hex", "github", "npm")
BASE = KINDS[:3]
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
TOKEN = re.compile(r"(?:gh[pousr]|npm)_([A-Za-z0-9]{36})(?![A-Za-z0-9])")
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def checksum62(body: str) -> str:
    """Six base-62 digits of the CRC-32."""
    n, out = zlib.crc32(body.encode()), ""
    while n:
        n, d = divmod(n, 62)
        out = DIGITS[d] + out
    return out.rjust(6, "0")


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for w in WORDS:  # keywords in either case, so that the text needn't be folded
        for cased in itertools.product(*({c, c.upper()} for c in w)):
            a.add_word("".join(cased), ("assign", len(w)))
    a.add_word("AKIA", ("access", 4))
    for p in ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"):
        a.add_word(p, ("github", 4))
    a.add_word("npm_", ("npm", 4))
    a.make_automaton()
    return a


_held: list[ahocorasick.Automaton] = []


def find_secrets(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all secrets, by start, then kind."""
    if not text:
        return []
    if not _held:
        _held.append(_automaton())
    found: list[tuple[int, int, int]] = []
    past = dict.fromkeys(KINDS, 0)
    hits = sorted({(end + 1 - size, kind) for end, (kind, size) in _held[0].iter(text)})
    for at, kind in hits:
        if at < past[kind]:
            continue
        if kind == "assign":
            if m := ASSIGN.match(text, at):
                past[kind] = m.end()
                if len(m[1]) >= 12:
                    found.append((at, 0, m.end()))
        elif kind == "access":
            if m := ACCESS.match(text, at):
                past[kind] = m.end()
                if m.end() - at >= 18:
                    found.append((at, 1, m.end()))
        elif m := TOKEN.match(text, at):
            if checksum62(m[1][:30]) == m[1][30:]:
                past[kind] = m.end()
                found.append((at, KINDS.index(kind), m.end()))
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(KINDS[k], a, b) for a, k, b in sorted(found)]


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def secret_spans(docs: DataFrame, *, keys: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The key columns and ``spans``: array of (kind, start, end); one row for each row of ``docs``."""
    bounded_batches(docs.sparkSession)
    few = docs.select(*keys, F.col(text).cast("string").alias("text_"))
    kind = T.StructType([*few.schema.fields[:-1], T.StructField("spans", SPANS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text_"):
                made = [[{"kind": k, "start": a, "end": b} for k, a, b in find_secrets(t)] for t in batch.column("text_").to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, type=_SPANS)], names=kind.names)

    return few.mapInArrow(run, kind)


def redact(text: str | None) -> str | None:
    """The text with each run of overlapping spans replaced by ``[kind]`` of the first."""
    if not text or not (spans := find_secrets(text)):
        return text
    out, at, k = [], 0, 0
    while k < len(spans):
        kind, a, b = spans[k]
        while k < len(spans) and spans[k][1] < b:
            b = max(b, spans[k][2])
            k += 1
        out += [text[at:a], f"[{kind}]"]
        at = b
    return "".join([*out, text[at:]])


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's secrets, counted and as digests."""
    made = secret_spans(table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return made.select("doc_id", *(count(k).alias(f"n_{k}") for k in BASE), F.sha2(joined(F.filter("spans", lambda s: s["kind"].isin(*BASE))), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
