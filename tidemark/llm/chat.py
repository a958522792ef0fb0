r"""Chat formatting by columnar byte assembly.

A turn is ``<turn>role<text>text</turn>\n``. Backslashes and ``<`` of roles and texts get a backslash before them, so
every bare ``<`` is a control string and the text reads back exactly. Assembly works on a whole slice of rows: numpy
computes the length of every segment (header, contents, ends), their cumulative offsets and, for the contents, the place
to which each byte goes; headers and contents are scattered into one preallocated buffer, which becomes the Arrow column
without a copy. The loss mask lists the spans (code points) of the assistant's texts within the formatted text.

Turns are formatted row by row, wherever the rows lie. Only then do rows of one conversation meet, sorted by turn within
a partition and streamed, so a conversation of any length passes in pieces.

Null text and null role are empty. Turns that share a number stand in order of role, then text; a null turn comes first.
A null conv_id is a conversation of its own. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_batches, slices, table

OPEN, MIDDLE, CLOSE = b"<turn>", b"<text>", b"</turn>\n"
TURN = re.compile(r"<turn>([^\\<]*(?:\\.[^\\<]*)*)<text>([^\\<]*(?:\\.[^\\<]*)*)</turn>\n", re.S)
LOSS_ROLE = "assistant"


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a string column; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _escaped(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes that need a backslash, and for each row its escaped length; where each byte goes, row ends aside."""
    marked = (data == 0x5C) | (data == 0x3C)
    before = np.concatenate([[0], np.cumsum(marked)])
    return marked, (offsets[1:] - offsets[:-1]) + before[offsets[1:]] - before[offsets[:-1]], np.arange(len(data)) + before[1:]


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The formatted turns, their lengths, and where each text starts and ends in its turn, in code points."""
    (rd, ro), (td, to) = _bytes_of(roles), _bytes_of(texts)
    (rm, rl, rp), (tm, tl, tp) = _escaped(rd, ro), _escaped(td, to)
    size = len(OPEN) + rl + len(MIDDLE) + tl + len(CLOSE)
    ends = np.cumsum(size)
    base = ends - size
    out = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.uint8)

    def constant(at: np.ndarray, value: bytes) -> None:
        out[at[:, None] + np.arange(len(value))] = np.frombuffer(value, dtype=np.uint8)

    def contents(at: np.ndarray, data: np.ndarray, offsets: np.ndarray, marked: np.ndarray, place: np.ndarray, size: np.ndarray) -> None:
        # place runs on over all rows; each row's own shift brings it behind its header
        shift = np.repeat(at - (np.cumsum(size) - size), offsets[1:] - offsets[:-1])
        place = place + shift
        out[place] = data
        out[place[marked] - 1] = 0x5C

    constant(base, OPEN)
    contents(base + len(OPEN), rd, ro, rm, rp, rl)
    constant(base + len(OPEN) + rl, MIDDLE)
    start = base + len(OPEN) + rl + len(MIDDLE)
    contents(start, td, to, tm, tp, tl)
    constant(ends - len(CLOSE), CLOSE)
    whole = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64)), pa.py_buffer(out))
    points = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])
    return whole, points[ends] - points[base], points[start] - points[base], points[start + tl] - points[base]


TURNS = "conv_ {kind}, formatted string, chars long, loss boolean, loss_start long, loss_end long"


def format_turns(rows: DataFrame) -> DataFrame:
    """Rows of conv_, turn_, role_, text_ with ``formatted`` and the text's place in it; each conversation's rows
    follow each other within one partition, in order."""
    bounded_batches(rows.sparkSession)
    few = rows.select(F.col("conv_id").alias("conv_"), F.col("turn").alias("turn_"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role_"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text_"))
    few = few.repartition("conv_").sortWithinPartitions(F.col("conv_").asc_nulls_first(), F.col("turn_").asc_nulls_first(), "role_", "text_")
    kind = dict(few.dtypes)["conv_"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text_"):
                made, chars, start, end = assemble(batch.column("role_"), batch.column("text_"))
                loss = pa.array([r == LOSS_ROLE for r in batch.column("role_").to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column("conv_"), made.cast(pa.string()), pa.array(chars), loss, pa.array(start), pa.array(end)], names=["conv_", "formatted", "chars", "loss", "loss_start", "loss_end"])

    return few.mapInArrow(run, TURNS.format(kind=kind))


def format_conversations(rows: DataFrame) -> DataFrame:
    """conv_id, formatted (the whole conversation) and loss_spans (array of start, end in its code points).

    The result holds each conversation in one cell; use ``format_turns`` where a conversation can exceed memory.
    """
    turns = format_turns(rows)
    kind = dict(turns.dtypes)["conv_"]
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key], type=conv), pa.array(["".join(parts)]), pa.array([loss], type=spans)], names=["conv_id", "formatted", "loss_spans"])

        key, parts, loss, at, conv = None, [], [], 0, None
        for batch in batches:
            conv = batch.schema.field("conv_").type
            for k, text, chars, is_loss, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if parts and k != key:
                    yield row()
                    parts, loss, at = [], [], 0
                key = k
                parts.append(text)
                if is_loss:
                    loss.append({"start": at + a, "end": at + b})
                at += chars
        if parts:
            yield row()

    return turns.mapInArrow(run, f"conv_id {kind}, formatted string, loss_spans array<struct<start: long, end: long>>")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted text; raises if anything else is in it."""
    out, at = [], 0
    for m in TURN.finditer(formatted):
        if m.start() != at:
            break
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError("not a formatted conversation")
    return out


def conversation_digests(turns: DataFrame) -> DataFrame:
    """What formatted turns say when they are read back, by conversation; holds one turn at a time."""
    kind = dict(turns.dtypes)["conv_"]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, seen, conv = None, None, None
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0], type=conv), *(pa.array(c) for c in cols[1:])], names=names)

        def close() -> None:
            n, turns_sha, chars, loss_sha, whole = seen
            rows.append((key, n, turns_sha.hexdigest(), chars, loss_sha.hexdigest(), whole))

        for batch in batches:
            conv = batch.schema.field("conv_").type
            for k, text, is_loss, a, b in zip(*(batch.column(c).to_pylist() for c in ("conv_", "formatted", "loss", "loss_start", "loss_end")), strict=True):
                if seen is not None and k != key:
                    close()
                    seen = None
                if seen is None:
                    key, seen = k, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in read_back(text):
                    seen[0] += 1
                    seen[1].update(f"{role}\n{said}\n".encode())
                if is_loss:
                    loss = unescape(text[a:b])
                    seen[2] += len(loss)
                    seen[3].update(loss.encode())
                seen[4] += len(text)
            if len(rows) >= 1000:
                yield out()
        if seen is not None:
            close()
        if rows:
            yield out()

    return turns.mapInArrow(run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations, and of one that is full of control strings, read back from their format."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "\\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return conversation_digests(format_turns(given.unionByName(own)))


_HARD = "'\\### Assistant: </turn> ok'"
_ESCAPED = "(2 * length({0}) - length(replace(replace({0}, '\\', ''), '<', '')))"
SQL = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', {_HARD} UNION ALL SELECT -7, 1, 'assistant', {_HARD})
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
    CAST(sum({_ESCAPED.format("role")} + {_ESCAPED.format("text")} + {len(OPEN) + len(MIDDLE) + len(CLOSE)}) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
