"""SentencePiece encoding and decoding by a merge-type prefix table.

For every prefix of a text the BPE encoding ends in exactly one token. An Aho-Corasick automaton over the pieces
proposes the tokens that end at a position; the one whose predecessor (the last token of the shorter prefix) could
stand beside it without an earlier merge across the boundary is stored. The ids are then read off backwards. This takes
time linear in the text, also without any white space, and equals the library's greedy merging.

Pieces that share one score (runs of spaces) have no rank among themselves. They have the lowest score, so they merge
after all others, leftmost first, on the tokens that the table gives.

A model whose pieces aren't all made of pieces of higher score has no such table; ``has_table`` says so, and such a model
is merged best first instead. Null text is empty, an empty text has no ids. Texts are never cut: very long ones go through in
blocks that end where no piece can cross. Repeated rows are rows of their own, an empty table gives no rows, and columns that
aren't asked for don't matter, whatever their names.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import bounded_batches, remembers, slices, table, take_turn

SPACE = "▁"
#: Distinct words whose ids a worker remembers in each of two generations.
REMEMBERED = 100_000
#: Pairs of tokens whose compatibility a worker remembers.
PAIRS = 250_000
WORDS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
BLOCK = 1 << 20


class PieceModel:
    """The merges of a SentencePiece BPE model with byte fallback."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.size = sp.get_piece_size()
        if any(sp.is_unused(i) for i in range(self.size)):
            raise ValueError("models with unused pieces aren't supported")
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(self.size)]
        self.ids = {sp.id_to_piece(i): i for i in range(self.size) if not special[i]}
        self.score = {p: sp.get_score(i) for p, i in self.ids.items()}
        self.byte_id = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.id_bytes = [b"" if special[i] else sp.id_to_piece(i).replace(SPACE, " ").encode() for i in range(self.size)]
        self.silent = {i for i in range(self.size) if sp.is_control(i)}
        self.byte_of = {i: b for b, i in enumerate(self.byte_id)}
        self.unknown = sp.unk_id()
        self.unknown_text = sp.decode([self.unknown])
        self.by_space = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        space = self.ids.get(SPACE)
        self.strips_one = space is not None and sp.decode([space, space]) == " "
        self._tables()
        #: Ids of short words, in two generations: when the newer is full, the older goes.
        self.remembered: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _tables(self) -> None:
        multi = sorted((p for p in self.ids if len(p) > 1), key=lambda p: -self.score[p])
        held: dict[float, int] = {}
        for p in multi:
            held[self.score[p]] = held.get(self.score[p], 0) + 1
        self.tied = {p for p in multi if held[self.score[p]] > 1}
        self.least_tied = [p for p in self.tied if not any(q in p for q in self.tied if q != p)]
        ranked = [p for p in multi if p not in self.tied]
        bases = sorted({c for p in self.ids for c in p})
        self.text = [*bases]
        code = {c: i for i, c in enumerate(bases)}
        self.n_base = len(bases)
        self.left, self.right = [*range(self.n_base)], [*range(self.n_base)]
        self.pair: dict[tuple[int, int], int] = {}
        ordered = not self.tied or not ranked or max(self.score[p] for p in self.tied) < self.score[ranked[-1]]
        rank = {p: k for k, p in enumerate(ranked)}
        for p in ranked:
            end = self._merged([*p], rank, stop=2)
            if len(end) != 2:
                continue  # no text ever merges to this piece
            if end[0] not in code or end[1] not in code:
                ordered = False
                break
            code[p] = k = len(self.text)
            self.text.append(p)
            self.left.append(code[end[0]])
            self.right.append(code[end[1]])
            self.pair[code[end[0]], code[end[1]]] = k
        #: Whether every piece is made of pieces of higher score, as the table needs.
        self.has_table = ordered
        self.code_ids = [[self.ids[p]] if p in self.ids else [self.byte_id[b] for b in p.encode()] for p in self.text]
        self.code_bytes = [array("i", ids).tobytes() for ids in self.code_ids]
        self.length = [len(p) for p in self.text]
        self.automaton = ahocorasick.Automaton()
        for p, k in code.items():
            self.automaton.add_word(p, (k, len(p)))
        self.automaton.make_automaton()
        #: Answers of ``compatible`` by both codes in one number.
        self.known: dict[int, bool] = {}

    @staticmethod
    def _merged(parts: list[str], rank: dict[str, int], stop: int) -> list[str]:
        """Merges short lists best first until none is left; the last state of ``stop`` parts if the end has one."""
        kept = parts
        while len(parts) > 1:
            best = min(((rank[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in rank), default=None)
            if best is None:
                return parts if len(parts) > 1 and stop == 1 else []
            kept = parts
            i = best[1]
            parts = [*parts[:i], parts[i] + parts[i + 1], *parts[i + 2 :]]
        return kept if len(kept) == stop else []

    def compatible(self, a: int, b: int) -> bool:
        """Whether the encoding of the texts of two tokens, side by side, is just these two.

        Undo the merges of both tokens, last one first: codes grow with the order of merging. What faces the other side at any
        time must not have merged across the border before the next undone merge had been made. The idea is that of known
        pair tests for byte-pair encodings."""
        merged, left, right, base = self.pair, self.left, self.right, self.n_base
        undone = len(self.text)  # the merge undone last; nothing across the border may come before it
        while merged.get((a, b), undone) >= undone:
            if a < base and b < base:
                return True
            if a > b:
                undone, a = a, right[a]
            else:  # of two equal tokens the right one is made later
                undone, b = b + 1, left[b]
        return False

    def _codes(self, span: str) -> list[int]:
        """Codes of the tokens of ``span``; characters that no piece holds have code -1 - code point."""
        n = len(span)
        last: list[int | None] = [None] * (n + 1)
        known, codes = self.known, len(self.text)
        if len(known) >= PAIRS:
            known.clear()
        last[0] = -1
        done = 0
        for end, (code, length) in self.automaton.iter(span):
            stop = end + 1
            if last[stop] is None:
                before = last[stop - length]
                if before is None:  # no piece holds the character before
                    while done < end:
                        done += 1
                        if last[done] is None:
                            last[done] = -1 - ord(span[done - 1])
                    before = last[stop - length]
                if before >= 0:
                    ok = known.get(key := before * codes + code)
                    if ok is None:
                        ok = known[key] = self.compatible(before, code)
                    if ok:
                        last[stop] = code
                else:
                    last[stop] = code
        if None in last:
            last[1:] = [-1 - ord(c) if k is None else k for k, c in zip(last[1:], span, strict=True)]
        out = []
        sizes = self.length
        i = n
        while i:
            out.append(c := last[i])
            i -= sizes[c] if c >= 0 else 1
        out.reverse()
        return out

    def agenda(self, parts: list[str], score: dict[str, float]) -> list[str]:
        """Greedy merging, highest score first, then leftmost."""
        parts = [*parts]
        n = len(parts)
        prev, nxt = [*range(-1, n - 1)], [*range(1, n + 1)]
        heap: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < n and (s := score.get(p := parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-s, i, j, p))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, p = heapq.heappop(heap)
            if not parts[i] or not parts[j] or parts[i] + parts[j] != p or nxt[i] != j:
                continue
            parts[i], parts[j] = p, ""
            nxt[i] = k = nxt[j]
            if k < n:
                prev[k] = i
            offer(prev[i], i)
            offer(i, k)
        return [p for p in parts if p]

    def _ids_of(self, piece: str) -> list[int]:
        i = self.ids.get(piece)
        return [i] if i is not None else [self.byte_id[b] for b in piece.encode()]

    def packed_span(self, span: str) -> bytes:
        """Ids of normalized text as int32."""
        if not self.has_table:
            return array("i", [i for p in self.agenda([*span], self.score) for i in self._ids_of(p)]).tobytes()
        codes = self._codes(span)
        for tied in self.least_tied:
            if tied in span:
                parts = [self.text[c] if c >= 0 else chr(-1 - c) for c in codes]
                return array("i", [i for p in self.agenda(parts, {p: self.score[p] for p in self.tied}) for i in self._ids_of(p)]).tobytes()
        held = self.code_bytes
        return b"".join([held[c] if c >= 0 else array("i", [self.byte_id[b] for b in chr(-1 - c).encode()]).tobytes() for c in codes])

    def encode_span(self, span: str) -> list[int]:
        return np.frombuffer(self.packed_span(span), dtype=np.int32).tolist()

    def blocks(self, normalized: str) -> Iterator[str]:
        """Cuts that no piece crosses, every million characters or so."""
        at = 0
        while self.by_space and len(normalized) - at > BLOCK:
            to = at + BLOCK
            while (to := normalized.find(SPACE, to)) > 0 and normalized[to - 1] == SPACE:
                to += 1
            if to < 0:
                break
            yield normalized[at:to]
            at = to
        yield normalized[at:]

    def _remember(self, key: str, span: str) -> bytes:
        ids = self.older.get(key)
        if ids is None:
            ids = self.packed_span(span)
        if len(key) <= 48:
            if len(self.remembered) >= REMEMBERED:
                self.older, self.remembered = self.remembered, {}
            self.remembered[key] = ids
        return ids

    def _packed_block(self, block: str) -> bytes:
        get, find = self.remembered.get, self._remember
        if not self.by_space:
            return self.packed_span(block)
        if block.startswith(SPACE) and SPACE * 2 not in block:  # words go by their letters, which takes less memory
            return b"".join([get(w) or find(w, SPACE + w) for w in block[1:].split(SPACE)])
        return b"".join([get(w) or find(w, w) if w[0] == SPACE else self.packed_span(w) for w in WORDS.findall(block)])

    def encode_packed(self, text: str | None) -> bytes:
        """Ids as little-endian int32."""
        return b"".join(map(self._packed_block, self.blocks(self.sp.normalize(text)))) if text else b""

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_packed(text), dtype=np.int32).tolist()

    def decode(self, ids: list[int]) -> str:
        """The library's text of the ids: pieces joined, byte pieces read as UTF-8, the first space dropped."""
        if not ids:
            return ""
        if not self.strips_one or self.unknown in ids:
            return self.sp.decode([*map(int, ids)])
        bytes_in = self.byte_of
        out: list[bytes] = []
        run = bytearray()
        for i, held in zip(ids, map(self.id_bytes.__getitem__, ids), strict=True):
            if held:
                if run:
                    out.append(_read(run))
                    run = bytearray()
                out.append(held)
            elif i in bytes_in:
                run.append(bytes_in[i])
        if run:
            out.append(_read(run))
        text = b"".join(out).decode()
        first = next((i for i in ids if i not in self.silent), ids[0])
        return text[1:] if self.id_bytes[first].startswith(b" ") else text


def _read(run: bytearray) -> bytes:
    try:
        return run.decode().encode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(run):  # each byte that starts no whole character is one replacement character
            for size in (1, 2, 3, 4):
                try:
                    out.append(run[at : at + size].decode())
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                size = 1
            at += size
        return "".join(out).encode()


_models: dict[int, PieceModel] = {}
remembers("sentencepiece", _models.clear)


def model_of(data: bytes) -> PieceModel:
    """One model a worker process."""
    take_turn("sentencepiece")
    key = hash(data)
    if key not in _models:
        _models.clear()
        _models[key] = PieceModel(data)
    return _models[key]


def _transcoded(batches: Iterator[pa.RecordBatch], data: bytes, text: str, kind: pa.Schema, decoded: bool) -> Iterator[pa.RecordBatch]:
    model = model_of(data)
    for whole in batches:
        for batch in slices(whole, text):
            packed = [model.encode_packed(t) for t in batch.column(text).to_pylist()]
            size = np.array([len(p) // 4 for p in packed], dtype=np.int64)
            ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(packed), dtype=np.int32)))
            made = [ids]
            if decoded:
                made.append(pa.array([model.decode(np.frombuffer(p, dtype=np.int32).tolist()) for p in packed], type=pa.string()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c).cast(kind.field(c).type) for c in kind.names[: -len(made)]), *made], schema=kind)


def encode_texts(docs: DataFrame, model_path: str, *, keys: tuple[str, ...] = ("doc_id",), text: str = "text", decoded: bool = True) -> DataFrame:
    """The key columns, ``ids`` array<int> and, if asked for, ``decoded``: the text read back from the ids.

    One row for each row of ``docs``; other columns of any name are left out. The model file is read on the driver and
    goes out with the task (half a megabyte for 32,000 pieces).
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    with open(model_path, "rb") as f:
        data = f.read()
    bounded_batches(docs.sparkSession)
    few = docs.select(*keys, F.col(text).cast("string").alias("text_"))
    kind = T.StructType([*few.schema.fields[:-1], T.StructField("ids", T.ArrayType(T.IntegerType())), *([T.StructField("decoded", T.StringType())] if decoded else [])])
    arrow = to_arrow_schema(kind)
    arrow = pa.schema([f if f.name != "ids" else pa.field("ids", pa.list_(pa.int32())) for f in arrow])
    return few.mapInArrow(lambda it: _transcoded(it, data, "text_", arrow, decoded), kind)


def decode_ids(df: DataFrame, model_path: str, *, keys: tuple[str, ...] = ("doc_id",), ids: str = "ids") -> DataFrame:
    """The key columns and ``decoded``; null ids give an empty text."""
    with open(model_path, "rb") as f:
        data = f.read()
    bounded_batches(df.sparkSession)
    few = df.select(*keys, F.col(ids).cast("array<int>").alias("ids_"))
    kind = T.StructType([*few.schema.fields[:-1], T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(data)
        for batch in batches:
            made = pa.array([model.decode(x or []) for x in batch.column("ids_").to_pylist()], type=pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], names=kind.names)

    return few.mapInArrow(run, kind)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's ids and decoded text as digests."""
    made = encode_texts(table(spark, sf_dir, "documents"), default_model())
    return made.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
