"""Self-describing sketch envelopes: magic, version, kind, metadata and payload, all checked when read.

Metadata is a MessagePack map (how keys were hashed, and the sketch's shape), the payload a MessagePack array of raw
state. Readers fail closed: an unknown version, kind, key or length raises. The frame's magic and the profile's
identifiers are parameters, so bytes of another producer that uses the same layout can be read and written by naming its
values. Encoding works on one sketch's packed state; sketches of many groups are packed by ``pack_hll`` and
``pack_count_min``, one row a group.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import groups

VERSION = 1
KINDS = {"hll_classic": b"\x01\x01", "hll_ertl": b"\x01\x02", "hll_hip": b"\x01\x03", "count_min": b"\x02\x00"}


@dataclass(frozen=True)
class HashProfile:
    """What metadata says about hashing."""

    profile_id: str = "tidemark.md5.slices.v1"
    algorithm: str = "md5"
    seed_derivation: str = "row_prefix"
    input_encoding: str = "text"
    seeds: tuple[int, ...] = ()
    canonical_index: int = 0
    matrix_index: int = 0
    magic: bytes = field(default=b"TIDEMK")

    def metadata(self, **rest: Any) -> dict[str, Any]:
        head = {"metadata_version": 1, "hash_profile_id": self.profile_id, "hash_algorithm": self.algorithm, "seed_derivation": self.seed_derivation, "input_encoding": self.input_encoding, "seed_list": list(self.seeds)}
        return head | rest


OWN = HashProfile()


def pack(x: Any) -> bytes:
    """MessagePack: non-negative integers as the narrowest unsigned, negative as the narrowest signed, 64-bit floats."""
    if x is None:
        return b"\xc0"
    if isinstance(x, bool):
        return b"\xc3" if x else b"\xc2"
    if isinstance(x, (int, np.integer)):
        x = int(x)
        if 0 <= x < 128:
            return bytes([x])
        if -32 <= x < 0:
            return struct.pack("b", x)
        forms = ((0xCC, ">B"), (0xCD, ">H"), (0xCE, ">I"), (0xCF, ">Q")) if x >= 0 else ((0xD0, ">b"), (0xD1, ">h"), (0xD2, ">i"), (0xD3, ">q"))
        for tag, form in forms:
            try:
                return bytes([tag]) + struct.pack(form, x)
            except struct.error:
                continue
        raise ValueError("integers have at most 64 bits")
    if isinstance(x, float):
        return b"\xcb" + struct.pack(">d", x)
    if isinstance(x, str):
        b = x.encode()
        head = bytes([0xA0 | len(b)]) if len(b) < 32 else _sized(len(b), 0xD9, 0xDA, 0xDB)
        return head + b
    if isinstance(x, (bytes, bytearray)):
        return _sized(len(x), 0xC4, 0xC5, 0xC6) + bytes(x)
    if isinstance(x, dict):
        head = bytes([0x80 | len(x)]) if len(x) < 16 else _sized(len(x), None, 0xDE, 0xDF)
        return head + b"".join(pack(k) + pack(v) for k, v in x.items())
    if isinstance(x, (list, tuple)):
        head = bytes([0x90 | len(x)]) if len(x) < 16 else _sized(len(x), None, 0xDC, 0xDD)
        return head + b"".join(map(pack, x))
    raise ValueError(f"cannot pack {type(x).__name__}")


def _sized(n: int, one: int | None, two: int, four: int) -> bytes:
    if one is not None and n < 1 << 8:
        return bytes([one, n])
    return bytes([two]) + struct.pack(">H", n) if n < 1 << 16 else bytes([four]) + struct.pack(">I", n)


_FIXED = {0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q", 0xCA: ">f", 0xCB: ">d"}
_LENGTHS = {0xC4: (">B", bytes), 0xC5: (">H", bytes), 0xC6: (">I", bytes), 0xD9: (">B", str), 0xDA: (">H", str), 0xDB: (">I", str), 0xDC: (">H", list), 0xDD: (">I", list), 0xDE: (">H", dict), 0xDF: (">I", dict)}


def unpack(data: bytes) -> Any:
    x, at = _unpack(data, 0)
    if at != len(data):
        raise ValueError("bytes left over")
    return x


def _take(data: bytes, at: int, n: int) -> bytes:
    if at + n > len(data):
        raise ValueError("bytes are missing")
    return data[at : at + n]


def _unpack(data: bytes, at: int) -> tuple[Any, int]:
    tag = _take(data, at, 1)[0]
    at += 1
    if tag < 0x80:
        return tag, at
    if tag >= 0xE0:
        return tag - 256, at
    if tag in (0xC0, 0xC2, 0xC3):
        return {0xC0: None, 0xC2: False, 0xC3: True}[tag], at
    if form := _FIXED.get(tag):
        n = struct.calcsize(form)
        return struct.unpack(form, _take(data, at, n))[0], at + n
    if tag < 0xC0:
        n, kind = (tag & 0x0F, dict) if tag < 0x90 else (tag & 0x0F, list) if tag < 0xA0 else (tag & 0x1F, str)
    elif tag in _LENGTHS:
        form, kind = _LENGTHS[tag]
        k = struct.calcsize(form)
        n = struct.unpack(form, _take(data, at, k))[0]
        at += k
    else:
        raise ValueError("unknown type")
    if kind in (bytes, str):
        b = _take(data, at, n)
        return (b if kind is bytes else b.decode()), at + n
    if kind is list:
        out = []
        for _ in range(n):
            x, at = _unpack(data, at)
            out.append(x)
        return out, at
    held = {}
    for _ in range(n):
        k, at = _unpack(data, at)
        held[k], at = _unpack(data, at)
    if len(held) != n:
        raise ValueError("a key occurs twice")
    return held, at


def frame(kind: bytes, metadata: bytes, payload: bytes, magic: bytes = OWN.magic) -> bytes:
    return magic + bytes([VERSION, len(kind)]) + kind + struct.pack(">II", len(metadata), len(payload)) + metadata + payload


def split(data: bytes, magic: bytes = OWN.magic) -> tuple[bytes, bytes, bytes]:
    """(kind, metadata, payload); raises on anything but a whole frame."""
    n = len(magic)
    if len(data) < n + 10 or data[:n] != magic:
        raise ValueError("not a sketch envelope")
    if data[n] != VERSION:
        raise ValueError("unknown version")
    at = n + 2 + data[n + 1]
    kind = data[n + 2 : at]
    m, p = struct.unpack(">II", _take(data, at, 8))
    at += 8
    if len(data) != at + m + p:
        raise ValueError("lengths don't add up")
    return kind, data[at : at + m], data[at + m :]


def encode_hll(registers: np.ndarray, variant: str = "hll_classic", hip: tuple[float, float, float] | None = None, profile: HashProfile = OWN) -> bytes:
    n = len(registers)
    if n < 16 or n & (n - 1):
        raise ValueError("registers are a power of two")
    if (variant == "hll_hip") != (hip is not None):
        raise ValueError("only HIP has running figures")
    meta = profile.metadata(canonical_seed_index=profile.canonical_index, precision=n.bit_length() - 1)
    return frame(KINDS[variant], pack(meta), pack([np.asarray(registers, dtype=np.uint8).tobytes(), *map(float, hip or ())]), profile.magic)


def decode_hll(data: bytes, profile: HashProfile = OWN) -> tuple[str, np.ndarray, tuple[float, ...]]:
    """(variant, registers, HIP figures)."""
    kind, meta, payload = split(data, profile.magic)
    variant = next((k for k, v in KINDS.items() if v == kind and k.startswith("hll")), None)
    if variant is None:
        raise ValueError("not a HyperLogLog")
    state = unpack(payload)
    held = unpack(meta)
    want = profile.metadata(canonical_seed_index=profile.canonical_index, precision=held.get("precision"))
    if held != want or not isinstance(state, list) or len(state) != (4 if variant == "hll_hip" else 1):
        raise ValueError("metadata or payload don't fit")
    registers = np.frombuffer(state[0], dtype=np.uint8)
    p = held["precision"]
    if not isinstance(p, int) or len(registers) != 1 << p or registers.max(initial=0) > 64 - p + 1:
        raise ValueError("registers don't fit the precision")
    return variant, registers, tuple(state[1:])


def encode_count_min(counts: np.ndarray, mode: str = "fast", profile: HashProfile = OWN) -> bytes:
    if mode not in ("fast", "regular") or counts.ndim != 2:
        raise ValueError("counts have rows and columns, and a mode of fast or regular")
    whole = counts.dtype.kind in "iu"
    meta = profile.metadata(matrix_seed_index=profile.matrix_index, rows=counts.shape[0], cols=counts.shape[1], counter_type="i64" if whole else "f64", mode=mode)
    flat = [int(x) for x in counts.ravel()] if whole else [float(x) for x in counts.ravel()]
    return frame(KINDS["count_min"], pack(meta), pack([flat]), profile.magic)


def decode_count_min(data: bytes, profile: HashProfile = OWN) -> tuple[np.ndarray, str]:
    """(counts, mode)."""
    kind, meta, payload = split(data, profile.magic)
    if kind != KINDS["count_min"]:
        raise ValueError("not a Count-Min sketch")
    held, state = unpack(meta), unpack(payload)
    shape = {k: held.get(k) for k in ("rows", "cols", "counter_type", "mode")}
    if held != profile.metadata(matrix_seed_index=profile.matrix_index, **shape) or shape["counter_type"] not in ("i64", "f64") or shape["mode"] not in ("fast", "regular"):
        raise ValueError("metadata don't fit")
    if not isinstance(state, list) or len(state) != 1 or len(state[0]) != shape["rows"] * shape["cols"]:
        raise ValueError("counts don't fit rows and columns")
    kind_of = int if shape["counter_type"] == "i64" else float
    if any(type(x) is not kind_of for x in state[0]):
        raise ValueError("counts are of another type")
    return np.array(state[0], dtype=np.int64 if kind_of is int else np.float64).reshape(shape["rows"], shape["cols"]), shape["mode"]


def packed(sketch: DataFrame, by: Sequence[str], columns: Sequence[str], make: Callable[[pa.Table], bytes]) -> DataFrame:
    """One envelope a group, null or not. A group's rows are bounded by the sketch's shape, so they fit a task."""
    from pyspark.sql.pandas.types import to_arrow_schema

    by = list(by)
    df = sketch if by else sketch.withColumn("all_", F.lit(0))
    keys = by or ["all_"]
    few = df.select(*keys, *columns)
    kind = T.StructType([*few.schema.fields[: len(keys)], T.StructField("envelope", T.BinaryType())])
    arrow = to_arrow_schema(kind)

    def one(key: tuple, t: pa.Table) -> pa.Table:
        return pa.table([*(pa.array([k.as_py()], type=f.type) for k, f in zip(key, arrow, strict=False)), pa.array([make(t)], type=pa.binary())], schema=arrow)

    out = few.groupBy(*keys).applyInArrow(one, kind)
    return out if by else out.drop("all_")


def unpacked(envelopes: DataFrame, by: Sequence[str], schema: str, read: Callable[[bytes], dict[str, Sequence]]) -> DataFrame:
    """(groups..., columns of ``schema``) of what ``read`` gives for each envelope, as lists of equal length."""
    from pyspark.sql.pandas.types import to_arrow_schema

    few = envelopes.select(*by, "envelope")
    own = T.StructType.fromDDL(schema)
    kind = T.StructType([*few.schema.fields[:-1], *own.fields])
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in enumerate(batch.column("envelope").to_pylist()):
                got = read(data)
                n = len(next(iter(got.values())))
                yield pa.RecordBatch.from_arrays([*(pa.array([batch.column(c)[i].as_py()] * n, type=arrow.field(c).type) for c in by), *(pa.array(got[f.name], type=arrow.field(f.name).type) for f in own)], schema=arrow)

    return few.mapInArrow(run, kind)


def _registers(t: pa.Table, p: int) -> np.ndarray:
    out = np.zeros(1 << p, dtype=np.uint8)
    out[t.column("reg").to_numpy()] = t.column("rho").to_numpy()
    return out


def pack_hll(sketch: DataFrame, *, p: int, by: Sequence[str] = (), variant: str = "hll_classic", profile: HashProfile = OWN) -> DataFrame:
    return packed(sketch, by, ["reg", "rho"], lambda t: encode_hll(_registers(t, p), variant, profile=profile))


def pack_hip(sketch: DataFrame, estimates: DataFrame, *, p: int, by: Sequence[str] = (), profile: HashProfile = OWN) -> DataFrame:
    """Envelopes of registers and their groups' (groups..., est); the running sums follow from the registers."""

    def make(t: pa.Table) -> bytes:
        registers = _registers(t, p)
        low = registers < 32
        sums = [float(np.ldexp(1.0, -registers[x].astype(np.int32)).sum()) for x in (low, ~low)]
        return encode_hll(registers, "hll_hip", (*sums, float(t.column("est")[0].as_py())), profile)

    return packed(groups.join(sketch, estimates.select(*by, "est"), by), by, ["reg", "rho", "est"], make)


def unpack_hll(envelopes: DataFrame, *, by: Sequence[str] = (), profile: HashProfile = OWN) -> DataFrame:
    """(groups..., reg, rho) of envelopes of any variant."""

    def read(data: bytes) -> dict[str, Sequence]:
        registers = decode_hll(data, profile)[1]
        at = np.flatnonzero(registers)
        return {"reg": at.astype(np.int32), "rho": registers[at].astype(np.int32)}

    return unpacked(envelopes, by, "reg int, rho int", read)


def pack_count_min(sketch: DataFrame, *, rows: int, cols: int, by: Sequence[str] = (), mode: str = "fast", profile: HashProfile = OWN) -> DataFrame:
    """Counters are whole numbers or doubles, as the sketch's column is."""
    kind = np.float64 if dict(sketch.dtypes)["cnt"] in ("double", "float") else np.int64
    return packed(sketch, by, ["row", "col", "cnt"], lambda t: encode_count_min(grid(t, rows, cols, kind), mode, profile))


def grid(t: pa.Table, rows: int, cols: int, kind: type = np.float64) -> np.ndarray:
    """The matrix of (row, col, cnt)."""
    counts = np.zeros((rows, cols), dtype=kind)
    counts[t.column("row").to_numpy(), t.column("col").to_numpy()] = t.column("cnt").to_numpy()
    return counts


def cells_of(counts: np.ndarray) -> dict[str, Sequence]:
    i, j = np.nonzero(counts)
    return {"row": i.astype(np.int32), "col": j, "cnt": counts[i, j]}


def unpack_count_min(envelopes: DataFrame, *, by: Sequence[str] = (), counter: str = "long", profile: HashProfile = OWN) -> DataFrame:
    """(groups..., row, col, cnt) of envelopes; ``counter`` is long or double, and envelopes of the other kind raise."""

    def read(data: bytes) -> dict[str, Sequence]:
        counts, _ = decode_count_min(data, profile)
        if (counts.dtype.kind == "f") != (counter == "double"):
            raise ValueError(f"the envelope doesn't hold counters of type {counter}")
        return cells_of(counts)

    return unpacked(envelopes, by, f"row int, col long, cnt {counter}", read)


def varint_pairs(registers: np.ndarray) -> bytes:
    """The registers above zero as pairs of varints: the gap to the one before, and the value."""
    out, last = bytearray(), -1
    for i in np.flatnonzero(registers).tolist():
        for x in (i - last - 1, int(registers[i])):
            while x >= 0x80:
                out.append(x & 0x7F | 0x80)
                x >>= 7
            out.append(x)
        last = i
    return bytes(out)


def from_varint_pairs(data: bytes, n: int) -> np.ndarray:
    numbers, x, shift = [], 0, 0
    for b in data:
        x |= (b & 0x7F) << shift
        shift += 7
        if b < 0x80:
            numbers.append(x)
            x = shift = 0
    if shift or len(numbers) % 2:
        raise ValueError("pairs are cut off")
    out, at = np.zeros(n, dtype=np.uint8), -1
    for gap, value in zip(numbers[::2], numbers[1::2], strict=True):
        at += gap + 1
        if at >= n or not 0 < value < 256:
            raise ValueError("no such register")
        out[at] = value
    return out


def scaled(values: Sequence[float]) -> tuple[int, int, list[int]] | None:
    """(scale, offset, whole residuals) with value = (residual + offset) / 10^scale exactly, or none such for scales 0 to
    6; a compact form of sample values."""
    for scale in range(7):
        whole = [round(v * 10**scale) for v in values]
        if all(w / 10**scale == v for w, v in zip(whole, values, strict=True)):
            offset = min(whole, default=0)
            return scale, offset, [w - offset for w in whole]
    return None


def unscaled(scale: int, offset: int, residuals: Sequence[int]) -> list[float]:
    return [(r + offset) / 10**scale for r in residuals]
