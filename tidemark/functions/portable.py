"""Plain MessagePack forms of sketches and of their deltas, for readers that know the kind from elsewhere.

Each form is an array of fields in a fixed order, given below; matrices are arrays of rows of doubles. ``pack`` makes one
value a group, ``unpack`` gives the sketch's rows back; both work on groups that are null. A reader raises on a value with
other fields, lengths or types. What a group packs has to fit a row: sketches are bounded by their shape, plain sets aren't.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tidemark.functions import wire


@dataclass(frozen=True)
class Form:
    """Input columns, the value made of a group's rows and its shape, and the rows of a value."""

    columns: tuple[str, ...]
    schema: str
    make: Callable[[pa.Table, dict], list]
    read: Callable[[list], dict[str, Sequence]]


def _lists(t: pa.Table, *names: str) -> list[list]:
    return [t.column(c).to_pylist() for c in names]


def _ordered(t: pa.Table, *names: str) -> pa.Table:
    return t.sort_by([(c, "ascending") for c in names])


def _matrix(t: pa.Table, shape: dict) -> list[list[float]]:
    return [[float(x) for x in r] for r in wire.grid(t, shape["rows"], shape["cols"])]


def _cells(rows: Any, cols: Any, matrix: Any) -> dict[str, Sequence]:
    counts = np.array(matrix, dtype=np.float64)
    _check(counts.shape == (rows, cols))
    return wire.cells_of(counts)


def _check(fine: bool) -> None:
    if not fine:
        raise ValueError("the value doesn't have this form")


def _fields(x: Any, n: int) -> list:
    _check(isinstance(x, list) and len(x) == n)
    return x


def _heap(t: pa.Table) -> list[list]:
    """The heap's (key, value) pairs, heaviest first; rows with a key, where cells have none."""
    pairs = [(k, float(v)) for k, v in zip(*_lists(t, "key", "cnt"), strict=True) if k is not None]
    return [[k, v] for k, v in sorted(pairs, key=lambda p: (-p[1], p[0]))]


def _with_heap(cells: dict[str, Sequence], heap: list) -> dict[str, Sequence]:
    n, m = len(cells["row"]), len(heap)
    return {"row": [*cells["row"].tolist(), *[None] * m], "col": [*cells["col"].tolist(), *[None] * m], "cnt": [*cells["cnt"].tolist(), *(float(v) for _, v in heap)], "key": [*[None] * n, *(k for k, _ in heap)]}


def _cells_only(t: pa.Table) -> pa.Table:
    return t.filter(pc.is_valid(t.column("row")))


def _dd(t: pa.Table, shape: dict) -> list:
    buckets, counts = (t.column(c).to_numpy() for c in ("bucket", "cnt"))
    held = np.zeros(int(buckets.max() - buckets.min()) + 1, dtype=np.int64)
    held[buckets - buckets.min()] = counts
    return [float(shape["alpha"]), held.tolist(), int(buckets.min())]


def _dd_rows(x: list) -> dict[str, Sequence]:
    _, counts, offset = _fields(x, 3)
    held = np.array(counts, dtype=np.int64)
    at = np.flatnonzero(held)
    return {"bucket": (at + offset).astype(np.int32), "cnt": held[at]}


def _changed(t: pa.Table, shape: dict) -> list:
    return [shape["rows"], shape["cols"], *_lists(_ordered(t, "row", "col"), "row", "col", "cnt")]


def _pairs(*names: str) -> tuple[Callable, Callable]:
    def read(x: list) -> dict[str, Sequence]:
        a, b = _fields(x, 2)
        _check(len(a) == len(b))
        return dict(zip(names, (a, b), strict=True))

    return lambda t, shape: _lists(_ordered(t, names[0]), *names), read


def _triples(x: list) -> dict[str, Sequence]:
    _, _, row, col, cnt = _fields(x, 5)
    _check(len(row) == len(col) == len(cnt))
    return {"row": row, "col": col, "cnt": cnt}


def _hydra(t: pa.Table, shape: dict) -> list:
    held = {(i, j): b for i, j, b in zip(*_lists(t, "hrow", "hcol", "kll"), strict=True)}
    return [shape["rows"], shape["cols"], [[[shape["k"], held.get((i, j), b"")] for j in range(shape["cols"])] for i in range(shape["rows"])]]


def _hydra_rows(x: list) -> dict[str, Sequence]:
    rows, cols, cells = _fields(x, 3)
    _check(len(cells) == rows and all(len(r) == cols for r in cells))
    got = [(i, j, b) for i, r in enumerate(cells) for j, (_, b) in enumerate(r) if b]
    return {"hrow": [i for i, _, _ in got], "hcol": [j for _, j, _ in got], "kll": [b for _, _, b in got]}


def _kll_rows(x: list) -> dict[str, Sequence]:
    _, data = _fields(x, 2)
    return {"kll": [data]}


_CELLS = "row int, col long, cnt double"
_CHANGES = "row int, col long, cnt long"
FORMS: dict[str, Form] = {
    # matrix, rows, cols
    "count_min": Form(("row", "col", "cnt"), _CELLS, lambda t, s: [_matrix(t, s), s["rows"], s["cols"]], lambda x: _cells(*(y := _fields(x, 3))[1:], y[0])),
    # (matrix, rows, cols), (key, value) pairs, size of the heap
    "count_min_heap": Form(
        ("row", "col", "cnt", "key"),
        _CELLS + ", key string",
        lambda t, s: [[_matrix(_cells_only(t), s), s["rows"], s["cols"]], _heap(t), s["k"]],
        lambda x: _with_heap(_cells(*(y := _fields(_fields(x, 3)[0], 3))[1:], y[0]), x[1]),
    ),
    # rows, cols, matrix, (key, value) pairs
    "count_sketch": Form(
        ("row", "col", "cnt", "key"), _CELLS + ", key string", lambda t, s: [s["rows"], s["cols"], _matrix(_cells_only(t), s), _heap(t)], lambda x: _with_heap(_cells(*_fields(x, 4)[:3]), x[3])
    ),
    # alpha, counts of consecutive buckets, number of the first
    "ddsketch": Form(("bucket", "cnt"), "bucket int, cnt long", _dd, _dd_rows),
    # k, bytes
    "kll": Form(("kll",), "kll binary", lambda t, s: [s["k"], t.column("kll")[0].as_py()], _kll_rows),
    # rows, cols, rows of (k, bytes); cells without values have no bytes
    "hydra_kll": Form(("hrow", "hcol", "kll"), "hrow int, hcol long, kll binary", _hydra, _hydra_rows),
    # k, hashes in order
    "kmv": Form(("hash",), "hash long", lambda t, s: [s["k"], sorted(*_lists(t, "hash"))], lambda x: {"hash": _fields(x, 2)[1]}),
    # members
    "set": Form(("member",), "member string", lambda t, s: [sorted(*_lists(t, "member"))], lambda x: {"member": _fields(x, 1)[0]}),
    # members added, members removed
    "set_delta": Form(
        ("member", "change"),
        "member string, change string",
        lambda t, s: [sorted(m for m, c in zip(*_lists(t, "member", "change"), strict=True) if c == which) for which in ("added", "removed")],
        lambda x: {"member": [*_fields(x, 2)[0], *x[1]], "change": ["added"] * len(x[0]) + ["removed"] * len(x[1])},
    ),
    # rows, cols, rows, columns and changes of the cells
    "matrix_delta": Form(("row", "col", "cnt"), _CHANGES, _changed, _triples),
    # registers, ranks
    "hll_delta": Form(("reg", "rho"), "reg int, rho int", *_pairs("reg", "rho")),
    # buckets, added counts
    "ddsketch_delta": Form(("bucket", "cnt"), "bucket int, cnt long", *_pairs("bucket", "cnt")),
}


def with_heap(sketch: DataFrame, heap: DataFrame, key: str, value: str = "est", *, by: Sequence[str] = ()) -> DataFrame:
    """Cells and heavy keys as one relation (groups..., row, col, cnt, key), as the forms with a heap take it."""
    cells = sketch.selectExpr(*by, "row", "col", "cast(cnt as double) as cnt", "cast(null as string) as key")
    return cells.unionByName(heap.selectExpr(*by, "cast(null as int) as row", "cast(null as bigint) as col", f"cast({value} as double) as cnt", f"cast({key} as string) as key"))


def pack(sketch: DataFrame, form: str, *, by: Sequence[str] = (), **shape: Any) -> DataFrame:
    """(groups..., envelope); ``shape`` has what the form needs besides the rows: rows, cols, k or alpha."""
    f = FORMS[form]
    return wire.packed(sketch, by, f.columns, lambda t: wire.pack(f.make(t, shape)))


def unpack(packed: DataFrame, form: str, *, by: Sequence[str] = ()) -> DataFrame:
    f = FORMS[form]
    return wire.unpacked(packed, by, f.schema, lambda data: f.read(wire.unpack(data)))
