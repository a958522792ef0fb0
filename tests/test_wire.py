"""Envelopes: exact bytes of small parts, round trips, and readers that fail closed."""

import numpy as np
import pytest

from tidemark.functions import portable, wire
from tidemark.operators import cardinality, matrix, quantiles, sampling, sets, subpopulation, topk
from tidemark.operators.matrix import MatrixConfig


def test_integers_take_the_narrowest_form():
    forms = {1: "01", 127: "7f", 128: "cc80", 300: "cd012c", 65536: "ce00010000", 1 << 40: "cf0000010000000000", -1: "ff", -33: "d0df", -300: "d1fed4"}
    for n, form in forms.items():
        assert wire.pack(n).hex() == form and wire.unpack(bytes.fromhex(form)) == n
    assert wire.pack(1.5).hex() == "cb3ff8000000000000"


def test_nested_round_trip():
    x = {"a": [1, -2, 3.5, None, True, "é" * 40, b"\x00" * 300], "b": {str(i): i for i in range(20)}}
    assert wire.unpack(wire.pack(x)) == x


def test_hll_round_trip():
    registers = np.zeros(4096, dtype=np.uint8)
    registers[[0, 2, 77, 4000]] = [9, 1, 50, 5]
    assert (wire.from_varint_pairs(wire.varint_pairs(registers), 4096) == registers).all()
    for variant, hip in (("hll_classic", None), ("hll_ertl", None), ("hll_hip", (4000.5, 0.25, 95.0))):
        data = wire.encode_hll(registers, variant, hip)
        got, back, figures = wire.decode_hll(data)
        assert got == variant and (back == registers).all() and figures == (hip or ())
        for broken in (data[:-1], data + b"\x00", b"X" + data[1:], data[:6] + b"\x02" + data[7:]):
            with pytest.raises(ValueError):
                wire.decode_hll(broken)
        with pytest.raises(ValueError):
            wire.decode_hll(data, wire.HashProfile(profile_id="other"))
        with pytest.raises(ValueError):
            wire.decode_count_min(data)


@pytest.mark.parametrize("counts", [np.array([[7, 0, -5, 200], [70_000, 1 << 40, 3, 1]]), np.array([[0.5, 0.0], [-2.75, 1e300]])])
def test_count_min_round_trip(counts):
    back, mode = wire.decode_count_min(wire.encode_count_min(counts, "regular"))
    assert mode == "regular" and back.dtype == counts.dtype and (back == counts).all()


def test_sketches_of_groups_travel(spark):
    df = spark.createDataFrame([(g, k) for g in "ab" for k in range(50)], "g string, k long")
    config = MatrixConfig(rows=3, cols=64)
    sketch = matrix.build(df, "k", config, by="g")
    back = wire.unpack_count_min(wire.pack_count_min(sketch, rows=3, cols=64, by=["g"]), by=["g"])
    key = ["g", "row", "col", "cnt"]
    assert {tuple(r) for r in back.select(key).collect()} == {tuple(r) for r in sketch.select(key).collect()}
    row = wire.pack_hll(cardinality.hll(df, "k"), p=14).first()
    assert (wire.decode_hll(bytes(row.envelope))[1] > 0).sum() == cardinality.hll(df, "k").count()


def rows_of(df):
    return sorted((tuple(bytes(x) if isinstance(x, bytearray) else x for x in r) for r in df.collect()), key=str)


def test_doubles_null_groups_and_hip_travel(spark):
    df = spark.createDataFrame([(g, k, k) for g in ("a", None) for k in range(50)], "g string, k long, t long")
    config = MatrixConfig(rows=3, cols=64)
    sketch = sampling.build(df, "k", "k", config, 0.4, by="g")
    packed = wire.pack_count_min(sketch, rows=3, cols=64, by=["g"])
    assert rows_of(wire.unpack_count_min(packed, by=["g"], counter="double").select("g", "row", "col", "cnt")) == rows_of(sketch.select("g", "row", "col", "cnt"))
    with pytest.raises(Exception, match="counters of type long"):
        wire.unpack_count_min(packed, by=["g"]).collect()
    registers, est = cardinality.hip_state(df, "k", "t", by="g", p=12)
    hip = wire.pack_hip(registers, est, p=12, by=["g"])
    assert rows_of(wire.unpack_hll(hip, by=["g"])) == rows_of(registers.select("g", "reg", "rho"))
    for r in hip.collect():
        variant, held, (low, high, figure) = wire.decode_hll(bytes(r.envelope))
        assert variant == "hll_hip" and low + high == np.ldexp(1.0, -held.astype(int)).sum() and abs(figure - 50) < 2


def test_portable_forms_travel(spark):
    df = spark.createDataFrame([(g, f"k{k % 9}", float(k)) for g in ("a", None) for k in range(1, 60)], "g string, k string, v double")
    config = MatrixConfig(rows=3, cols=16)
    cms, half = matrix.build(df, "k", config, by="g"), matrix.build(df.where("v < 30"), "k", config, by="g")
    heap = topk.from_sketch(cms, df, "k", 4, config, by="g")
    doubles = cms.selectExpr("g", "row", "col", "cast(cnt as double) as cnt")
    dd, kll = quantiles.ddsketch(df, "v", by="g"), quantiles.kll(df, "v", by="g")
    shape = {"rows": 3, "cols": 16}
    cases = [
        ("count_min", doubles, shape),
        ("count_min_heap", portable.with_heap(cms, heap, "k", by=["g"]), shape | {"k": 4}),
        ("count_sketch", portable.with_heap(cms, heap, "k", by=["g"]), shape),
        ("ddsketch", dd.select("g", "bucket", "cnt"), {"alpha": 0.01}),
        ("kll", kll, {"k": 200}),
        ("kmv", cardinality.kmv(df, "k", k=4, by="g"), {"k": 4}),
        ("set", sets.members(df, "k", by="g"), {}),
        ("set_delta", sets.difference(sets.members(df.where("v < 5"), "k", by="g"), sets.members(df.where("v > 2 and v < 8"), "k", by="g"), by="g"), {}),
        ("matrix_delta", matrix.delta(cms, half, by="g"), shape),
        ("hll_delta", cardinality.hll(df, "k", by="g"), {}),
        ("ddsketch_delta", quantiles.dd_delta(dd, quantiles.ddsketch(df.where("v < 30"), "v", by="g"), by="g").select("g", "bucket", "cnt"), {}),
    ]
    for form, sketch, more in cases:
        sketch = sketch.cache()
        packed = portable.pack(sketch, form, by=["g"], **more).cache()
        back = portable.unpack(packed, form, by=["g"])
        assert packed.count() == 2 and rows_of(back.select(*sketch.columns)) == rows_of(sketch), form
        with pytest.raises(ValueError):
            portable.FORMS[form].read([1] * 7)
    keyed = subpopulation.keyed(df, "k", "v", rows=2, cols=8)
    back = portable.unpack(portable.pack(keyed, "hydra_kll", rows=2, cols=8, k=200), "hydra_kll")
    assert back.count() == keyed.count()
    ask = lambda s: rows_of(subpopulation.keyed_quantiles(s, df, "k", [0.5], rows=2, cols=8))
    assert ask(back) == ask(back) and len(ask(back)) == 9
    assert wire.unpack(bytes(portable.pack(spark.createDataFrame([("b",), ("a",)], "member string"), "set").first().envelope)) == [["a", "b"]]


def test_scaled_values():
    assert wire.unscaled(*wire.scaled([1.25, 3.5, -2.0])) == [1.25, 3.5, -2.0]
    assert wire.scaled([1 / 3]) is None
