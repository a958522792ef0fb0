"""Accuracy budgets, merge homomorphism and hand-written cases."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import cardinality, histogram, matrix, ordered, quantiles, sampling, sets, subpopulation, topk, universal
from tidemark.operators.ensemble import Ensemble
from tidemark.operators.matrix import MatrixConfig, count_sketch
from tidemark.sources import tables
from tidemark.streaming import windows


@pytest.fixture(scope="module")
def zipf(spark):
    w = 1 / np.arange(1, 1025) ** 1.1
    keys = np.random.default_rng(1).choice(1024, 20_000, p=w / w.sum())
    return spark.createDataFrame(pd.DataFrame({"seq": np.arange(len(keys)), "key": keys})).cache()


def counts_of(df):
    return {r.key: r["count"] for r in df.groupBy("key").count().collect()}


def cells(sketch):
    return {tuple(r) for r in sketch.select("row", "col", "cnt").collect()}


@pytest.mark.parametrize("config", [MatrixConfig(cols=1024), MatrixConfig(cols=1024, fast=False), MatrixConfig(cols=1024, profile="xxhash64"), count_sketch(rows=5, cols=1024)])
def test_frequency_bounds(spark, zipf, config):
    exact = counts_of(zipf)
    got = {r.key: r.est for r in matrix.query(matrix.build(zipf, "key", config), zipf, "key", config).collect()}
    assert got.keys() == exact.keys()
    if config.signed:
        bad = sum(abs(got[k] - n) > 3 * math.sqrt(sum(v * v for v in exact.values()) / config.cols) for k, n in exact.items())
    else:
        assert all(got[k] >= n for k, n in exact.items())
        bad = sum(got[k] - n > math.e / config.cols * 20_000 for k, n in exact.items())
    assert bad <= 0.05 * len(exact)


def test_merge_is_build_of_union_and_partitions_dont_matter(zipf):
    config = count_sketch(rows=3, cols=256)
    whole = cells(matrix.build(zipf, "key", config))
    a, b = zipf.where("seq % 2 = 0"), zipf.where("seq % 2 = 1")
    assert cells(matrix.merge(matrix.build(a, "key", config), matrix.build(b, "key", config))) == whole
    for n in (1, 7, 64):
        assert cells(matrix.build(zipf.repartition(n), "key", config)) == whole


def test_configs_must_agree(zipf):
    a, b = MatrixConfig(cols=256), MatrixConfig(cols=512)
    with pytest.raises(ValueError):
        matrix.merge(zipf, zipf, configs=[a, b])
    with pytest.raises(ValueError):
        MatrixConfig(rows=6)
    with pytest.raises(ValueError):
        matrix.fold_width(MatrixConfig(cols=300), 1)
    with pytest.raises(ValueError):
        Ensemble(a=a, b=b)


def test_nulls_and_empty(spark):
    df = spark.createDataFrame([(None, 1), ("a", 2)], "key string, w long")
    config = MatrixConfig()
    assert [(r.key, r.est) for r in matrix.query(matrix.build(df, "key", config, weight="w"), df, "key", config).collect()] == [("a", 2)]
    none = df.where("false")
    assert matrix.build(none, "key", config).count() == 0
    assert cardinality.hll_classic(cardinality.hll(none, "key"), by=None).first().est == 0
    assert quantiles.dd_quantiles(quantiles.ddsketch(none.select(F.lit(1.0).alias("v")), "v"), [0.5]).count() == 0


def test_l2_with_deletes(spark):
    config = count_sketch(rows=3, cols=64)
    df = spark.createDataFrame([("a", 5)], "key string, w long")
    back = df.unionByName(spark.createDataFrame([("a", -2)], "key string, w long"))
    for rows, value in ((df, 5), (back, 3)):
        assert matrix.query(matrix.build(rows, "key", config, weight="w"), rows, "key", config).first().est == value


def test_topk_recall_and_hand_case(spark, zipf):
    config = MatrixConfig(rows=3, cols=2048)
    exact = {r.key for r in topk.exact(zipf, "key", 16).collect()}
    assert len(exact & {r.key for r in topk.sketched(zipf, "key", 16, config).collect()}) >= 15
    df = spark.createDataFrame([(k, 10 * k) for k in range(1, 6)], "key long, w long")
    assert sorted(r.est for r in topk.sketched(df, "key", 3, config, weight="w").collect()) == [30, 40, 50]


@pytest.mark.parametrize(("p", "bound"), [(12, 0.03), (14, 0.02), (16, 0.02)])
def test_distinct_bounds(spark, p, bound):
    for n in (10, 1000, 50_000):
        sketch = cardinality.hll(spark.range(n), "id", p=p)
        assert abs(cardinality.hll_classic(sketch, p=p).first().est - n) <= max(1, 2 * bound * n)
        assert abs(cardinality.hll_ertl(sketch, p=p).first().est - n) <= max(1, 2 * bound * n)
    est = cardinality.kmv_estimate(cardinality.kmv(spark.range(50_000), "id", k=4096), k=4096).first().est
    assert abs(est - 50_000) <= 0.05 * 50_000


def test_hll_delta_restores(spark):
    before, after = cardinality.hll(spark.range(500), "id"), cardinality.hll(spark.range(2000), "id")
    merged = cardinality.hll_merge(before, cardinality.hll_delta(after, before))
    assert {tuple(r) for r in merged.collect()} == {tuple(r) for r in after.collect()}


def walked_hip(rows, p):
    """HIP by walking the rows in order."""
    m = 1 << p
    registers, s, est = {}, float(m), 0.0
    for _, reg, rho in sorted(rows):
        old = registers.get(reg, 0)
        if rho > old:
            est += m / s
            s += 2.0**-rho - 2.0**-old
            registers[reg] = rho
    return est


def test_hip_is_the_walk_and_has_no_merge(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 2 == 0, "x").alias("g"), (F.col("id") % 1700).alias("k"), F.timestamp_seconds(F.col("id") / 3).alias("t"))
    got = {r.g: r.est for r in cardinality.hip(df, "k", "t", by="g", p=8).collect()}
    rows = cardinality.ranked(df, "k", 8, ["g", "t"]).toPandas()
    assert got.keys() == {"x", None}
    for g, est in got.items():
        own = rows[rows.g.isna() if g is None else rows.g == g]
        assert math.isclose(est, walked_hip(zip(own.t, own.reg.tolist(), own.rho.tolist(), strict=True), 8))
    assert abs(cardinality.hip(df, "k", "t").first().est - 1700) < 0.03 * 1700
    with pytest.raises(ValueError):
        cardinality.refuse_merge(df, df)


def test_hll_ranges(spark):
    large = spark.createDataFrame([(r, 26) for r in range(16)], "reg int, rho int")
    raw = 0.673 * 256 / (16 * 2.0**-26)
    assert cardinality.hll_classic(large, p=4).first().est == int(raw)
    assert cardinality.hll_classic(large, p=4, large=True).first().est == int(-cardinality.RANGE * math.log(1 - raw / cardinality.RANGE))
    with pytest.raises(ValueError):
        cardinality.hll(large, "reg", p=3)
    with pytest.raises(ValueError):
        cardinality.kmv_merge(large, large, k=8, ks=[8, 16])


def test_kmv_keeps_the_least_of_each_group(spark, monkeypatch):
    df = spark.range(20_000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"), (F.col("id") % 6000).alias("k"))
    for held in (1 << 21, 100):
        monkeypatch.setattr(cardinality, "HELD", held)
        got = cardinality.kmv(df, "k", k=50, by="g")
        want = {(r.g, r.hash) for r in cardinality._smallest(df.select("g", F.conv(F.substring(F.md5(F.col("k").cast("string")), 1, 13), 16, 10).cast("long").alias("hash")), 50, ["g"]).collect()}
        assert {tuple(r) for r in got.collect()} == want and len(want) == 150


def test_ddsketch(spark):
    df = spark.createDataFrame([(float(v),) for v in [0, -5, 1, 2, 3, 10, 50, 100, 1000]], "v double")
    got = quantiles.dd_summary(quantiles.ddsketch(df, "v")).first()
    assert (got.n, got.min, got.max) == (7, 1.0, 1000.0)
    values = np.random.default_rng(2).uniform(1e6, 1e7, 5000)
    df = spark.createDataFrame(pd.DataFrame({"v": values}))
    for r in quantiles.dd_quantiles(quantiles.ddsketch(df, "v"), [0.1, 0.5, 0.9, 0.99]).collect():
        exact = np.sort(values)[math.ceil(r.q * 5000) - 1]
        assert abs(r.value - exact) <= 0.0101 * exact
    with pytest.raises(ValueError):
        quantiles.dd_merge(df, df, alphas=[0.01, 0.02])


def test_kll_rank_error(spark, zipf):
    df = spark.createDataFrame(pd.DataFrame({"v": np.random.default_rng(3).uniform(100, 1000, 50_000)}))
    values = np.sort(df.toPandas().v.to_numpy())
    for r in quantiles.kll_quantiles(quantiles.kll(df, "v"), [0.1, 0.5, 0.9]).collect():
        assert abs(np.searchsorted(values, r.value) / 50_000 - r.q) <= 0.02


def test_kll_kinds_distribution_and_interpolation(spark):
    values = np.random.default_rng(5).integers(0, 100_000, 20_000)
    df = spark.createDataFrame(pd.DataFrame({"v": values, "g": np.where(values % 2, "a", None)}))
    for kind in ("double", "bigint"):
        sketch = quantiles.kll(df, "v", kind=kind)
        for r in quantiles.kll_quantiles_interpolated(sketch, [0.05, 0.5, 0.95], kind=kind).collect():
            assert abs((values <= r.value).mean() - r.q) <= 0.02
    steps = quantiles.kll_cdf(quantiles.kll(df, "v", by="g"), by="g").toPandas()
    assert set(steps.g.fillna("~")) == {"a", "~"}
    for _, own in steps.sort_values("value").groupby(steps.g.fillna("~")):
        assert own.fraction.is_monotonic_increasing and own.fraction.iloc[-1] == 1 and math.isclose(own.w.sum(), own.cum.max())
    with pytest.raises(ValueError):
        quantiles.kll(df, "v", k=3)


def test_cdf_has_one_running_sum_whatever_the_partitions(spark):
    df = spark.createDataFrame(pd.DataFrame({"v": np.random.default_rng(4).integers(0, 500, 3000).astype(float)}))
    got = quantiles.cdf(quantiles.counts(df, "v")).orderBy("value").toPandas()
    assert (got.cum == got.w.cumsum()).all() and got.fraction.iloc[-1] == 1


def test_hydra_hand_case(spark):
    rows = [("key1", "key2", "key3", 10.0), ("key1", "key2", "key4", 10.0), ("key1", "key2", "key3", 20.0), ("key1", "key2", "key3", 30.0)]
    rows += [("key4", "key5", "key6", v) for v in (40.0, 50.0, 60.0)] + [("key7", "key8", "key9", v) for v in (70.0, 80.0, 90.0)]
    df = spark.createDataFrame(rows, "d1 string, d2 string, d3 string, value double")
    inner = MatrixConfig(rows=3, cols=256)
    asked = spark.createDataFrame([("d1=key1", 10.0), ("d1=key1", 20.0), ("d1=key1", 30.0)], "subset string, value double")
    got = {r.value: r.est for r in subpopulation.query_frequency(subpopulation.frequency(df, ["d1", "d2", "d3"], "value", inner), asked, "value", inner).collect()}
    assert got == {10.0: 2, 20.0: 1, 30.0: 1}
    with pytest.raises(ValueError):
        subpopulation.query("hll", "frequency")
    with pytest.raises(ValueError):
        subpopulation.subsets(df, [f"d{i}" for i in range(11)], [F.count("*").alias("n")])


def test_hydra_tells_null_from_absent_and_escapes(spark):
    df = spark.createDataFrame([(None, "a;b"), ("x", "a;b")], "d1 string, d2 string")
    got = {r.subset: r.n for r in subpopulation.subsets(df, ["d1", "d2"], [F.count("*").alias("n")]).collect()}
    assert got == {"d1=\\N": 1, "d1=x": 1, "d2=a\\;b": 2, "d1=\\N;d2=a\\;b": 1, "d1=x;d2=a\\;b": 1}
    df = spark.createDataFrame([(None, "a"), ("\\N", "a"), ("a\\", "a"), ("a;d2", "=")], "d1 string, d2 string")
    keys = [r.subset for r in subpopulation.fanned(df, ["d1"], []).collect()]
    assert sorted(keys) == sorted(["d1=\\N", "d1=\\\\N", "d1=a\\\\", "d1=a\\;d2"])
    assert {r.subset for r in subpopulation.fanned(df, ["d1", "d2"], []).collect()} == {r.subset for r in subpopulation.subsets(df, ["d1", "d2"], [F.count("*").alias("n")]).collect()}


def test_universal(spark, zipf):
    exact, est = universal.exact_metrics(zipf, "key").first(), universal.metrics(zipf, "key").first()
    assert est.n == exact.n == 20_000
    assert abs(est.l2 - exact.l2) <= 0.15 * exact.l2
    assert abs(est.entropy - exact.entropy) <= 0.15 * exact.entropy
    two = spark.createDataFrame([("A", 10), ("B", 20)], "key string, w long")
    got = universal.metrics(two, "key", weight="w").first()
    assert round(got.l1) == 30 and round(got.card) == 2


def test_stored_layered_sketches_merge_and_answer(spark, zipf):
    config = universal.UnivConfig(layers=6, rows=3, cols=512, k=16)
    whole = universal.build(zipf, "key", config).cache()
    parts = [universal.build(zipf.where(f"seq % 3 = {i}"), "key", config) for i in range(3)]
    merged = universal.merge(*parts, config=config)
    cells = lambda s: {tuple(r) for r in s.where("row > -2").collect()}
    assert cells(merged) == cells(whole)
    a, b = universal.ask(whole, config).first(), universal.ask(merged, config).first()
    assert a.n == b.n == 20_000 and abs(a.l2 - b.l2) < 0.05 * a.l2 and abs(a.entropy - b.entropy) < 0.1 * a.entropy
    assert {tuple(r) for r in universal.ask(whole, config).collect()} == {tuple(r) for r in universal.metrics(zipf, "key", config).collect()}


def test_hydra_kinds(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame(pd.DataFrame({"a": rng.choice(["x", "y", None], 3000), "b": rng.integers(0, 3, 3000), "v": rng.uniform(1, 100, 3000), "k": rng.integers(0, 40, 3000)}))
    grid, dims = MatrixConfig(rows=3, cols=256, salt="hydra"), ["a", "b"]
    exact = subpopulation.subsets(df, dims, [F.count("*").alias("n"), F.percentile("v", 0.5).alias("mid"), F.countDistinct("k").alias("keys")]).toPandas().set_index("subset")
    asked = spark.createDataFrame([(x,) for x in exact.index], "subset string")
    halves = [df.where("k < 20"), df.where("k >= 20")]
    config = universal.UnivConfig(layers=3, rows=3, cols=256, k=64)
    for kind, make in (("ddsketch", subpopulation.dd_cells), ("kll", subpopulation.kll_cells), ("values", subpopulation.values)):
        merged = subpopulation.merge(kind, *(make(h, dims, "v", grid=grid) for h in halves))
        for r in subpopulation.query(kind, "quantile", merged, asked, [0.5], grid=grid).collect():
            assert abs(r.value - exact.mid[r.subset]) < 6, (kind, r)
        for r in subpopulation.query(kind, "cdf", merged, asked, [50.0], grid=grid).collect():
            assert 0.4 < r.fraction < 0.6
    univ = subpopulation.merge("univmon", *(subpopulation.univ_cells(h, dims, "k", config, grid=grid) for h in halves), config=config)
    for r in subpopulation.query("univmon", "cardinality", univ, asked, config, grid=grid).collect():
        assert abs(r.card - exact["keys"][r.subset]) <= 6
    for r in subpopulation.query("univmon", "l1", univ, asked, config, grid=grid).collect():
        assert abs(r.l1 - exact.n[r.subset]) <= 0.15 * exact.n[r.subset]
    with pytest.raises(ValueError):
        subpopulation.query("kll", "l1", univ, asked)
    with pytest.raises(ValueError):
        subpopulation.merge("counts", univ, asked)


def test_nitro_is_unbiased_and_checks_rates(zipf):
    config = MatrixConfig(rows=5, cols=1024)
    sketch = sampling.build(zipf, "seq", "key", config, 0.2)
    top = topk.exact(zipf, "key", 1).first()
    assert abs({r.key: r.est for r in sampling.estimate(sketch, zipf, "key", config).collect()}[top.key] - top.cnt) < 0.15 * top.cnt
    with pytest.raises(ValueError):
        sampling.check_rate(0)
    with pytest.raises(ValueError):
        sampling.merge([sketch, sketch], [0.2, 0.1])


def test_ensemble(zipf):
    both = Ensemble(cms=MatrixConfig(cols=1024), cs=count_sketch(cols=1024))
    built = both.build(zipf, "key").cache()
    config = MatrixConfig(cols=1024)
    alone = {tuple(r) for r in matrix.query(matrix.build(zipf, "key", config), zipf, "key", config).collect()}
    assert {tuple(r) for r in both.estimate(built, "cms", zipf, "key").collect()} == alone
    assert abs(both.cardinality(built).first().est - len(counts_of(zipf))) <= 0.04 * len(counts_of(zipf))
    with pytest.raises(ValueError):
        both.estimate(built, "hll", zipf, "key")


def test_sample_sizes_and_merge(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    whole = quantiles.uniform_sample(df, "k", 0.05)
    halves = [quantiles.uniform_sample(df.where(f"k % 2 = {i}"), "k", 0.05) for i in (0, 1)]
    merged = quantiles.merge_samples(halves, [500, 500], [0.05, 0.05], "k")
    assert whole.count() == merged.count() == 50


def test_elastic_and_coco_lose_nothing(spark):
    df = spark.createDataFrame([(i, f"k{i % 7 if i % 3 else 0}") for i in range(900)], "t long, key string")
    exact = {r.key: r["count"] for r in df.groupBy("key").count().collect()}
    built = ordered.elastic(df, "key", "t").cache()
    got = {r.key: r.est for r in ordered.elastic_query(built, df, "key").collect()}
    assert got == exact
    assert {r.key: r.est for r in matrix.query(ordered.elastic_merge(built), df, "key", ordered.ELASTIC).collect()} == exact
    table = ordered.coco(df, "key").cache()
    assert ordered.coco_estimate(table, "k").first().est == 900
    assert ordered.coco_estimate(table, "k0", lambda full, p: full == p).first().est == exact["k0"]
    assert ordered.coco_estimate(ordered.coco_merge(table, table), "k").first().est == 1800


def test_elastic_and_coco_equal_a_walk(spark, zipf):
    few = zipf.where("seq < 3000").withColumn("g", F.col("seq"))
    built = ordered.elastic(few, "key", "seq").toPandas()
    rows = few.select((F.conv(F.substring(F.md5(F.concat(F.lit("elastic:"), F.col("key").cast("string"))), 1, 8), 16, 10).cast("long") % 8).alias("b"), "key").orderBy("seq").collect()
    heavy, light = {}, {}
    for b, k in rows:
        h = heavy.setdefault(b, [str(k), 0, 0, False])
        if h[0] == str(k):
            h[1] += 1
            continue
        h[2] += 1
        if h[2] // h[1] < 8:
            light[str(k)] = light.get(str(k), 0) + 1
        else:
            light[h[0]] = light.get(h[0], 0) + h[1]
            heavy[b] = [str(k), 1, 1, True]
    got = built[built.heavy_key.notna()]
    assert {(r.bucket, r.heavy_key, r.positive, r.evicted) for r in got.itertuples()} == {(b, h[0], h[1], h[3]) for b, h in heavy.items()}
    assert built[built.light_key.notna()].groupby("light_key").light.sum().to_dict() == light
    exact = counts_of(few)
    for r in ordered.elastic_query(ordered.elastic(few, "key", "seq"), few, "key").collect():
        assert r.est >= exact[int(r.key)]
    assert ordered.coco_estimate(ordered.coco(few, "key", width=8, depth=2, parts=2), "").first().est == 3000


def test_built_in_summaries_are_near(spark, zipf):
    exact = counts_of(zipf)
    got = {r.key: r.cnt for r in topk.builtin(zipf, "key", 10).collect()}
    assert set(got) == {k for k, _ in sorted(exact.items(), key=lambda x: -x[1])[:10]} and all(abs(n - exact[k]) <= 0.02 * 20_000 for k, n in got.items())
    r = cardinality.builtin(zipf, "key").first()
    assert all(abs(x - len(exact)) <= 0.08 * len(exact) for x in r)
    r = sets.theta_overlap(zipf.where("seq < 12000"), zipf.where("seq >= 8000"), "key").first()
    a, b = ({x.key for x in zipf.where(c).select("key").distinct().collect()} for c in ("seq < 12000", "seq >= 8000"))
    for est, true in ((r.n_union, len(a | b)), (r.n_intersection, len(a & b)), (r.n_difference, len(a - b))):
        assert abs(est - true) <= 0.05 * len(a | b)
    few = subpopulation.keyed_merge(subpopulation.keyed(zipf.where("seq % 2 = 0").withColumn("g", F.col("key") % 3), "g", "seq"), subpopulation.keyed(zipf.where("seq % 2 = 1").withColumn("g", F.col("key") % 3), "g", "seq"))
    for r in subpopulation.keyed_quantiles(few, zipf.select((F.col("key") % 3).alias("g")), "g", [0.5]).collect():
        assert abs(r.value - 10_000) < 1000


@pytest.mark.parametrize("k", [1, 4, 7, 8])
def test_levels_are_those_of_single_inserts(spark, k):
    sizes = [0, 1, 2, 3, 5, 8, 13, 40, 99, 700]
    got = spark.createDataFrame([(n,) for n in sizes], "n long").withColumn("l", ordered.l1_levels(F.col("n"), k)).collect()
    for n, levels in got:
        h = ordered.ExponentialHistogram(k, 1e9)
        for t in range(n):
            h.update(t)
        ends = [levels[i + 1].first if i + 1 < len(levels) else None for i in range(len(levels))]
        made, at = [], 0
        for x, end in zip(levels, ends, strict=True):
            assert x.start == at
            many = (n - at) // x.size if end is None else end - x.first
            made += [x.size] * many
            at += many * x.size
        assert made[::-1] == [b[2] for b in h.buckets] and at == n


def test_exponential_histogram(spark):
    h = ordered.ExponentialHistogram(8, 100)
    for t in range(1000):
        h.update(t)
    n, _ = h.query(900, 999)
    assert abs(n - 100) <= 100 / 4 and len(h.buckets) < 60
    with pytest.raises(ValueError):
        ordered.ExponentialHistogram(0, 1)
    df = spark.range(500).select(F.when(F.col("id") % 2 == 0, 1.0).alias("g"), F.timestamp_seconds("id").alias("t"), F.lit(2.0).alias("v"))
    whole = ordered.exponential_histogram(df, "g", "t", k=4, window=1e9, value="v").toPandas()
    assert whole.cnt.sum() == 500 and whole.total.sum() == 1000 and whole.g.isna().any()
    squares = ordered.exponential_histogram(df, "g", "t", k=4, window=1e9, value="v", norm="l2").toPandas()
    assert squares.cnt.sum() == 500 and squares.g.isna().any() and len(squares) < 200
    late = ordered.exponential_histogram(df, "g", "t", k=4, window=50).toPandas()
    assert 50 <= late.cnt.sum() <= 100


def test_histograms_hold_any_family(spark, zipf):
    df = zipf.select(F.timestamp_seconds("seq").alias("t"), "key", F.when(F.col("key") % 2 == 0, "even").alias("g"))
    built = histogram.sketches(df, "key", "count_min", "t", k=8, window=1e9, by=["g"]).cache()
    whole = histogram.merged(built, "count_min", 0, 1e9, by=["g"])
    assert {tuple(r) for r in whole.collect()} == {tuple(r) for r in matrix.build(df, "key", MatrixConfig(), by="g").collect()}
    assert all(r.covered and r.min_time < 10 for r in histogram.cover(built, 10, 19_990, by=["g"]).collect())
    part = histogram.merged(built, "count_min", 15_000, 19_999, by=["g"]).where("row = 0").agg(F.sum("cnt")).first()[0]
    assert abs(part - 5000) <= 5000 / 4
    config = universal.UnivConfig(layers=6, rows=3, cols=512, k=16)
    maps, layered = histogram.hybrid(df, "key", "t", config, k=8, window=1e9, most_keys=200)
    assert maps.select("bucket").distinct().count() > 0 < layered.select("bucket").distinct().count()
    recent = histogram.hybrid_metrics(maps, layered, 19_990, 19_999, config).first()
    old = histogram.hybrid_metrics(maps, layered, 0, 19_999, config).first()
    assert recent.tier == "map" and recent.n >= 8 and old.tier == "sketch" and old.n == 20_000
    exact = universal.exact_metrics(df, "key").first()
    assert abs(old.l2 - exact.l2) <= 0.15 * exact.l2 and abs(old.entropy - exact.entropy) <= 0.15 * exact.entropy


def test_windows_count_by_calendar(spark):
    df = spark.createDataFrame([("2024-01-01 00:10:00", 1), ("2024-01-01 05:00:00", 2), ("2024-01-01 00:50:00", 3)], "ts string, key long")
    df = windows.timed(df, "ts")
    config = MatrixConfig()
    panes = windows.matrix_panes(df, "ts", "1 hour", "key", config)
    early = windows.matrix_of(windows.between(panes, "2024-01-01 00:00:00", "2024-01-01 01:00:00"))
    assert {r.key: r.est for r in matrix.query(early, df, "key", config).collect()} == {1: 1, 2: 0, 3: 1}
    assert windows.recent(panes, 1).select("window_start").distinct().count() == 1
    assert windows.evict(panes, 1).select("window_start").distinct().count() == 2
    got = windows.interval_metrics(windows.sliding_counts(df, "ts", "1 hour", "key")).first()
    assert (got.n, got.card) == (3, 3)


def test_set_changes(spark):
    a, b = (spark.createDataFrame([(x,) for x in s], "m string") for s in ("ab", "bc"))
    got = {tuple(r) for r in sets.difference(sets.members(b, "m"), sets.members(a, "m")).collect()}
    assert got == {("c", "added"), ("a", "removed")}


def test_sketches_keep_their_configuration(spark, zipf, tmp_path):
    config = MatrixConfig(cols=512)
    tables.save_sketch(matrix.build(zipf, "key", config), config, str(tmp_path / "s"))
    back, found = tables.load_sketch(spark, str(tmp_path / "s"), config)
    assert found == config and cells(back) == cells(matrix.build(zipf, "key", config))
    with pytest.raises(ValueError):
        tables.load_sketch(spark, str(tmp_path / "s"), MatrixConfig(cols=256))


def test_null_groups_count_like_others(spark):
    df = spark.createDataFrame([(g, k, i) for i, (g, k) in enumerate([(None, "a")] * 3 + [("x", "a")] * 2 + [(None, "b")])], "g string, k string, i long")
    config = MatrixConfig(cols=64)
    sketch = matrix.build(df, "k", config, by="g")
    assert {tuple(r) for r in matrix.query(sketch, df, "k", config, by="g").collect()} == {(None, "a", 3), ("x", "a", 2), (None, "b", 1)}
    assert matrix.delta(sketch, sketch, by="g").count() == 0
    h = cardinality.hll(df, "k", by="g")
    assert cardinality.hll_delta(h, h, by="g").count() == 0
    assert {(r.g, r.est) for r in cardinality.hll_classic(h, by="g").collect()} == {(None, 2), ("x", 1)} == {(r.g, r.est) for r in cardinality.hll_ertl(h, by="g").collect()}
    assert {(r.g, round(r.est)) for r in cardinality.kmv_estimate(cardinality.kmv(df, "k", by="g"), by="g").collect()} == {(None, 2), ("x", 1)}
    dd = quantiles.ddsketch(df.withColumn("v", F.col("i") + 1.0), "v", by="g")
    assert quantiles.dd_delta(dd, dd, by="g").count() == 0
    assert {(r.g, r.n, r.sum) for r in quantiles.dd_summary(dd, by="g").collect()} == {(None, 4, 12.0), ("x", 2, 9.0)}
    assert quantiles.dd_quantiles(dd, [0.5], by="g").count() == quantiles.dd_rank(dd, [3.0], by="g").count() == 2
    assert {(r.g, r.n, round(r.card)) for r in universal.metrics(df, "k", by="g").collect()} == {(None, 4, 2), ("x", 2, 1)}
    assert quantiles.uniform_sample(df, "i", 0.5, by="g").groupBy("g").count().where("g is null").first()["count"] == 2
    assert {tuple(r) for r in topk.sketched(df, "k", 1, config, by="g").collect()} == {(None, "a", 3), ("x", "a", 2)}
    assert quantiles.quantiles(quantiles.counts(df, "i", by="g"), [0.5], by="g").count() == quantiles.kll_quantiles(quantiles.kll(df, "i", by="g"), [0.5], by="g").count() == 2
    assert sampling.build(df, "i", "k", config, 1.0, by="g").agg(F.sum("cnt")).first()[0] == 18
    assert {(r.g, r.member) for r in sets.difference(sets.members(df, "k", by="g"), sets.members(df.where("g is null"), "k", by="g"), by="g").collect()} == {("x", "a")}


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line.strip() for line in plan.splitlines() if "Exchange" in line and "Broadcast" not in line]


def test_builds_shuffle_cells_not_keys(spark, zipf):
    config = MatrixConfig(cols=256)
    df = zipf.withColumns({"a": F.col("key") % 3, "b": F.col("key") % 5})
    builds = [
        (matrix.build(df, "seq", config), "row"),
        (matrix.build(df, "seq", count_sketch(cols=256), by="a"), "row"),
        (cardinality.hll(df, "seq"), "reg"),
        (Ensemble(cms=config).build(df, "seq"), "row"),
        (universal._cells(df, "seq", universal.UnivConfig(), None, []), "layer"),
        (subpopulation.frequency(df, ["a", "b"], "seq", config), "hrow"),
        (subpopulation.distinct(df, ["a", "b"], "seq"), "hrow"),
        (subpopulation.dd_cells(df, ["a", "b"], "seq"), "hrow"),
        (sampling.build(df, "seq", "key", config, 0.5), "row"),
    ]
    for built, name in builds:
        found = exchanges(built)
        assert len(found) == 1 and f"hashpartitioning({name}" in found[0] or f", {name}" in found[0], found


def test_sketches_of_any_kind_keep_their_configuration(spark, zipf, tmp_path):
    config = universal.UnivConfig(layers=4, rows=3, cols=64, k=8)
    built = universal.build(zipf, "key", config)
    tables.save_sketch(built, config, str(tmp_path / "u"))
    back, found = tables.load_sketch(spark, str(tmp_path / "u"))
    assert found == config and {tuple(r) for r in universal.ask(back, found).collect()} == {tuple(r) for r in universal.ask(built, config).collect()}
    tables.save_sketch(cardinality.hll(zipf, "key", p=10), {"p": 10}, str(tmp_path / "h"))
    back, found = tables.load_sketch(spark, str(tmp_path / "h"))
    assert cardinality.hll_classic(back, **found).first() == cardinality.hll_classic(cardinality.hll(zipf, "key", p=10), p=10).first()
    for wrong in ({"p": 12}, config):
        with pytest.raises(ValueError):
            tables.load_sketch(spark, str(tmp_path / "h"), wrong)


def run_stream(spark, out, name, mode):
    q = out.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_streamed_panes_equal_batch(spark, tmp_path):
    df = windows.timed(tables.table(spark, "/root/testdata/sf0.001", "events"), "ts").select("ts", "user_id", "event_type").where("ts < '2024-01-03'")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    config = MatrixConfig(rows=2, cols=64)
    live = tables.stream(spark, str(tmp_path / "in"), files_a_trigger=1)
    got = run_stream(spark, windows.matrix_panes(windows.timed(live, "ts", watermark="60 days"), "ts", "1 day", "user_id", config), "panes", "complete")
    want = windows.matrix_panes(df, "ts", "1 day", "user_id", config)
    key = ["window_start", "row", "col", "cnt"]
    assert {tuple(r) for r in got.select(key).collect()} == {tuple(r) for r in want.select(key).collect()}


def test_streamed_histogram_counts_all(spark, tmp_path):
    df = windows.timed(tables.table(spark, "/root/testdata/sf0.001", "events"), "ts").select("ts", "event_type")
    df.write.parquet(str(tmp_path / "in"))
    live = windows.timed(tables.stream(spark, str(tmp_path / "in")), "ts")
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # a time to live makes one batch follow another
    got = run_stream(spark, windows.streaming_histogram(live, "event_type", "ts", k=8, window=1e9, ttl_ms=10**9), "hist", "update")
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert got.agg(F.sum("cnt")).first()[0] == df.count()
    want = ordered.exponential_histogram(df, "event_type", "ts", k=8, window=1e9)
    assert sorted(r.cnt for r in got.collect()) == sorted(r.cnt for r in want.collect())


def test_live_sketches_answer_while_they_run(spark, tmp_path):
    df = windows.timed(tables.table(spark, "/root/testdata/sf0.001", "events"), "ts").select("ts", "user_id")
    df.write.parquet(str(tmp_path / "in"))
    config = MatrixConfig(rows=2, cols=64)
    stream = windows.timed(tables.stream(spark, str(tmp_path / "in")), "ts")
    query, read = windows.live(windows.matrix_panes(stream, "ts", "1 day", "user_id", config), "live_panes")
    try:
        query.processAllAvailable()
        assert query.isActive
        got = matrix.query(windows.matrix_of(read()), df, "user_id", config)
        assert {tuple(r) for r in got.collect()} == {tuple(r) for r in matrix.query(matrix.build(df, "user_id", config), df, "user_id", config).collect()}
    finally:
        query.stop()


def test_streamed_samples_are_those_of_the_batch(spark, tmp_path):
    df = tables.table(spark, "/root/testdata/sf0.001", "events").select("event_id", "user_id")
    df.write.parquet(str(tmp_path / "in"))
    config = MatrixConfig(rows=3, cols=64)
    got = run_stream(spark, sampling.build(tables.stream(spark, str(tmp_path / "in")), "event_id", "user_id", config, 0.5), "nitro", "complete")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in sampling.build(df, "event_id", "user_id", config, 0.5).collect()}
