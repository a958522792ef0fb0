"""Families behind one interface."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import registry, universal


@pytest.fixture(scope="module")
def df(spark):
    return spark.range(300).select((F.col("id") % 40).alias("k"), (F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("v")).cache()


@pytest.mark.parametrize("name", ["count_min", "count_sketch", "hll", "kmv", "ddsketch", "univmon", "pyramid"])
def test_merged_groups_are_the_whole(df, name):
    f = registry.family(name)
    whole = f.build(df, "v" if name == "ddsketch" else "k", [])
    merged = f.merged(f.build(df, "v" if name == "ddsketch" else "k", ["g"]))
    assert {tuple(r) for r in merged.select(*whole.columns).collect()} == {tuple(r) for r in whole.collect()}


@pytest.mark.parametrize("name", ["univmon", "pyramid"])
def test_stored_layered_sketches_answer(df, name):
    f = registry.family(name, "l2")
    merged = f.merged(f.build(df, "k", ["g"]))
    exact = universal.exact_metrics(df, "k").first()
    for q in ("l1", "l2", "entropy", "card"):
        assert abs(f.ask(q, merged).first()[q] - exact[q]) <= 0.2 * exact[q]


def test_samples_say_how_many_rows_there_were(df):
    got = registry.family("uniform").build(df, "v", ["g"]).collect()
    assert len(got) == 30 and {r.seen for r in got} == {100}


def test_what_cannot_be_raises(df):
    with pytest.raises(ValueError):
        registry.family("elastic")
    with pytest.raises(ValueError):
        registry.family("hll", "l2")
    with pytest.raises(ValueError):
        registry.family("hip").merged(df)
    with pytest.raises(ValueError):
        registry.family("hll").ask("quantile", df)


def test_shards_lose_nothing(df):
    parts, whole = registry.sharded(df, "k", "count_min", 5)
    assert parts.select("shard").distinct().count() == 5
    assert whole.where("row = 0").agg(F.sum("cnt")).first()[0] == 300


def test_one_shot_aggregates(df):
    none = df.where("false")
    assert registry.aggregate_count(none, "k") is None and registry.aggregate_kll(none, "v") is None
    assert registry.aggregate_sum(df, "k", "g").agg(F.sum("cnt")).first()[0] == 3 * 300
    assert registry.aggregate_topk(df, "k", "v", 3).count() == 3
    assert registry.aggregate_keyed_kll(df, "k", "v").count() > 0


def test_tables_made_on_the_way_go(spark):
    from tidemark.sources import scratch

    kept = scratch.Scratch(spark)
    with scratch.passing():
        way = scratch.Scratch(spark)
        table = way.save(spark.range(5))
        made = kept.save(table.selectExpr("id + 1 as id"))
    assert made.count() == 5
    with pytest.raises(Exception, match="not exist|NOT_EXIST|PATH_NOT_FOUND"):
        spark.read.parquet(table._tidemark_path).count()
    kept.drop(made)
    kept.close()
