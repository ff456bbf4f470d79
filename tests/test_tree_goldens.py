"""The reference's tree tests: 110 ints in 11 leaves, systematic sampler,
fan-in 2, s = 5 (leaf golden and forest golden), plus the chunk rule."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftcore.operators.samplers import SystematicSampler, UniformSampler
from weftcore.operators.tree import TreeConfig, leaf_sample, suggest_leaves, tree_reduce


@pytest.fixture()
def ints(spark):
    return spark.range(110).select(
        F.col("id").alias("pid"), F.array(F.col("id").cast("double")).alias("features"),
        F.lit(1.0).alias("weight"), F.floor(F.col("id") / 10).cast("long").alias("leaf"))


def test_flat_sample(spark, ints):
    cfg = TreeConfig(sample_size=5, fan_in=2)
    rows = leaf_sample(ints, cfg, SystematicSampler(), 0).collect()
    assert all(r.level == 0 for r in rows)
    by_leaf = {}
    for r in rows:
        by_leaf.setdefault(r.pid // 10, []).append(r.pid)
    assert len(by_leaf) == 11
    for p, pids in by_leaf.items():
        assert sorted(pids) == [10 * p + 2 * i for i in range(5)]
    nodes = Counter(r.node for r in rows)
    assert {n: c // 5 for n, c in nodes.items()} == {0: 2, 1: 2, 2: 2, 3: 2, 4: 2, 5: 1}


def test_tree_sample(spark, ints):
    cfg = TreeConfig(sample_size=5, fan_in=2)
    leaves = leaf_sample(ints, cfg, SystematicSampler(), 0)
    stats = []
    tree = tree_reduce(leaves, cfg, SystematicSampler(), 0, stats)
    got = {(r.level, r.node): sorted(r.p) for r in
           tree.groupBy("level", "node").agg(F.collect_list("pid").alias("p")).collect()}
    assert got == {(0, 5): [100, 102, 104, 106, 108],
                   (1, 2): [80, 84, 88, 92, 96],
                   (3, 0): [0, 16, 32, 48, 64]}
    assert stats[-1][2] == 0  # the last round moved nothing


def test_chunk_rule_small_containers_untouched(spark):
    # 3 leaves of 7 points, T = 2 * 5 = 10: every leaf stays whole.
    pts = spark.range(21).select(F.col("id").alias("pid"), F.array(F.col("id").cast("double")).alias("features"),
                                 F.lit(1.0).alias("weight"), (F.col("id") % 3).alias("leaf"))
    cfg = TreeConfig(5, 2)
    out = leaf_sample(pts, cfg, UniformSampler(), 1)
    assert out.count() == 21
    assert out.agg(F.sum("weight")).first()[0] == 21.0


def test_fan_in_one_rejected():
    with pytest.raises(ValueError):
        TreeConfig(5, 1)


def test_empty_tree_unchanged(spark):
    from weftcore.sources.points import empty_points
    e = empty_points(spark).select(F.lit(0).alias("level"), F.lit(0).cast("long").alias("node"), "*")
    assert tree_reduce(e, TreeConfig(5, 2), UniformSampler(), 0).count() == 0


def test_suggest_leaves():
    cfg = TreeConfig(100, 2)
    assert suggest_leaves(1_000_000, cfg, 8) == 5000
    assert suggest_leaves(1000, cfg, 8) == 5
    assert suggest_leaves(10, cfg, 8) == 1
