"""Sampler and tree invariants on the driver tables."""

import pytest
from pyspark.sql import functions as F

from conftest import SF01
from weftcore.functions.hashing import uniform01
from weftcore.operators.samplers import (ClusterMeanSampler, LightSampler, NormSampler,
                                         UniformSampler, priority_select)
from weftcore.operators.tree import TreeConfig, coreset
from weftcore.sources.points import number_rows, points_from_columns


@pytest.fixture(scope="module")
def orders(spark):
    o = spark.read.parquet(f"{SF01}/orders.parquet")
    return points_from_columns(o, "o_orderkey", ["o_totalprice"]).persist()


@pytest.mark.parametrize("leaves,mode", [(1, "hash"), (7, "hash"), (16, "mod"), (5, "range")])
def test_uniform_tree_equals_global_bottom_k(spark, orders, leaves, mode):
    cs = coreset(orders, TreeConfig(40, 2, leaves=leaves, leaf_mode=mode), UniformSampler(), 9)
    got = sorted(r.pid for r in cs.collect())
    exp = sorted(r.pid for r in orders.orderBy(uniform01("pid", 9), "pid").limit(40).collect())
    assert got == exp
    assert abs(cs.agg(F.sum("weight")).first()[0] - 15000.0) < 1e-6


def test_same_seed_same_rows(spark, orders):
    a = LightSampler().sample(orders, [], 30, 3).collect()
    b = LightSampler().sample(orders.repartition(5), [], 30, 3).collect()
    # same rows; weights equal up to the summation order of the aggregates
    wa, wb = {r.pid: r.weight for r in a}, {r.pid: r.weight for r in b}
    assert wa.keys() == wb.keys()
    assert all(abs(wa[k] - wb[k]) <= 1e-9 * wa[k] for k in wa)


def test_keyed_priority_sample(spark, orders):
    df = orders.withColumn("g", F.col("pid") % 3)
    out = NormSampler().sample(df, ["g"], 10, 1)
    sizes = {r.g: r.c for r in out.groupBy("g").agg(F.count(F.lit(1)).alias("c")).collect()}
    assert sizes == {0: 10, 1: 10, 2: 10}


def test_small_group_unchanged(spark, orders):
    small = orders.limit(0).unionByName(orders.where(F.col("pid") < 8))
    out = priority_select(small, [], 10, 1, F.lit(1.0))
    assert sorted(r.pid for r in out.collect()) == list(range(8))
    assert {r.weight for r in out.collect()} == {1.0}


@pytest.mark.parametrize("bounded", [False, True])
def test_cluster_mean_preserves_weight_and_mean(spark, orders, bounded):
    df = orders.withColumn("g", F.col("pid") % 2)
    out = ClusterMeanSampler().sample(df, ["g"], 20, 4, bounded=bounded)
    tot = out.groupBy("g").agg(F.sum("weight").alias("w"),
                               F.sum(F.col("weight") * F.col("features")[0]).alias("m")).collect()
    exp = df.groupBy("g").agg(F.count(F.lit(1)).alias("w"),
                              F.sum(F.col("features")[0]).alias("m")).collect()
    e = {r.g: (r.w, r.m) for r in exp}
    for r in tot:
        assert abs(r.w - e[r.g][0]) < 1e-9
        assert abs(r.m - e[r.g][1]) / abs(e[r.g][1]) < 1e-9
    assert out.groupBy("g").count().where("count > 20").count() == 0


def test_priority_weights_unbiased_in_mean(spark, orders):
    # light importance is at least 1/(2n), so the weights are bounded and the
    # count estimate concentrates; squared-norm weights are heavy-tailed.
    ests = [LightSampler().sample(orders, [], 200, seed).agg(F.sum("weight")).first()[0]
            for seed in range(8)]
    mean = sum(ests) / len(ests)
    assert 0.85 * 15000 < mean < 1.15 * 15000


def test_number_rows_matches_row_number(spark):
    li = spark.read.parquet(f"{SF01}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey",
                                                                "l_suppkey", "l_quantity", "l_extendedprice",
                                                                "l_shipdate")
    order = li.columns
    got = number_rows(li, order, "idx", num_ranges=5)
    from pyspark.sql import Window
    exp = li.withColumn("idx", F.row_number().over(Window.orderBy(*order)) - 1)
    assert got.select(*order, "idx").exceptAll(exp.select(*order, "idx")).count() == 0
    assert got.count() == 60000
