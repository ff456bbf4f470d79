"""Skew-safe ranking, sparse/dense sampler agreement, results checks,
report output and stream state retention."""

import os
import tempfile

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF001
from weftcore.functions.vectors import dense_to_sparse
from weftcore.operators.evaluate import write_report
from weftcore.operators.samplers import LightSampler, NormSampler, SensitivitySampler
from weftcore.sources.points import rank_within, read_results


def test_rank_within_hot_key(spark):
    # one key holds a third of all rows
    df = spark.range(3000).select(F.col("id").alias("pid"),
                                  F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % 50).alias("k"))
    got = rank_within(df, ["k"], ["pid"], "rn", count_col="n", num_ranges=7)
    w = Window.partitionBy("k")
    exp = df.withColumn("rn", F.row_number().over(w.orderBy("pid")).cast("long")) \
            .withColumn("n", F.count(F.lit(1)).over(w))
    assert got.select("pid", "k", "rn", "n").exceptAll(exp.select("pid", "k", "rn", "n")).count() == 0
    assert got.count() == 3000


def _dense_and_sparse(spark):
    e = spark.read.parquet(f"{SF001}/embeddings.parquet")
    f = F.transform(F.col("embedding").cast("array<double>"),
                    lambda x: F.when(F.abs(x) > 0.1, x).otherwise(F.lit(0.0)))
    dense = e.select(F.col("vec_id").alias("pid"), f.alias("features"), F.lit(1.0).alias("weight")).persist()
    sparse = dense.select("pid", dense_to_sparse("features").alias("features"), "weight").persist()
    return dense, sparse


@pytest.mark.parametrize("sampler", [LightSampler(), NormSampler()])
def test_sparse_matches_dense(spark, sampler):
    dense, sparse = _dense_and_sparse(spark)
    a = {r.pid: r.weight for r in sampler.sample(dense, [], 40, 3).collect()}
    b = {r.pid: r.weight for r in sampler.sample(sparse, [], 40, 3).collect()}
    assert a.keys() == b.keys()
    assert all(abs(a[k] - b[k]) <= 1e-9 * a[k] for k in a)


def test_sparse_sensitivity_centres_shared(spark):
    dense, sparse = _dense_and_sparse(spark)
    sd = SensitivitySampler(k=4, seed=2).prepare(dense)
    ss = SensitivitySampler(k=4, seed=2, centres=sd.centres)
    a = {r.pid for r in sd.sample(dense, [], 30, 5).collect()}
    b = {r.pid for r in ss.sample(sparse, [], 30, 5).collect()}
    assert a == b


def test_read_results_requires_one_per_batch(spark):
    d = tempfile.mkdtemp(prefix="weftcore-test-")
    rows = spark.createDataFrame([(1, 10), (1, 11), (2, 5)], "batch_id long, num_points long")
    rows.write.partitionBy("batch_id").parquet(os.path.join(d, "r"))
    with pytest.raises(ValueError):
        read_results(spark, os.path.join(d, "r"))
    assert read_results(spark, os.path.join(d, "r"), check=False).count() == 3


def test_write_report(spark):
    d = tempfile.mkdtemp(prefix="weftcore-test-")
    rep = spark.createDataFrame([(0, 1.5, [1.0])], "batch_id long, cost double, x array<double>")
    write_report(rep.drop("x"), os.path.join(d, "rep"))
    text = spark.read.text(os.path.join(d, "rep")).collect()
    assert text[0].value == "batch_id\tcost" and text[1].value == "0\t1.5"


def test_stream_state_retention(spark):
    from weftcore.operators.samplers import UniformSampler
    from weftcore.operators.tree import TreeConfig
    from weftcore.streaming.tree_stream import StreamingTreeSampler
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    pts = ev.select(F.col("event_id").alias("pid"), F.array("value").alias("features"), F.lit(1.0).alias("weight"))
    d = tempfile.mkdtemp(prefix="weftcore-test-")
    sts = StreamingTreeSampler(TreeConfig(20, 2, leaves=2), UniformSampler(), 1, os.path.join(d, "st"),
                               keep_versions=1)
    for b in range(3):
        sts.process_batch(pts.where(F.col("event_id") % 3 == b), b)
    kept = sorted(os.listdir(os.path.join(d, "st", "tree")))
    assert kept == ["batch_id=1", "batch_id=2"]  # the newest batch may run again from the one before it
    assert sts.current_tree(spark).count() > 0


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_leaf_limit_before_the_shuffle(spark):
    """With broadcasting off, a leaf's rows are limited below the first exchange."""
    from weftcore.operators.samplers import UniformSampler
    from weftcore.operators.tree import TreeConfig, assign_leaves, leaf_sample
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cfg = TreeConfig(20, 2, leaves=4)
        pts = spark.range(1000).select(F.col("id").alias("pid"), F.array(F.col("id").cast("double")).alias("features"), F.lit(1.0).alias("weight"))
        for sampler in (UniformSampler(weighted=False), UniformSampler(weighted=True), NormSampler()):
            plan = _plan(leaf_sample(assign_leaves(pts, cfg), cfg, sampler, 3))
            lines = [x for x in plan.split("\n") if "WindowGroupLimit" in x or "Exchange" in x]
            partial = next(i for i, x in enumerate(lines) if "WindowGroupLimit" in x and "Partial" in x)
            assert "Exchange" in lines[partial - 1]  # what stands above the limit; nothing shuffles below it
            assert partial == len(lines) - 1 or lines[partial + 1].index("Exchange") < lines[partial].index("WindowGroupLimit")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_plans_scan_once(spark):
    from weftcore.plans import registered as reg
    gram = _plan(reg.lineitem_points(spark, SF001, numbered=False))
    assert "Exchange" not in gram and "RDD" not in gram
    vec = _plan(reg.document_points(spark, SF001))
    assert "Exchange" not in vec and "Generate" not in vec


def test_planned_rounds_equal_written_rounds(spark):
    from weftcore.operators.samplers import UniformSampler
    from weftcore.operators.tree import TreeConfig, coreset
    pts = spark.range(3000).select(F.col("id").alias("pid"), F.array(F.col("id").cast("double") + 1).alias("features"), F.lit(1.0).alias("weight")).persist()
    for sampler in (lambda: UniformSampler(weighted=False), lambda: UniformSampler(weighted=True), NormSampler):
        cfg = TreeConfig(15, 3, leaves=40)
        a = {(r.pid, round(r.weight, 6)) for r in coreset(pts, cfg, sampler(), 3).collect()}
        b = {(r.pid, round(r.weight, 6)) for r in coreset(pts, cfg, sampler(), 3, stats=[]).collect()}
        assert a == b and len(a) == 15


def test_weighted_uniform_keeps_heavy_points(spark):
    from weftcore.operators.samplers import UniformSampler
    pts = spark.range(100).select(F.col("id").alias("pid"), F.array(F.lit(1.0)).alias("features"), F.when(F.col("id") == 7, 1000.0).otherwise(1.0).alias("weight"))
    total, heavy = [], []
    for seed in range(30):
        rows = UniformSampler().prepare(pts).sample(pts, [], 10, seed).collect()
        total.append(sum(r.weight for r in rows))
        heavy += [r.weight for r in rows if r.pid == 7]
    assert heavy == [1000.0] * 30 and abs(sum(total) / 30 - 1099) < 25


def test_sample_above_s_is_an_error(spark):
    from weftcore.operators.samplers import SystematicSampler, take
    pts = spark.range(11).select(F.col("id").alias("pid"), F.array(F.lit(1.0)).alias("features"), F.lit(1.0).alias("weight"))
    with pytest.raises(AssertionError):
        take(pts, 4, SystematicSampler(), 1)  # step 2 of 11 rows: six rows


def test_cluster_means_of_many_pieces(spark):
    from weftcore.operators.samplers import ClusterMeanSampler
    from weftcore.functions.vectors import dense_to_sparse
    pts = spark.range(900).select(F.col("id").alias("pid"), F.array(F.col("id") * 0.5, F.lit(0.0), F.lit(2.0)).alias("features"), F.lit(2.0).alias("weight"))
    for df in (pts, pts.withColumn("features", dense_to_sparse("features"))):
        out = ClusterMeanSampler(piece=100).sample(df, [], 12, 3)
        x = "features" if df is pts else "features.values"
        r = out.agg(F.count(F.lit(1)).alias("n"), F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col(x)[F.size(x) - 1]).alias("m")).first()
        assert r.n <= 12 and abs(r.w - 1800) < 1e-9 and abs(r.m - 3600) < 1e-6
