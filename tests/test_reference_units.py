"""The reference's unit tests re-expressed: inner join with duplicates,
sparse point display, ids of a first-s sampler, three far groups."""

from pyspark.sql import functions as F

from weftcore.functions.vectors import sparse_text
from weftcore.operators import relational as rel
from weftcore.operators.models import weighted_kmeans
from weftcore.operators.samplers import (ClusterMeanSampler, FirstSampler, SensitivitySampler,
                                         take, take_ids)
from weftcore.sources.text import parse_sparse


def test_inner_join_bag(spark):
    left = spark.createDataFrame([(i, str(i)) for i in range(1, 6)], "k int, s string")
    right = spark.createDataFrame([(2, 2.0), (3, 3.0), (5, 5.0), (5, 5.0)], "k int, d double")
    for out in (rel.inner_join(left, right, "k"), rel.inner_join(left, right, "k", "shuffle_hash"),
                rel.broadcast_join(left, right, "k"), rel.broadcast_join(right, left, "k")):
        got = sorted((r.s, r.d) for r in out.collect())
        assert got == [("2", 2.0), ("3", 3.0), ("5", 5.0), ("5", 5.0)]


def test_sparse_point_text(spark):
    df = spark.createDataFrame([("7 10 2 1.0",)], "value string")
    p = parse_sparse(df).select(sparse_text("features").alias("t"), "features.size").first()
    assert p.t == "(10,[1],[1.0])"
    assert p.size == 10


SPARSE_LINES = ["0 100 1 0.0 2 1.0 3 2.0 10 10.0", "1 100 1 0.0 2 1.0 3 2.0 10 10.0",
                "2 100 1 0.0 2 1.0 3 2.0 50 50.0", "3 100 1 0.0 2 1.0 3 2.0 90 90.0"]


def test_sample_taker_by_id(spark):
    lines = spark.createDataFrame([(i, v) for i, v in enumerate(SPARSE_LINES)], "pid long, value string")
    pts = parse_sparse(lines, keep=["pid"], mode="FAILFAST").withColumn("weight", F.lit(1.0))
    by_id = {r.pid: (tuple(r.features.indices), tuple(r.features.values)) for r in pts.collect()}
    for s in range(5):
        ids = [r.pid for r in take_ids(pts, s, FirstSampler(), 0).collect()]
        assert len(ids) == s
        assert sorted(by_id[i] for i in ids) == sorted(by_id[i] for i in range(s))


def _three_groups(spark):
    vals = [(-100000.0 - r) for r in range(100)] + [float(r) for r in range(100)] + \
           [100000.0 + r for r in range(100)]
    rows = [(i, [vals[i % 300]], 1.0) for i in range(3000)]
    return spark.createDataFrame(rows, "pid long, features array<double>, weight double")


def test_three_groups_sensitivity(spark):
    pts = _three_groups(spark)
    sampler = SensitivitySampler(k=3, seed=1).prepare(pts)
    s = take(pts, 30, sampler, 7, check=True).persist()
    assert s.count() <= 30
    centres = sorted(c[0] for c in weighted_kmeans(s, 3, seed=3))
    for c, target in zip(centres, (-100050.0, 50.0, 100050.0)):
        assert abs(c - target) < 200.0


def test_three_groups_cluster_means(spark):
    pts = _three_groups(spark)
    s = ClusterMeanSampler().sample(pts, [], 3, 5).collect()
    assert len(s) <= 3
    assert abs(sum(r.weight for r in s) - 3000.0) < 1e-9
    mean = sum(r.weight * r.features[0] for r in s) / 3000.0
    assert abs(mean - 16.5) < 1e-6  # (-100049.5 + 49.5 + 100049.5) / 3
