"""E1, E2, E3, M1-M6 on small known inputs."""

import numpy as np
from pyspark.sql import functions as F

from conftest import SF01
from weftcore.operators import evaluate as ev
from weftcore.operators import models
from weftcore.streaming.kmeans import streaming_kmeans_update


def _pts(spark, rows):
    return spark.createDataFrame([(i, r, 1.0) for i, r in enumerate(rows)],
                                 "pid long, features array<double>, weight double")


def test_kmeans_cost(spark):
    p = _pts(spark, [[0.0, 0.0], [1.0, 0.0], [10.0, 10.0]])
    c = ev.kmeans_cost(p, [[0.0, 0.0], [10.0, 9.0]]).first().cost
    assert abs(c - 2.0) < 1e-12


def test_svd_cost_identity(spark):
    rng = np.random.default_rng(0)
    rows = rng.normal(size=(50, 3)).tolist()
    p = _pts(spark, rows)
    r = ev.svd_cost(p, [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0]]).first()
    a = np.array(rows)
    assert abs(r.projection_norm - np.linalg.norm(a[:, :2])) < 1e-9
    assert abs(r.residual_norm - np.linalg.norm(a[:, 2])) < 1e-9
    assert abs(r.projection_norm ** 2 + r.residual_norm ** 2 - r.frobenius_norm ** 2) < 1e-8


def test_svd_axes_match_numpy(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(200, 5)) * np.array([5, 3, 1, 0.5, 0.1])
    axes = models.svd_axes(_pts(spark, a.tolist()), 2)
    _, _, vt = np.linalg.svd(a, full_matrices=False)
    for got, exp in zip(axes, vt[:2]):
        assert abs(abs(np.dot(got, exp)) - 1.0) < 1e-8


def test_progressive_cost(spark):
    p = _pts(spark, [[0.0], [2.0], [4.0], [6.0]]).withColumnRenamed("pid", "idx")
    res = spark.createDataFrame([(0, [[0.0]], 2, 1, "x-kmeans"), (1, [[4.0]], 2, 1, "x-kmeans"),
                                 (2, [], 0, 0, "x-kmeans")],
                                "batch_id long, points array<array<double>>, num_points long, "
                                "sample_size int, alg_name string")
    out = {r.batch_id: (r.cum_points, r.cost) for r in ev.evaluate(p, res, "x-kmeans").collect()}
    assert out == {0: (2, 4.0), 1: (4, 16 + 4 + 0 + 4)}


def test_cost_kind_errors():
    import pytest
    assert ev.cost_kind("coreset-kmeans") == "kmeans"
    with pytest.raises(ValueError):
        ev.cost_kind("coreset-kmeans2")


def test_streaming_kmeans_update(spark):
    p = _pts(spark, [[0.0], [1.0], [10.0], [11.0]])
    c, w = streaming_kmeans_update(p, [[0.0], [10.0]], [0.0, 0.0])
    assert c == [[0.5], [10.5]] and w == [2.0, 2.0]
    c2, w2 = streaming_kmeans_update(_pts(spark, [[2.5]]), c, w)
    assert abs(c2[0][0] - (0.5 * 2 + 2.5) / 3) < 1e-12 and w2 == [3.0, 2.0]


def test_bulk_and_weighted_kmeans(spark):
    e = spark.read.parquet(f"{SF01}/embeddings.parquet")
    from weftcore.sources.points import points_from_array
    p = points_from_array(e, "vec_id", "embedding")
    full = models.bulk_kmeans(p, 10, seed=1)
    assert len(full) == 10 and len(full[0]) == 64
    from weftcore.operators.samplers import LightSampler
    s = LightSampler().sample(p, [], 100, 1).persist()
    core = models.weighted_kmeans(s, 10, seed=1)
    c_full = ev.kmeans_cost(p, full).first().cost
    c_core = ev.kmeans_cost(p, core).first().cost
    assert c_core < 1.5 * c_full


def _sparse(df):
    from weftcore.functions.vectors import dense_to_sparse
    return df.withColumn("features", dense_to_sparse("features"))


def test_costs_dense_and_sparse_agree(spark):
    rng = np.random.default_rng(2)
    rows = (rng.normal(size=(60, 5)) * (rng.random((60, 5)) > 0.5)).tolist()
    p = _pts(spark, rows)
    axes = [[2.0, 0.0, 1.0, 0.0, 0.0], [0.0, 1.0, 1.0, 0.0, 3.0]]  # neither unit nor orthogonal
    a, v = np.array(rows), np.array(axes).T
    for df in (p, _sparse(p)):
        r = ev.svd_cost(df, axes).first()
        assert abs(r.projection_norm - np.linalg.norm(a @ v @ v.T)) < 1e-9
        assert abs(r.residual_norm - np.linalg.norm(a - a @ v @ v.T)) < 1e-9
    res = spark.createDataFrame([(b, axes, 30, 1, "x-svd") for b in (0, 1)], "batch_id long, points array<array<double>>, num_points long, sample_size int, alg_name string")
    for df in (p, _sparse(p)):
        df = df.withColumnRenamed("pid", "idx")
        for kind, want in (("x-svd", [np.linalg.norm(a[:n] @ v @ v.T) for n in (30, 60)]),
                           ("x-kmeans", [((a[:n, None] - v.T[None]) ** 2).sum(2).min(1).sum() for n in (30, 60)])):
            got = [r.cost for r in ev.evaluate(df, res, kind).orderBy("batch_id").collect()]
            assert np.allclose(got, want)
    # a cost of one's own: the number of points
    mine = (lambda x, xx, model: np.ones(len(x)), lambda c: c)
    assert [r.cost for r in ev.progressive_cost(p.withColumnRenamed("pid", "idx"), res, mine).orderBy("batch_id").collect()] == [30.0, 60.0]


def test_many_results_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ev, "BLOCK_CELLS", 3)
    p = _pts(spark, [[float(i)] for i in range(20)]).withColumnRenamed("pid", "idx")
    res = spark.createDataFrame([(b, [[0.0], [1.0]], 2, 1, "x-kmeans") for b in range(10)], "batch_id long, points array<array<double>>, num_points long, sample_size int, alg_name string")
    got = [r.cost for r in ev.evaluate(p, res, "x-kmeans").orderBy("batch_id").collect()]
    assert got == [sum(min(i * i, (i - 1) ** 2) for i in range(2 * b + 2)) for b in range(10)]


def test_dimension_checks(spark):
    import pytest
    two, mixed, none = _pts(spark, [[0.0, 1.0]]), _pts(spark, [[0.0, 1.0], [0.0]]), _pts(spark, [[0.0]]).limit(0)
    for points, centres in ((two, [[0.0, 0.0, 0.0]]), (two, [[0.0, 0.0], [0.0]]), (mixed, [[0.0, 0.0]]), (none, [[0.0]]), (two, [])):
        with pytest.raises(ValueError):
            ev.kmeans_cost(points, centres)
        with pytest.raises(ValueError):
            ev.svd_cost(points, centres)
    bad = spark.createDataFrame([(0, [[0.0], [1.0, 2.0]])], "batch_id long, points array<array<double>>")
    with pytest.raises(Exception, match="several dimensions"):
        ev.centre_stats(bad).collect()


def test_svd_and_gram_sparse(spark):
    from weftcore.functions.linalg import gram_matrix, matrix_cells, transpose
    rng = np.random.default_rng(4)
    a = rng.normal(size=(300, 40)) * (rng.random((300, 40)) > 0.7) * np.linspace(5, 0.1, 40)
    w = rng.random(300) + 0.5
    p = spark.createDataFrame([(i, r, float(x)) for i, (r, x) in enumerate(zip(a.tolist(), w))], "pid long, features array<double>, weight double").repartition(40)
    _, _, vt = np.linalg.svd(a * np.sqrt(w)[:, None], full_matrices=False)
    for df in (p, _sparse(p)):
        for got, exp in zip(models.svd_axes(df, 3, weighted=True), vt[:3]):
            assert abs(abs(np.dot(got, exp)) - 1.0) < 1e-7
        g = np.zeros((40, 40))
        for r in gram_matrix(df, weight="weight").collect():
            g[r.i, r.j] = r.value
        assert np.allclose(g, (a * w[:, None]).T @ a)
    t = transpose(matrix_cells(spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "i int, row array<double>")))
    assert sorted(map(tuple, t.collect())) == [(0, 0, 1.0), (0, 1, 3.0), (1, 0, 2.0), (1, 1, 4.0)]


def test_sparse_kmeans_and_stream_step(spark):
    p = _pts(spark, [[0.0, 1.0], [0.0, 2.0], [10.0, 0.0], [11.0, 0.0], [0.0, 1.5]])
    c = sorted(models.bulk_kmeans(_sparse(p), 2, seed=1))
    assert np.allclose(c, [[0.0, 1.5], [10.5, 0.0]])
    dense, sparse = (streaming_kmeans_update(df, [[0.0, 0.0], [9.0, 0.0]], [1.0, 2.0], 0.5) for df in (p, _sparse(p)))
    assert np.allclose(dense[0], sparse[0]) and dense[1] == sparse[1]


def test_sparse_seeds_among_equal_points(spark):
    # a third of the points are one vector; four groups of two points each lie far from a crowd
    far = [[100.0 * (g == j) + 0.1 * i for j in range(4)] for g in range(4) for i in range(2)]
    crowd = [[0.01 * i, 0.0, 0.0, 1.0] for i in range(30)]
    rows = [[0.0, 0.0, 0.0, 1.5]] * 20 + crowd + far
    for seed in range(3):
        p = _sparse(_pts(spark, rows))
        seeds = models.sparse_seeds(p, 5, seed)
        assert len({tuple(s) for s in seeds.tolist()}) == 5
        centres = np.array(models.weighted_kmeans(p, 5, seed))
        a = np.array(rows)
        near = ((a[:, None] - centres[None]) ** 2).sum(2)
        assert len(set(near.argmin(1).tolist())) == 5 and near.min(1).sum() < 50
    assert len(models.weighted_kmeans(_sparse(_pts(spark, [[0.0, 1.0]] * 5)), 3, 1)) == 1
