"""Block k-means, leverage sampling, cluster means, and model rows that wrong models fail."""

import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import SF01
from oracle_compare import _rows, oracle_con
from weftcore.functions.terms import hashed_terms
from weftcore.functions.vectors import dense_to_sparse
from weftcore.operators import evaluate as ev
from weftcore.operators import kmeans as km
from weftcore.operators import models
from weftcore.operators.samplers import ClusterMeanSampler, LeverageSampler, LocalSensitivitySampler
from weftcore.operators.samplers import is_sparse
from weftcore.operators.tree import TreeConfig, coreset
from weftcore.plans import oracles
from weftcore.plans import registered as reg
from weftcore.sources.points import materialize, number_rows

POINTS = "pid long, features array<double>, weight double"
SPARSE = "pid long, features struct<size:int,indices:array<int>,values:array<double>>, weight double"


def dense_points(spark, x, w=None):
    w = np.ones(len(x)) if w is None else w
    return spark.createDataFrame([(i, r, float(a)) for i, (r, a) in enumerate(zip(np.asarray(x, float).tolist(), w))], POINTS)


def sparse_of(df):
    return df.withColumn("features", dense_to_sparse("features"))


def random_sparse(seed, n=300, d=40, share=0.2):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d)) * (r.random((n, d)) < share)
    x[::17] = 0
    return x, r.random(n) + 0.5


def arrow_columns(x):
    idx = [np.flatnonzero(r).astype(np.int32) for r in x]
    return [pa.array(idx, pa.list_(pa.int32())), pa.array([r[i] for r, i in zip(x, idx)], pa.list_(pa.float64()))]


def test_blocks_equal_numpy(monkeypatch):
    x, w = random_sparse(1)
    c = np.vstack([x[3], x[8] + 1, np.zeros(40)])
    used = np.flatnonzero(c.any(axis=0))
    for size in (km.BLOCK, 64):
        monkeypatch.setattr(km, "BLOCK", size)
        for block in (km.Block.of([pa.array(x.tolist(), pa.list_(pa.float64()))]), km.Block.of(arrow_columns(x))):
            for centres in (km.Centres.of_dense(c), km.Centres(40, used, c[:, used])):
                np.testing.assert_allclose(block.products(centres), x @ c.T, atol=1e-12)
                b, d2 = block.nearest(centres)
                full = ((x[:, None] - c[None]) ** 2).sum(axis=2)
                np.testing.assert_allclose(d2, full.min(axis=1), atol=1e-10)
                assert (full[np.arange(len(x)), b] <= full.min(axis=1) + 1e-10).all()
            at, j, v = block.cells(b, w)
            total = np.zeros((3, 41))
            np.add.at(total, (at, j), v)
            want = np.array([w[b == k] @ x[b == k] for k in range(3)])
            np.testing.assert_allclose(total[:, :40], want, atol=1e-10)
            np.testing.assert_allclose(total[:, 40], [w[b == k].sum() for k in range(3)])


def plain_plus_plus(x, w, k, seed, steps=20):
    r = np.random.default_rng(seed)
    c = [x[r.choice(len(x), p=w / w.sum())]]
    while len(c) < k:
        d2 = ((x[:, None] - np.array(c)[None]) ** 2).sum(axis=2).min(axis=1) * w
        c.append(x[r.choice(len(x), p=d2 / d2.sum())])
    c = np.array(c)
    for _ in range(steps):
        b = ((x[:, None] - c[None]) ** 2).sum(axis=2).argmin(axis=1)
        c = np.array([(w[b == j] @ x[b == j]) / w[b == j].sum() if (b == j).any() else c[j] for j in range(k)])
    return float(w @ ((x[:, None] - c[None]) ** 2).sum(axis=2).min(axis=1))


def test_sparse_kmeans_costs_no_more_than_plain_plus_plus(spark):
    r = np.random.default_rng(5)
    centres = r.normal(size=(8, 60)) * (r.random((8, 60)) < 0.4) * 4
    x = centres[r.integers(0, 8, 600)] + r.normal(size=(600, 60)) * (r.random((600, 60)) < 0.3)
    w = r.random(600) + 0.5
    p = sparse_of(dense_points(spark, x, w)).coalesce(3).cache()
    plain = [plain_plus_plus(x, w, 8, s) for s in range(5)]
    mine = [float(ev.kmeans_cost(p, models.sparse_kmeans(p, 8, s), weighted=True).first().cost) for s in range(2)]
    assert np.mean(mine) <= np.mean(plain) * 1.001
    again = models.sparse_kmeans(p, 8, 0)
    np.testing.assert_allclose(again, models.sparse_kmeans(p, 8, 0), atol=1e-9)
    p.unpersist()


def test_lloyd_dense_equals_sparse_from_given_centres(spark):
    x, w = random_sparse(3)
    dense = dense_points(spark, x, w)
    start = km.Centres.of_dense(x[[1, 5, 9]])
    a, b = (km.lloyd(p, start, 7, 0.0) for p in (dense, sparse_of(dense)))
    np.testing.assert_allclose(a.centres.dense(), b.centres.dense(), atol=1e-10)
    assert a.cost == pytest.approx(b.cost) and a.steps == b.steps
    # a centre far from all points stays
    far = km.lloyd(dense, km.Centres.of_dense(np.vstack([x[1], np.full(40, 1e6)])), 2).centres.dense()
    assert (far[1] == 1e6).all()
    with pytest.raises(Exception, match="dimension"):
        models.weighted_kmeans(dense, 2, init=[[0.0], [1.0]])


def test_sparse_kmeans_at_many_coordinates(spark):
    d, n = 100_000, 2000
    df = spark.range(n).select(F.col("id").alias("pid"), F.struct(
        F.lit(d).alias("size"), F.expr("array_sort(array_distinct(transform(sequence(1, 60), k -> cast(pmod(hash(id % 5, k, if(k % 3 = 0, id, 0)), 100000) as int))))").alias("indices")).alias("f"))
    df = df.select("pid", F.struct("f.size", "f.indices", F.transform("f.indices", lambda i: F.lit(1.0)).alias("values")).alias("features"), F.lit(1.0).alias("weight"))
    p = materialize(df, "wide")
    began = time.time()
    centres = np.array(models.sparse_kmeans(p, 5, 1))
    assert centres.shape == (5, d) and time.time() - began < 30
    assert float(ev.kmeans_cost(p, centres.tolist()).first().cost) < 25 * n  # five groups that share two thirds of their entries


def test_hashed_terms(spark):
    import hashlib
    rows = [(0, "a b  a\nb"), (1, ""), (2, None), (3, " "), (4, "é é 中")]
    got = spark.createDataFrame(rows, "i int, t string").select("i", hashed_terms("t", 16).alias("v")).collect()
    for r, (_, t) in zip(sorted(got), rows):
        if t is None:
            assert r.v is None
            continue
        want = {}
        for x in t.split(" "):
            if x:
                b = int(hashlib.md5(x.encode()).hexdigest()[:8], 16) % 16
                want[b] = want.get(b, 0.0) + 1
        assert r.v["size"] == 16 and dict(zip(r.v["indices"], r.v["values"])) == want and r.v["indices"] == sorted(want)


def oracle_rows(name, columns):
    con = oracle_con(SF01)
    cur = con.execute(oracles.ORACLES[name])
    assert sorted(d[0] for d in cur.description) == sorted(columns)
    return _rows([d[0] for d in cur.description], cur.fetchall())


def spark_rows(df):
    return _rows(df.columns, [tuple(r) for r in df.collect()])


def test_wrong_axes_and_centres_turn_the_rows_red(spark):
    pts = reg.lineitem_points(spark, SF01, numbered=False)
    right, wrong = reg.axes_rows(models.svd_axes(pts, 2), pts), reg.axes_rows(models.svd_axes(pts, 4)[2:], pts)
    want = oracle_rows("svd_axes", right.columns)
    assert spark_rows(right) == want and spark_rows(wrong) != want
    e = reg.embedding_points(spark, SF01).drop("label")
    mean = np.mean([r.features for r in e.collect()], axis=0).tolist()
    good = models.bulk_kmeans(e, reg.KMEANS_K, max_iter=reg.KMEANS_STEPS, tol=0.0, init=reg.first_rows(e, reg.KMEANS_K))
    want = oracle_rows("bulk_kmeans", ["c", "j", "value", "cost", "fit_close"])
    assert spark_rows(reg.model_rows(good, e, False, good)) == want
    assert spark_rows(reg.model_rows([mean] * 10, e, False, good)) != want  # equal centres instead of Lloyd steps
    assert spark_rows(reg.model_rows(good, e, False, [mean] * 10)) != want  # or instead of the fit


def leverage(x, w, axes):
    p = x @ np.array(axes).T
    return w * (p * p / (w[:, None] * p * p).sum(axis=0)).sum(axis=1)


def test_leverage_dense_sparse_and_two_passes(spark):
    x, w = random_sparse(7)
    dense = dense_points(spark, x, w)
    _, _, vt = np.linalg.svd(x * np.sqrt(w)[:, None], full_matrices=False)
    for df in (dense, sparse_of(dense)):
        s = LeverageSampler(k=3).prepare(df)
        got = {r.pid: r.v for r in df.select("pid", s.row_importance(df).alias("v")).collect()}
        np.testing.assert_allclose([got[i] for i in range(len(x))], leverage(x, w, vt[:3]), atol=1e-7)
        assert sum(got.values()) == pytest.approx(3, abs=1e-6)  # weighted scores of k directions add up to k
        sample = s.sample(df, [], 40, 1)
        assert sample.count() == 40
        again = LeverageSampler(k=3)
        again.restore(s.state())
        assert sorted(r.pid for r in again.sample(df, [], 40, 1).collect()) == sorted(r.pid for r in sample.collect())
        tree = coreset(df, TreeConfig(20, 2, leaves=4), LeverageSampler(k=2), 1)
        assert tree.count() == 20
    # rows outside the axes come last
    flat = dense_points(spark, [[1.0, 0.0]] * 3 + [[0.0, 1.0]] * 5)
    assert sorted(r.pid for r in LeverageSampler(axes=[[1.0, 0.0]]).prepare(flat).sample(flat, [], 3, 1).collect()) == [0, 1, 2]
    none = dense_points(spark, np.zeros((0, 2)))
    assert LeverageSampler().prepare(none).sample(none, [], 3, 1).count() == 0


def test_cluster_means_keep_weight_mean_and_cost(spark):
    r = np.random.default_rng(11)
    x = (r.normal(size=(12, 10)) * 6)[r.integers(0, 12, 3000)] + r.normal(size=(3000, 10))
    w = r.random(3000) + 0.5
    for p, seeds in ((dense_points(spark, x, w), 5), (sparse_of(dense_points(spark, x, w)), 1)):
        p = p.coalesce(2).cache()
        full, small = [], []
        for seed in range(seeds):
            cs = materialize(coreset(p, TreeConfig(100, 2, leaves=8), ClusterMeanSampler(), seed), "sample")
            assert cs.count() <= 100
            rows = cs.withColumn("features", F.col("features") if not is_sparse(p) else F.expr(
                "transform(sequence(0, features.size - 1), i -> coalesce(element_at(map_from_arrays(features.indices, features.values), i), 0D))")).collect()
            a, m = np.array([q.weight for q in rows]), np.array([q.features for q in rows])
            assert a.sum() == pytest.approx(w.sum()) and np.allclose(a @ m, w @ x)
            small.append(float(ev.kmeans_cost(p, models.weighted_kmeans(cs, 12, seed), weighted=True).first().cost))
            full.append(float(ev.kmeans_cost(p, models.kmeans_centres(p, 12, seed), weighted=True).first().cost))
        assert np.mean(small) <= 1.1 * np.mean(full)
        p.unpersist()


def test_local_sensitivity_keeps_cost_and_weight(spark):
    r = np.random.default_rng(12)
    x = (r.normal(size=(8, 6)) * 8)[r.integers(0, 8, 4000)] + r.normal(size=(4000, 6))
    x[:3] += 400  # far rows must not be lost
    w = np.ones(4000)
    for p, seeds in ((dense_points(spark, x, w), 5), (sparse_of(dense_points(spark, x, w)), 1)):
        p = p.coalesce(2).cache()
        ratio, weights = [], []
        for seed in range(seeds):
            cs = materialize(coreset(p, TreeConfig(300, 2, leaves=4), LocalSensitivitySampler(k=8), seed), "sample")
            got = cs.select("pid", "weight").collect()
            assert len(got) == len({q.pid for q in got}) == 300 and {q.pid for q in got} >= {0, 1, 2}
            weights.append(sum(q.weight for q in got))
            centres = models.weighted_kmeans(cs, 9, seed)
            full = models.kmeans_centres(p, 9, seed)
            ratio.append(ev.kmeans_cost(p, centres).first().cost / ev.kmeans_cost(p, full).first().cost)
        # relative error of a priority sample's total: below 1 / sqrt(s - 1) a tree level
        assert abs(np.mean(weights) / 4000 - 1) < 4 * np.sqrt(3 / 299 / seeds) and np.median(ratio) < 1.1
        p.unpersist()
    # pieces: a group beyond the bound of one step
    small = LocalSensitivitySampler(k=3, piece=256).sample(dense_points(spark, x, w).repartition(3), [], 50, 1)
    assert small.count() == 50


def test_cluster_means_do_not_depend_on_row_order(spark):
    x, w = random_sparse(2, n=400)
    p = dense_points(spark, x, w)
    for df in (p, sparse_of(p)):
        a, b = (sorted((r.pid, round(r.weight, 9)) for r in ClusterMeanSampler().sample(d, [], 30, 3).collect()) for d in (df.repartition(7), df.coalesce(1).orderBy(F.desc("pid"))))
        assert a == b and len(a) == 30


def test_numbering_reads_and_writes_only_what_is_needed(spark):
    li = spark.read.parquet(f"{SF01}/lineitem.parquet")
    got = number_rows(li, reg.LINEITEM_ORDER, "pid", keep=["l_returnflag"])
    assert sorted(got.columns) == ["l_returnflag", "pid"]
    read = [f for f in got.inputFiles()]
    import pyarrow.parquet as pq
    assert set(pq.read_schema(read[0].removeprefix("file:")).names) == {"l_returnflag", "_part", "_mid"}
    plan = li.select("l_returnflag", *reg.LINEITEM_ORDER)._jdf.queryExecution().executedPlan().toString()
    assert "l_tax" not in plan
    assert got.select("pid").distinct().count() == li.count()
    assert (got.agg(F.min("pid"), F.max("pid")).first()) == (0, li.count() - 1)


def test_progressive_cost_by_ranges_of_models(spark, monkeypatch):
    pts, res = reg.progressive_results(spark, "/root/testdata/sf0.001")
    whole = sorted(map(tuple, ev.progressive_cost(pts, res, "kmeans").collect()))
    held = []
    load = ev._models
    monkeypatch.setattr(ev, "_models", lambda r, lo, hi: held.append((lo, hi)) or load(r, lo, hi))
    monkeypatch.setattr(ev, "BLOCK_CELLS", 1300)  # two models of 640 numbers
    cut = sorted(map(tuple, ev.progressive_cost(pts, res, "kmeans").collect()))
    assert held == [(1, 3), (4, 5)]
    assert [r[0] for r in cut] == [r[0] for r in whole]
    np.testing.assert_allclose([[x for x in r if isinstance(x, float)] for r in cut], [[x for x in r if isinstance(x, float)] for r in whole])


def test_ten_thousand_results_keep_the_driver_flat(spark, monkeypatch):
    res = spark.range(10_000).select(
        F.col("id").alias("batch_id"), F.array(F.array(F.col("id").cast("double"), F.lit(0.0))).alias("points"), F.lit(1).cast("long").alias("num_points"),
        F.lit(0).alias("sample_size"), F.lit("x-kmeans").alias("alg_name"))
    res = materialize(res, "results")
    pts = spark.range(10_000).select(F.col("id").alias("idx"), F.array(F.lit(0.0), F.lit(0.0)).alias("features"))
    most = []
    load = ev._models
    monkeypatch.setattr(ev, "_models", lambda r, lo, hi: (lambda got: most.append(sum(m.size for _, _, m in got)) or got)(load(r, lo, hi)))
    monkeypatch.setattr(ev, "BLOCK_CELLS", 5000)
    rep = ev.progressive_cost(pts, res, "kmeans")
    assert rep.count() == 10_000 and max(most) <= 5002 and len(most) == 4
    r = rep.where("batch_id = 99").first()
    assert r.cum_points == 100 and r.cost == pytest.approx(100 * 99.0 ** 2)
