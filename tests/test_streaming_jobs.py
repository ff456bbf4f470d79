"""Streaming tree state, empty batches, restart, windows, and the three jobs."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import SF001
from weftcore.functions.hashing import uniform01
from weftcore.functions.vectors import dense_to_sparse
from weftcore.operators.samplers import (ClusterMeanSampler, LightSampler, NormSampler, SensitivitySampler,
                                         SystematicSampler, UniformSampler)
from weftcore.operators.tree import TreeConfig
from weftcore.plans.jobs import JobConfig, load_points, run, run_bulk, run_evaluate, run_streaming
from weftcore.sources.text import dense_line, sparse_line
from weftcore.streaming.tree_stream import StreamingTreeSampler, latest_result
from weftcore.streaming.windows import batch_progress, sliding_sum


def _tmp():
    return tempfile.mkdtemp(prefix="weftcore-test-")


def _points(df):
    return df.select(F.col("event_id").alias("pid"), F.array("value").alias("features"),
                     F.lit(1.0).alias("weight"))


def test_tree_state_across_batches_and_restart(spark):
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    d = _tmp()
    cfg = TreeConfig(20, 2, leaves=2)
    a = StreamingTreeSampler(cfg, UniformSampler(), 5, os.path.join(d, "state"),
                             results_dir=os.path.join(d, "res"))
    a.process_batch(_points(ev.where("event_id < 400")), 0)
    a.process_batch(_points(ev.limit(0)), 1)  # empty: nothing written
    # a new sampler object (a restarted driver) continues from the commit
    b = StreamingTreeSampler(cfg, UniformSampler(), 5, os.path.join(d, "state"),
                             results_dir=os.path.join(d, "res"))
    b.process_batch(_points(ev.where("event_id >= 400")), 2)
    res = spark.read.parquet(os.path.join(d, "res"))
    assert sorted(r.batch_id for r in res.select("batch_id").distinct().collect()) == [0, 2]
    got = sorted(r.pid for r in latest_result(res).collect())
    exp = sorted(r.pid for r in _points(ev).orderBy(uniform01("pid", 5), "pid").limit(20).collect())
    assert got == exp
    # re-running batch 2 (a retry) gives the same result
    b.process_batch(_points(ev.where("event_id >= 400")), 2)
    assert sorted(r.pid for r in latest_result(spark.read.parquet(os.path.join(d, "res"))).collect()) == exp
    progress = batch_progress(spark.read.parquet(os.path.join(d, "state", "commits")), batch_secs=3600).collect()
    assert sorted((r.batch_id, r.num_points, r.over_time) for r in progress) == [(0, 400, False), (2, 600, False)]


def test_sliding_window_stream(spark):
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    d = _tmp()
    ev.repartition(3).write.parquet(os.path.join(d, "src"))
    s = spark.readStream.schema(ev.schema).parquet(os.path.join(d, "src"))
    agg = sliding_sum(s, "ts", "value", "2 days", "1 day", watermark="1 day", out="value_sum")
    q = (agg.writeStream.outputMode("update").format("memory").queryName("slide_t")
         .option("checkpointLocation", os.path.join(d, "ck")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = spark.sql("SELECT window_start, max(rows) AS rows FROM slide_t GROUP BY window_start")
    batch = sliding_sum(ev, "ts", "value", "2 days", "1 day")
    assert got.count() == batch.count()


def _write_dense_text(spark, d, files=4):
    e = spark.read.parquet(f"{SF001}/embeddings.parquet")
    lines = e.select("vec_id", dense_line(F.col("embedding").cast("array<double>"), "label").alias("value"))
    n = lines.count()
    for i in range(files):
        (lines.where(F.floor(F.col("vec_id") * files / n) == i).orderBy("vec_id").select("value")
         .coalesce(1).write.mode("append").text(d))
        import time
        time.sleep(1.1)


def test_bulk_and_evaluate_jobs(spark):
    d = _tmp()
    _write_dense_text(spark, os.path.join(d, "in"), files=2)
    for alg in ("coreset-kmeans", "coreset-uniform-kmeans", "spark-kmeans"):
        out = os.path.join(d, alg)
        cfg = JobConfig(alg=alg, algorithm_params=5, input=os.path.join(d, "in"), output=out,
                        mode="bulk", dense=True, sample_size=50, seed=1)
        res = run_bulk(spark, cfg).first()
        assert res.num_points == 500 and len(res.points) == 5
        rep = run_evaluate(spark, JobConfig(alg=alg, algorithm_params=5, input=os.path.join(d, "in"),
                                            output=out, mode="evaluate", dense=True)).collect()
        assert len(rep) == 1 and rep[0].cost > 0


def test_streaming_job(spark):
    d = _tmp()
    _write_dense_text(spark, os.path.join(d, "in"), files=3)
    out = os.path.join(d, "out")
    cfg = JobConfig(alg="coreset-uniform-kmeans", algorithm_params=4, input=os.path.join(d, "in"),
                    output=out, mode="streaming", dense=True, sample_size=40, seed=2,
                    max_files_per_trigger=1, available_now=True,
                    checkpoint_location=os.path.join(d, "ck"))
    q = run_streaming(spark, cfg)
    q.awaitTermination()
    res = spark.read.parquet(out).orderBy("batch_id").collect()
    assert sorted(r.num_points for r in res) == [166, 167, 167]
    assert all(len(r.points) == 4 for r in res)
    rep = run_evaluate(spark, JobConfig(alg="coreset-uniform-kmeans", algorithm_params=4,
                                        input=os.path.join(d, "in"), output=out, mode="evaluate",
                                        dense=True)).orderBy("batch_id").collect()
    assert [r.cum_points for r in rep][-1] == 500


def test_streaming_kmeans_job(spark):
    d = _tmp()
    _write_dense_text(spark, os.path.join(d, "in"), files=2)
    out = os.path.join(d, "out")
    cfg = JobConfig(alg="spark-kmeans", algorithm_params=3, input=os.path.join(d, "in"), output=out,
                    mode="streaming", dense=True, dim=64, max_files_per_trigger=1, available_now=True,
                    checkpoint_location=os.path.join(d, "ck"))
    run_streaming(spark, cfg).awaitTermination()
    res = spark.read.parquet(out).collect()
    assert len(res) == 2 and all(len(r.points) == 3 for r in res)


@pytest.mark.parametrize("sampler", [lambda: UniformSampler(), lambda: LightSampler(), lambda: NormSampler(),
                                     lambda: SensitivitySampler(k=4, seed=1), lambda: ClusterMeanSampler(), lambda: SystematicSampler()])
def test_last_batch_again(spark, sampler):
    """A batch run again by a new object gives the same rows, with old versions retired."""
    e = spark.read.parquet(f"{SF001}/embeddings.parquet")
    pts = e.select(F.col("vec_id").alias("pid"), F.col("embedding").cast("array<double>").alias("features"), F.lit(1.0).alias("weight"))
    d = _tmp()
    cfg = TreeConfig(20, 2, leaves=2)

    def make():
        return StreamingTreeSampler(cfg, sampler(), 5, os.path.join(d, "state"), results_dir=os.path.join(d, "res"), keep_versions=1)

    one = make()
    for b in range(3):
        one.process_batch(pts.where(F.col("pid") % 3 == b), b)
    first = {(r.pid, round(r.weight, 9)) for r in latest_result(spark.read.parquet(os.path.join(d, "res"))).collect()}
    make().process_batch(pts.where(F.col("pid") % 3 == 2), 2)
    assert {(r.pid, round(r.weight, 9)) for r in latest_result(spark.read.parquet(os.path.join(d, "res"))).collect()} == first
    assert sorted(os.listdir(os.path.join(d, "state", "tree"))) == ["batch_id=1", "batch_id=2"]


def test_stream_without_ids(spark):
    d = _tmp()
    pts = spark.range(300, numPartitions=3).select(F.array(F.col("id").cast("double")).alias("features"))
    sts = StreamingTreeSampler(TreeConfig(10, 2, leaves=2), UniformSampler(), 5, os.path.join(d, "s"), results_dir=os.path.join(d, "r"))
    for b in (0, 3_000_000_000):  # ids of any batch number
        sts.process_batch(pts, b)
    res = latest_result(spark.read.parquet(os.path.join(d, "r")))
    assert res.select("pid").distinct().count() == 10 and abs(res.agg(F.sum("weight")).first()[0] - 600) < 1e-6


def test_line_order_of_unequal_files(spark):
    """Prefixes follow file names and lines, whatever the sizes and ranges."""
    d = _tmp()
    os.makedirs(os.path.join(d, "in"))
    n = 0
    for name, k in (("a-first.txt", 10), ("b-second.txt", 1990), ("c-third.txt", 3)):
        with open(os.path.join(d, "in", name), "w") as f:
            for _ in range(k):
                f.write(f"{n} 0\n")
                n += 1
    for ranges in (None, 8):
        cfg = JobConfig(alg="spark-kmeans", algorithm_params=1, input=os.path.join(d, "in"), output="x", mode="bulk", dense=True, parallelism=ranges)
        assert all(r.pid == r.features[0] for r in load_points(spark, cfg).collect())


def _sparse_text(spark, path):
    e = spark.read.parquet(f"{SF001}/embeddings.parquet")
    f = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.when(F.abs(x) > 0.1, x).otherwise(F.lit(0.0)))
    e.orderBy("vec_id").select(sparse_line("vec_id", dense_to_sparse(f)).alias("value")).coalesce(1).write.text(path)


@pytest.fixture(scope="module")
def inputs(spark):
    d = _tmp()
    _write_dense_text(spark, os.path.join(d, "dense"), files=1)
    _sparse_text(spark, os.path.join(d, "sparse"))
    return d


#: SURVEY's algorithm matrix: (algorithm, dense, bulk runs, streaming runs).
MATRIX = [("coreset-kmeans", True, True, True), ("coreset-kmeans", False, True, True), ("coreset2-kmeans", True, True, True), ("coreset2-kmeans", False, True, True),
          ("coreset-uniform-kmeans", True, True, True), ("coreset-uniform-kmeans", False, True, True), ("coreset-svd", True, False, False), ("coreset-svd", False, True, True),
          ("coreset-uniform-svd", True, False, False), ("coreset-uniform-svd", False, True, True), ("spark-kmeans", True, True, True), ("spark-kmeans", False, True, True),
          ("spark-svd", True, True, False), ("spark-svd", False, False, False)]


@pytest.mark.parametrize("alg,dense,bulk,stream", MATRIX)
def test_algorithm_matrix(spark, inputs, alg, dense, bulk, stream):
    for mode, works in (("bulk", bulk), ("streaming", stream)):
        out = os.path.join(_tmp(), "out")
        cfg = JobConfig(alg=alg, algorithm_params=3, input=os.path.join(inputs, "dense" if dense else "sparse"), output=out, mode=mode, dense=dense,
                        dim=64, sample_size=60, seed=3, available_now=True)
        if not works:
            with pytest.raises(ValueError):
                run(spark, cfg)
            continue
        if mode == "streaming" and (alg, dense) == ("coreset2-kmeans", True):
            continue  # the sampler of coreset-kmeans
        got = run(spark, cfg)
        if mode == "streaming":
            got.awaitTermination()
        res = spark.read.parquet(out).collect()
        assert len(res) == 1 and res[0].num_points == 500 and len(res[0].points) == 3 and len(res[0].points[0]) == 64
        if mode == "streaming":
            continue
        rep = run(spark, JobConfig(alg=alg, algorithm_params=3, input=cfg.input, output=out, mode="evaluate", dense=dense)).collect()
        assert len(rep) == 1 and rep[0].cost > 0 and rep[0].cum_points == 500 and rep[0].result_path == out


def test_given_spark_params_win(spark, inputs):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        run(spark, JobConfig(alg="spark-kmeans", algorithm_params=2, input=os.path.join(inputs, "dense"), output=os.path.join(_tmp(), "o"), mode="bulk", dense=True,
                             spark_params={"spark.sql.shuffle.partitions": "5"}))
        assert spark.conf.get("spark.sql.shuffle.partitions") == "5"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_two_results_of_a_batch_are_an_error(spark, inputs):
    d = _tmp()
    rows = spark.createDataFrame([(0, [[0.0] * 64], 5, 1, "x-kmeans")] * 2, "batch_id long, points array<array<double>>, num_points long, sample_size int, alg_name string")
    rows.write.partitionBy("batch_id").parquet(os.path.join(d, "r"))
    with pytest.raises(ValueError):
        run(spark, JobConfig(alg="x-kmeans", algorithm_params=1, input=os.path.join(inputs, "dense"), output=os.path.join(d, "r"), mode="evaluate", dense=True))
