"""Bounded run time and batches, progress, and the life of scratch tables."""

import os
import time

import pytest
from pyspark.sql import functions as F

from weftcore.operators.samplers import LightSampler, UniformSampler
from weftcore.operators.tree import TreeConfig
from weftcore.plans.jobs import JobConfig, run
from weftcore.session import ScratchScope, ensure_checkpoint_dir, keep, scratch_path
from weftcore.sources.points import materialize
from weftcore.sources.text import read_lines_stream
from weftcore.streaming.tree_stream import StreamingTreeSampler, committed_results, latest_result


def scratch_folders(spark):
    base = os.path.join(ensure_checkpoint_dir(spark).removeprefix("file:"), "weftcore")
    return set(os.listdir(base)) if os.path.isdir(base) else set()


def cached(spark):
    return spark.sparkContext._jsc.getPersistentRDDs().size()


def write_lines(folder, files, rows=40):
    os.makedirs(folder, exist_ok=True)
    for k in range(files):
        with open(f"{folder}/part-{k:03d}.txt", "w") as f:
            f.write("".join(f"{k}.0 {i}.5 0\n" for i in range(rows)))
        os.utime(f"{folder}/part-{k:03d}.txt", (time.time() - 100 + k, time.time() - 100 + k))


def job(base, **more):
    return JobConfig(alg="coreset-uniform-kmeans", algorithm_params=2, input=f"{base}/in", output=f"{base}/out", mode="streaming", dense=True,
                     sample_size=20, batch_secs=1, max_files_per_trigger=1, checkpoint_location=f"{base}/ckpt", seed=3, **more)


def test_run_time_limit_stops_after_a_batch_and_goes_on(spark, tmp_path):
    write_lines(f"{tmp_path}/in", 12)
    q = run(spark, job(str(tmp_path), max_run_secs=7))
    assert not q.isActive and (q.exception() is None or "StreamStopped" in str(q.exception()))
    commits = spark.read.parquet(f"{tmp_path}/out/_state/commits")
    first = sorted(r.batch_id for r in commits.collect())
    assert first == list(range(len(first))) and 0 < len(first) < 12
    results = {int(d.split("=")[1]) for d in os.listdir(f"{tmp_path}/out") if d.startswith("batch_id=")}
    assert set(first) <= results  # the last batch is whole
    q = run(spark, job(str(tmp_path), available_now=True))
    q.awaitTermination()
    done = spark.read.parquet(f"{tmp_path}/out/_state/commits").collect()
    assert sorted(r.batch_id for r in done) == list(range(12)) and sum(r.num_points for r in done) == 12 * 40
    with pytest.raises(ValueError):
        job(str(tmp_path), max_run_secs=0)


def test_run_time_limit_of_a_short_stream(spark, tmp_path):
    write_lines(f"{tmp_path}/in", 2)
    q = run(spark, job(str(tmp_path), max_run_secs=120, available_now=True))
    assert not q.isActive and q.exception() is None
    assert spark.read.parquet(f"{tmp_path}/out/_state/commits").count() == 2


def test_batches_bounded_by_bytes(spark, tmp_path):
    folder = f"{tmp_path}/in"
    os.makedirs(folder)
    sizes = [20_000] + [1_000] * 20
    for k, n in enumerate(sizes):
        with open(f"{folder}/f-{k:03d}.txt", "w") as f:
            f.write("0123456 9\n" * (n // 10))
        os.utime(f"{folder}/f-{k:03d}.txt", (time.time() - 100 + k, time.time() - 100 + k))
    rows = []
    lines = read_lines_stream(spark, folder, max_bytes_per_trigger=5_000)
    q = lines.writeStream.foreachBatch(lambda b, i: rows.append(b.count())).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = [r for r in rows if r]
    assert sum(rows) == sum(sizes) // 10
    assert rows[0] == 2_000 and all(r <= 500 for r in rows[1:]) and len(rows) >= 5  # the large file alone, then bounded batches
    with pytest.raises(ValueError):
        read_lines_stream(spark, folder, 1, max_bytes_per_trigger=5)


def event_stream(spark, tmp_path, files, sampler, s=20, rows=120):
    base = str(tmp_path)
    for k in range(files):
        spark.range(k * rows, (k + 1) * rows).coalesce(1).write.mode("append").parquet(f"{base}/src")
    src = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{base}/src")
    pts = src.select(F.col("id").alias("pid"), F.array(F.col("id").cast("double")).alias("features"), F.lit(1.0).alias("weight"))
    sts = StreamingTreeSampler(TreeConfig(s, 2, leaves=2, leaf_mode="mod"), sampler, 1, f"{base}/state", results_dir=f"{base}/results", keep_versions=3)
    return pts, sts, f"{base}/ckpt"


@pytest.mark.parametrize("sampler,files", [(UniformSampler(), 10), (LightSampler(), 6)])
def test_many_batches_leave_no_scratch(spark, tmp_path, sampler, files):
    pts, sts, ckpt = event_stream(spark, tmp_path, files, sampler)
    folders, frames, seen = scratch_folders(spark), cached(spark), []
    sts.after = lambda result, batch_id: seen.append((len(scratch_folders(spark) - folders), cached(spark) - frames))
    q = sts.start(pts, ckpt, available_now=True)
    q.awaitTermination()
    assert len(seen) == files
    assert max(n for n, _ in seen) <= 12 and len({n for n, _ in seen[files // 2:]}) <= 3  # of the running batch alone
    assert scratch_folders(spark) - folders == set() and cached(spark) <= frames
    trees = [d for d in os.listdir(sts.tree_dir) if d.startswith("batch_id=")]
    assert len(trees) == 3
    got = latest_result(committed_results(spark.read.parquet(f"{tmp_path}/results"), spark.read.parquet(sts.commits_dir)))
    assert got.count() == 20


def test_progress_and_node_sizes(spark, tmp_path):
    pts, sts, ckpt = event_stream(spark, tmp_path, 3, UniformSampler())
    q = sts.start(pts, ckpt, available_now=True)
    q.awaitTermination()
    for _ in range(50):  # the listener hears of the last batch a little later
        if len(q.progress.rows) >= 3:
            break
        time.sleep(0.2)
    log = q.progress.frame(spark).orderBy("batch_id").collect()
    assert [(r.batch_id, r.rows, r.weight) for r in log] == [(b, 120, 120.0) for b in range(3)] and all(r.seconds > 0 for r in log)
    nodes = {(r.batch_id, r.level): (r.nodes, r.rows) for r in spark.read.parquet(sts.nodes_dir).collect()}
    # leaves of 60 rows keep 20, two leaves make a node of 40, which climbs with 20: a binary counter of batches
    assert nodes == {(0, 1): (1, 20), (1, 2): (1, 20), (2, 1): (1, 20), (2, 2): (1, 20)}


def test_scopes_nest_and_release(spark):
    before = scratch_folders(spark)
    with pytest.raises(ZeroDivisionError):
        with ScratchScope(spark) as outer:
            a = materialize(spark.range(3), "a")
            with ScratchScope(spark) as inner:
                materialize(spark.range(4), "b")
                kept = materialize(spark.range(5), path=inner.outside("kept"))
                held = keep(spark.range(6))
                assert held.count() == 6
            assert held.storageLevel.useMemory is False
            assert a.count() == 3 and kept.count() == 5
            free = outer.outside("free")
            materialize(spark.range(2), path=free)
            1 / 0
    assert {f.split("-")[0] for f in scratch_folders(spark) - before} == {"free"}
    assert spark.read.parquet(free).count() == 2 and "free" not in scratch_path(spark, "x")
