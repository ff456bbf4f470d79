"""The stateful tree sample over a micro-batch stream.

Each micro-batch runs in ``foreachBatch``:

1. read the forest and the sampler's state (rough centres) committed by the
   latest earlier batch (never its own),
2. sample the batch's leaves (C15), union them with that forest, run the
   merge-and-reduce rounds (C16) as one query and write the new forest to
   ``state/tree/batch_id=N`` (overwrite: a retried batch replaces itself),
3. take the final sample (C19), hand it to the model callback and write the
   result to ``results/batch_id=N`` as one file (K2),
4. write the sizes of the forest's nodes to ``state/nodes/batch_id=N`` and
   ``state/commits/batch_id=N`` last, which makes version N current.

The state lives in files under the shared folder, not in driver variables,
so a batch run again, by this object or a new one, gives the same rows.
``committed_results`` shows only results whose commit was written.  An empty
batch writes nothing; readers take the latest result (T6) instead of a
repeated row.
"""

from __future__ import annotations

import os
import threading
import time
import uuid
from dataclasses import dataclass, field
from typing import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftcore.operators.samplers import POINT_COLS, Sampler
from weftcore.operators.tree import (TREE_COLS, TreeConfig, assign_leaves, final_sample, leaf_sample,
                                     node_sizes, rounds_needed, tree_reduce, tree_reduce_planned)
from weftcore.session import ScratchScope, delete_path
from weftcore.sources.points import materialize
from weftcore.streaming.progress import ProgressLog, observed

COMMIT = ("batch_id long, num_points long, tree_path string, max_level int, "
          "sampler_state array<array<double>>, seconds double")


def stream_pids(batch: DataFrame, batch_id: int) -> DataFrame:
    """Ids for rows of a micro-batch that carry none: a 64-bit hash of batch
    and place in the batch, the same when the batch is run again because the
    file split is the same.  Two rows of one id would only share their random
    number."""
    return batch.withColumn("pid", F.xxhash64(F.lit(int(batch_id)), F.monotonically_increasing_id()))


def latest_version(spark: SparkSession, commits_dir: str, before: int | None = None) -> int | None:
    """Greatest committed batch id (below ``before`` when given)."""
    try:
        c = spark.read.parquet(commits_dir)
    except AnalysisException:
        return None
    if before is not None:
        c = c.where(F.col("batch_id") < before)
    v = c.agg(F.max("batch_id").alias("v")).first()["v"]
    return None if v is None else int(v)


def latest_commit(spark: SparkSession, commits_dir: str, before: int | None = None):
    """The commit row (batch_id, num_points, tree_path) of the latest batch."""
    try:
        c = spark.read.parquet(commits_dir)
    except AnalysisException:
        return None
    if before is not None:
        c = c.where(F.col("batch_id") < before)
    return c.orderBy(F.col("batch_id").desc()).limit(1).first()


def committed_results(results: DataFrame, commits: DataFrame) -> DataFrame:
    """Results of batches that were committed."""
    return results.join(commits.select("batch_id"), "batch_id", "left_semi")


def latest_result(results: DataFrame) -> DataFrame:
    """The result with the greatest batch id (the model after the last
    non-empty batch)."""
    top = results.agg(F.max("batch_id").alias("batch_id"))
    return results.join(top, "batch_id")


class StreamStopped(RuntimeError):
    """A batch that began after its stream's time was over."""


class Gate:
    """Batches run inside the gate; once closed, none begins."""

    def __init__(self):
        self.lock, self.closed = threading.Lock(), False

    def __enter__(self):
        self.lock.acquire()
        if self.closed:
            self.lock.release()
            raise StreamStopped("the stream's time is over")

    def __exit__(self, *error):
        self.lock.release()


def run_for(query: StreamingQuery, secs: float, gate: Gate | None = None) -> bool:
    """Let the query run for at most ``secs`` seconds.  A batch that is
    running then ends and is committed; no other begins.  Returns whether the
    query ended by itself.  A query started again goes on where this one
    stopped."""
    if query.awaitTermination(secs):
        return True
    if gate is not None:
        with gate:  # waits for the running batch
            gate.closed = True
    query.stop()
    error = query.exception()
    if error is not None and StreamStopped.__name__ not in str(error):
        raise error
    return False


NODES = "level int, nodes long, rows long, smallest long, largest long"


@dataclass
class StreamingTreeSampler:
    """T2 (and T3 with the identity callback, T4 with ``before``/``after``)."""

    cfg: TreeConfig
    sampler: Sampler
    seed: int
    state_dir: str
    results_dir: str | None = None
    process_sample: Callable | None = None
    before: Callable | None = None
    after: Callable | None = None
    leaves_per_batch: int | None = None
    id_col: str | None = None
    keep_versions: int | None = None
    gate: Gate = field(default_factory=Gate)

    @property
    def nodes_dir(self) -> str:
        """K3: sizes of the forest's nodes, by batch and level."""
        return os.path.join(self.state_dir, "nodes")

    @property
    def tree_dir(self) -> str:
        return os.path.join(self.state_dir, "tree")

    @property
    def commits_dir(self) -> str:
        return os.path.join(self.state_dir, "commits")

    def _tree_at(self, spark: SparkSession, before: int | None) -> DataFrame | None:
        c = latest_commit(spark, self.commits_dir, before)
        return None if c is None else spark.read.parquet(c["tree_path"]).select(*TREE_COLS)

    def previous_tree(self, spark: SparkSession, batch_id: int) -> DataFrame | None:
        """The forest committed by the latest batch before ``batch_id``."""
        return self._tree_at(spark, batch_id)

    def current_tree(self, spark: SparkSession) -> DataFrame | None:
        return self._tree_at(spark, None)

    def _reduced(self, merged: DataFrame, sampler: Sampler, leaves: int, max_level: int, path: str) -> DataFrame:
        if sampler.row_importance(merged) is not None:
            rounds = rounds_needed(max_level, leaves, self.cfg.fan_in)
            return materialize(tree_reduce_planned(merged, self.cfg, sampler, self.seed, rounds), path=path)
        tree = tree_reduce(materialize(merged, "stream-leaves"), self.cfg, sampler, self.seed)
        return materialize(tree, path=path)

    def process_batch(self, batch: DataFrame, batch_id: int) -> None:
        """One micro-batch.  Its scratch tables and cached frames end with it (K6)."""
        with self.gate, ScratchScope(batch.sparkSession):
            self._process(batch, batch_id)

    def _process(self, batch: DataFrame, batch_id: int) -> None:
        spark, began = batch.sparkSession, time.time()
        if self.id_col:
            batch = batch.withColumnRenamed(self.id_col, "pid") if self.id_col != "pid" else batch
        elif "pid" not in batch.columns:
            batch = stream_pids(batch, batch_id)
        if "weight" not in batch.columns:
            batch = batch.withColumn("weight", F.lit(1.0))
        batch = batch.select(*POINT_COLS).persist()
        try:
            n = batch.count()
            if n == 0:
                return  # T6: nothing new; the latest result stays current
            if self.before:
                self.before(batch, batch_id)
            last = latest_commit(spark, self.commits_dir, batch_id)
            self.sampler.restore([list(c) for c in last["sampler_state"]] if last and last["sampler_state"] else None)
            sampler = self.sampler.prepare(batch)
            # At most one leaf per task slot, and no leaf below the threshold:
            # leaves are sampled with a map-side partial top-k, so big leaves
            # are cheap and the tree stays shallow.
            slots = int(spark.conf.get("spark.sql.shuffle.partitions"))
            L = self.leaves_per_batch or self.cfg.leaves or max(
                1, min(slots, n // self.cfg.threshold))
            merged = leaf_sample(assign_leaves(batch, self.cfg, L), self.cfg, sampler, self.seed)
            max_level = 0
            if last is not None:
                merged = spark.read.parquet(last["tree_path"]).select(*TREE_COLS).unionByName(merged)
                max_level = last["max_level"]
            path = os.path.join(self.tree_dir, f"batch_id={batch_id}")
            tree = self._reduced(merged, sampler, L, max_level, path)
            sample = final_sample(tree, self.cfg, sampler, self.seed)
            if self.process_sample is not None:
                result = self.process_sample(batch, sample, batch_id, n)
            else:  # T3: emit the sample itself
                result = sample.withColumn("num_points", F.lit(n).cast("long"))
            if self.results_dir and result is not None:
                (result.coalesce(1).write.mode("overwrite")  # at most s rows
                 .parquet(os.path.join(self.results_dir, f"batch_id={batch_id}")))
            level = self._write_nodes(tree, batch_id)
            (spark.createDataFrame([(int(batch_id), int(n), path, int(level), sampler.state(), time.time() - began)], COMMIT)
             .coalesce(1).write.mode("overwrite")  # one row
             .parquet(os.path.join(self.commits_dir, f"batch_id={batch_id}")))
            if self.keep_versions:
                self._retire_old_versions(spark)
            if self.after:
                self.after(result, batch_id)
        finally:
            batch.unpersist()

    def _write_nodes(self, tree: DataFrame, batch_id: int) -> int:
        """K3: per level the number of nodes and their sizes, beside the commit; returns the top level."""
        rows = node_sizes(tree).groupBy("level").agg(
            F.count(F.lit(1)).alias("nodes"), F.sum("size").alias("rows"), F.min("size").alias("smallest"), F.max("size").alias("largest")).collect()  # a row per level
        tree.sparkSession.createDataFrame([tuple(r) for r in rows], NODES).coalesce(1).write.mode("overwrite").parquet(
            os.path.join(self.nodes_dir, f"batch_id={batch_id}"))
        return max((r["level"] for r in rows), default=0)

    def _retire_old_versions(self, spark: SparkSession) -> None:
        """Keep the trees of the last ``keep_versions`` commits, and always
        the two last: the newest batch may run again, and starts from the one
        before it."""
        keep = max(2, self.keep_versions)
        old = spark.read.parquet(self.commits_dir).select("tree_path", "batch_id").orderBy(F.col("batch_id").desc()).offset(keep)
        for r in old.toLocalIterator():  # commits that are retired already have no folder
            delete_path(spark, r["tree_path"])

    def start(self, points_stream: DataFrame, checkpoint_location: str,
              batch_secs: int | None = None, available_now: bool = False):
        """Run the stream; the source offsets are checkpointed by
        Structured Streaming, the tree by this class."""
        return start_batches(points_stream, self.process_batch, checkpoint_location, batch_secs, available_now)


def start_batches(stream: DataFrame, process: Callable, checkpoint_location: str, batch_secs: int | None = None,
                  available_now: bool = False) -> StreamingQuery:
    """Start a query whose progress (:class:`ProgressLog`) is its attribute ``progress``."""
    name = f"weftcore-{uuid.uuid4().hex[:12]}"
    log = ProgressLog(name)
    streams = stream.sparkSession.streams
    streams.addListener(log)
    writer = observed(stream).writeStream.queryName(name).foreachBatch(process).option("checkpointLocation", checkpoint_location)
    query = writer.trigger(**trigger_kwargs(batch_secs, available_now)).start()
    query.progress = log
    return query


def trigger_kwargs(batch_secs: int | None = None, available_now: bool = False) -> dict:
    """Fixed-period micro-batches, or all available data then stop."""
    if available_now:
        return {"availableNow": True}
    return {"processingTime": f"{int(batch_secs or 10)} seconds"}
