"""Job configuration and the three jobs.

``JobConfig`` replaces the reference's command-line parameters.  Jobs take a
session from the caller; ``spark_params`` are set on it and win over what it
had.
"""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftcore.operators import models
from weftcore.operators.evaluate import evaluate as evaluate_results
from weftcore.operators.evaluate import report
from weftcore.operators.samplers import ClusterMeanSampler, LocalSensitivitySampler, NormSampler, Sampler, UniformSampler
from weftcore.operators.tree import TreeConfig, coreset, suggest_leaves
from weftcore.session import ScratchScope, keep, scratch_path
from weftcore.sources.points import materialize, number_rows, read_results
from weftcore.sources.text import LINE_ORDER, parse_dense, parse_sparse, read_lines, read_lines_stream

MODES = ("bulk", "streaming", "evaluate")
CORESET_ALGS = ("coreset-kmeans", "coreset2-kmeans", "coreset-uniform-kmeans",
                "coreset-svd", "coreset-uniform-svd")
SPARK_ALGS = ("spark-kmeans", "spark-svd")


@dataclass
class JobConfig:
    """The job parameters (``dim`` optional; only the streaming baseline reads it)."""

    alg: str
    algorithm_params: int  # k
    input: str
    output: str
    mode: str
    dense: bool = False
    dim: int | None = None
    sample_size: int = -1
    batch_secs: int = 10
    parallelism: int | None = None
    fan_in: int = 2
    seed: int = 0
    max_files_per_trigger: int | None = None
    max_bytes_per_trigger: int | str | None = None
    max_run_secs: float | None = None
    available_now: bool = False
    checkpoint_location: str | None = None
    spark_params: dict = field(default_factory=dict)

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        if not self.alg or not self.input or not self.output:
            raise ValueError("alg, input and output are required")
        if self.mode != "evaluate" and self.alg not in CORESET_ALGS + SPARK_ALGS:
            raise ValueError(f"unknown algorithm {self.alg!r}")
        if self.alg in CORESET_ALGS and self.mode != "evaluate" and self.sample_size <= 0:
            raise ValueError("coreset algorithms need sample_size > 0")
        if self.max_run_secs is not None and self.max_run_secs <= 0:
            raise ValueError("max_run_secs must be > 0")
        if self.algorithm_params <= 0:
            raise ValueError("algorithm_params (k) must be > 0")

    @property
    def k(self) -> int:
        return int(self.algorithm_params)

    def tree(self) -> TreeConfig:
        return TreeConfig(sample_size=self.sample_size, fan_in=self.fan_in)


def create_sampler(cfg: JobConfig) -> Sampler:
    """The coreset algorithm by name and density (reference matrix)."""
    a = cfg.alg
    if a == "coreset-uniform-kmeans":
        return UniformSampler()
    if a == "coreset-kmeans":
        return LocalSensitivitySampler(k=cfg.k)
    if a == "coreset2-kmeans":
        return ClusterMeanSampler() if not cfg.dense else LocalSensitivitySampler(k=cfg.k)
    if a in ("coreset-svd", "coreset-uniform-svd"):
        if cfg.dense:
            raise ValueError(f"{a} on dense data is not supported (as in the reference)")
        return NormSampler()
    raise ValueError(f"{a} is not a coreset algorithm")


def _apply_spark_params(spark: SparkSession, cfg: JobConfig) -> None:
    for k, v in cfg.spark_params.items():
        spark.conf.set(k, v)


def load_points(spark: SparkSession, cfg: JobConfig) -> DataFrame:
    """S1 + S4 + S5/S6 + W1: unit-weight points of the text input, numbered in
    its order (``parallelism``: ranges of the numbering).  Sparse input stays
    sparse: samplers, costs and models take the sparse struct."""
    lines = read_lines(spark, cfg.input)
    parse = parse_dense if cfg.dense else parse_sparse
    parsed = parse(lines, mode="FAILFAST", keep=LINE_ORDER)
    numbered = number_rows(parsed, LINE_ORDER, "pid", cfg.parallelism)
    return numbered.select("pid", "features", F.lit(1.0).alias("weight"))


def run_bulk(spark: SparkSession, cfg: JobConfig, batch_id: int = 0) -> DataFrame:
    """Points -> coreset -> model (or the Spark baseline) -> results file.
    Scratch tables and cached frames end with the job (K6)."""
    _apply_spark_params(spark, cfg)
    with ScratchScope(spark):
        points = load_points(spark, cfg)  # already written: numbering cuts the lineage
        n = points.count()
        if cfg.alg in SPARK_ALGS:
            fit = models.spark_baseline(cfg.alg, cfg.dense, False, cfg.k, cfg.seed)
            res = models.result_frame(spark, batch_id, fit(points), n, int(n), cfg.alg)
        else:
            tcfg = cfg.tree()
            leaves = suggest_leaves(n, tcfg, int(spark.conf.get("spark.sql.shuffle.partitions")))
            sample = keep(coreset(points, tcfg, create_sampler(cfg), cfg.seed, leaves=leaves))
            fit = models.model_on_sample(cfg.alg, cfg.dense, cfg.k, cfg.seed)
            res = models.result_frame(spark, batch_id, fit(sample) if n else [], n, sample.count(), cfg.alg)
        res.coalesce(1).write.mode("overwrite").parquet(os.path.join(cfg.output, f"batch_id={batch_id}"))  # one row
    return spark.read.parquet(cfg.output)


def run_streaming(spark: SparkSession, cfg: JobConfig):
    """Text stream -> per-batch tree sample -> model -> results per batch.
    Returns the query; with ``max_run_secs`` after it has ended or its time is
    over (T13)."""
    from weftcore.streaming.kmeans import StreamingKMeansState
    from weftcore.streaming.tree_stream import Gate, StreamingTreeSampler, run_for, start_batches

    def started(query, gate):
        if cfg.max_run_secs is not None:
            run_for(query, cfg.max_run_secs, gate)
        return query

    _apply_spark_params(spark, cfg)
    lines = read_lines_stream(spark, cfg.input, cfg.max_files_per_trigger,
                              f"{100 * cfg.batch_secs}s", cfg.parallelism, cfg.max_bytes_per_trigger)
    parsed = (parse_dense(lines, mode="FAILFAST", keep=[]) if cfg.dense
              else parse_sparse(lines, mode="FAILFAST", keep=[]))
    points = parsed.select("features", F.lit(1.0).alias("weight"))
    ckpt = cfg.checkpoint_location or scratch_path(spark, "stream-ckpt")
    state = os.path.join(cfg.output, "_state")

    if cfg.alg == "spark-kmeans":
        if not cfg.dim:
            raise ValueError("spark-kmeans streaming needs dim")
        km = StreamingKMeansState(cfg.k, cfg.dim, state, cfg.seed, carry=False)

        gate = Gate()

        def per_batch(batch, batch_id):  # T7
            with gate, ScratchScope(spark):
                n = batch.count()
                centres = km.process_batch(batch, batch_id)
                if centres is not None:
                    models.result_frame(spark, batch_id, centres, n, n, cfg.alg).coalesce(1).write \
                        .mode("overwrite").parquet(os.path.join(cfg.output, f"batch_id={batch_id}"))
        return started(start_batches(points, per_batch, ckpt, cfg.batch_secs, cfg.available_now), gate)
    if cfg.alg in SPARK_ALGS:
        raise ValueError(f"{cfg.alg} does not run on a stream")

    fit = models.model_on_sample(cfg.alg, cfg.dense, cfg.k, cfg.seed)

    def process(batch, sample, batch_id, n):
        sample = keep(sample)
        return models.result_frame(spark, batch_id, fit(sample), n, sample.count(), cfg.alg)

    sts = StreamingTreeSampler(cfg.tree(), create_sampler(cfg), cfg.seed, state,
                               results_dir=cfg.output, process_sample=process)
    return started(sts.start(points, ckpt, cfg.batch_secs, cfg.available_now), sts.gate)


def run_evaluate(spark: SparkSession, cfg: JobConfig) -> DataFrame:
    """Score every saved result on its prefix of the input (E3/E4).  The
    report is a small written table; the job's other tables end with it."""
    _apply_spark_params(spark, cfg)
    with ScratchScope(spark) as scope:
        points = load_points(spark, cfg).withColumnRenamed("pid", "idx")
        costs = evaluate_results(points, read_results(spark, cfg.output), cfg.alg)
        return materialize(report(costs, cfg.output), path=scope.outside("report"))


def run(spark: SparkSession, cfg: JobConfig):
    """Dispatch on the mode."""
    return {"bulk": run_bulk, "streaming": run_streaming, "evaluate": run_evaluate}[cfg.mode](spark, cfg)
