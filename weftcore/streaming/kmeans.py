"""M5: streaming k-means with decay, state in a versioned table.

Update per batch for centre c with weight n, batch cluster mean xbar with m
points and decay a:  ``c' = (c n a + xbar m) / (n a + m)``, ``n' = n a + m``.
Initial centres are seeded Gaussian coordinates with weight 0 (so the first
batch moves every centre that receives points onto its cluster mean).  A
centre whose weight falls below 1e-8 of the largest is replaced by a split of
the largest cluster, as Spark's streaming k-means does.

``carry=False`` reproduces the reference, which built a new model for every
batch; ``carry=True`` keeps the model across batches.
"""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftcore.functions.vectors import is_sparse_type
from weftcore.operators.kmeans import Centres, nearest_column


def random_centres(k: int, dim: int, seed: int) -> list:
    rng = np.random.default_rng(seed)
    return [[float(x) for x in rng.standard_normal(dim)] for _ in range(k)]


def streaming_kmeans_update(points: DataFrame, centres: list, weights: list,
                            decay: float = 1.0) -> tuple[list, list]:
    """One batch step, dense or sparse points.  Only k cluster sums (k x d)
    reach the driver, one row per centre."""
    dim = len(centres[0])
    x = points.select(nearest_column(points, Centres.of_dense(centres))["idx"].alias("_k"), "features")
    if is_sparse_type(points.schema["features"].dataType):
        cells = x.select("_k", F.explode(F.arrays_zip(F.col("features.indices").alias("j"), F.col("features.values").alias("v"))).alias("e")).select("_k", "e.j", "e.v")
    else:
        cells = x.select("_k", F.posexplode("features").alias("j", "v"))
    sums = cells.groupBy("_k", "j").agg(F.sum("v").alias("s")).groupBy("_k").agg(
        F.collect_list("j").alias("j"), F.collect_list("s").alias("s"))
    cnt = {r["_k"]: r["m"] for r in x.groupBy("_k").agg(F.count(F.lit(1)).alias("m")).collect()}
    tot = {i: np.zeros(dim) for i in cnt}
    for r in sums.collect():
        tot[r["_k"]][r["j"]] = r["s"]
    new_c, new_w = [], []
    for i, (c, n) in enumerate(zip(centres, weights)):
        m = cnt.get(i, 0)
        c = np.asarray(c, dtype=float)
        if m > 0:
            xbar = tot[i] / m
            denom = n * decay + m
            c = (c * n * decay + xbar * m) / denom
            n = denom
        else:
            n = n * decay
        new_c.append(c)
        new_w.append(float(n))
    # split the largest cluster into a dying one
    wmax = max(new_w)
    for i, w in enumerate(new_w):
        if wmax > 0 and w < 1e-8 * wmax:
            j = int(np.argmax(new_w))
            jitter = 1e-14 * max(1.0, float(np.abs(new_c[j]).max()))
            new_c[i] = new_c[j] + jitter
            new_c[j] = new_c[j] - jitter
            new_w[i] = new_w[j] = new_w[j] / 2.0
    return [[float(v) for v in c] for c in new_c], new_w


class StreamingKMeansState:
    """M5 inside ``foreachBatch``: centres versioned by batch id."""

    def __init__(self, k: int, dim: int, state_dir: str, seed: int = 0,
                 decay: float = 1.0, carry: bool = True):
        self.k, self.dim, self.state_dir = k, dim, state_dir
        self.seed, self.decay, self.carry = seed, decay, carry

    def _load(self, spark: SparkSession, batch_id: int):
        from weftcore.streaming.tree_stream import latest_version  # noqa: PLC0415
        if not self.carry:
            return random_centres(self.k, self.dim, self.seed), [0.0] * self.k
        v = latest_version(spark, os.path.join(self.state_dir, "commits"), before=batch_id)
        if v is None:
            return random_centres(self.k, self.dim, self.seed), [0.0] * self.k
        rows = spark.read.parquet(os.path.join(self.state_dir, "centres", f"batch_id={v}")) \
            .orderBy("cid").collect()
        return [list(r["centre"]) for r in rows], [r["n"] for r in rows]

    def process_batch(self, points: DataFrame, batch_id: int):
        spark = points.sparkSession
        if points.isEmpty():
            return None
        centres, weights = self._load(spark, batch_id)
        centres, weights = streaming_kmeans_update(points, centres, weights, self.decay)
        rows = [(i, c, w) for i, (c, w) in enumerate(zip(centres, weights))]
        spark.createDataFrame(rows, "cid int, centre array<double>, n double").coalesce(1) \
            .write.mode("overwrite").parquet(os.path.join(self.state_dir, "centres", f"batch_id={batch_id}"))
        spark.createDataFrame([(int(batch_id),)], "batch_id long").write.mode("overwrite") \
            .parquet(os.path.join(self.state_dir, "commits", f"batch_id={batch_id}"))
        return centres
