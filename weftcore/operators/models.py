"""M1-M9: models fitted on samples (or on all points, for the baselines).

Only model parameters (k centres or k axes) ever reach the driver.
"""

from __future__ import annotations

import datetime as _dt
import warnings

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftcore.functions.linalg import sum_partials
from weftcore.functions.vectors import is_sparse_type
from weftcore.operators import kmeans as km

RESULT_SCHEMA = T.StructType([
    T.StructField("batch_id", T.LongType()),
    T.StructField("points", T.ArrayType(T.ArrayType(T.DoubleType()))),
    T.StructField("num_points", T.LongType()),
    T.StructField("sample_size", T.IntegerType()),
    T.StructField("alg_name", T.StringType()),
    T.StructField("time", T.TimestampType()),
])


def kmeans_centres(points: DataFrame, k: int, seed: int = 0, max_iter: int = 20,
                   init_steps: int = 2, tol: float = 1e-4, weighted: bool = True, init: list | None = None) -> list:
    """k centres of dense points (Spark ML k-means, k-means|| init) or of
    sparse ones (:func:`sparse_kmeans`); an empty input has none.  With
    ``init`` (k centres as dense rows) Lloyd steps start from there."""
    if points.isEmpty():
        return []
    if init is not None:
        return km.lloyd(points, km.Centres.of_dense(init), max_iter, tol, weighted).centres.dense().tolist()
    if is_sparse_type(points.schema["features"].dataType):
        return sparse_kmeans(points, k, seed, max_iter, tol, weighted)
    est = KMeans(k=k, seed=seed, maxIter=max_iter, initSteps=init_steps, tol=tol,
                 featuresCol="_vec")
    if weighted:
        est = est.setWeightCol("weight")
    vec = points.select(array_to_vector(F.col("features")).alias("_vec"), "weight")
    return [[float(x) for x in c] for c in est.fit(vec).clusterCenters()]


def sparse_seeds(points: DataFrame, k: int, seed: int = 0, weighted: bool = True, rounds: int = 2) -> np.ndarray:
    """The seeds of :func:`weftcore.operators.kmeans.seeds` as a k x d matrix."""
    return km.seeds(points, k, seed, weighted, rounds).dense()


def sparse_kmeans(points: DataFrame, k: int, seed: int = 0, max_iter: int = 20, tol: float = 1e-4,
                  weighted: bool = True) -> list:
    """k-means|| seeds and Lloyd steps as block products over the non-zeros
    (:mod:`weftcore.operators.kmeans`).  Points of fewer than k different
    vectors give fewer centres."""
    start = km.seeds(points, k, seed, weighted)
    return km.lloyd(points, start, max_iter, tol, weighted).centres.dense().tolist()


def weighted_kmeans(sample: DataFrame, k: int, seed: int = 0, max_iter: int = 20, init: list | None = None) -> list:
    """M1 / M2: weighted k-means on the coreset."""
    return kmeans_centres(sample, k, seed=seed, max_iter=max_iter, weighted=True, init=init)


def bulk_kmeans(points: DataFrame, k: int, seed: int = 0, max_iter: int = 1000,
                tol: float = 1e-4, init: list | None = None) -> list:
    """M4: k-means on all points, run to convergence (the reference sets no
    iteration cap; ``max_iter`` is a large safety bound)."""
    return kmeans_centres(points, k, seed=seed, max_iter=max_iter, tol=tol, weighted=False, init=init)


def _gram_times(q: np.ndarray, points: DataFrame, weighted: bool) -> np.ndarray:
    """``A^T W A q`` in one pass: a d x m partial per task, added up along a tree."""
    spark = points.sparkSession
    shared = spark.sparkContext.broadcast(q)
    sparse = is_sparse_type(points.schema["features"].dataType)
    w = F.col("weight") if weighted else F.lit(1.0)
    feats = [F.col("features.indices").alias("_idx"), F.col("features.values").alias("_val")] if sparse else [F.col("features")]

    def partial(batches):
        import pyarrow as pa

        from weftcore.operators.evaluate import _dense_rows
        out = np.zeros_like(shared.value)
        for whole in batches:
            for a in range(0, whole.num_rows, 1024):
                batch = whole.slice(a, 1024)
                x, used = _dense_rows(batch, sparse)
                wx = x * batch.column("w").to_numpy()[:, None]
                if used is None:
                    out += wx.T @ (x @ shared.value)
                else:
                    out[used] += wx.T @ (x @ shared.value[used])
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()])], names=["m"])

    parts = sum_partials(points.select(w.alias("w"), *feats).mapInArrow(partial, "m binary"), 32)
    got = [np.frombuffer(bytes(r["m"])) for r in parts.select("m").collect()]  # at most 32 rows
    return np.sum(got, axis=0).reshape(q.shape) if got else np.zeros_like(q)


def svd_axes(points: DataFrame, k: int, weighted: bool = False, dim: int | None = None,
             tol: float = 1e-10, max_passes: int = 60) -> list:
    """M6 (``weighted=False``) and M3 (``weighted=True``): top-k right
    singular vectors, returned as k axes of length d (V transposed).

    Block Krylov: a block of k + 8 directions is multiplied by ``A^T A``, one
    pass over the points each time, made orthogonal to the blocks before it,
    and joined to them; the Gram matrix within this subspace gives the axes.
    It ends when their residuals are below ``tol`` of the largest eigenvalue,
    or when the subspace is the whole space.  One method for every d; the
    driver holds d x (directions) numbers, the d x d matrix is never formed.
    Weighted rows enter as ``sqrt(w) x``.  Signs are normalised so the
    largest entry is positive.  A warning says if ``max_passes`` were not
    enough."""
    if points.isEmpty():
        return []
    if dim is None:
        sparse = is_sparse_type(points.schema["features"].dataType)
        dim = points.agg(F.max(F.col("features.size") if sparse else F.size("features"))).first()[0]
    rng = np.random.default_rng(0)
    block = np.linalg.qr(rng.standard_normal((dim, min(dim, k + 8))))[0]
    basis, image = np.zeros((dim, 0)), np.zeros((dim, 0))
    for _ in range(max_passes):
        new = _gram_times(block, points, weighted)
        basis, image = np.hstack([basis, block]), np.hstack([image, new])
        small = basis.T @ image
        vals, vecs = np.linalg.eigh((small + small.T) / 2)
        top = np.argsort(vals)[::-1][:k]
        axes, values = basis @ vecs[:, top], vals[top]
        residual = np.linalg.norm(image @ vecs[:, top] - axes * values, axis=0)
        if basis.shape[1] >= dim or residual.max(initial=0) <= tol * max(values.max(initial=0), 1e-300):
            break
        for _ in range(2):
            new = new - basis @ (basis.T @ new)
        q, r = np.linalg.qr(new)
        keep = np.abs(np.diag(r)) > 1e-12 * max(np.abs(np.diag(r)).max(), 1e-300)
        block = q[:, keep][:, :dim - basis.shape[1]]
        if not block.shape[1]:
            break
    else:
        warnings.warn(f"svd_axes: {max_passes} passes left a residual of {residual.max():.3g} beside eigenvalues up to {values.max():.3g}", stacklevel=2)
    out = []
    for a in axes.T:
        a = -a if a[np.argmax(np.abs(a))] < 0 else a
        out.append([float(x) for x in a])
    return out


def svd_values(points: DataFrame, axes: list, weighted: bool = False) -> list:
    """``sum w (x . v)^2`` of every axis v: for singular vectors, the squared
    singular values.  One pass."""
    v = np.array(axes, float).T
    return (v * _gram_times(v, points, weighted)).sum(axis=0).tolist()


def result_frame(spark: SparkSession, batch_id: int, model: list, num_points: int,
                 sample_size: int, alg_name: str, time: _dt.datetime | None = None) -> DataFrame:
    """M9: one ``ComputedResult`` row."""
    time = time or _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    return spark.createDataFrame(
        [(int(batch_id), model, int(num_points), int(sample_size), alg_name, time)], RESULT_SCHEMA)


def model_on_sample(alg: str, dense: bool, k: int, seed: int = 0):
    """M7: the model fitted on a coreset, by algorithm name and density."""
    if alg.endswith("kmeans"):
        return lambda sample: weighted_kmeans(sample, k, seed)
    if alg.endswith("svd"):
        if dense:
            raise ValueError(f"{alg}: SVD on a dense coreset is not supported (as in the reference)")
        # the reference fitted k-means here with a note to do SVD; this is the SVD
        return lambda sample: svd_axes(sample, k, weighted=True)
    raise ValueError(f"unknown algorithm {alg!r}")


def spark_baseline(alg: str, dense: bool, streaming: bool, k: int, seed: int = 0):
    """M8: the Spark baseline without a coreset."""
    if alg == "spark-kmeans":
        if streaming:
            raise ValueError("streaming k-means keeps a state: use weftcore.streaming.kmeans")
        return lambda points: bulk_kmeans(points, k, seed)
    if alg == "spark-svd":
        if streaming or not dense:
            raise ValueError("spark-svd runs on dense bulk input only")
        return lambda points: svd_axes(points, k)
    raise ValueError(f"unknown baseline {alg!r}")
