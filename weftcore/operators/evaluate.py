"""Scoring models against the data.

Centres or axes (k x d, bounded by the model) are broadcast;
points never leave their partitions except as partial sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftcore.functions.vectors import any_sq_norm, coord_mean, dot, is_sparse_type, sparse_dot_dense, sparse_sq_norm, sq_norm
from weftcore.operators.kmeans import Centres, nearest_column
from weftcore.session import scratch_path


def check_dims(points: DataFrame, dims: set[int]) -> int:
    """One dimension everywhere: of the points (all of them) and of the model
    vectors, which must exist; raises otherwise.  Returns it."""
    if not dims:
        raise ValueError("a cost needs at least one centre or axis")
    if len(dims) > 1:
        raise ValueError(f"model vectors of several dimensions: {sorted(dims)}")
    size = F.col("features.size") if is_sparse_type(points.schema["features"].dataType) else F.size("features")
    lo, hi = points.agg(F.min(size), F.max(size)).first()
    if lo is None:
        raise ValueError("a cost needs at least one point")
    dim = dims.pop()
    if (lo, hi) != (dim, dim):
        raise ValueError(f"points of dimension {lo} to {hi} against a model of dimension {dim}")
    return dim


def kmeans_cost(points: DataFrame, centres: list | DataFrame, weighted: bool = False) -> DataFrame:
    """Sum over points of the squared distance to the nearest centre.

    ``centres`` is a list or a one-row frame with column ``c``.  Needs at
    least one centre and one point, all of one dimension.
    """
    if not isinstance(centres, list):
        centres = [list(c) for c in centres.first()["c"]]
    check_dims(points, {len(c) for c in centres})
    w = F.col("weight") if weighted else F.lit(1.0)
    near = points.select(w.alias("w"), nearest_column(points, Centres.of_dense(centres))["d2"].alias("d2"))
    return near.agg(F.sum(F.col("w") * F.col("d2")).alias("cost"))


def projection_terms(features: Column | str, axes: Column | str, gram: Column | str, sparse: bool = False) -> tuple[Column, Column]:
    """Per row: ``|x V V^T|^2`` and ``|x - x V V^T|^2`` for axes given as rows
    of V^T, from ``p = x V`` and ``G = V^T V`` (k x k): ``p^T G p`` and
    ``|x|^2 - 2 p.p + p^T G p``.  The axes need not be orthonormal."""
    f = F.col(features) if isinstance(features, str) else features
    a = F.col(axes) if isinstance(axes, str) else axes
    g = F.col(gram) if isinstance(gram, str) else gram
    p = F.transform(a, lambda ax: sparse_dot_dense(f, ax) if sparse else dot(f, ax))
    proj = dot(p, F.transform(g, lambda row: dot(p, row)))
    xx = sparse_sq_norm(f) if sparse else sq_norm(f)
    return proj, F.greatest(xx - 2.0 * sq_norm(p) + proj, F.lit(0.0))


def svd_cost(points: DataFrame, axes: list) -> DataFrame:
    """``|A V V^T|_F`` (the reference's projection norm) and the residual
    ``|A - A V V^T|_F``, plus ``|A|_F``; axes are k rows of length d."""
    check_dims(points, {len(a) for a in axes})
    rows = [[float(x) for x in r] for r in axes]
    gram = [[sum(x * y for x, y in zip(a, b)) for b in rows] for a in rows]
    adf = points.sparkSession.createDataFrame([(rows, gram)], "a array<array<double>>, g array<array<double>>")
    sparse = is_sparse_type(points.schema["features"].dataType)
    proj, resid = projection_terms("features", "a", "g", sparse)
    return points.crossJoin(F.broadcast(adf)).agg(
        F.sqrt(F.sum(proj)).alias("projection_norm"),
        F.sqrt(F.sum(resid)).alias("residual_norm"),
        F.sqrt(F.sum(any_sq_norm("features", sparse))).alias("frobenius_norm"))


def centre_stats(results: DataFrame) -> DataFrame:
    """A7-A9 per result: count/mean/stddev_pop/max/min of the centres'
    coordinate means, and their common dimension (an error if they differ)."""
    c = results.select("batch_id", F.explode("points").alias("_p"))
    one = F.min(F.size("_p")) == F.max(F.size("_p"))
    dim = F.when(one, F.min(F.size("_p"))).otherwise(F.raise_error(F.lit("centres of several dimensions in one result")).cast("int"))
    return c.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("k"),
        dim.alias("dim"),
        F.avg(coord_mean("_p")).alias("mean_of_means"),
        F.stddev_pop(coord_mean("_p")).alias("stddev_of_means"),
        F.max(coord_mean("_p")).alias("max_of_means"),
        F.min(coord_mean("_p")).alias("min_of_means"))


def running_points(results: DataFrame) -> DataFrame:
    """Non-empty results with the running total of points in
    batch order and their number.  The one-partition window sees three
    numbers per batch; models are joined back to them."""
    some = results.where((F.col("num_points") > 0) & (F.size("points") > 0))
    w = Window.orderBy("batch_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    narrow = some.select("batch_id", F.col("num_points").alias("_n")).select(
        "batch_id", F.sum("_n").over(w).alias("cum_points"), F.row_number().over(Window.orderBy("batch_id")).alias("batch_no"))
    return some.join(narrow, "batch_id")


def kmeans_terms(x, xx, model):
    """Squared distance of each row to its nearest centre."""
    import numpy as np
    return np.maximum(xx + ((model * model).sum(axis=1)[None, :] - 2 * x @ model.T).min(axis=1), 0)


def svd_terms(x, xx, model):
    """Squared norm of each row's projection, p^T G p."""
    p = x @ model.T
    return ((p @ (model @ model.T)) * p).sum(axis=1)


#: Cost of a result: terms that are summed over the points, and what the sum becomes.
COSTS = {"kmeans": (kmeans_terms, lambda c: c), "svd": (svd_terms, F.sqrt)}

# Model cells (results x k x d doubles) that one pass over the points holds.
BLOCK_CELLS = 4_000_000


def _dense_rows(batch, sparse: bool):
    """An Arrow batch's points as a matrix; sparse ones over the coordinates in use."""
    import numpy as np
    if not sparse:
        col = batch.column("features")
        return np.array(col.flatten().to_numpy(zero_copy_only=False), float).reshape(batch.num_rows, -1), None
    idx, val = batch.column("_idx"), batch.column("_val")
    lens = np.diff(np.asarray(idx.offsets))
    used, at = np.unique(np.asarray(idx.flatten()), return_inverse=True)
    x = np.zeros((batch.num_rows, len(used)))
    x[np.repeat(np.arange(batch.num_rows), lens), at] = np.asarray(val.flatten())
    return x, used


def _prefix_sums(shared, terms, idx_col: str, sparse: bool, rows: int = 1024):
    """Per task: each result's sum of terms over the task's points in its prefix."""
    def run(batches):
        import numpy as np
        import pyarrow as pa
        models = shared.value
        sums = np.zeros(len(models))
        for whole in batches:
            for a in range(0, whole.num_rows, rows):
                batch = whole.slice(a, rows)
                x, used = _dense_rows(batch, sparse)
                xx, idx = (x * x).sum(axis=1), batch.column(idx_col).to_numpy()
                for r, (_, cum, m) in enumerate(models):
                    inside = idx < cum
                    if not inside.any():
                        continue
                    if used is None:
                        sums[r] += terms(x[inside], xx[inside], m).sum()
                    else:  # coordinates that no point here uses: the rest of |c|^2, or of the axes' products
                        sums[r] += _with_rest(terms, x[inside], xx[inside], m, used)
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _, _ in models], pa.int64()), pa.array(sums)], names=["batch_id", "part"])
    return run


def model_ranges(res: DataFrame) -> list[tuple[int, int]]:
    """Ranges of ``batch_no`` whose models hold about ``BLOCK_CELLS`` numbers
    (one larger model is a range of its own): a row per range."""
    cells = F.aggregate("points", F.lit(0).cast("long"), lambda a, p: a + F.size(p))
    before = F.sum("cells").over(Window.orderBy("batch_no").rowsBetween(Window.unboundedPreceding, -1))
    sized = res.select("batch_no", cells.alias("cells")).withColumn("range", F.floor(F.coalesce(before, F.lit(0)) / F.lit(BLOCK_CELLS)))
    rows = sized.groupBy("range").agg(F.min("batch_no").alias("lo"), F.max("batch_no").alias("hi")).orderBy("range").collect()
    return [(int(r["lo"]), int(r["hi"])) for r in rows]


def _models(res: DataFrame, lo: int, hi: int) -> list:
    """(batch_id, cum_points, matrix) of one range of results, by batch_no."""
    import numpy as np
    got = res.where(F.col("batch_no").between(lo, hi)).select("batch_id", "cum_points", "points").orderBy("batch_no").toArrow()
    out = []
    for batch, cum, rows in zip(got.column("batch_id").to_pylist(), got.column("cum_points").to_pylist(), got.column("points")):
        out.append((batch, cum, np.asarray(rows.values.flatten()).reshape(len(rows), -1)))
    return out


def _with_rest(terms, x, xx, model, used):
    """Terms of sparse rows laid out over ``used``: the model's other columns
    meet zeros, so they are folded into columns that keep its inner products."""
    import numpy as np
    rest = np.delete(model, used, axis=1)
    gram = rest @ rest.T
    vals, vecs = np.linalg.eigh(gram)
    fold = vecs * np.sqrt(np.maximum(vals, 0))
    wide = np.hstack([model[:, used], fold])
    return terms(np.hstack([x, np.zeros((len(x), fold.shape[1]))]), xx, wide).sum()


def progressive_cost(points: DataFrame, results: DataFrame, cost="kmeans",
                     idx_col: str = "idx") -> DataFrame:
    """Result i is scored on the first ``sum_{j<=i} num_points`` points.

    One scan scores many results: models are read range by range of
    ``batch_no`` (:func:`model_ranges`), so the driver and a broadcast hold
    about ``BLOCK_CELLS`` numbers however many results there are.  Each task
    computes distances as matrix products and gives one partial sum per
    result; a range's sums are written before the next one is read.  No point
    is paired with a result as rows.  ``points`` carries a 0-based ``idx``
    (W1); dense or sparse.  ``cost`` is a name in ``COSTS`` or a pair like its
    values.
    """
    spark = points.sparkSession
    if isinstance(cost, str):
        if cost not in COSTS:
            raise ValueError(f"unknown cost {cost!r}")
        cost = COSTS[cost]
    terms, finish = cost
    res = running_points(results)
    sparse = is_sparse_type(points.schema["features"].dataType)
    ranges = model_ranges(res)
    if ranges:
        size = res.select(F.explode("points").alias("p")).agg(F.min(F.size("p")), F.max(F.size("p"))).first()
        check_dims(points, set(size))
    feats = [F.col("features.indices").alias("_idx"), F.col("features.values").alias("_val")] if sparse else [F.col("features")]
    src, path = points.select(idx_col, *feats), scratch_path(spark, "prefix-sums")
    for k, (lo, hi) in enumerate(ranges):
        shared = spark.sparkContext.broadcast(_models(res, lo, hi))
        src.mapInArrow(_prefix_sums(shared, terms, idx_col, sparse), "batch_id long, part double").write.parquet(f"{path}/range={k}")
        shared.destroy()
    sums = spark.read.parquet(path) if ranges else spark.createDataFrame([], "batch_id long, part double")
    costs = sums.groupBy("batch_id").agg(finish(F.sum("part")).alias("cost"))
    total = points.agg(F.count(F.lit(1)).alias("total_points"))
    return (res.select("batch_id", "sample_size", "num_points", "cum_points", "batch_no", "alg_name")
            .join(costs, "batch_id", "left").crossJoin(F.broadcast(total))
            .join(centre_stats(res), "batch_id", "left"))


def cost_kind(alg_name: str) -> str:
    """The cost by name suffix; anything else is an error."""
    if alg_name.endswith("kmeans"):
        return "kmeans"
    if alg_name.endswith("svd"):
        return "svd"
    raise ValueError(f"cannot evaluate {alg_name!r}: name must end in 'kmeans' or 'svd'")


def evaluate(points: DataFrame, results: DataFrame, alg_name: str) -> DataFrame:
    """E4 + E3: progressive cost with the cost chosen by name."""
    return progressive_cost(points, results, cost_kind(alg_name))


def report(costs: DataFrame, path: str) -> DataFrame:
    """K5: the cost table with the path of the results it scores."""
    return costs.withColumn("result_path", F.lit(path))


def write_report(report: DataFrame, path: str) -> None:
    """K5: the cost report as tab-separated text with a header."""
    flat = report.select(*[F.col(c).cast("string").alias(c) for c in report.columns])
    flat.coalesce(1).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)
