"""The registered queries: one per operator group, over the driver tables.

Every query reads whole tables (or data Spark derives from them).  Floating
outputs are rounded (6 decimals, fewer for large sums) so that Spark and the
SQL oracle agree despite different summation orders.  Integer outputs are
BIGINT unless stated.
"""

from __future__ import annotations

import os
from typing import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftcore.functions.hashing import uniform01
from weftcore.functions.linalg import gram_matrix, matrix_cells, multiply_rows, transpose
from weftcore.functions.terms import hashed_terms
from weftcore.functions.vectors import coord_mean, is_sparse_type, sparse_to_dense, sq_norm
from weftcore.operators import evaluate as ev
from weftcore.operators import models
from weftcore.operators import relational as rel
from weftcore.operators.samplers import (ClusterMeanSampler, FixedCentreReducer, LeverageSampler, LightSampler, NormSampler,
                                         SensitivitySampler, SystematicSampler, UniformSampler,
                                         take_ids, take_multi_sample, weighted_mean)
from weftcore.operators.tree import (ChunkedTreeConfig, TreeConfig, assign_leaves, chunked_tree_reduce,
                                     coreset, leaf_sample, tree_reduce)
from weftcore.plans.jobs import JobConfig, run
from weftcore.session import bound_workers, scratch_path
from weftcore.sources.points import materialize, number_rows, points_from_array, points_from_columns
from weftcore.sources.text import dense_line, parse_dense, parse_sparse, sparse_line
from weftcore.streaming.kmeans import streaming_kmeans_update
from weftcore.streaming.tree_stream import StreamingTreeSampler, committed_results, latest_result
from weftcore.streaming.windows import batch_progress, sliding_sum

SEED = 42
R = 6


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf, f"{name}.parquet"))


def _r(c, n: int = R):
    return F.round(F.col(c) if isinstance(c, str) else c, n)


# ------------------------------------------------------------ point sets ---

def embedding_points(spark, sf) -> DataFrame:
    """``embeddings`` as dense points (FLOAT cast to DOUBLE)."""
    return points_from_array(_t(spark, sf, "embeddings"), "vec_id", "embedding", extra=["label"])


# lineitem has no unique key; rows are numbered (W1) in this order, which is
# unique over whole rows (fixed values).
LINEITEM_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                  "l_extendedprice", "l_shipdate"]
LINEITEM_PID_SQL = ("row_number() OVER (ORDER BY " + ", ".join(LINEITEM_ORDER) + ") - 1")
# 4-d lineitem points, scaled to comparable ranges (fixed values).
LINEITEM_FEATURES_SQL = ["l_quantity / 10.0", "l_extendedprice / 10000.0",
                         "l_discount * 10.0", "l_tax * 10.0"]


def lineitem_numbered(spark, sf, *keep: str) -> DataFrame:
    """Columns ``keep`` of ``lineitem`` with a unique 0-based ``pid`` (scalable numbering)."""
    return number_rows(_t(spark, sf, "lineitem"), LINEITEM_ORDER, "pid", keep=list(keep))


def lineitem_points(spark, sf, numbered: bool = True) -> DataFrame:
    """4-d points; ``numbered=False`` where no ``pid`` is read (all -1): one scan."""
    li = lineitem_numbered(spark, sf, "l_quantity", "l_extendedprice", "l_discount", "l_tax") if numbered else _t(spark, sf, "lineitem").withColumn("pid", F.lit(-1))
    feats = [F.col("l_quantity") / 10.0, F.col("l_extendedprice") / 10000.0,
             F.col("l_discount") * 10.0, F.col("l_tax") * 10.0]
    return points_from_columns(li, "pid", feats)


def label_centres(points: DataFrame) -> list:
    """Per-label mean vectors, in label order (k x d, collected: a model)."""
    m = weighted_mean(points, ["label"]).orderBy("label").collect()
    return [list(r["_mu"]) for r in m]


# --------------------------------------------------------------- queries ---

def q_dense_text_roundtrip(spark, sf):
    """Every embedding and its label written as a dense line and parsed."""
    e = _t(spark, sf, "embeddings")
    lines = e.select("vec_id", dense_line(F.col("embedding").cast("array<double>"), "label").alias("value"))
    p = parse_dense(lines, keep=["vec_id"], mode="FAILFAST")
    return p.select("vec_id", F.posexplode("features").alias("j", "value")).select(
        "vec_id", F.col("j").cast("bigint").alias("j"), _r("value").alias("value"))


def q_sparse_text_roundtrip(spark, sf):
    """Every document's term vector written as a sparse line (1-based) and parsed."""
    lines = document_points(spark, sf).select("pid", sparse_line("pid", "features").alias("value"))
    p = parse_sparse(lines, keep=["pid"], mode="FAILFAST")
    z = p.select("pid", F.col("features.size").alias("size"),
                 F.explode(F.arrays_zip("features.indices", "features.values")).alias("e"))
    return z.select(F.col("pid").alias("doc_id"), F.col("size").cast("bigint").alias("size"),
                    F.col("e.indices").cast("bigint").alias("idx"), _r("e.values").alias("value"))


def q_vector_mean_stats(spark, sf):
    """Per label, stats of each vector's coordinate mean."""
    p = embedding_points(spark, sf).withColumn("m", coord_mean("features"))
    return p.groupBy("label").agg(
        F.count(F.lit(1)).alias("cnt"), _r(F.avg("m")).alias("mean"),
        _r(F.stddev_pop("m")).alias("stddev_pop"), _r(F.max("m")).alias("max"),
        _r(F.min("m")).alias("min")).select(F.col("label").cast("bigint").alias("label"), "cnt",
                                            "mean", "stddev_pop", "max", "min")


def q_uniform_coreset(spark, sf):
    """C4: bottom-50 by u(pid, 42) over all embeddings; weight = n / 50."""
    s = UniformSampler().sample(embedding_points(spark, sf).drop("label"), [], 50, SEED)
    return s.select("pid", _r("weight").alias("weight"))


def q_tree_uniform_coreset(spark, sf):
    """16 leaves (pid mod 16), fan-in 2, s = 50; equals the global bottom-50."""
    o = _t(spark, sf, "orders")
    p = points_from_columns(o, "o_orderkey", ["o_totalprice"])
    cs = coreset(p, TreeConfig(50, 2, leaves=16, leaf_mode="mod"), UniformSampler(), SEED)
    return cs.select("pid", _r("weight").alias("weight"))


def q_weighted_uniform_coreset(spark, sf):
    """C4 on weighted points: 50 orders of weight totalprice / 1000, by weight / u."""
    p = points_from_columns(_t(spark, sf, "orders"), "o_orderkey", ["o_totalprice"],
                            weight=F.col("o_totalprice") / 1000.0)
    s = UniformSampler().prepare(p).sample(p, [], 50, SEED)
    return s.select("pid", _r("weight").alias("weight"))


def q_take_ids(spark, sf):
    """20 sampled orders as points of their customer key; equal points go by their last id."""
    p = points_from_columns(_t(spark, sf, "orders"), "o_orderkey", ["o_custkey"])
    return take_ids(p, 20, UniformSampler(weighted=False), SEED)


def q_take_multi_sample(spark, sf):
    """One uniform sample of 30 over two containers, orders and customers."""
    o = points_from_columns(_t(spark, sf, "orders"), "o_orderkey", ["o_totalprice"])
    c = points_from_columns(_t(spark, sf, "customer"), F.col("c_custkey") + F.lit(10**9), ["c_acctbal"])
    s = take_multi_sample([o, c], 30, UniformSampler(weighted=False), SEED)
    return s.select("pid", _r("weight").alias("weight"))


TREE_SYS_LEAVES, TREE_SYS_S, TREE_SYS_FAN = 16, 5, 2


def q_tree_forest_systematic(spark, sf):
    """The reference's systematic test sampler over ``orders``,
    leaves o_orderkey mod 16, fan-in 2, s = 5: the whole forest."""
    o = _t(spark, sf, "orders")
    p = points_from_columns(o, "o_orderkey", ["o_orderkey"])
    cfg = TreeConfig(TREE_SYS_S, TREE_SYS_FAN, leaves=TREE_SYS_LEAVES, leaf_mode="mod")
    leaves = leaf_sample(assign_leaves(p, cfg), cfg, SystematicSampler(), SEED)
    tree = tree_reduce(leaves, cfg, SystematicSampler(), SEED)
    return tree.select(F.col("level").cast("bigint").alias("level"), "node", "pid", "weight")


CHUNK_S, CHUNK_MIN, CHUNK_MAX, CHUNK_FAN, CHUNK_LEAVES = 50, 100, 200, 4, 16


def q_tree_forest_chunked(spark, sf):
    """The prototype's two-threshold tree over ``orders`` with the
    uniform sampler: leaves o_orderkey mod 16 as level-0 containers, chunks of
    at most 200, chunks of at least 100 sampled to 50, fan-in 4."""
    o = _t(spark, sf, "orders")
    p = points_from_columns(o, "o_orderkey", ["o_totalprice"])
    t0 = p.select(F.lit(0).alias("level"), F.pmod("pid", F.lit(CHUNK_LEAVES)).cast("long").alias("node"),
                  "pid", "features", "weight")
    cfg = ChunkedTreeConfig(CHUNK_S, CHUNK_MIN, CHUNK_MAX, CHUNK_FAN)
    t = chunked_tree_reduce(t0, cfg, UniformSampler(weighted=False), SEED)
    return t.select(F.col("level").cast("bigint").alias("level"), "node", "pid", _r("weight").alias("weight"))


def q_leaf_samples(spark, sf):
    """Lineitem leaves pid mod 64, uniform s = 20 per leaf, fan-in 2."""
    cfg = TreeConfig(20, 2, leaves=64, leaf_mode="mod")
    t = leaf_sample(assign_leaves(lineitem_points(spark, sf), cfg), cfg, UniformSampler(), SEED)
    return t.select(F.col("level").cast("bigint").alias("level"), "node", "pid",
                    _r("weight").alias("weight"))


def q_light_coreset(spark, sf):
    """C5 (light): 50 embeddings by light sensitivity, priority-sampled."""
    s = LightSampler().sample(embedding_points(spark, sf).drop("label"), [], 50, SEED)
    return s.select("pid", _r("weight").alias("weight"))


TREE_LIGHT_S, TREE_LIGHT_FAN, TREE_LIGHT_LEAVES = 50, 2, 8


def q_tree_light_coreset(spark, sf):
    """C5 + C16: light sampler through a tree of 8 leaves (vec_id mod 8), s = 50: the sample."""
    pts = embedding_points(spark, sf).drop("label")
    cs = coreset(pts, TreeConfig(TREE_LIGHT_S, TREE_LIGHT_FAN, leaves=TREE_LIGHT_LEAVES, leaf_mode="mod"), LightSampler(), SEED)
    return cs.select("pid", _r("weight").alias("weight"))


def q_sensitivity_coreset(spark, sf):
    """100 embeddings by full sensitivity against fixed centres, the label means."""
    pts = embedding_points(spark, sf)
    s = SensitivitySampler(centres=label_centres(pts)).sample(pts.drop("label"), [], 100, SEED)
    return s.select("pid", _r("weight").alias("weight"))


TREE_SENS_S, TREE_SENS_LEAVES = 100, 4


def q_tree_sensitivity_coreset(spark, sf):
    """C5 + C16: sensitivity sampler against the label means through a tree of
    4 leaves (vec_id mod 4), s = 100: the sample."""
    pts = embedding_points(spark, sf)
    sampler = SensitivitySampler(centres=label_centres(pts))
    cs = coreset(pts.drop("label"), TreeConfig(TREE_SENS_S, 2, leaves=TREE_SENS_LEAVES, leaf_mode="mod"), sampler, SEED)
    return cs.select("pid", _r("weight").alias("weight"))


def q_norm_coreset(spark, sf):
    """100 lineitem rows by squared norm, priority-sampled."""
    s = NormSampler().sample(lineitem_points(spark, sf), [], 100, SEED)
    return s.select("pid", _r("weight").alias("weight"))


def q_leverage_coreset(spark, sf):
    """C8 (rank k): 100 lineitem rows by leverage on two fixed axes, priority-sampled."""
    pts = lineitem_points(spark, sf)
    s = LeverageSampler(axes=PROJ_AXES).prepare(pts).sample(pts, [], 100, SEED)
    return s.select("pid", _r("weight").alias("weight"))


def q_cluster_mean_coreset(spark, sf):
    """C7 (fixed centres): each embedding to its nearest label centre; per
    cluster the weight sum and the weighted mean, one row per coordinate."""
    pts = embedding_points(spark, sf)
    red = FixedCentreReducer(label_centres(pts)).reduce(pts.drop("label"))
    out = red.select("cluster", "n", "weight", F.posexplode("features").alias("j", "value"))
    return out.select(F.col("cluster").cast("bigint").alias("cluster"), "n",
                      _r("weight").alias("weight"), F.col("j").cast("bigint").alias("j"),
                      _r("value").alias("value"))


def q_kmeans_cost_label_centres(spark, sf):
    """K-means cost of all embeddings against the label means."""
    pts = embedding_points(spark, sf)
    cent = label_centres(pts)
    c = ev.kmeans_cost(pts, cent)
    return c.select(_r("cost").alias("cost"), F.lit(len(cent)).cast("bigint").alias("k"),
                    F.lit(len(cent[0])).cast("bigint").alias("dim"))


PROG_BATCHES = 5


def progressive_results(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Embeddings cut into 5 batches by row number; result b holds the label
    means over everything seen up to batch b (a streaming model's output)."""
    pts = number_rows(embedding_points(spark, sf), ["pid"], "idx")
    n = pts.count()
    pts = pts.withColumn("batch", F.floor(F.col("idx") * PROG_BATCHES / F.lit(n)).cast("long"))
    # Per (batch, label, coordinate) sums, then running sums over batches: the
    # table is batches x labels x d, so no point is ever paired with a batch.
    cells = pts.select("batch", "label", F.posexplode("features").alias("j", "x"))
    agg = cells.groupBy("batch", "label", "j").agg(F.sum("x").alias("sx"),
                                                   F.count(F.lit(1)).alias("cnt"))
    grid = (agg.select("batch").distinct()
            .crossJoin(agg.select("label", "j").distinct()))
    full = grid.join(agg, ["batch", "label", "j"], "left").fillna(0, ["sx", "cnt"])
    w = Window.partitionBy("label", "j").orderBy("batch").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    run = (full.withColumn("csx", F.sum("sx").over(w)).withColumn("cn", F.sum("cnt").over(w))
           .where(F.col("cn") > 0).withColumn("m", F.col("csx") / F.col("cn")))
    cvec = run.groupBy("batch", "label").agg(F.array_sort(F.collect_list(
        F.struct("j", "m"))).alias("_v")).select(
        "batch", "label", F.transform("_v", lambda e: e["m"]).alias("_mu"))
    cent = cvec.groupBy(F.col("batch").alias("batch_id")).agg(F.array_sort(F.collect_list(
        F.struct("label", "_mu"))).alias("_c"))
    sizes = pts.groupBy(F.col("batch").alias("batch_id")).agg(F.count(F.lit(1)).alias("num_points"))
    res = cent.join(sizes, "batch_id").select(
        "batch_id", F.transform("_c", lambda e: e["_mu"]).alias("points"), "num_points",
        F.lit(0).alias("sample_size"), F.lit("label-means-kmeans").alias("alg_name"))
    return pts, res


def q_progressive_cost(spark, sf):
    """Each batch's model scored on its prefix."""
    pts, res = progressive_results(spark, sf)
    rep = ev.progressive_cost(pts, res, "kmeans")
    return rep.select(
        F.col("batch_id").cast("bigint").alias("batch_id"), "num_points", "cum_points",
        "total_points", F.col("batch_no").cast("bigint").alias("batch_no"),
        _r("cost").alias("cost"), F.col("k").cast("bigint").alias("k"),
        F.col("dim").cast("bigint").alias("dim"), _r("mean_of_means").alias("mean_of_means"),
        _r("stddev_of_means").alias("stddev_of_means"), _r("max_of_means").alias("max_of_means"),
        _r("min_of_means").alias("min_of_means"))


def _write_lines(lines: DataFrame, path: str) -> None:
    """Text files in the order of ``part``, then ``pid``: one folder per part,
    its files by ranges of pid."""
    lines.repartitionByRange(4, "part", "pid").sortWithinPartitions("part", "pid").select("part", "value").write.partitionBy("part").text(path)


def q_evaluate_job(spark, sf):
    """The evaluate job on embeddings
    written as text files of unequal size; its report written and read again."""
    pts, res = progressive_results(spark, sf)
    base = scratch_path(spark, "evaluate-job")
    n = pts.count()
    part = F.when(F.col("idx") * 50 < n, 0).when(F.col("idx") * 3 < n, 1).otherwise(2)
    _write_lines(pts.select("pid", part.alias("part"), dense_line("features", "label").alias("value")), f"{base}/in")
    res.withColumn("b", F.col("batch_id")).select(*[c for c in res.columns if c != "batch_id"], F.col("b").alias("batch_id")) \
        .write.partitionBy("batch_id").parquet(f"{base}/results")
    out = None
    for ranges in (None, 5):
        cfg = JobConfig(alg="coreset-kmeans", algorithm_params=10, input=f"{base}/in", output=f"{base}/results", mode="evaluate", dense=True, parallelism=ranges)
        ev.write_report(run(spark, cfg), f"{base}/report-{ranges}")
        got = spark.read.option("sep", "\t").option("header", True).option("inferSchema", True).csv(f"{base}/report-{ranges}")
        got = got.where(F.col("result_path") == f"{base}/results").select(
            F.lit(ranges or 0).cast("bigint").alias("ranges"), F.col("batch_id").cast("bigint").alias("batch_id"), F.col("num_points").cast("bigint").alias("num_points"),
            F.col("cum_points").cast("bigint").alias("cum_points"), F.col("total_points").cast("bigint").alias("total_points"),
            _r("cost", 4).alias("cost"), F.col("k").cast("bigint").alias("k"), F.col("dim").cast("bigint").alias("dim"))
        out = got if out is None else out.unionByName(got)
    return out


# Two orthonormal axes in R^4 (fixed values).
PROJ_AXES = [[0.5, 0.5, 0.5, 0.5], [0.5, -0.5, 0.5, -0.5]]


def q_projection_norm(spark, sf):
    """Projection norm, residual and Frobenius norm of lineitem on fixed axes."""
    c = ev.svd_cost(lineitem_points(spark, sf, numbered=False), PROJ_AXES)
    return c.select(*[_r(x).alias(x) for x in ("projection_norm", "residual_norm", "frobenius_norm")])


def q_gram_matrix(spark, sf):
    """A^T A of the 4-d lineitem points."""
    g = gram_matrix(lineitem_points(spark, sf, numbered=False))
    return g.select(F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"),
                    _r("value", 4).alias("value"))


def q_label_mean_transpose(spark, sf):
    """The matrix of label means by rows, its cells, and their transpose."""
    m = weighted_mean(embedding_points(spark, sf), ["label"]).select(F.col("label").alias("i"), F.col("_mu").alias("row"))
    t = transpose(matrix_cells(m))
    return t.select(F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"), _r("value").alias("value"))


def q_label_mean_product(spark, sf):
    """F8: all embeddings times the transposed label means (one broadcast row)."""
    pts = embedding_points(spark, sf)
    means = spark.createDataFrame([(label_centres(pts),)], "m array<array<double>>")
    p = pts.crossJoin(F.broadcast(means)).select("pid", F.posexplode(multiply_rows("features", "m")).alias("c", "value"))
    return p.select("pid", F.col("c").cast("bigint").alias("c"), _r("value").alias("value"))


def axes_rows(axes: list, points: DataFrame, weighted: bool = False) -> DataFrame:
    """Per axis v: its number, the products v_i v_j (free of the sign) and
    ``sum w (x . v)^2``, for an axis of singular vectors its eigenvalue."""
    values = models.svd_values(points, axes, weighted)
    rows = [(c, i, j, float(x * y), float(e)) for c, (v, e) in enumerate(zip(axes, values)) for i, x in enumerate(v) for j, y in enumerate(v)]
    out = points.sparkSession.createDataFrame(rows, "c bigint, i bigint, j bigint, value double, eigenvalue double")
    return out.select("c", "i", "j", _r("value").alias("value"), _r("eigenvalue", 3).alias("eigenvalue"))


def q_svd_axes(spark, sf):
    """M6: top-2 right singular vectors of the lineitem points, and their eigenvalues."""
    pts = lineitem_points(spark, sf, numbered=False)
    return axes_rows(models.svd_axes(pts, 2), pts)


def q_weighted_svd(spark, sf):
    """M3: weighted SVD axes of a norm coreset of 200 lineitem rows, and their eigenvalues."""
    s = materialize(NormSampler().sample(lineitem_points(spark, sf), [], 200, SEED), "sample")
    return axes_rows(models.svd_axes(s, 2, weighted=True), s, weighted=True)


KMEANS_K, KMEANS_STEPS, KMEANS_SAMPLE = 10, 6, 100
#: A fit from k-means|| seeds may cost so much more than the Lloyd steps from given centres beside it.
FIT_MARGIN = 1.04


def model_rows(centres: list, points: DataFrame, weighted: bool, fit: list, dense: bool = True) -> DataFrame:
    """Cells of the centres that Lloyd steps give from fixed ones, their cost,
    and whether ``fit``, a model from k-means|| seeds, costs about as much."""
    spark = points.sparkSession
    cost, other = (float(ev.kmeans_cost(points, c, weighted).first()["cost"]) for c in (centres, fit))
    rows = [(c, j, float(x)) for c, v in enumerate(centres) for j, x in enumerate(v) if dense or x]
    out = spark.createDataFrame(rows, "c bigint, j bigint, value double")
    return out.select("c", "j", _r("value").alias("value"), _r(F.lit(cost), 4).alias("cost"), F.lit(len(fit) == len(centres) and other <= FIT_MARGIN * cost).alias("fit_close"))


def first_rows(points: DataFrame, k: int) -> list:
    """The vectors of the k smallest pids, dense."""
    f = sparse_to_dense("features") if is_sparse_type(points.schema["features"].dataType) else F.col("features")
    return [list(r["f"]) for r in points.orderBy("pid").limit(k).select(f.alias("f")).collect()]


def q_weighted_kmeans(spark, sf):
    """M1: weighted k-means (k = 10) on a light coreset of 100 embeddings: six
    Lloyd steps from its 10 smallest ids, and a fit from k-means|| seeds beside it."""
    s = materialize(LightSampler().sample(embedding_points(spark, sf).drop("label"), [], KMEANS_SAMPLE, SEED), "sample")
    centres = models.weighted_kmeans(s, KMEANS_K, max_iter=KMEANS_STEPS, init=first_rows(s, KMEANS_K))
    return model_rows(centres, s, True, models.weighted_kmeans(s, KMEANS_K, SEED))


def q_bulk_kmeans(spark, sf):
    """M4: k-means (k = 10) on all embeddings: six Lloyd steps from the 10
    smallest ids, and a fit from k-means|| seeds beside it."""
    pts = embedding_points(spark, sf).drop("label")
    centres = models.bulk_kmeans(pts, KMEANS_K, max_iter=KMEANS_STEPS, tol=0.0, init=first_rows(pts, KMEANS_K))
    return model_rows(centres, pts, False, models.bulk_kmeans(pts, KMEANS_K, SEED))


STREAM_KMEANS_WEIGHT, STREAM_KMEANS_DECAY = 10.0, 0.5


def q_streaming_kmeans_step(spark, sf):
    """M5: one step of streaming k-means on all embeddings from the label
    means with weight 10 and decay 0.5: the new centres."""
    pts = embedding_points(spark, sf)
    c = label_centres(pts)
    new, weight = streaming_kmeans_update(pts, c, [STREAM_KMEANS_WEIGHT] * len(c), STREAM_KMEANS_DECAY)
    rows = [(i, float(w), [float(x) for x in v]) for i, (v, w) in enumerate(zip(new, weight))]
    out = spark.createDataFrame(rows, "c bigint, weight double, v array<double>").select("c", "weight", F.posexplode("v").alias("j", "value"))
    return out.select("c", _r("weight").alias("weight"), F.col("j").cast("bigint").alias("j"), _r("value").alias("value"))


# --------------------------------------------------------------- streams ---

STREAM_FILES, STREAM_S, STREAM_LEAVES = 4, 50, 4


def _event_points(df: DataFrame) -> DataFrame:
    return df.select(F.col("event_id").alias("pid"), F.array(F.col("value")).alias("features"),
                     F.lit(1.0).alias("weight"))


def run_event_stream(spark, sf) -> tuple[str, str]:
    """Stream all ``events``, dealt into 4 files by equal ranges of id, one file
    per micro-batch in that order, through the tree sampler (leaves event_id
    mod 4); the results and state folders."""
    ev_df = _t(spark, sf, "events")
    base = scratch_path(spark, "events")
    n = ev_df.count()
    for k in range(STREAM_FILES):  # one after the other: files are taken by their time
        part = ev_df.where(F.expr(f"event_id * {STREAM_FILES} div {max(n, 1)}") == k)
        part.coalesce(1).write.mode("append").parquet(f"{base}/src")  # a file is a micro-batch
    stream = spark.readStream.schema(ev_df.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/src")
    cfg = TreeConfig(STREAM_S, 2, leaves=STREAM_LEAVES, leaf_mode="mod")
    sts = StreamingTreeSampler(cfg, UniformSampler(), SEED, f"{base}/state", results_dir=f"{base}/results")
    q = sts.start(_event_points(stream), f"{base}/checkpoint", available_now=True)
    q.awaitTermination()
    return f"{base}/results", f"{base}/state"


def q_streaming_tree_uniform(spark, sf):
    """After 4 micro-batches the streamed
    tree's sample is the bottom-50 of all events, and its weight their number."""
    results, state = run_event_stream(spark, sf)
    done = committed_results(spark.read.parquet(results), spark.read.parquet(os.path.join(state, "commits")))
    return latest_result(done).select("pid", _r("weight").alias("weight"))


def q_streaming_results_running(spark, sf):
    """Per micro-batch and level of its forest the nodes
    and their rows, with the batch's points, the running total and progress."""
    _, state = run_event_stream(spark, sf)
    commits = spark.read.parquet(os.path.join(state, "commits"))
    w = Window.orderBy("batch_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row per batch
    running = batch_progress(commits, batch_secs=86_400).where(F.col("num_points") > 0).withColumn("cum_points", F.sum("num_points").over(w))
    nodes = spark.read.parquet(os.path.join(state, "nodes")).withColumn("batch_id", F.col("batch_id").cast("long"))
    return nodes.join(running, "batch_id").select(
        "batch_id", "num_points", "cum_points", F.col("level").cast("bigint").alias("level"), "nodes", "rows", "smallest", "largest", "over_time")


def q_sliding_points(spark, sf):
    """Events per 2-day window sliding by 1 day, with the value sum."""
    e = _t(spark, sf, "events")
    s = sliding_sum(e, "ts", "value", "2 days", "1 day", out="value_sum")
    return s.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
                    F.date_format("window_end", "yyyy-MM-dd HH:mm:ss").alias("window_end"),
                    F.col("rows").cast("bigint").alias("rows"), _r("value_sum").alias("value_sum"))


# ------------------------------------------------------------ relational ---

def q_inner_join_bag(spark, sf):
    """Orders x customer on the customer key (bag semantics)."""
    o, c = _t(spark, sf, "orders"), _t(spark, sf, "customer")
    j = rel.inner_join(o, c.withColumnRenamed("c_custkey", "o_custkey"), "o_custkey")
    return j.select("o_orderkey", "o_custkey", "c_name", _r("o_totalprice", 2).alias("o_totalprice"))


def q_broadcast_join(spark, sf):
    """Customer with the small nation table, broadcast after a size check."""
    c, n = _t(spark, sf, "customer"), _t(spark, sf, "nation")
    j = rel.broadcast_join(c, n.withColumnRenamed("n_nationkey", "c_nationkey"), "c_nationkey")
    return j.select("c_custkey", F.col("c_nationkey").cast("bigint").alias("c_nationkey"), "n_name")


def q_sample_back_join(spark, sf):
    """20 sampled order ids joined back to their rows, in sample order."""
    o = _t(spark, sf, "orders")
    p = points_from_columns(o, "o_orderkey", ["o_totalprice"])
    ids = UniformSampler().sample(p, [], 20, SEED).select(
        "pid", F.row_number().over(Window.orderBy(uniform01("pid", SEED), "pid")).alias("pos"))
    rows = o.withColumnRenamed("o_orderkey", "pid")
    j = rel.join_back(rows, ids, "pos")
    return j.select((F.col("pos") - 1).cast("bigint").alias("pos"), F.col("pid").alias("o_orderkey"),
                    "o_custkey", _r("o_totalprice", 2).alias("o_totalprice"))


def q_reduce_by_key(spark, sf):
    """A1: per order, quantity sum and line count."""
    li = _t(spark, sf, "lineitem")
    return rel.reduce_by_key(li, "l_orderkey", _r(F.sum("l_quantity"), 2).alias("qty"),
                             F.count(F.lit(1)).alias("lines"))


def q_count_distinct_nodes(spark, sf):
    """Distinct tree addresses when order keys climb one level (div 2)."""
    li = _t(spark, sf, "lineitem").select(F.floor(F.col("l_orderkey") / 2).alias("node"))
    return rel.count_distinct_nodes(li)


def q_distinct_rows(spark, sf):
    """A5."""
    li = _t(spark, sf, "lineitem")
    return rel.distinct_rows(li.select("l_returnflag", "l_linestatus",
                                       F.col("l_linenumber").cast("bigint").alias("l_linenumber")))


def q_observed_rows(spark, sf):
    """Rows counted as they pass into an aggregate."""
    seen, obs = rel.tap(_t(spark, sf, "lineitem"), "lineitem")
    top = seen.agg(F.max("l_quantity")).first()[0]
    return spark.createDataFrame([(int(obs.get["rows"]), float(top))], "rows bigint, max_quantity double")


def q_count_by_value(spark, sf):
    """A13."""
    li = _t(spark, sf, "lineitem").select(F.col("l_linenumber").cast("bigint").alias("l_linenumber"))
    return rel.count_by_value(li, "l_linenumber")


def q_sort_first(spark, sf):
    """O1, O2: the first lineitem row by price descending, ties by pid."""
    li = lineitem_numbered(spark, sf, "l_extendedprice")
    return rel.first_row(li, "l_extendedprice", ascending=False).select(
        "pid", _r("l_extendedprice", 2).alias("l_extendedprice"))


def q_chunk_groups(spark, sf):
    """Lines per order in chunks of 3; rows per chunk number."""
    li = _t(spark, sf, "lineitem")
    c = rel.chunk_ids(li, "l_orderkey", "l_linenumber", 3, keep=[])
    return c.groupBy(F.col("chunk").cast("bigint").alias("chunk")).agg(F.count(F.lit(1)).alias("cnt"))


def q_bag_union(spark, sf):
    """Returned lines and large lines, duplicates kept."""
    li = lineitem_numbered(spark, sf, "l_returnflag", "l_quantity")
    a = li.where(F.col("l_returnflag") == "R").select("pid")
    b = li.where(F.col("l_quantity") > 45).select("pid")
    return rel.bag_union(a, b)


def q_scalable_row_index(spark, sf):
    """Global 0-based row numbers of lineitem in key order without a
    one-task window; the order key and the price identify the row."""
    li = number_rows(_t(spark, sf, "lineitem"), LINEITEM_ORDER, "idx", keep=["l_orderkey", "l_linenumber", "l_extendedprice"])
    return li.select("idx", "l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"),
                     _r("l_extendedprice", 2).alias("l_extendedprice"))


TERM_BUCKETS = 1024


def document_points(spark, sf) -> DataFrame:
    """Each whole document as a sparse hashed term-count vector (1024 buckets
    from md5 of each space-separated token): ``pid`` = doc_id, unit weight.
    Documents without tokens have no point."""
    bound_workers(spark)
    d = _t(spark, sf, "documents").select(F.col("doc_id").alias("pid"), hashed_terms("text", TERM_BUCKETS).alias("features"))
    return d.where(F.size("features.indices") > 0).withColumn("weight", F.lit(1.0))


def q_document_term_vectors(spark, sf):
    """S9 on text: per document the sparse vector's size, non-zeros, total
    count and squared norm."""
    v = document_points(spark, sf)
    return v.select(F.col("pid").alias("doc_id"), F.col("features.size").cast("bigint").alias("size"),
                    F.size("features.indices").cast("bigint").alias("nnz"),
                    F.aggregate("features.values", F.lit(0.0), lambda a, x: a + x).cast("bigint")
                    .alias("total"), _r(sq_norm("features.values"), 2).alias("sq_norm"))


def q_sparse_light_coreset(spark, sf):
    """C6 (light, sparse): 50 documents by light sensitivity on their sparse
    term vectors; distances from non-zeros only."""
    pts = materialize(document_points(spark, sf), "document-vectors")
    s = LightSampler().sample(pts, [], 50, SEED)
    return s.select("pid", _r("weight").alias("weight"))


def q_sparse_norm_coreset(spark, sf):
    """C8 (sparse): 50 documents by squared norm of their term vectors."""
    s = NormSampler().sample(document_points(spark, sf), [], 50, SEED)
    return s.select("pid", _r("weight").alias("weight"))


def q_sparse_cluster_coreset(spark, sf):
    """C7 (sparse, "coreset2"): documents through a tree of 4 leaves with the
    cluster-mean sampler, s = 20: the kept weighted sum of every coordinate."""
    pts = materialize(document_points(spark, sf), "document-vectors")
    cs = materialize(coreset(pts, TreeConfig(20, 2, leaves=4), ClusterMeanSampler(), SEED), "sample")
    cells = cs.select("weight", F.explode(F.arrays_zip("features.indices", "features.values")).alias("e"))
    kept = cells.groupBy(F.col("e.indices").cast("bigint").alias("j")).agg(_r(F.sum(F.col("weight") * F.col("e.values")), 4).alias("total"))
    size = cs.agg(_r(F.sum("weight"), 6).alias("weight"), (F.count(F.lit(1)) <= 20).alias("small"))
    return kept.crossJoin(F.broadcast(size))  # one row


SPARSE_K, SPARSE_STEPS, SPARSE_SAMPLE = 5, 4, 100


def q_sparse_kmeans_coreset(spark, sf):
    """C6 + M2: sparse sensitivity coreset of documents against the vectors of
    the 5 smallest ids, then four weighted Lloyd steps from its 5 smallest
    ids; beside it the same with rough centres and seeds by k-means||, its
    model scored on the first sample."""
    pts = materialize(document_points(spark, sf), "document-vectors")
    rough = SensitivitySampler(centres=first_rows(pts, SPARSE_K))
    s = materialize(rough.sample(pts, [], SPARSE_SAMPLE, SEED), "sample")
    centres = models.weighted_kmeans(s, SPARSE_K, max_iter=SPARSE_STEPS, init=first_rows(s, SPARSE_K))
    own = materialize(SensitivitySampler(k=SPARSE_K, seed=SEED).prepare(pts).sample(pts, [], SPARSE_SAMPLE, SEED), "sample")
    return model_rows(centres, s, True, models.weighted_kmeans(own, SPARSE_K, SEED, max_iter=20), dense=False)


def q_sparse_svd_coreset(spark, sf):
    """C8 + M3: weighted SVD axes (k = 2) of a sparse norm coreset of 100
    documents: their squared entries and eigenvalues."""
    s = materialize(NormSampler().sample(document_points(spark, sf), [], 100, SEED), "sample")
    axes = models.svd_axes(s, 2, weighted=True)
    values = models.svd_values(s, axes, weighted=True)
    rows = [(c, j, float(x * x), float(e)) for c, (v, e) in enumerate(zip(axes, values)) for j, x in enumerate(v)]
    out = spark.createDataFrame(rows, "c bigint, j bigint, value double, eigenvalue double")
    return out.select("c", "j", _r("value").alias("value"), _r("eigenvalue", 3).alias("eigenvalue"))


def q_sparse_leverage_coreset(spark, sf):
    """C8 (rank k, sparse): 50 documents by leverage on the two axes of ``sparse_svd_cost``."""
    pts = document_points(spark, sf)
    s = LeverageSampler(axes=SPARSE_AXES).prepare(pts).sample(pts, [], 50, SEED)
    return s.select("pid", _r("weight").alias("weight"))


# Two axes over the term buckets, neither unit nor orthogonal (fixed values).
SPARSE_AXES = [[1.0] * TERM_BUCKETS, [float(j % 3) for j in range(TERM_BUCKETS)]]


def q_sparse_svd_cost(spark, sf):
    """E2 (sparse): all documents' term vectors on two axes that are neither unit nor orthogonal."""
    c = ev.svd_cost(document_points(spark, sf), SPARSE_AXES)
    return c.select(*[_r(x, 3).alias(x) for x in ("projection_norm", "residual_norm", "frobenius_norm")])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "dense_text_roundtrip": q_dense_text_roundtrip,
    "sparse_text_roundtrip": q_sparse_text_roundtrip,
    "vector_mean_stats": q_vector_mean_stats,
    "uniform_coreset": q_uniform_coreset,
    "tree_uniform_coreset": q_tree_uniform_coreset,
    "tree_forest_systematic": q_tree_forest_systematic,
    "leaf_samples": q_leaf_samples,
    "tree_forest_chunked": q_tree_forest_chunked,
    "light_coreset": q_light_coreset,
    "tree_light_coreset": q_tree_light_coreset,
    "sensitivity_coreset": q_sensitivity_coreset,
    "norm_coreset": q_norm_coreset,
    "leverage_coreset": q_leverage_coreset,
    "cluster_mean_coreset": q_cluster_mean_coreset,
    "kmeans_cost_label_centres": q_kmeans_cost_label_centres,
    "progressive_cost": q_progressive_cost,
    "projection_norm": q_projection_norm,
    "gram_matrix": q_gram_matrix,
    "svd_axes": q_svd_axes,
    "weighted_svd": q_weighted_svd,
    "weighted_kmeans": q_weighted_kmeans,
    "bulk_kmeans": q_bulk_kmeans,
    "streaming_tree_uniform": q_streaming_tree_uniform,
    "streaming_results_running": q_streaming_results_running,
    "sliding_points": q_sliding_points,
    "inner_join_bag": q_inner_join_bag,
    "broadcast_join": q_broadcast_join,
    "sample_back_join": q_sample_back_join,
    "reduce_by_key": q_reduce_by_key,
    "count_distinct_nodes": q_count_distinct_nodes,
    "distinct_rows": q_distinct_rows,
    "count_by_value": q_count_by_value,
    "sort_first": q_sort_first,
    "chunk_groups": q_chunk_groups,
    "bag_union": q_bag_union,
    "scalable_row_index": q_scalable_row_index,
    "document_term_vectors": q_document_term_vectors,
    "sparse_light_coreset": q_sparse_light_coreset,
    "sparse_norm_coreset": q_sparse_norm_coreset,
    "sparse_leverage_coreset": q_sparse_leverage_coreset,
    "sparse_cluster_coreset": q_sparse_cluster_coreset,
    "sparse_kmeans_coreset": q_sparse_kmeans_coreset,
    "sparse_svd_coreset": q_sparse_svd_coreset,
    "weighted_uniform_coreset": q_weighted_uniform_coreset,
    "take_ids": q_take_ids,
    "take_multi_sample": q_take_multi_sample,
    "tree_sensitivity_coreset": q_tree_sensitivity_coreset,
    "evaluate_job": q_evaluate_job,
    "label_mean_transpose": q_label_mean_transpose,
    "label_mean_product": q_label_mean_product,
    "streaming_kmeans_step": q_streaming_kmeans_step,
    "observed_rows": q_observed_rows,
    "sparse_svd_cost": q_sparse_svd_cost,
}
