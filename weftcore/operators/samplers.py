"""Samplers that reduce keyed groups of weighted points.

Contract (X1).  ``sampler.sample(df, keys, s, seed, salt=0)`` takes rows
``keys..., pid, features, weight`` and returns the same columns: every group
(one value of ``keys``; ``keys=[]`` is one global group) with more than ``s``
rows is replaced by a weighted sample of at most ``s`` rows, smaller groups
pass unchanged.  Samples are repeatable: the only randomness is
:func:`weftcore.functions.hashing.uniform01` of ``pid`` and the seed.

Priority samplers (uniform, light, sensitivity, norm, leverage) share one selection:
priority ``r = v / u`` for an importance ``v > 0``; keep the top ``s`` by
``r`` (ties by pid); ``tau`` = the (s+1)-th priority; a kept row's weight
becomes ``w * max(v, tau) / v`` (Duffield, Lund & Thorup 2007).  The top
``s + 1`` per group is a ``row_number() <= s + 1`` filter, which Spark
plans as a partial window group limit *before* the shuffle, so only
``s + 1`` rows per group and map task cross the network.  The global group
goes through hash buckets first so no task ever sees more than
``buckets * (s + 1)`` rows.

The systematic sampler ranks unbounded groups with
:func:`weftcore.sources.points.rank_within`; the cluster-mean sampler cuts
them into pieces of bounded size.  Tree containers (``bounded=True``) hold at
most ``fan_in * threshold`` rows and use plain windows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftcore.functions.hashing import bucket, uniform01
from weftcore.functions.vectors import (any_sq_norm, is_sparse_type, nearest, nonzero_cells,
                                        sparse_dot_dense, sparse_sq_norm, sq_dist)
from weftcore.operators.kmeans import Block, Centres, nearest_column, product_column, reduce_block

POINT_COLS = ["pid", "features", "weight"]


# ------------------------------------------------------------------ helpers ---

def _join_stats(df: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """Attach per-group statistics.  The global group's stats are one row
    (an aggregate without grouping), so broadcasting it is bounded by one row
    of width d; keyed stats are joined on the keys (AQE broadcasts them only
    after measuring them)."""
    if keys:
        return df.join(stats, keys)
    return df.crossJoin(F.broadcast(stats))


def _group_agg(df: DataFrame, keys: list[str], *aggs: Column) -> DataFrame:
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def weighted_mean(df: DataFrame, keys: list[str], features: str = "features",
                  weight: str = "weight", out: str = "_mu") -> DataFrame:
    """Per-group weighted mean vector as ``ARRAY<DOUBLE>`` (Summarizer: a JVM
    aggregate with map-side partial aggregation, dense or sparse)."""
    mean = Summarizer.mean(array_to_vector(F.col(features)), F.col(weight))
    return _group_agg(df, keys, vector_to_array(mean).alias(out),
                      F.sum(weight).alias("_W"), F.count(F.lit(1)).alias("_n"))


def _bucket_count(df: DataFrame) -> int:
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def priority_select(df: DataFrame, keys: list[str], s: int, seed: int,
                    importance: Column | str, buckets: int | None = None) -> DataFrame:
    """Priority sample of at most ``s`` rows per group; see the module doc."""
    if s <= 0:
        return df.limit(0)
    cols = df.columns
    v = F.col(importance) if isinstance(importance, str) else importance
    ranked = df.withColumn("_v", v).withColumn("_r", F.col("_v") / uniform01("pid", seed))
    order = [F.col("_r").desc(), F.col("pid").asc()]
    if not keys:
        # Two levels for the global group: top s+1 per hash bucket, then over
        # the buckets' survivors.  Top-(s+1) of a union = top-(s+1) of the
        # parts' top-(s+1), so this is exact.
        nb = buckets or _bucket_count(df)
        ranked = ranked.withColumn("_b", bucket("pid", nb))
        ranked = (ranked.withColumn("_rn", F.row_number().over(
            Window.partitionBy("_b").orderBy(*order))).where(F.col("_rn") <= s + 1).drop("_b", "_rn"))
    w = Window.partitionBy(*keys).orderBy(*order)
    top = ranked.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= s + 1)
    tau = F.max(F.when(F.col("_rn") == s + 1, F.col("_r"))).over(Window.partitionBy(*keys))
    top = top.withColumn("_tau", tau).where(F.col("_rn") <= s)
    new_w = (F.when(F.col("_tau").isNull() | (F.col("_v") >= F.col("_tau")), F.col("weight"))
             .otherwise(F.col("weight") * F.col("_tau") / F.col("_v")))
    return top.withColumn("weight", new_w).select(*cols)


def _strip(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, *POINT_COLS)


def is_sparse(df: DataFrame) -> bool:
    """Whether ``features`` holds sparse structs (C3: one protocol, two forms)."""
    return is_sparse_type(df.schema["features"].dataType)


def sparse_group_mean_cells(df: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Weighted group means of sparse points as cells ``keys..., j, _m`` (only
    coordinates some point uses) plus ``keys..., _W, _n, _mn`` (|mu|^2).
    Never builds a dense d-vector per row."""
    g = _group_agg(df, keys, F.sum("weight").alias("_W"), F.count(F.lit(1)).alias("_n"))
    cells = nonzero_cells(df, keys)
    mu = _join_stats(cells.groupBy(*keys, "j").agg(F.sum(F.col("weight") * F.col("v")).alias("_sv")),
                     g, keys).select(*keys, "j", (F.col("_sv") / F.col("_W")).alias("_m"))
    mn = _group_agg(mu, keys, F.sum(F.col("_m") * F.col("_m")).alias("_mn"))
    g = g.join(mn, keys) if keys else g.crossJoin(mn)
    return mu, g


def sparse_dist_to_group_mean(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with ``_d2 = |x - mu|^2`` to their group's weighted mean, and
    ``_W``, for sparse points: ``|x|^2 - 2 x.mu + |mu|^2`` with ``x.mu`` from a
    join on (group, coordinate) over the non-zeros."""
    mu, g = sparse_group_mean_cells(df, keys)
    if not keys:
        # one group: its mean is one row of at most d values, so every point
        # meets it without a shuffle
        row = mu.agg(F.map_from_entries(F.collect_list(F.struct("j", "_m"))).alias("_mu"))
        dim = df.agg(F.max("features.size").alias("_d"))
        row = row.crossJoin(dim).select(F.transform(F.sequence(F.lit(0), F.greatest("_d", F.lit(1)) - 1), lambda i: F.coalesce(
            F.element_at("_mu", i), F.lit(0.0))).alias("_mu"))
        x = _join_stats(df.crossJoin(F.broadcast(row)), g, keys)
        d2 = F.greatest(sparse_sq_norm("features") - 2.0 * sparse_dot_dense("features", "_mu") + F.col("_mn"), F.lit(0.0))
        return x.withColumn("_d2", d2).drop("_mu")
    cells = nonzero_cells(df, keys)
    dots = cells.join(mu, [*keys, "j"]).groupBy(*keys, "pid").agg(
        F.sum(F.col("v") * F.col("_m")).alias("_xm"))
    x = df.join(dots, [*keys, "pid"], "left").fillna(0.0, ["_xm"])
    x = _join_stats(x, g, keys)
    d2 = F.greatest(sparse_sq_norm("features") - 2.0 * F.col("_xm") + F.col("_mn"), F.lit(0.0))
    return x.withColumn("_d2", d2)


# ----------------------------------------------------------------- samplers ---

@dataclass
class Sampler:
    """Base class: ``subset`` says whether outputs are input rows (C2 valid);
    ``consistent`` samplers use the same random number per pid in every tree
    round (needed for the bottom-k invariant)."""

    name: str = "base"
    subset: bool = True
    consistent: bool = False

    def prepare(self, points: DataFrame) -> "Sampler":
        """Global state computed once before a tree (e.g. rough centres)."""
        return self

    def state(self) -> list | None:
        """What ``prepare`` found, to be kept with a stream's commits."""
        return None

    def restore(self, state: list | None) -> None:
        """Continue from a kept state (None: forget what was prepared)."""

    def row_importance(self, df: DataFrame) -> Column | None:
        """The priority sampler's importance of a row where it needs nothing
        but the row; None for all other samplers."""
        return None

    def kept_weight(self, s: int) -> Column:
        """Weight of a kept row of a group above s, from ``_v``, ``_tau``,
        ``_W`` and its own weight (samplers with a ``row_importance``)."""
        return F.when(F.col("_tau").isNull() | (F.col("_v") >= F.col("_tau")), F.col("weight")).otherwise(
            F.col("weight") * F.col("_tau") / F.col("_v"))

    def sample(self, df: DataFrame, keys: list[str], s: int, seed: int,
               salt: int = 0, bounded: bool = False) -> DataFrame:
        """``bounded=True`` promises every group fits in one task (tree
        containers), which lets rank-based samplers use plain windows."""
        raise NotImplementedError

    def _seed(self, seed: int, salt: int) -> int:
        return seed if self.consistent else seed + 1_000_003 * salt


@dataclass
class UniformSampler(Sampler):
    """C4: bottom-s by the repeatable number u(pid, seed), ties by pid.

    On points of unit weight (``weighted=False``) kept rows share the group's
    total weight equally, so total weight is preserved exactly.  Bottom-k of
    a union equals bottom-k of the parts' bottom-k, so any tree of this
    sampler returns the global bottom-s.

    With ``weighted=True`` a row's priority is ``weight / u`` and a kept row
    weighs ``max(weight, tau)``: total weight is preserved in the mean, and a
    heavy point keeps its own weight.  ``prepare`` looks whether any weight
    differs from 1 unless ``weighted`` is given.
    """

    name: str = "uniform"
    consistent: bool = True
    weighted: bool | None = None

    def prepare(self, points):
        if self.look:
            self.weighted = not points.where(F.col("weight") != 1.0).limit(1).isEmpty()
            self.consistent = not self.weighted
        return self

    def __post_init__(self):
        self.look = self.weighted is None
        if self.weighted:
            self.consistent = False

    def row_importance(self, df):
        return F.col("weight") if self.weighted else F.lit(1.0)

    def kept_weight(self, s):
        if self.weighted:
            return super().kept_weight(s)
        return F.col("_W") / F.lit(float(s))

    def sample(self, df, keys, s, seed, salt=0, bounded=False):
        seed = self._seed(seed, salt)
        if self.weighted:
            return priority_select(_strip(df, keys), keys, s, seed, F.col("weight")).select(*keys, *POINT_COLS)
        x = _strip(df, keys)
        totals = _group_agg(x, keys, F.sum("weight").alias("_W"), F.count(F.lit(1)).alias("_n"))
        # importance 1 => priority 1/u => order by u ascending.  A group above
        # s keeps exactly s rows, which share its total weight.
        top = _join_stats(priority_select(x.withColumn("_w0", F.col("weight")), keys, s, seed, F.lit(1.0)), totals, keys)
        w = F.when(F.col("_n") <= s, F.col("_w0")).otherwise(self.kept_weight(s))
        return top.withColumn("weight", w).select(*keys, *POINT_COLS)


@dataclass
class LightSampler(Sampler):
    """C5, light form (Bachem, Lucic & Krause 2018): importance
    ``v = w (1/(2W) + d^2(x, mu) / (2 sum w d^2))`` with the group's weighted
    mean ``mu``; all from two group aggregates."""

    name: str = "light"

    def importance(self, df: DataFrame, keys: list[str]) -> DataFrame:
        if is_sparse(df):
            x = sparse_dist_to_group_mean(df, keys)
        else:
            stats = weighted_mean(df, keys)
            x = _join_stats(df, stats, keys).withColumn("_d2", sq_dist("features", "_mu"))
        cost = _group_agg(x, keys, F.sum(F.col("weight") * F.col("_d2")).alias("_C"))
        x = _join_stats(x, cost, keys)
        v = F.when(F.col("_C") > 0, F.col("weight") * (
            F.lit(0.5) / F.col("_W") + F.lit(0.5) * F.col("_d2") / F.col("_C"))
        ).otherwise(F.col("weight") / F.col("_W"))
        return x.withColumn("_imp", v)

    def sample(self, df, keys, s, seed, salt=0, bounded=False):
        df = _strip(df, keys)
        x = self.importance(df, keys).select(*keys, *POINT_COLS, "_imp")
        out = priority_select(x, keys, s, self._seed(seed, salt), "_imp")
        return out.select(*keys, *POINT_COLS)


@dataclass
class SensitivitySampler(Sampler):
    """Sensitivity sampling (Feldman & Langberg 2011) against rough
    centres B fitted once by Spark ML k-means|| (``init_steps=2``).

    With ``d2 = d^2(x, B)``, ``W = sum w``, ``c = sum w d2 / W`` and for x's
    centre b: ``W_b``, ``C_b = sum_b w d2``; ``alpha = 16 (ln k + 2)``:
    ``sigma = alpha d2 / c + 2 alpha C_b / (W_b c) + 4 W / W_b``, ``v = w sigma``.
    """

    name: str = "sensitivity"
    k: int = 10
    seed: int = 0
    max_iter: int = 5
    centres: list | None = None

    def prepare(self, points):
        """Rough centres from all points: k-means|| on dense ones, Lloyd steps
        over the non-zeros of sparse ones."""
        if self.centres is None:
            from weftcore.operators.models import kmeans_centres
            self.centres = kmeans_centres(points, self.k, seed=self.seed, max_iter=self.max_iter,
                                          init_steps=2)
        return self

    def state(self):
        return self.centres

    def restore(self, state):
        self.centres = state

    def sample(self, df, keys, s, seed, salt=0, bounded=False):
        if self.centres is None:
            self.prepare(df)
        df = _strip(df, keys)
        k = len(self.centres)
        alpha = 16.0 * (math.log(max(k, 1)) + 2.0)
        # k centres (k x d doubles, the model's size) go to every task once
        near = df.withColumn("_nb", nearest_column(df, Centres.of_dense(self.centres)))
        x = near.select(*keys, *POINT_COLS, F.col("_nb.idx").alias("_b"),
                        F.col("_nb.d2").alias("_d2"))
        g = _group_agg(x, keys, F.sum("weight").alias("_W"),
                       F.sum(F.col("weight") * F.col("_d2")).alias("_S"))
        gb = x.groupBy(*keys, "_b").agg(F.sum("weight").alias("_Wb"),
                                        F.sum(F.col("weight") * F.col("_d2")).alias("_Cb"))
        # the whole input's centre sums are k rows
        x = _join_stats(x, g, keys).join(gb if keys else F.broadcast(gb), [*keys, "_b"])
        c = F.col("_S") / F.col("_W")
        sigma = (F.lit(alpha) * F.col("_d2") / c + F.lit(2 * alpha) * F.col("_Cb") / (F.col("_Wb") * c)
                 + F.lit(4.0) * F.col("_W") / F.col("_Wb"))
        x = x.withColumn("_imp", F.when(F.col("_S") > 0, F.col("weight") * sigma)
                         .otherwise(F.col("weight")))
        out = priority_select(x.select(*keys, *POINT_COLS, "_imp"), keys, s,
                              self._seed(seed, salt), "_imp")
        return out.select(*keys, *POINT_COLS)


@dataclass
class NormSampler(Sampler):
    """Rows by squared norm (Drineas, Kannan & Mahoney 2006), importance
    ``v = w |x|^2``; weighted rows enter later steps scaled by sqrt(w)."""

    name: str = "norm"

    def row_importance(self, df):
        return F.col("weight") * any_sq_norm("features", is_sparse(df))

    def sample(self, df, keys, s, seed, salt=0, bounded=False):
        df = _strip(df, keys)
        out = priority_select(df, keys, s, self._seed(seed, salt), self.row_importance(df))
        return out.select(*keys, *POINT_COLS)


@dataclass
class LeverageSampler(Sampler):
    """C8, rank-k form: rows by their weighted leverage on the top k right
    singular directions, ``v = w |x V_k S_k^-1|^2 = w sum_j (x . v_j)^2 / l_j``
    with ``l_j = sum w (x . v_j)^2`` (Drineas, Mahoney & Muthukrishnan 2008).

    Two passes: ``prepare`` fits the axes (:func:`models.svd_axes`) and their
    values l, unless ``axes`` are given; priorities are then products of a
    block of rows with the axes, dense or sparse.  A row without a share in
    the axes (v = 0) is drawn after all others."""

    name: str = "leverage"
    k: int = 2
    axes: list | None = None
    values: list | None = None

    def prepare(self, points):
        from weftcore.operators.models import svd_axes, svd_values
        if self.axes is None:
            self.axes = svd_axes(points, self.k, weighted=True)
            self.values = None
        if self.values is None and self.axes:
            self.values = svd_values(points, self.axes, weighted=True)
        return self

    def state(self):
        return None if not self.axes else [*self.axes, list(self.values)]

    def restore(self, state):
        self.axes, self.values = (None, None) if not state else (state[:-1], state[-1])

    def row_importance(self, df):
        if not self.axes:
            self.prepare(df)
        if not self.axes:
            return F.lit(0.0)
        p = product_column(df, Centres.of_dense(self.axes))
        share = F.array(*[F.lit(1.0 / v if v > 0 else 0.0) for v in self.values])
        return F.col("weight") * F.aggregate(F.zip_with(p, share, lambda x, y: x * x * y), F.lit(0.0), lambda a, x: a + x)

    def sample(self, df, keys, s, seed, salt=0, bounded=False):
        df = _strip(df, keys)
        out = priority_select(df.withColumn("_imp", self.row_importance(df)), keys, s, self._seed(seed, salt), "_imp")
        return out.select(*keys, *POINT_COLS)


@dataclass
class SystematicSampler(Sampler):
    """W4, the reference's test sampler: sort the group, step = n div s, keep
    positions 0, step, 2 step, ...; only when n > s.  May keep more than s
    rows when s does not divide n.  Weights pass unchanged.  Unbounded
    groups are ranked with :func:`rank_within` (no group in one task)."""

    name: str = "systematic"
    order_col: str = "pid"

    def sample(self, df, keys, s, seed, salt=0, bounded=False):
        from weftcore.sources.points import number_rows, rank_within
        df = df.drop("_n", "_W")
        cols = df.columns
        order = [self.order_col, "pid"] if self.order_col != "pid" else ["pid"]
        if bounded:
            w = Window.partitionBy(*keys)
            x = (df.withColumn("_rn", F.row_number().over(w.orderBy(*order)))
                 .withColumn("_n", F.count(F.lit(1)).over(w)))
        elif not keys:
            n = df.count()
            x = (number_rows(df, order, "_rn").withColumn("_rn", F.col("_rn") + 1)
                 .withColumn("_n", F.lit(n)))
        else:
            x = rank_within(df, keys, order, "_rn", count_col="_n")
        step = F.floor(F.col("_n") / F.lit(s))
        keep = (F.col("_n") <= s) | (((F.col("_rn") - 1) % step) == 0)
        return x.where(keep).select(*cols)


@dataclass
class FirstSampler(Sampler):
    """The reference's first-s test sampler: the s smallest by ``order_col``."""

    name: str = "first"
    order_col: str = "pid"

    def sample(self, df, keys, s, seed, salt=0, bounded=False):
        df = df.drop("_n", "_W")
        cols = df.columns
        rn = F.row_number().over(Window.partitionBy(*keys).orderBy(self.order_col, "pid"))
        return df.withColumn("_rn", rn).where(F.col("_rn") <= s).select(*cols)


@dataclass
class PieceSampler(Sampler):
    """Samplers whose work on a group is one NumPy step (``_body``).

    A group is cut into pieces of about ``piece`` rows (or 4 s) by a hash of
    the pid, at every size (a group that small is one piece); one step reduces
    a piece to at most s rows, and what is left is cut again until it is one
    piece, so no task holds a whole unbounded group."""

    piece: int = 4096
    steps: int = 3

    def _body(self, keys: list[str], s: int, sparse: bool, seed: int):
        """table -> table on one group of bounded size."""
        raise NotImplementedError

    def sample(self, df, keys, s, seed, salt=0, bounded=False):
        from weftcore.sources.points import materialize
        df, seed = _strip(df, keys), self._seed(seed, salt)
        if bounded:
            return self._reduce(df, keys, s, seed)
        piece = max(self.piece, 4 * s)
        for step in range(64):
            counts = _group_agg(df, keys, F.count(F.lit(1)).alias("_n"))
            most = counts.agg(F.max("_n")).first()[0] or 0
            if most <= piece:
                return self._reduce(df, keys, s, seed)
            pieces = F.ceil(F.col("_n") / F.lit(piece))
            cut = _join_stats(df, counts, keys).withColumn("_piece", F.pmod(F.xxhash64("pid", F.lit(step)), pieces))
            part = self._reduce(cut.select(*keys, "_piece", *POINT_COLS), [*keys, "_piece"], s, seed + 7919 * (step + 1))
            df = materialize(_strip(part, keys), "pieces")
        raise RuntimeError(f"pieces of {self.name} do not settle")

    def _reduce(self, df, keys, s, seed):
        """Groups of bounded size: one ``applyInArrow`` stage."""
        sparse = is_sparse(df)
        names = keys or ["_g"]
        flat = df if keys else df.withColumn("_g", F.lit(0))
        ddl = ", ".join(f"`{k}` {flat.schema[k].dataType.simpleString()}" for k in names)
        f = F.col("features")
        if sparse:
            cols, out = [f["size"].alias("_size"), f["indices"].alias("_idx"), f["values"].alias("_val")], "_size int, _idx array<int>, _val array<double>"
        else:
            cols, out = [f.alias("_val")], "_val array<double>"
        flat = flat.select(*names, "pid", "weight", *cols)
        done = flat.groupBy(*names).applyInArrow(self._body(names, s, sparse, seed), f"{ddl}, pid bigint, weight double, {out}")
        feats = F.struct(F.col("_size").alias("size"), F.col("_idx").alias("indices"), F.col("_val").alias("values")) if sparse else F.col("_val")
        return done.select(*keys, "pid", feats.alias("features"), "weight")


def _ordered(table, sparse: bool, seed: int):
    """A group in pid order, so draws do not depend on how rows arrive: the
    table, its pids and weights, a block of its points, a generator."""
    import numpy as np
    import pyarrow as pa
    table = table.sort_by("pid").combine_chunks()
    pids, w = table.column("pid").to_numpy().astype(np.int64), table.column("weight").to_numpy().astype(float)
    parts = [table.column(c).combine_chunks() for c in (("_idx", "_val") if sparse else ("_val",))]
    rng = np.random.default_rng([seed & 0xFFFFFFFF, len(pids), int(pids[0]) & 0xFFFFFFFF, int(pids[-1]) & 0xFFFFFFFF])
    return table, pids, w, Block.of([p if isinstance(p, pa.Array) else p.chunk(0) for p in parts]), rng


@dataclass
class ClusterMeanSampler(PieceSampler):
    """Clustering coreset (after Barger & Feldman 2016).  Per group with
    more than s rows: s centres by k-means++ (draws by weight x squared
    distance) and a few Lloyd steps, every row assigned to its nearest one,
    each cluster replaced by (weighted mean, sum of weights).  Total weight
    and the weighted mean are preserved exactly.  The output pid is the
    smallest pid of the cluster.

    Groups are reduced in pieces (:class:`PieceSampler`).  Replacing clusters
    by their means changes a k-means cost by at most 2 sqrt(e cost) + e, with e
    the cost of the pieces' own clusterings, and that holds again for every
    round."""

    name: str = "cluster_mean"
    subset: bool = False

    def _body(self, keys, s, sparse, seed):
        steps = self.steps

        def run(table):
            import numpy as np
            import pyarrow as pa
            if table.num_rows <= s:
                return table
            table, pids, w, block, rng = _ordered(table, sparse, seed)
            label, means = reduce_block(block, w, s, rng, steps)
            n = len(means)
            least = np.full(n, np.iinfo(np.int64).max)
            np.minimum.at(least, label, pids)
            out = {c: pa.array([table.column(c)[0].as_py()] * n, table.schema.field(c).type) for c in keys}
            out |= {"pid": pa.array(least), "weight": pa.array(np.bincount(label, weights=w, minlength=n))}
            if sparse:
                out["_size"] = pa.array([max(table.column("_size").to_pylist())] * n, pa.int32())
                out["_idx"] = pa.array([i.astype(np.int32) for i, _ in means], pa.list_(pa.int32()))
            out["_val"] = pa.array([v for _, v in means], pa.list_(pa.float64()))
            return pa.table({c: out[c] for c in table.column_names})

        return run


@dataclass
class LocalSensitivitySampler(PieceSampler):
    """C5 / C6 with rough centres of the container itself: k-means++ on its
    rows (k centres, ``steps`` Lloyd steps), then the sensitivities of
    :class:`SensitivitySampler` against them and a priority sample of s rows.
    Nothing is fitted beforehand and no state is kept, so a stream's later
    batches are not measured by the centres of its first one."""

    name: str = "sensitivity-local"
    k: int = 10

    def _body(self, keys, s, sparse, seed):
        k, steps = self.k, self.steps
        alpha = 16.0 * (math.log(max(k, 1)) + 2.0)

        def run(table):
            import numpy as np
            if table.num_rows <= s:
                return table
            table, pids, w, block, rng = _ordered(table, sparse, seed)
            label, means = reduce_block(block, w, k, rng, steps)
            dim = block.x.shape[1] if not sparse else 0
            d2 = np.empty(block.n)
            for c in range(len(means)):
                one = Centres.of_sparse([means[c]], dim) if sparse else Centres.of_dense([_dense(means[c], dim)])
                d2[label == c] = block.nearest(one)[1][label == c]
            wb, cb = np.bincount(label, weights=w), np.bincount(label, weights=w * d2)
            total, cost = w.sum(), float(w @ d2)
            v = w * (alpha * d2 * total / cost + 2 * alpha * cb[label] * total / (wb[label] * cost) + 4 * total / wb[label]) if cost > 0 else w
            r = v / (1.0 - rng.random(block.n))
            order = np.lexsort((pids, -r))
            tau, kept = r[order[s]], np.sort(order[:s])
            weight = np.where(v[kept] >= tau, w[kept], w[kept] * tau / v[kept])
            out = table.take(kept)
            return out.set_column(out.schema.get_field_index("weight"), "weight", [weight])

        return run


def _dense(mean: tuple, dim: int):
    import numpy as np
    v = np.zeros(dim)
    v[mean[0]] = mean[1]
    return v


@dataclass
class FixedCentreReducer:
    """C7 with given centres (SQL-checkable form): each point goes to its
    nearest fixed centre; output one row per centre with the weighted mean
    and the weight sum."""

    centres: list = field(default_factory=list)

    def reduce(self, df: DataFrame, keys: list[str] | None = None) -> DataFrame:
        keys = keys or []
        spark = df.sparkSession
        cdf = spark.createDataFrame([(self.centres,)], "c array<array<double>>")
        x = df.crossJoin(F.broadcast(cdf)).withColumn("cluster", nearest("features", "c")["idx"])
        mean = Summarizer.mean(array_to_vector(F.col("features")), F.col("weight"))
        return x.groupBy(*keys, "cluster").agg(
            F.min("pid").alias("pid"), vector_to_array(mean).alias("features"),
            F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------ take wrappers ---

def take(df: DataFrame, s: int, sampler: Sampler, seed: int, keys: list[str] | None = None,
         check: bool = True) -> DataFrame:
    """Groups above ``s`` rows are sampled, others pass.  The result size
    is verified (one small action) unless ``check`` is off."""
    keys = keys or []
    out = sampler.prepare(df).sample(df, keys, s, seed)
    if check:
        sizes = _group_agg(out, keys, F.count(F.lit(1)).alias("n")).where(F.col("n") > s)
        if not sizes.isEmpty():
            raise AssertionError(f"sampler {sampler.name} returned more than {s} rows")
    return out


def take_ids(df: DataFrame, s: int, sampler: Sampler, seed: int) -> DataFrame:
    """One id per sampled row; equal points map to the last (largest) id
    among them, so an id may repeat (as in the reference's id map)."""
    if not sampler.subset:
        raise ValueError(f"sampler {sampler.name} does not return input rows")
    sample = sampler.sample(df, [], s, seed).select("features")
    last = df.groupBy("features").agg(F.max("pid").alias("_last"))
    return sample.join(last, "features").select(F.col("_last").alias("pid"))


def take_multi_sample(dfs: list[DataFrame], s: int, sampler: Sampler, seed: int) -> DataFrame:
    """Several containers sampled together (the uniform sampler gives
    one mergeable reservoir); a single one is taken alone."""
    if len(dfs) == 1:
        return take(dfs[0], s, sampler, seed)
    u = dfs[0]
    for d in dfs[1:]:
        u = u.unionByName(d)
    return take(u, s, sampler, seed)

