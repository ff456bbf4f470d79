"""The merge-and-reduce tree on DataFrames.

A tree (in fact a forest) is one row per sampled point:
``level INT, node BIGINT, pid BIGINT, features, weight DOUBLE``.  Containers
that share ``(level, node)`` are merged simply by sharing the key.

Chunk rule (C13): with threshold ``T = fan_in * s`` a container of n rows is
sampled to at most s rows when ``n >= T`` and otherwise left whole.

Round (C16): containers with ``n >= T`` are sampled and climb to
``(level + 1, node div fan_in)`` (C17); the others stay.  Rounds repeat
until nothing climbs.  ``tree_reduce`` writes every round to the shared
checkpoint folder, which cuts the plan and survives executor loss;
``tree_reduce_planned`` plans all rounds as one query for samplers whose
importance needs only the row.

Leaves (C15) replace the reference's physical partition number with an
explicit ``leaf`` column, so AQE or a retry cannot change the tree.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftcore.functions.hashing import bucket, uniform01
from weftcore.operators.samplers import POINT_COLS, Sampler
from weftcore.sources.points import materialize, rank_within

TREE_COLS = ["level", "node", *POINT_COLS]


@dataclass(frozen=True)
class TreeConfig:
    """``SamplerConfig``: fan-in (nodes merged per step) and sample size."""

    sample_size: int
    fan_in: int = 2
    leaves: int | None = None
    leaf_mode: str = "hash"  # hash | mod | range
    max_rounds: int = 128

    def __post_init__(self):
        if self.sample_size <= 0:
            raise ValueError("sample_size must be > 0")
        if self.fan_in < 2:
            raise ValueError("fan_in must be >= 2 (with 1 a full node cannot shrink)")

    @property
    def threshold(self) -> int:
        return self.fan_in * self.sample_size


def suggest_leaves(n_points: int, cfg: TreeConfig, parallelism: int) -> int:
    """``floor((n / (s * fan_in)) / p) * p``, at least one leaf per
    ``T`` points when that rounds to zero, and at least 1."""
    per = n_points / float(cfg.threshold)
    p = max(1, int(parallelism))
    leaves = int(per // p) * p
    if leaves == 0:
        leaves = int(per)
    return max(1, leaves)


def assign_leaves(points: DataFrame, cfg: TreeConfig, leaves: int | None = None,
                  n_points: int | None = None) -> DataFrame:
    """Add ``leaf``: ``pmod(xxhash64(pid), L)`` (balanced whatever the ids),
    ``pid % L``, or ``pid div span`` for ids numbered in file order."""
    spark = points.sparkSession
    L = leaves or cfg.leaves
    if L is None:
        n = n_points if n_points is not None else points.count()
        L = suggest_leaves(n, cfg, int(spark.conf.get("spark.sql.shuffle.partitions")))
    L = max(1, int(L))
    if cfg.leaf_mode == "hash":
        leaf = bucket("pid", L)
    elif cfg.leaf_mode == "mod":
        leaf = F.pmod(F.col("pid"), F.lit(L))
    elif cfg.leaf_mode == "range":
        bounds = points.agg(F.min("pid").alias("lo"), F.max("pid").alias("hi")).first()
        lo, hi = (bounds["lo"] or 0), (bounds["hi"] or 0)
        span = max(1, -(-(hi - lo + 1) // L))
        leaf = F.expr(f"(pid - {lo}) div {span}")
    else:
        raise ValueError(f"unknown leaf_mode {cfg.leaf_mode!r}")
    return points.withColumn("leaf", leaf.cast("long"))


def group_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows ``_n`` and weight ``_W`` per container (map-side partial aggregate)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.sum("weight").alias("_W"))


def ranked_chunk_sample(df: DataFrame, keys: list[str], cfg: TreeConfig, sampler: Sampler,
                        seed: int) -> DataFrame:
    """C13 for samplers with a ``row_importance``, on unbounded containers.

    The rows of largest priority are cut per container straight on the input
    (a partial limit before the shuffle, at most ``max(T, s + 1)`` rows per
    container and task); the container sizes come from their own partial
    aggregate and are joined to these survivors.  A container below the
    threshold has all its rows among them."""
    s, T = cfg.sample_size, cfg.threshold
    rows = df.select(*keys, *POINT_COLS).withColumn("_v", sampler.row_importance(df))
    rows = rows.withColumn("_r", F.col("_v") / uniform01("pid", sampler._seed(seed, 0)))
    w = Window.partitionBy(*keys).orderBy(F.col("_r").desc(), F.col("pid").asc())
    top = rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= max(T, s + 1))
    return _keep(top.join(group_counts(df, keys), keys), keys, cfg, sampler)


def _keep(ranked: DataFrame, keys: list[str], cfg: TreeConfig, sampler: Sampler) -> DataFrame:
    """The rule on rows with ``_v, _r, _rn`` and their container's ``_n, _W``;
    ``_moved`` tells the containers at the threshold."""
    s = cfg.sample_size
    tau = F.max(F.when(F.col("_rn") == s + 1, F.col("_r"))).over(Window.partitionBy(*keys))
    big = F.col("_n") >= cfg.threshold
    out = ranked.withColumn("_tau", tau).where(~big | (F.col("_rn") <= s))
    return out.withColumn("weight", F.when(big, sampler.kept_weight(s)).otherwise(F.col("weight"))).withColumn("_moved", big)


def chunk_sample(df: DataFrame, keys: list[str], cfg: TreeConfig, sampler: Sampler,
                 seed: int, salt: int = 0, counts: DataFrame | None = None,
                 bounded: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """C13 on keyed containers: returns (sampled rows, untouched rows, counts).

    Only the groups at or above the threshold reach the sampler.
    """
    T = cfg.threshold
    counts = counts if counts is not None else group_counts(df, keys)
    marked = df.join(counts, keys)
    big = marked.where(F.col("_n") >= T).drop("_n", "_W")
    small = marked.where(F.col("_n") < T).drop("_n", "_W")
    return sampler.sample(big, keys, cfg.sample_size, seed, salt, bounded=bounded), small, counts


def leaf_sample(points: DataFrame, cfg: TreeConfig, sampler: Sampler, seed: int,
                leaves: int | None = None) -> DataFrame:
    """Sample each leaf (C13) and address it ``(0, leaf div fan_in)``."""
    if "leaf" not in points.columns:
        points = assign_leaves(points, cfg, leaves)
    pts = points.select("leaf", *POINT_COLS)
    if sampler.row_importance(pts) is not None:
        both = ranked_chunk_sample(pts, ["leaf"], cfg, sampler, seed)
    else:
        sampled, small, _ = chunk_sample(pts, ["leaf"], cfg, sampler, seed, salt=0)
        both = sampled.select("leaf", *POINT_COLS).unionByName(small.select("leaf", *POINT_COLS))
    return both.select(F.lit(0).alias("level"), _div("leaf", cfg.fan_in).alias("node"), *POINT_COLS)


def _div(col: str, n: int) -> Column:
    return F.expr(f"{col} div {int(n)}").cast("long")


def climb(df: DataFrame, fan_in: int) -> DataFrame:
    """C17: one level up."""
    return df.select((F.col("level") + 1).alias("level"),
                     _div("node", fan_in).alias("node"), *POINT_COLS)


def rounds_needed(max_level: int, leaves: int, fan_in: int) -> int:
    """A bound on the rounds until nothing climbs: one level a round, up to
    the level where one node holds everything."""
    top = 0
    while leaves > 1:
        leaves, top = -(-leaves // fan_in), top + 1
    return max(max_level, top) + 2


def tree_reduce_planned(tree: DataFrame, cfg: TreeConfig, sampler: Sampler, seed: int,
                        rounds: int) -> DataFrame:
    """C16 as one query: ``rounds`` rounds (more than needed change nothing)
    of windows over the containers, which hold at most ``fan_in * T`` rows.
    For samplers with a ``row_importance``."""
    out = tree.select(*TREE_COLS)
    keys = ["level", "node"]
    for rnd in range(1, rounds + 1):
        box = Window.partitionBy(*keys)
        x = out.withColumn("_v", sampler.row_importance(out))
        x = x.withColumn("_r", F.col("_v") / uniform01("pid", sampler._seed(seed, rnd)))
        x = x.withColumns({"_n": F.count(F.lit(1)).over(box), "_W": F.sum("weight").over(box),
                           "_rn": F.row_number().over(box.orderBy(F.col("_r").desc(), F.col("pid").asc()))})
        x = _keep(x, keys, cfg, sampler)
        out = x.select((F.col("level") + F.col("_moved").cast("int")).alias("level"),
                       F.when(F.col("_moved"), _div("node", cfg.fan_in)).otherwise(F.col("node")).alias("node"), *POINT_COLS)
    return out


def tree_reduce(tree: DataFrame, cfg: TreeConfig, sampler: Sampler, seed: int,
                stats: list | None = None, round_dir: str | None = None) -> DataFrame:
    """Merge-and-reduce rounds until no container climbs.

    Per round: the container sizes (a small table, kept in memory for the
    round) answer "is any container at the threshold?" and feed the join;
    then the round's tree is written to the shared checkpoint folder, which
    cuts the plan and survives executor loss.  Two jobs per round.
    ``stats`` collects ``(round, rows, containers at the threshold)``.
    With ``round_dir`` the round tables go to ``round_dir/round=R``.
    """
    tree = tree.select(*TREE_COLS)
    T = cfg.threshold
    for rnd in range(1, cfg.max_rounds + 1):
        counts = group_counts(tree, ["level", "node"]).persist()
        try:
            summary = counts.agg(F.sum("_n").alias("rows"), F.sum(
                F.when(F.col("_n") >= T, 1).otherwise(0)).alias("moved")).first()
            moved = int(summary["moved"] or 0)
            if stats is not None:
                stats.append((rnd, int(summary["rows"] or 0), moved))
            if moved == 0:
                return tree
            # containers hold at most fan_in * (T - 1) rows: bounded groups
            sampled, small, _ = chunk_sample(tree, ["level", "node"], cfg, sampler, seed,
                                             salt=rnd, counts=counts, bounded=True)
            path = f"{round_dir}/round={rnd}" if round_dir else None
            tree = materialize(small.select(*TREE_COLS).unionByName(climb(sampled, cfg.fan_in)),
                               "tree-round", path)
        finally:
            counts.unpersist()
    raise RuntimeError(f"tree did not settle in {cfg.max_rounds} rounds; "
                       f"sampler {sampler.name} must return fewer rows than it gets")


@dataclass(frozen=True)
class ChunkedTreeConfig:
    """The prototype's two-threshold rule (C14): containers of at least
    ``min_size`` rows are cut into chunks of at most ``max_size`` rows (in
    pid order); chunks of at least ``min_size`` rows are sampled to
    ``sample_size``; every chunk of such a container climbs."""

    sample_size: int
    min_size: int
    max_size: int
    fan_in: int = 4
    max_rounds: int = 128

    def __post_init__(self):
        if not (0 < self.sample_size < self.min_size <= self.max_size):
            raise ValueError("need 0 < sample_size < min_size <= max_size")
        if self.fan_in < 2:
            raise ValueError("fan_in must be >= 2")


def chunked_tree_reduce(tree: DataFrame, cfg: ChunkedTreeConfig, sampler: Sampler, seed: int,
                        stats: list | None = None) -> DataFrame:
    """C14 + C18: rounds of the two-threshold rule until nothing climbs.

    Chunk numbers come from :func:`rank_within`, so a container of any size is
    spread over the tasks; a chunk has at most ``max_size`` rows.  The result
    is repartitioned by node address, as the prototype did.
    """
    tree = tree.select(*TREE_COLS)
    for rnd in range(1, cfg.max_rounds + 1):
        counts = group_counts(tree, ["level", "node"]).persist()
        try:
            summary = counts.agg(F.sum("_n").alias("rows"), F.sum(
                F.when(F.col("_n") >= cfg.min_size, 1).otherwise(0)).alias("moved")).first()
            moved = int(summary["moved"] or 0)
            if stats is not None:
                stats.append((rnd, int(summary["rows"] or 0), moved))
            if moved == 0:
                nodes = counts.count()
                return tree.repartition(max(1, nodes), "level", "node")
            marked = tree.join(counts, ["level", "node"])
            stay = marked.where(F.col("_n") < cfg.min_size).select(*TREE_COLS)
            big = marked.where(F.col("_n") >= cfg.min_size).drop("_n", "_W")
            ranked = rank_within(big, ["level", "node"], ["pid"], "_rank")
            chunked = ranked.withColumn("chunk", F.expr(f"(_rank - 1) div {int(cfg.max_size)}")).drop("_rank")
            keys = ["level", "node", "chunk"]
            ccounts = group_counts(chunked, keys)
            cm = chunked.join(ccounts, keys)
            whole = cm.where(F.col("_n") < cfg.min_size).select(*TREE_COLS)
            part = cm.where(F.col("_n") >= cfg.min_size)
            sampled = sampler.sample(part, keys, cfg.sample_size, seed, salt=rnd, bounded=True)
            climbed = climb(whole.unionByName(sampled.select(*TREE_COLS)), cfg.fan_in)
            tree = materialize(stay.unionByName(climbed), "chunked-round")
        finally:
            counts.unpersist()
    raise RuntimeError(f"chunked tree did not settle in {cfg.max_rounds} rounds")


def node_sizes(tree: DataFrame) -> DataFrame:
    """K3: rows per container, for logs and the console sink."""
    return tree.groupBy("level", "node").agg(F.count(F.lit(1)).alias("size")).orderBy("level", "node")


def final_sample(tree: DataFrame, cfg: TreeConfig, sampler: Sampler, seed: int) -> DataFrame:
    """Flatten every node of the forest and take ``sample_size``."""
    pts = tree.select(*POINT_COLS)
    return sampler.sample(pts, [], cfg.sample_size, seed, salt=10_000)


def build_tree(points: DataFrame, cfg: TreeConfig, sampler: Sampler, seed: int,
               leaves: int | None = None, stats: list | None = None) -> DataFrame:
    """C15 + C16: the forest over a bulk input, as one query where the sampler
    needs only the row (and no round statistics are asked for)."""
    sampler = sampler.prepare(points)
    if "leaf" not in points.columns:
        n = leaves or cfg.leaves or suggest_leaves(points.count(), cfg, int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        points = assign_leaves(points, cfg, n)
        if stats is None and sampler.row_importance(points) is not None:
            first = leaf_sample(points, cfg, sampler, seed)
            return materialize(tree_reduce_planned(first, cfg, sampler, seed, rounds_needed(0, n, cfg.fan_in)), "tree")
    leaves_df = materialize(leaf_sample(points, cfg, sampler, seed, leaves), "tree-leaves")
    return tree_reduce(leaves_df, cfg, sampler, seed, stats)


def coreset(points: DataFrame, cfg: TreeConfig, sampler: Sampler, seed: int,
            leaves: int | None = None, stats: list | None = None) -> DataFrame:
    """C20: whole bulk sample = leaves -> tree -> final take."""
    tree = build_tree(points, cfg, sampler, seed, leaves, stats)
    return final_sample(tree, cfg, sampler, seed)
