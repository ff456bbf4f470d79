"""Relational helpers.

These are thin on purpose: Catalyst plans them.  They exist to fix the
semantics the reference relies on (bag joins, order restoration, stable
tie-breaks) in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F


def inner_join(left: DataFrame, right: DataFrame, key: str | list[str],
               strategy: str | None = None) -> DataFrame:
    """Inner equi-join with bag semantics (duplicates multiply).
    ``strategy`` may be ``shuffle_hash`` / ``merge`` / ``broadcast`` hints."""
    if strategy:
        right = right.hint(strategy)
    return left.join(right, key, "inner")


def broadcast_join(big: DataFrame, small: DataFrame, key: str | list[str]) -> DataFrame:
    """Join a small side to a distributed one.  No hint: adaptive execution
    measures the side's bytes and broadcasts it below
    ``spark.sql.autoBroadcastJoinThreshold``."""
    return big.join(small, key, "inner")


def join_back(points: DataFrame, sample_ids: DataFrame, pos_col: str | None = "pos") -> DataFrame:
    """Sampled ids joined back to their rows, in sample order when
    ``pos_col`` is given (else a left-semi join keeps the rows' own order)."""
    if pos_col is None:
        return points.join(sample_ids.select("pid"), "pid", "left_semi")
    return points.join(sample_ids.select("pid", pos_col), "pid").orderBy(pos_col)


def reduce_by_key(df: DataFrame, key: str | list[str], *aggs: Column) -> DataFrame:
    """A1: associative reduction per key (partial then final aggregate)."""
    return df.groupBy(key).agg(*aggs)


def distinct_rows(df: DataFrame) -> DataFrame:
    """A5."""
    return df.distinct()


def count_distinct_nodes(tree: DataFrame, col: str = "node") -> DataFrame:
    """Number of distinct node addresses."""
    return tree.agg(F.countDistinct(col).alias("num_nodes"))


def count_by_value(df: DataFrame, col: str) -> DataFrame:
    """A13."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("cnt"))


def sort_by(df: DataFrame, col: str, ascending: bool = True, tie: str = "pid") -> DataFrame:
    """O1: sort with an explicit tie-break column (the reference's local
    descending sort reverses ties; here ties always go by ``tie``)."""
    c = F.col(col).asc() if ascending else F.col(col).desc()
    return df.orderBy(c, F.col(tie).asc())


def first_row(df: DataFrame, col: str, ascending: bool = True, tie: str = "pid") -> DataFrame:
    """O2: the first row of a sort (a top-1: per-partition then one merge)."""
    return sort_by(df, col, ascending, tie).limit(1)


def bag_union(*dfs: DataFrame) -> DataFrame:
    """Union by name keeping duplicates."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    return out


def chunk_ids(df: DataFrame, key: str | list[str], order: str | list[str], size: int,
              out: str = "chunk", bounded: bool = False, keep: list[str] | None = None) -> DataFrame:
    """``grouped(n)`` -- consecutive chunks of at most ``size`` rows per key.

    Ranks come from :func:`rank_within` (a hot key stays spread over many
    tasks); ``bounded=True`` uses a plain window for small groups.  ``keep``
    names the columns wanted beside the key (default: all).
    """
    keys = [key] if isinstance(key, str) else key
    order = [order] if isinstance(order, str) else order
    if bounded:
        rn = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        return df.withColumn(out, F.floor((rn - 1) / F.lit(size)).cast("int"))
    from weftcore.sources.points import rank_within
    r = rank_within(df, keys, order, "_rk", keep=keep)
    return r.withColumn(out, F.floor((F.col("_rk") - 1) / F.lit(size)).cast("int")).drop("_rk")


def tap(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Count rows as they pass, without a separate job."""
    obs = Observation(name)
    return df.observe(obs, F.count(F.lit(1)).alias("rows")), obs
