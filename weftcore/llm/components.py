"""Connected components of an edge table by star contraction.

Each round replaces the neighbours of a node by edges to the smallest of
them (first for larger neighbours, then for smaller ones), which keeps the
components and ends with stars around each component's smallest node.
Aggregates and joins only; the edges of a node that has many stay where they
are and meet their node's smallest neighbour by a broadcast
(:func:`weftcore.llm.common.join_counted`).  Each round is written to the shared scratch
folder, so no round is recomputed when an executor is lost.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftcore.llm.common import join_counted, materialize


def _smallest(near: DataFrame) -> DataFrame:
    return near.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))


def _large(edges: DataFrame, n: int) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _smallest(both).select("u", F.least("u", "m").alias("m"), "n")
    moved = join_counted(both.where("v > u"), least, ["u"], "n", 2 * n)
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame, n: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _smallest(down)
    moved = join_counted(down, least, ["u"], "n", n).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1_000_003)).first())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of ``edges``; root is the component's smallest node."""
    now = materialize(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), "edges")
    state = _state(now)
    while state[0]:
        wide = materialize(_large(now, state[0]), "edges")
        now = materialize(_small(wide, wide.count()), "edges")
        after = _state(now)
        if after == state:
            break
        state = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
