"""Exact top-k inner products with vector-approximation files.

Vectors are turned into integers and written twice: as cell numbers of
``bits`` bits a component, in blocks (the approximation file), and exactly, a
row per vector.

1. Scan.  Only cells travel: every block of queries meets every block of cells.
   Cell middles and half widths bound each score from above and below; a task
   keeps, per query, the k highest lower bounds of its lane so far and hands on
   the candidates whose upper bound reaches the k-th of them.
2. The k-th highest lower bound over all lanes rules out more candidates.
3. Exact vectors are read in bound order, in two rounds: for every query those
   of its k highest upper bounds, which give a k-th exact score; then those of
   the candidates whose upper bound reaches that score.  All others are certain
   to be worse.

Queries go in blocks to ``lanes`` lanes of cell blocks; a task handles one
pair of blocks at a time, so its memory does not grow with the data.

Vectors that are null or hold null or non-finite components, and rows with a
null id, take no part.  Vectors of another length than the query's are no
candidates.  Rows of one id count as one: their best score.  Equal scores:
smaller id first.  No vectors or no queries: no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftcore.functions.vectors import dot
from weftcore.llm.common import ARROW_ROWS, bounded, materialize, prepare

BLOCK = "dim int, lo long, width long, ids binary, cells binary"
ASKED = "dim int, q_ids binary, q_exact binary"
BOUNDS = "query_id long, vec_id long, dim int, lower double, upper double"


def integers(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component."""
    return F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def _pack(rows: int, grid: dict[int, tuple[int, int]] | None):
    """Blocks of at most ``rows`` vectors of one length, from one task: cells
    by ``grid``, or the vectors themselves without it (queries)."""

    def block(dim: int, ids: list, vecs: list) -> pa.RecordBatch:
        x = np.array(vecs, np.int64).reshape(len(ids), dim)
        number = pa.array([np.array(ids, np.int64).tobytes()], pa.binary())
        if grid is None:
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), number, pa.array([x.tobytes()], pa.binary())], names=["dim", "q_ids", "q_exact"])
        lo, width = grid[dim]
        cell = ((x - lo) // width).astype(np.uint8).tobytes()
        return pa.RecordBatch.from_arrays([
            pa.array([dim], pa.int32()), pa.array([lo], pa.int64()), pa.array([width], pa.int64()), number, pa.array([cell], pa.binary())],
            names=["dim", "lo", "width", "ids", "cells"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        for batch in batches:
            for i, v in zip(batch.column("id").to_pylist(), batch.column("x").to_pylist()):
                ids, vecs = held.setdefault(len(v), ([], []))
                ids.append(i)
                vecs.append(v)
                if len(ids) == rows:
                    yield block(len(v), *held.pop(len(v)))
        for dim, (ids, vecs) in held.items():
            yield block(dim, ids, vecs)

    return run


class Bounds:
    """Bounds of a query block's scores: the k highest lower bounds of
    different ids, and the candidates whose upper bound may reach them."""

    def __init__(self, queries: np.ndarray, ids: np.ndarray, k: int):
        self.queries, self.ids, self.k, self.scanned = queries.astype(np.float64), ids, k, 0
        self.size = np.abs(self.queries).sum(1)
        self.top, self.top_ids = np.full((len(ids), k), -np.inf), np.zeros((len(ids), k), np.int64)
        self.kept: list[tuple] = []

    def scan(self, lo: int, width: int, ids: np.ndarray, cells: np.ndarray) -> None:
        """One block of cells."""
        middle = lo + width * cells.astype(np.float32) + np.float32((width - 1) / 2)
        score = (self.queries.astype(np.float32) @ middle.T).astype(np.float64)
        # float32 sums may be off by a little: widen the bounds by more than that
        slack = (self.size * ((width - 1) / 2) + (2e-7 * cells.shape[1] + 1e-6) * self.size * (abs(lo) + width * 256.0) + 1)[:, None]
        score[self.ids[:, None] == ids[None, :]] = -np.inf  # not the query itself
        self.scanned += score.size
        lower, upper = score - slack, score + slack
        if len(np.unique(ids)) < len(ids):  # an id counts once
            again = np.ones(len(ids), bool)
            again[np.unique(ids, return_index=True)[1]] = False
            some = np.where(again[None, :], -np.inf, lower)
        else:
            some = lower
        at = np.argpartition(some, -self.k, axis=1)[:, -self.k:] if some.shape[1] > self.k else np.broadcast_to(np.arange(some.shape[1]), some.shape)
        best, number = np.take_along_axis(some, at, axis=1), ids[at]
        same = number[:, :, None] == self.top_ids[:, None, :]
        if same.any():  # also when its rows stand in several blocks
            self.top = np.maximum(self.top, np.where(same, best[:, :, None], -np.inf).max(axis=1))
            best = np.where(same.any(axis=2), -np.inf, best)
        best, number = np.concatenate([self.top, best], axis=1), np.concatenate([self.top_ids, number], axis=1)
        order = np.argsort(best, axis=1, kind="stable")[:, -self.k:]
        self.top, self.top_ids = np.take_along_axis(best, order, axis=1), np.take_along_axis(number, order, axis=1)
        q, c = np.nonzero((upper >= self.top[:, :1]) & np.isfinite(upper))
        self.kept.append((q, ids[c], lower[q, c], upper[q, c]))
        if sum(len(x[0]) for x in self.kept) > 1 << 18:
            self._prune()

    def _prune(self) -> None:
        q, i, lower, upper = (np.concatenate(x) for x in zip(*self.kept))
        ok = upper >= self.top[q, 0]
        self.kept = [(q[ok], i[ok], lower[ok], upper[ok])]

    def result(self, dim: int) -> pa.RecordBatch:
        self._prune()
        q, i, lower, upper = self.kept[0]
        return pa.RecordBatch.from_arrays([pa.array(self.ids[q]), pa.array(i), pa.array(np.full(len(q), dim, np.int32)), pa.array(lower), pa.array(upper)],
                                          names=["query_id", "vec_id", "dim", "lower", "upper"])


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, found, dim = None, None, 0
        for batch in batches:
            for j in range(batch.num_rows):
                r = {n: batch.column(n)[j] for n in ("lane", "q", "dim", "lo", "width")}
                now = r["lane"].as_py(), r["q"].as_py()
                if now != key:
                    if found is not None and found.kept:
                        yield found.result(dim)
                    key, dim = now, r["dim"].as_py()
                    own = np.frombuffer(batch.column("q_ids")[j].as_buffer(), np.int64)
                    found = Bounds(np.frombuffer(batch.column("q_exact")[j].as_buffer(), np.int64).reshape(len(own), dim), own, k)
                ids = np.frombuffer(batch.column("ids")[j].as_buffer(), np.int64)
                found.scan(r["lo"].as_py(), r["width"].as_py(), ids, np.frombuffer(batch.column("cells")[j].as_buffer(), np.uint8).reshape(len(ids), dim))
        if found is not None and found.kept:
            yield found.result(dim)

    return run


def _scores(pairs: DataFrame, exact: DataFrame, queries: DataFrame) -> DataFrame:
    """Exact scores of pairs (query_id, vec_id, dim): rows of exact vectors are
    picked by the ids asked for before anything is shuffled."""
    some = bounded(pairs.select(F.col("vec_id").alias("id"), "dim").distinct())
    read = exact.join(some, ["id", "dim"], "left_semi").select(F.col("id").alias("vec_id"), "dim", "x")
    asked = queries.select(F.col("id").alias("query_id"), "dim", F.col("x").alias("y"))
    both = pairs.join(read, ["vec_id", "dim"]).join(asked, ["query_id", "dim"])
    return both.groupBy("query_id", "vec_id").agg(F.max(F.round(dot(F.col("x").cast("array<double>"), F.col("y").cast("array<double>"))).cast("long")).alias("score"))


def _best(df: DataFrame, k: int, *order: Column) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 256,
          bits: int = 8, block: int = 8192, query_block: int = 512, lanes: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of each query.

    ``is_query`` is a condition on the id, which the expression names ``id``.
    ``lanes``: as many as shuffle partitions, if not given."""
    spark = vectors.sparkSession
    prepare(spark)
    lanes = lanes or int(spark.conf.get("spark.sql.shuffle.partitions"))
    x = F.col("e")
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{embedding}`").alias("e")).where(
        F.col("id").isNotNull() & x.isNotNull() & ~F.coalesce(F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(False)))
    exact = rows.select("id", integers(x, scale).alias("x")).withColumn("dim", F.size("x"))
    ends = exact.groupBy("dim").agg(F.min(F.array_min("x")).alias("lo"), F.max(F.array_max("x")).alias("hi")).collect()  # one row per length
    grid = {d: (lo or 0, max(1, -(-((hi or 0) - (lo or 0) + 1) >> bits))) for d, lo, hi in ends}
    va = materialize(exact.select("id", "x").mapInArrow(_pack(block, grid), BLOCK), "va")
    queries = exact.where(is_query)
    asked = materialize(queries.select("id", "x").mapInArrow(_pack(query_block, None), ASKED), "queries")
    va = va.withColumn("lane", F.pmod(F.xxhash64("ids"), F.lit(lanes)))
    asked = asked.withColumn("q", F.xxhash64("q_ids")).withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lanes - 1).cast("long"))))
    # a merge join gives all blocks of a lane to one query block after the other,
    # so a query's lower bounds carry on; any other order is only slower
    pairs = asked.hint("merge").join(va, ["lane", "dim"]).select("lane", "q", "dim", "lo", "width", "q_ids", "q_exact", "ids", "cells")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")  # rows are whole blocks
    try:
        near = materialize(pairs.mapInArrow(_search(k), BOUNDS), "bounds")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    single = near.groupBy("query_id", "vec_id", "dim").agg(F.max("lower").alias("lower"), F.max("upper").alias("upper"))
    least = _best(single, k, F.desc("lower")).groupBy("query_id").agg(F.min("lower").alias("kth"), F.count(F.lit(1)).alias("n"))
    left = single.join(least, "query_id").where((F.col("n") < k) | (F.col("upper") >= F.col("kth"))).select("query_id", "vec_id", "dim", "upper")
    left = materialize(left, "candidates")
    first = _best(left, k, F.desc("upper"), F.col("vec_id")).select("query_id", "vec_id", "dim")
    scored = materialize(_scores(first, exact, queries), "scores")
    sure = scored.groupBy("query_id").agg(F.min("score").alias("kth"), F.count(F.lit(1)).alias("n"))
    rest = left.join(sure, "query_id").where((F.col("n") < k) | (F.col("upper") >= F.col("kth"))).join(scored, ["query_id", "vec_id"], "left_anti")
    every = scored.union(_scores(rest.select("query_id", "vec_id", "dim"), exact, queries))
    found = every.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return _best(found, k, F.desc("score"), F.col("vec_id")).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
