"""Whitening of embeddings from the covariance of their distinct vectors.

Entries become integers, ``x = floor(scale * entry) + offset``, so that equal
vectors are equal exactly.  Equal vectors are grouped; each distinct vector
counts with its multiplicity (``weights="counts"``) or once (``"one"``) in

- the number n and the sums S of every dimension (whole numbers, exact),
- the covariance: per task one weighted product of centred vectors, added up
  along a tree, divisor n.

The driver holds this one d x d matrix and its eigenvectors, sorted by falling
eigenvalue; the sign makes the largest entry positive.  Every distinct vector
is whitened once and its result joined back to the rows that hold it: vectors
of very many rows by a broadcast of at most 10,000 results, all others by a
shuffle of ids and hashes.

Rows whose vector is null, or holds a null, NaN, infinite entry or one beyond
2^40 / scale, take no part.  Vectors must have one length; those that do not
have the length of most rows (ties: the longer one) take no part.  Null and
repeated ids keep their rows.  Directions without variance (eigenvalue at most
1e-12 of the largest) have no component: equal vectors only, or none, give no
rows.  ``deviation`` is null where it does not fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftcore.functions.linalg import sum_partials
from weftcore.llm.common import join_counted, materialize, prepare

#: An eigenvalue below this share of the largest counts as no variance.
NO_VARIANCE = 1e-12
LIMIT = float(1 << 40)


@dataclass
class Whitening:
    """A fitted transform: n, sums S, unit components (rows), their eigenvalues, trace of the covariance."""

    n: int
    sums: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x - S / n``, by the exact whole number ``n x - S``."""
        return (self.n * x - self.sums) / float(self.n)

    def apply(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.components.T / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list:
        """Sum over dimensions of ``(n x - S)^2``, exact; None beyond a long."""
        y = self.n * x - self.sums
        if int(np.abs(y).max(initial=0)) ** 2 * max(y.shape[1], 1) < 1 << 63:
            return (y * y).sum(axis=1).tolist()
        exact = [sum(int(v) ** 2 for v in row) for row in y]
        return [v if v < 1 << 63 else None for v in exact]


def _whole(vector: Column, scale: float, offset: int) -> Column:
    return F.transform(vector, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")) + F.lit(offset).cast("long"))


def _rows(df: DataFrame, vec_id: str, vector: str, scale: float, offset: int) -> DataFrame:
    """(vec_id, x, h1, h2) of the rows that take part; two hashes stand for x."""
    v = F.col(f"`{vector}`")
    fits = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) * scale < LIMIT))
    good = df.select(F.col(f"`{vec_id}`").alias("vec_id"), v.alias("v")).where(v.isNotNull()).where(F.coalesce(fits.eqNullSafe(True), F.lit(False)))
    rows = good.select("vec_id", _whole(F.col("v"), scale, offset).alias("x"))
    return rows.withColumn("h1", F.xxhash64("x")).withColumn("h2", F.xxhash64(F.lit(1), "x"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy().reshape(batch.num_rows, -1)


def _weight(batch: pa.RecordBatch, weights: str) -> np.ndarray:
    return batch.column("n").to_numpy() if weights == "counts" else np.ones(batch.num_rows, np.int64)


def distinct_vectors(df: DataFrame, vec_id: str, vector: str, scale: float, offset: int) -> tuple[DataFrame, DataFrame]:
    """Rows that take part, and their distinct vectors with multiplicity ``n`` (a written table)."""
    rows = _rows(df, vec_id, vector, scale, offset)
    groups = materialize(rows.groupBy("x").agg(F.count(F.lit(1)).alias("n")), "vectors")
    lengths = groups.groupBy(F.size("x").alias("d")).agg(F.sum("n").alias("rows")).orderBy(F.desc("rows"), F.desc("d")).limit(1).collect()
    dim = lengths[0]["d"] if lengths else 0
    groups = groups.where(F.size("x") == dim)
    return rows.where(F.size("x") == dim), groups.withColumn("h1", F.xxhash64("x")).withColumn("h2", F.xxhash64(F.lit(1), "x"))


def fit(groups: DataFrame, weights: str = "counts") -> Whitening | None:
    """The transform of distinct vectors ``(x, n)``; None without vectors."""
    if weights not in ("counts", "one"):
        raise ValueError(f"weights are counts or one, not {weights!r}")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, most = None, 0, 0
        for batch in batches:
            if batch.num_rows and len(batch.column("x").flatten()):
                x, w = _matrix(batch), _weight(batch, weights)
                total = (0 if total is None else total) + w @ x
                n, most = n + int(w.sum()), max(most, int(np.abs(x).max()))
        if total is not None:
            if n * most >= 1 << 63:
                raise OverflowError("sums of a dimension do not fit a long")
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(total), dtype=np.int32)), pa.array(np.concatenate([[n], total]))], names=["j", "s"])

    found = groups.select("x", "n").mapInArrow(sums, "j int, s long").groupBy("j").agg(F.sum("s").alias("s")).orderBy("j").collect()  # a row per dimension
    if not found:
        return None
    n, total = found[0]["s"], np.array([r["s"] for r in found[1:]], np.int64)
    model = Whitening(n, total, np.zeros((0, len(total))), np.zeros(0), 0.0)

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((len(total), len(total)))
        for batch in batches:
            if batch.num_rows:
                y = model.centred(_matrix(batch))
                out += (y * _weight(batch, weights)[:, None]).T @ y
        yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["m"])

    v = _tree_sum(groups.select("x", "n").mapInArrow(product, "m binary"), (len(total), len(total))) / n
    values, vectors = np.linalg.eigh((v + v.T) / 2)
    order = np.argsort(-values, kind="stable")
    values, vectors = values[order], vectors[:, order].T
    some = values > NO_VARIANCE * max(values[0], 0.0) if values[0] > 0 else np.zeros(len(values), bool)
    vectors = vectors[some]
    if len(vectors):
        vectors = vectors * np.sign(vectors[np.arange(len(vectors)), np.abs(vectors).argmax(axis=1)])[:, None]
    return Whitening(n, total, vectors, values[some], float(np.trace(v)))


def _tree_sum(parts: DataFrame, shape: tuple) -> np.ndarray:
    got = [np.frombuffer(bytes(r["m"])) for r in sum_partials(parts, 32).select("m").collect()]  # at most 32 rows
    return np.sum(got, axis=0).reshape(shape) if got else np.zeros(shape)


def whiten_groups(groups: DataFrame, model: Whitening, components: int) -> DataFrame:
    """(h1, h2, n, deviation, whitened) of every distinct vector, written once."""
    k = min(components, len(model.values))
    model = Whitening(model.n, model.sums, model.components[:k], model.values[:k], model.trace)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch)
                z = model.apply(x)
                listed = pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, k, dtype=np.int32)), pa.array(np.ascontiguousarray(z).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("h1"), batch.column("h2"), batch.column("n"), pa.array(model.deviation(x), pa.int64()), listed],
                    names=["h1", "h2", "n", "deviation", "whitened"])

    done = groups.select("x", "n", "h1", "h2").mapInArrow(run, "h1 long, h2 long, n long, deviation long, whitened array<double>")
    return materialize(done, "whitened")


def identity_error(whitened: DataFrame, model: Whitening, k: int, weights: str = "counts") -> float:
    """Largest entry of the covariance of ``whitened`` over the fit list, minus the identity."""
    def sums(mean: np.ndarray | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(k if mean is None else (k, k))
            for batch in batches:
                if batch.num_rows:
                    z, w = batch.column("whitened").flatten().to_numpy().reshape(-1, k), _weight(batch, weights)
                    out += w @ z if mean is None else ((z - mean) * w[:, None]).T @ (z - mean)
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["m"])
        return run

    some = whitened.select("whitened", "n")
    mean = _tree_sum(some.mapInArrow(sums(None), "m binary"), (k,)) / model.n
    return float(np.abs(_tree_sum(some.mapInArrow(sums(mean), "m binary"), (k, k)) / model.n - np.eye(k)).max())


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(df: DataFrame, components: int = 32, weights: str = "counts", scale: float = 64, offset: int = 1_000_000,
           vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Per row that takes part and component (from 1, at most ``components``):
    vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = df.sparkSession
    prepare(spark)
    rows, groups = distinct_vectors(df, vec_id, vector, scale, offset)
    model = fit(groups, weights)
    k = min(components, len(model.values)) if model else 0
    if not k:
        return spark.createDataFrame([], RESULT)
    done = whiten_groups(groups, model, k)
    error = identity_error(done, model, k, weights)
    held = done.agg(F.sum("n")).first()[0]
    back = join_counted(rows.select("vec_id", "h1", "h2"), done, ["h1", "h2"], "n", held)
    share = F.array(*[F.lit(float(e / model.trace)) for e in model.values[:k]])
    return back.select("vec_id", "deviation", F.posexplode("whitened").alias("c", "whitened")).select(
        "vec_id", (F.col("c") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        share[F.col("c")].alias("explained"), F.lit(error).alias("identity_error"))
