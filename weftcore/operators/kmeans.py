"""K-means on dense or sparse points as block products.

A task turns its Arrow batches into blocks: a dense block is a matrix, a
sparse one keeps its rows' coordinates and values (CSR).  A block meets all
centres in one product, held over the coordinates that some centre uses, so
the cost is (non-zeros) x k whatever the dimension, and memory is one block.
Sums of a Lloyd step leave a task as one row per (centre, coordinate in use);
they are added up by a shuffle on that key.  The driver holds the model: k
centres over their coordinates in use.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftcore.functions.hashing import uniform01
from weftcore.functions.vectors import is_sparse_type

#: Numbers (non-zeros or cells, times k) that a block's product holds.
BLOCK = 1 << 20
#: Cells that a task holds before equal ones are added up.
HELD = 1 << 20
#: A distance below this share of the norms is a rounding error: the point lies on the centre.
SAME = 1e-12


@dataclass
class Centres:
    """k centres of ``dim`` coordinates as a k x len(used) matrix over the coordinates in use."""

    dim: int
    used: np.ndarray
    matrix: np.ndarray

    def __post_init__(self):
        self.norms = (self.matrix * self.matrix).sum(axis=1)

    def __len__(self) -> int:
        return len(self.matrix)

    @classmethod
    def of_dense(cls, rows) -> "Centres":
        m = np.array(rows, float).reshape(len(rows), -1)
        return cls(m.shape[1], np.arange(m.shape[1]), m)

    @classmethod
    def of_sparse(cls, rows: list[tuple], dim: int) -> "Centres":
        """Rows of (coordinates, values)."""
        used = np.unique(np.concatenate([np.zeros(0, np.int64), *[np.asarray(i, np.int64) for i, _ in rows]]))
        m = np.zeros((len(rows), len(used)))
        for r, (i, v) in zip(m, rows):
            r[np.searchsorted(used, i)] = v
        return cls(dim, used, m)

    def dense(self) -> np.ndarray:
        out = np.zeros((len(self), self.dim))
        out[:, self.used] = self.matrix
        return out

    def pick(self, rows) -> "Centres":
        return Centres(self.dim, self.used, self.matrix[rows])


def feature_columns(points: DataFrame) -> list[Column]:
    """What a block needs of ``features``."""
    if is_sparse_type(points.schema["features"].dataType):
        return [F.col("features.indices").alias("_idx"), F.col("features.values").alias("_val")]
    return [F.col("features").alias("_val")]


@dataclass
class Block:
    """Rows of a batch: a matrix, or non-zeros with where each row begins."""

    n: int
    x: np.ndarray | None
    idx: np.ndarray | None = None
    val: np.ndarray | None = None
    ends: np.ndarray | None = None

    @classmethod
    def of(cls, columns: list[pa.Array]) -> "Block":
        val = columns[-1]
        flat = np.asarray(val.flatten().to_numpy(zero_copy_only=False), float)
        if len(columns) == 1:
            return cls(len(val), flat.reshape(len(val), -1))
        sizes = np.asarray(val.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
        return cls(len(val), None, np.asarray(columns[0].flatten().to_numpy(zero_copy_only=False), np.int64), flat, np.cumsum(sizes))

    def pieces(self, width: int) -> Iterator[tuple[int, int]]:
        """Ranges of rows of about BLOCK / width numbers each."""
        most = max(1, BLOCK // max(width, 1))
        if self.x is not None:
            step = max(1, most // max(self.x.shape[1], 1))
            yield from ((a, min(a + step, self.n)) for a in range(0, self.n, step))
            return
        a = 0
        while a < self.n:
            before = self.ends[a - 1] if a else 0
            b = max(a + 1, int(np.searchsorted(self.ends, before + most, side="right")))
            yield a, b
            a = b

    def norms(self) -> np.ndarray:
        if self.x is not None:
            return (self.x * self.x).sum(axis=1)
        return self._row_sums(self.val * self.val, 0, self.n)

    def _row_sums(self, cells: np.ndarray, a: int, b: int) -> np.ndarray:
        """Sums of cells (of rows a to b) by row; rows without any are zero."""
        begin = self.ends[a - 1] if a else 0
        starts = np.concatenate([[begin], self.ends[a:b - 1]]) - begin
        some = self.ends[a:b] - begin > starts
        out = np.zeros((b - a, *cells.shape[1:]))
        if some.any():
            out[some] = np.add.reduceat(cells, starts[some], axis=0)
        return out

    def products(self, c: Centres) -> np.ndarray:
        """n x k inner products with the centres."""
        if self.x is not None:
            return self.x[:, c.used] @ c.matrix.T if len(c.used) < self.x.shape[1] else self.x @ c.matrix.T
        out = np.zeros((self.n, len(c)))
        by_place = np.vstack([c.matrix.T, np.zeros((1, len(c)))])  # the last row: coordinates without a centre
        for a, b in self.pieces(len(c)):
            lo, hi = (self.ends[a - 1] if a else 0), self.ends[b - 1]
            at = np.searchsorted(c.used, self.idx[lo:hi])
            miss = at >= len(c.used)
            at[miss] = 0
            if len(c.used):
                miss |= c.used[at] != self.idx[lo:hi]
            at[miss] = len(c.used)
            out[a:b] = self._row_sums(by_place[at] * self.val[lo:hi, None], a, b)
        return out

    def nearest(self, c: Centres) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of each row's nearest centre; ties: the first."""
        xx = self.norms()
        d2 = xx[:, None] - 2.0 * self.products(c) + c.norms[None, :]
        b = d2.argmin(axis=1)
        best = d2[np.arange(self.n), b]
        return b, np.where(best > SAME * (xx + c.norms[b]), best, 0.0)

    def cells(self, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(centre, coordinate, weighted value) of every entry; coordinate -1 carries the weight."""
        if self.x is not None:
            d = self.x.shape[1]
            row, j, v = np.repeat(np.arange(self.n), d), np.tile(np.arange(d), self.n), self.x.ravel()
        else:
            row, j, v = np.repeat(np.arange(self.n), np.diff(self.ends, prepend=0)), self.idx, self.val
        return np.concatenate([b, b[row]]), np.concatenate([np.full(self.n, -1), j]), np.concatenate([w, w[row] * v])


def _several(columns: pa.Array | tuple[pa.Array, ...]) -> list[pa.Array]:
    """The arguments of an Arrow function: a lone one comes as it is."""
    return [columns] if isinstance(columns, pa.Array) else list(columns)


def nearest_column(points: DataFrame, centres: Centres) -> Column:
    """struct(idx, d2) of each point's nearest centre, dense or sparse.
    A dense point of another dimension is an error."""
    shared = points.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            block = Block.of(_several(columns))
            if block.n and block.x is not None and block.x.shape[1] != shared.value.dim:
                raise ValueError("a centre and a point differ in dimension")
            b, d2 = block.nearest(shared.value)
            yield pa.StructArray.from_arrays([pa.array(b.astype(np.int32)), pa.array(d2)], names=["idx", "d2"])

    return F.arrow_udf(run, "idx int, d2 double")(*feature_columns(points))


def product_column(points: DataFrame, rows: Centres) -> Column:
    """Inner products of each point with every row, as an array."""
    shared = points.sparkSession.sparkContext.broadcast(rows)

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            p = Block.of(_several(columns)).products(shared.value)
            yield pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, p.shape[1], dtype=np.int32)), pa.array(np.ascontiguousarray(p).ravel()))

    return F.arrow_udf(run, "array<double>")(*feature_columns(points))


def _meets(points: DataFrame, new: Centres, first: int) -> Column:
    """struct(d2, b): the distance kept so far (columns d2 and b), or that to a new candidate where it is smaller."""
    shared = points.sparkSession.sparkContext.broadcast(new)

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for d2, b, *columns in batches:
            old, number = d2.to_numpy(zero_copy_only=False), b.to_numpy(zero_copy_only=False)
            at, near = Block.of(columns).nearest(shared.value)
            less = near < old
            yield pa.StructArray.from_arrays([pa.array(np.where(less, near, old)), pa.array(np.where(less, at + first, number).astype(np.int32))], names=["d2", "b"])

    return F.arrow_udf(run, "d2 double, b int")(F.col("d2"), F.col("b"), *feature_columns(points))


def _rows(found: list, sparse: bool) -> list[tuple]:
    out = []
    for r in found:
        f = r["features"]
        out.append((tuple(f["indices"]), tuple(f["values"])) if sparse else (None, tuple(f)))
    return out


def _centres(rows: list[tuple], sparse: bool, dim: int) -> Centres:
    return Centres.of_sparse(rows, dim) if sparse else Centres.of_dense([v for _, v in rows])


def weighted_plus_plus(c: Centres, mass: np.ndarray, k: int, seed: int, tries: int | None = None) -> np.ndarray:
    """Numbers of k of the (few) rows by greedy k-means++: of some draws by
    mass x squared distance, the one that leaves the least cost."""
    rng, tries = np.random.default_rng(seed), tries or 2 + int(np.log(max(k, 1)))

    def away(i: int) -> np.ndarray:
        d = c.norms + c.norms[i] - 2.0 * c.matrix @ c.matrix[i]
        return np.where(d > SAME * (c.norms + c.norms[i]), d, 0.0)

    chosen = [int(rng.choice(len(c), p=mass / mass.sum()))]
    d2 = away(chosen[0])
    while len(chosen) < k and (mass * d2).sum() > 0:
        p = mass * d2
        options = [(i, np.minimum(d2, away(i))) for i in dict.fromkeys(rng.choice(len(c), size=tries, p=p / p.sum()).tolist())]
        best, d2 = min(options, key=lambda o: float((mass * o[1]).sum()))
        chosen.append(best)
    return np.array(chosen)


def seeds(points: DataFrame, k: int, seed: int = 0, weighted: bool = True, rounds: int = 2) -> Centres:
    """k-means|| seeds.  Every point keeps its squared distance to the
    candidates so far and meets only the new ones; a round draws 2k points
    with probabilities in proportion to weight x squared distance (the 2k
    smallest of -log(u) / share, which needs no total).  Rounds go on until
    there are k different candidates or all points lie on them; greedy
    k-means++ by the candidates' weights then chooses k.  About 2k points a
    round reach the driver."""
    sparse = is_sparse_type(points.schema["features"].dataType)
    w = (F.col("weight") if weighted else F.lit(1.0)).cast("double")
    dim = points.agg(F.max(F.col("features.size") if sparse else F.size("features"))).first()[0] or 0
    state = points.select("pid", "features", w.alias("w"), F.lit(float("inf")).alias("d2"), F.lit(-1).alias("b"))

    def draw(df: DataFrame, share: Column, n: int, salt: int) -> list:
        return _rows(df.where(share > 0).orderBy(-F.log(uniform01("pid", seed + 7919 * salt)) / share, "pid").limit(n).select("features").collect(), sparse)

    found = draw(state, F.col("w"), 1, 0)
    new, step, kept = found, 0, None
    try:
        while new and (step < rounds or len(found) < k):
            step += 1
            met = state.withColumn("near", _meets(state, _centres(new, sparse, dim), len(found) - len(new)))
            state = met.select("pid", "features", "w", "near.d2", "near.b").persist()
            drawn = draw(state, F.col("w") * F.col("d2"), 2 * k, step)
            if kept is not None:
                kept.unpersist()
            kept = state
            new = list(dict.fromkeys(r for r in drawn if r not in set(found)))
            found = found + new
        if not found:
            return Centres(dim, np.zeros(0, np.int64), np.zeros((0, 0)))
        all_ = _centres(found, sparse, dim)
        if len(found) <= k:
            return all_
        if new:
            state = state.withColumn("near", _meets(state, _centres(new, sparse, dim), len(found) - len(new))).select("w", "near.b")
        mass = np.zeros(len(found))
        for r in state.groupBy("b").agg(F.sum("w").alias("w")).collect():  # a row per candidate
            mass[r["b"]] = r["w"]
        return all_.pick(weighted_plus_plus(all_, mass, k, seed))
    finally:
        if kept is not None:
            kept.unpersist()


def _step_sums(points: DataFrame, centres: Centres, weighted: bool) -> DataFrame:
    """(b, j, s): weighted sums by centre and coordinate in use; j = -1: the
    weight; b = -1: the cost."""
    shared = points.sparkSession.sparkContext.broadcast(centres)
    w = (F.col("weight") if weighted else F.lit(1.0)).cast("double").alias("w")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, cost, parts, held = shared.value, 0.0, [], 0

        def add_up() -> list:
            key = np.concatenate([k for k, _ in parts])
            cell, at = np.unique(key, return_inverse=True)
            return [(cell, np.bincount(at, weights=np.concatenate([s for _, s in parts]), minlength=len(cell)))]

        for batch in batches:
            if not batch.num_rows:
                continue
            block, weight = Block.of(list(batch.columns[1:])), batch.column("w").to_numpy()
            if block.x is not None and block.x.shape[1] != c.dim:
                raise ValueError("a centre and a point differ in dimension")
            b, d2 = block.nearest(c)
            cost += float(weight @ d2)
            at, j, s = block.cells(b, weight)
            parts.append(((at.astype(np.int64) << 32) + j + 1, s))
            held += len(s)
            if held > HELD:
                parts = add_up()
                held = 0
        if parts:
            (cell, s), = add_up()
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([[-1], cell >> 32]).astype(np.int32)), pa.array(np.concatenate([[-1], (cell & 0xFFFFFFFF) - 1]).astype(np.int32)),
                pa.array(np.concatenate([[cost], s]))], names=["b", "j", "s"])

    parts = points.select(w, *feature_columns(points)).mapInArrow(run, "b int, j int, s double")
    return parts.groupBy("b", "j").agg(F.sum("s").alias("s"))


@dataclass
class Fit:
    """Centres, the cost before the last step, steps made, whether no centre moved by more than the tolerance."""

    centres: Centres
    cost: float
    steps: int
    settled: bool


def lloyd(points: DataFrame, centres: Centres, max_iter: int = 20, tol: float = 1e-4, weighted: bool = True) -> Fit:
    """Lloyd steps from given centres, one pass each, until no centre moves by
    more than ``tol``.  A centre without points stays.  Equal in every run and
    for every partitioning up to the order of sums."""
    cost, settled, step = 0.0, False, 0
    while step < max_iter and not settled:
        step += 1
        sums = _step_sums(points, centres, weighted).groupBy("b").agg(F.collect_list("j").alias("j"), F.collect_list("s").alias("s"))
        rows = {}
        for r in sums.collect():  # the model: a row per centre
            j, s = np.array(r["j"], np.int64), np.array(r["s"])
            if r["b"] < 0:
                cost = float(s[0])
            else:
                keep = j >= 0
                rows[r["b"]] = (j[keep], s[keep] / s[~keep][0])
        old = [(centres.used, m) for m in centres.matrix]
        both = Centres.of_sparse([rows.get(k, old[k]) for k in range(len(centres))] + old, centres.dim)
        k = len(centres)
        settled = bool(((both.matrix[:k] - both.matrix[k:]) ** 2).sum(axis=1).max(initial=0) <= tol * tol)
        some = np.flatnonzero((both.matrix[:k] != 0).any(axis=0))
        centres = Centres(centres.dim, both.used[some], both.matrix[:k][:, some])
    return Fit(centres, cost, step, settled)


#: Centres that meet a block at once where there are many (the cluster reducer).
GROUP = 64


def reduce_block(block: Block, w: np.ndarray, s: int, rng: np.random.Generator, steps: int = 3) -> tuple[np.ndarray, list[tuple]]:
    """C7 on one block: k-means++ seeds (draws by weight x squared distance),
    ``steps`` Lloyd steps, and a last assignment.  Returns each row's cluster
    and the clusters' weighted means as (coordinates, values); at most s."""
    if block.x is not None:
        used, x = np.arange(block.x.shape[1]), block.x
        row = lambda i: x[i]
        along = lambda v: x @ v
    else:
        used, at = np.unique(block.idx, return_inverse=True)
        lo = np.concatenate([[0], block.ends[:-1]])

        def row(i: int) -> np.ndarray:
            v = np.zeros(len(used))
            v[at[lo[i]:block.ends[i]]] = block.val[lo[i]:block.ends[i]]
            return v

        along = lambda v: block._row_sums(v[at] * block.val, 0, block.n)
    xx = block.norms()

    def away(i: int) -> np.ndarray:
        d = xx + xx[i] - 2.0 * along(row(i))
        return np.where(d > SAME * (xx + xx[i]), d, 0.0)

    def draw(p: np.ndarray) -> int:
        total = np.cumsum(p)
        return min(int(np.searchsorted(total, rng.random() * total[-1], side="right")), block.n - 1)

    first = draw(w)
    chosen, d2 = [first], away(first)
    while len(chosen) < s and (w * d2).sum() > 0:
        i = draw(w * d2)
        if d2[i] <= 0:  # an edge of the cumulated sums
            i = int((w * d2).argmax())
        chosen.append(i)
        d2 = np.minimum(d2, away(i))
    dense = [row(i) for i in chosen]
    means = [(used[np.flatnonzero(v)], v[np.flatnonzero(v)]) for v in dense] if block.x is None else [(used, v) for v in dense]
    label = np.zeros(block.n, np.int64)
    for step in range(steps + 1):
        best = np.full(block.n, np.inf)
        for a in range(0, len(means), GROUP):
            c = Centres.of_sparse(means[a:a + GROUP], len(used)) if block.x is None else Centres.of_dense([v for _, v in means[a:a + GROUP]])
            b, d = block.nearest(c)
            less = d < best
            best, label = np.where(less, d, best), np.where(less, b + a, label)
        at_, j, v = block.cells(label, w)
        key, back = np.unique((at_.astype(np.int64) << 32) + j + 1, return_inverse=True)
        total = np.bincount(back, weights=v, minlength=len(key))
        cluster, coordinate = key >> 32, (key & 0xFFFFFFFF) - 1
        edge = np.flatnonzero(coordinate < 0)  # where a cluster's cells begin: its weight
        means = [(coordinate[a + 1:b], total[a + 1:b] / total[a]) for a, b in zip(edge, [*edge[1:], len(key)])]
        label = np.searchsorted(cluster[edge], label)  # clusters without rows are gone
    return label, means
