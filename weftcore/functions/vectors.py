"""Vector expressions on ``ARRAY<DOUBLE>`` columns and sparse structs.

Everything here is a Catalyst expression (higher-order functions), so it
stays inside whole-stage code generation; no Python runs per row.

Sparse vectors are ``STRUCT<size INT, indices ARRAY<INT>, values ARRAY<DOUBLE>>``
with 0-based, ascending indices.  Distances between a sparse point and a
dense centre use ``|x|^2 - 2 x.c + |c|^2`` over the non-zeros only, so
their cost is proportional to the number of non-zeros, not the dimension.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPARSE_TYPE = "struct<size:int,indices:array<int>,values:array<double>>"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def vsum(a: Column | str) -> Column:
    return F.aggregate(_c(a), F.lit(0.0), lambda acc, x: acc + x)


def sq_norm(a: Column | str) -> Column:
    """F9 building block: sum of squares of one array."""
    return F.aggregate(_c(a), F.lit(0.0), lambda acc, x: acc + x * x)


def dot(a: Column | str, b: Column | str) -> Column:
    return vsum(F.zip_with(_c(a), _c(b), lambda x, y: x * y))


def sq_dist(a: Column | str, b: Column | str) -> Column:
    """squared Euclidean distance of two dense arrays."""
    return vsum(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y)))


def coord_mean(a: Column | str) -> Column:
    """Mean of a vector's coordinates."""
    return vsum(a) / F.size(_c(a))


def scale(a: Column | str, s: Column | float) -> Column:
    s = s if isinstance(s, Column) else F.lit(float(s))
    return F.transform(_c(a), lambda x: x * s)


def to_double_array(a: Column | str) -> Column:
    """FLOAT arrays (``embeddings``) to DOUBLE before any arithmetic."""
    return _c(a).cast("array<double>")


def nearest(features: Column | str, centres: Column | str) -> Column:
    """J6 inside one row: struct(idx, d2) of the nearest of an array of centres.

    ``centres`` is ``ARRAY<ARRAY<DOUBLE>>`` (a broadcast single-row column),
    so every point meets all k centres without emitting point x centre rows.
    Ties go to the lowest index.  A centre of another length is an error.
    """
    f = _c(features)
    bad = F.raise_error(F.lit("a centre and a point differ in dimension")).cast("double")
    best = F.array_min(F.transform(_c(centres), lambda c, i: F.struct(
        F.when(F.size(c) == F.size(f), sq_dist(f, c)).otherwise(bad).alias("d2"), i.alias("idx"))))
    return F.struct(best["idx"].alias("idx"), best["d2"].alias("d2"))


# ---------------------------------------------------------------- sparse ---

def sparse_struct(size: Column, indices: Column, values: Column) -> Column:
    return F.struct(size.cast("int").alias("size"),
                    indices.cast("array<int>").alias("indices"),
                    values.cast("array<double>").alias("values"))


def sparse_to_dense(sv: Column | str) -> Column:
    """P10: sparse struct to a dense array of length ``size``."""
    sv = _c(sv)
    m = F.map_from_arrays(sv["indices"], sv["values"])
    return F.when(sv["size"] == 0, F.array().cast("array<double>")).otherwise(
        F.transform(F.sequence(F.lit(0), sv["size"] - 1),
                    lambda i: F.coalesce(F.element_at(m, i), F.lit(0.0))))


def dense_to_sparse(a: Column | str) -> Column:
    """P10: dense array to sparse struct keeping the non-zero entries."""
    a = _c(a)
    pairs = F.filter(F.arrays_zip(F.sequence(F.lit(0), F.size(a) - 1).alias("i"),
                                  a.alias("v")), lambda p: p["v"] != 0.0)
    return sparse_struct(F.size(a), F.transform(pairs, lambda p: p["i"]),
                         F.transform(pairs, lambda p: p["v"]))


def sparse_sq_norm(sv: Column | str) -> Column:
    return sq_norm(_c(sv)["values"])


def sparse_dot_dense(sv: Column | str, c: Column | str) -> Column:
    sv, c = _c(sv), _c(c)
    return vsum(F.zip_with(sv["indices"], sv["values"],
                           lambda i, v: v * F.element_at(c, i + 1)))


def sparse_text(sv: Column | str) -> Column:
    """Display form ``(size,[i,..],[v,..])`` of a sparse vector."""
    sv = _c(sv)
    return F.concat(F.lit("("), sv["size"].cast("string"), F.lit(",["),
                    F.array_join(sv["indices"].cast("array<string>"), ","), F.lit("],["),
                    F.array_join(sv["values"].cast("array<string>"), ","), F.lit("])"))


def is_sparse_type(dtype) -> bool:
    """True for the sparse struct type (``size``, ``indices``, ``values``)."""
    from pyspark.sql.types import StructType
    return isinstance(dtype, StructType) and {f.name for f in dtype.fields} >= {
        "size", "indices", "values"}


def any_sq_norm(f: Column | str, sparse: bool) -> Column:
    return sparse_sq_norm(f) if sparse else sq_norm(f)


def nonzero_cells(df, keys: list[str], features: str = "features", weight: str = "weight"):
    """One row per non-zero entry: ``keys..., pid, weight, j, v`` (sparse points)."""
    e = F.explode(F.arrays_zip(F.col(f"{features}.indices").alias("j"),
                               F.col(f"{features}.values").alias("v")))
    return df.select(*keys, "pid", F.col(weight).alias("weight"), e.alias("_e")).select(
        *keys, "pid", "weight", F.col("_e.j").alias("j"), F.col("_e.v").alias("v"))
