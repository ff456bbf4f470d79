"""Matrices as DataFrames, by rows ``(i INT, row ARRAY<DOUBLE>)`` or by
cells ``(i, j, value)``.

Small local matrices (centres, axes; at most k x d) are broadcast; tall
matrices (the points) stay distributed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftcore.functions.vectors import dot


def matrix_cells(mdf: DataFrame) -> DataFrame:
    """Every row of a row matrix as cells."""
    return mdf.select("i", F.posexplode("row").alias("j", "value"))


def transpose(cells: DataFrame) -> DataFrame:
    """swapped indices; no row of a tall matrix's transpose is gathered."""
    return cells.select(F.col("j").alias("i"), F.col("i").alias("j"), "value")


def multiply_rows(features: F.Column | str, right_t: F.Column | str) -> F.Column:
    """F8 per row: ``x B`` where ``right_t`` holds the *columns* of B as
    ``ARRAY<ARRAY<DOUBLE>>`` (i.e. the rows of B transposed)."""
    f = F.col(features) if isinstance(features, str) else features
    bt = F.col(right_t) if isinstance(right_t, str) else right_t
    return F.transform(bt, lambda col: dot(f, col))


def sum_partials(parts: DataFrame, most: int) -> DataFrame:
    """Arrays of doubles as bytes (column ``m``), added up to at most ``most``
    rows along a tree in which one task adds about 32 of them."""
    import numpy as np

    def add(pdf):
        import pandas as pd
        total = np.frombuffer(pdf["m"].iloc[0]).copy()
        for m in pdf["m"].iloc[1:]:
            total += np.frombuffer(m)
        return pd.DataFrame({"g": [pdf["g"].iloc[0]], "m": [total.tobytes()]})

    n = parts.rdd.getNumPartitions()
    out = parts.select(F.spark_partition_id().cast("long").alias("g"), "m")
    while n > most:
        n = max(most if n <= 32 * most else 1, -(-n // 32))
        out = out.withColumn("g", F.pmod("g", F.lit(n))).groupBy("g").applyInPandas(add, "g long, m binary")
    return out


def gram_matrix(df: DataFrame, features: str = "features", weight: str | None = None) -> DataFrame:
    """``A^T A`` as ``(i, j, value)``; weighted rows count ``w x x^T``.

    Each task folds its rows (dense arrays or sparse structs, as Arrow
    batches) into one d x d partial with NumPy; the partials are added up
    along a tree, so the shuffle carries d x d numbers per task once.  For
    moderate d; the models never form this matrix.
    """
    import numpy as np
    import pyarrow as pa

    from weftcore.functions.vectors import is_sparse_type
    from weftcore.operators.evaluate import _dense_rows

    sparse = is_sparse_type(df.schema[features].dataType)
    f = F.col(features)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    dim = df.agg(F.max(f["size"] if sparse else F.size(f))).first()[0] or 0
    feats = [f["indices"].alias("_idx"), f["values"].alias("_val")] if sparse else [f.alias("features")]

    def partial(batches):
        g = np.zeros((dim, dim))
        for whole in batches:
            for a in range(0, whole.num_rows, 1024):
                batch = whole.slice(a, 1024)
                x, used = _dense_rows(batch, sparse)
                part = (x * batch.column("w").to_numpy()[:, None]).T @ x
                if used is None:
                    g += part
                else:
                    g[np.ix_(used, used)] += part
        yield pa.RecordBatch.from_arrays([pa.array([g.tobytes()])], names=["m"])

    def cells(batches):
        for batch in batches:
            for m in batch.column("m").to_pylist():
                g = np.frombuffer(m)
                i, j = np.divmod(np.arange(len(g)), dim)
                yield pa.RecordBatch.from_arrays([pa.array(i.astype("int32")), pa.array(j.astype("int32")), pa.array(g)], names=["i", "j", "value"])

    total = sum_partials(df.select(w.alias("w"), *feats).mapInArrow(partial, "m binary"), 1)
    return total.mapInArrow(cells, "i int, j int, value double")
