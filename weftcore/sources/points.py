"""Building point DataFrames.

Point schema: ``pid BIGINT, features ARRAY<DOUBLE>, weight DOUBLE``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftcore.session import ensure_checkpoint_dir

POINT_SCHEMA = T.StructType([
    T.StructField("pid", T.LongType()),
    T.StructField("features", T.ArrayType(T.DoubleType())),
    T.StructField("weight", T.DoubleType()),
])

SPARSE_POINT_SCHEMA = T.StructType([
    T.StructField("pid", T.LongType()),
    T.StructField("features", T.StructType([
        T.StructField("size", T.IntegerType()),
        T.StructField("indices", T.ArrayType(T.IntegerType())),
        T.StructField("values", T.ArrayType(T.DoubleType())),
    ])),
    T.StructField("weight", T.DoubleType()),
])


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def points_from_columns(df: DataFrame, id_col: Column | str, cols: list[Column | str],
                        weight: Column | float = 1.0, extra: list[str] | None = None) -> DataFrame:
    """Numeric columns to a dense point; weight 1.0 unless given."""
    w = weight if isinstance(weight, Column) else F.lit(float(weight))
    return df.select(_c(id_col).cast("long").alias("pid"),
                     F.array(*[_c(c).cast("double") for c in cols]).alias("features"),
                     w.cast("double").alias("weight"), *(extra or []))


def points_from_array(df: DataFrame, id_col: Column | str, array_col: Column | str,
                      weight: Column | float = 1.0, extra: list[str] | None = None) -> DataFrame:
    """S8 for array columns (FLOAT arrays are cast to DOUBLE)."""
    w = weight if isinstance(weight, Column) else F.lit(float(weight))
    return df.select(_c(id_col).cast("long").alias("pid"),
                     _c(array_col).cast("array<double>").alias("features"),
                     w.cast("double").alias("weight"), *(extra or []))


def sparse_from_pairs(size: Column | str, pairs: Column | str) -> Column:
    """``ARRAY<STRUCT<index INT, value DOUBLE>>`` (0-based) and a size to a
    sparse struct; the last value of a repeated index wins; indices sorted."""
    pairs = _c(pairs)
    m = F.map_from_arrays(F.transform(pairs, lambda p: p["index"]),
                          F.transform(pairs, lambda p: p["value"]))
    entries = F.array_sort(F.map_entries(m))
    return F.struct(_c(size).cast("int").alias("size"),
                    F.transform(entries, lambda e: e["key"]).cast("array<int>").alias("indices"),
                    F.transform(entries, lambda e: e["value"]).cast("array<double>").alias("values"))


def empty_points(spark: SparkSession, sparse: bool = False) -> DataFrame:
    """The empty stream before the first data."""
    return spark.createDataFrame([], SPARSE_POINT_SCHEMA if sparse else POINT_SCHEMA)


def cut_lineage(df: DataFrame) -> DataFrame:
    """K4: write to the shared checkpoint folder and continue from the files.

    Reliable checkpoints survive executor loss (local checkpoints do not).
    The frame is persisted around the write so the plan runs once.
    """
    ensure_checkpoint_dir(df.sparkSession)
    df = df.persist()
    out = df.checkpoint(eager=True)
    df.unpersist()
    return out


def materialize(df: DataFrame, name: str = "table", path: str | None = None) -> DataFrame:
    """K4 for tables whose partitioning does not matter: write Parquet to the
    shared checkpoint folder (or ``path``, overwritten) in one job and
    continue from the files."""
    from weftcore.session import scratch_path
    path = path or scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def _in_ranges(df: DataFrame, order: list[str], keep: list[str] | None, num_ranges: int | None) -> DataFrame:
    """Rows in ``num_ranges`` ranges of ``order``, written once with their range
    (``_part``) and place (``_mid``).  Only the columns of ``order`` and ``keep``
    are read and shuffled, only those of ``keep`` (default: all) are written."""
    n = int(num_ranges or df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keep = df.columns if keep is None else keep
    narrow = df.select(*dict.fromkeys([*keep, *order]))
    ranged = narrow.repartitionByRange(n, *order).sortWithinPartitions(*order)
    place = [F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_mid")]
    return materialize(ranged.select(*keep, *place), "ranges")


def number_rows(df: DataFrame, order_cols: list[str], idx_col: str = "idx",
                num_ranges: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """Number rows 0, 1, 2, ... in ``order_cols`` order without a one-task window.

    Range-partition by the order columns, sort within partitions, and write
    the columns of ``keep`` (default: all) with their partition and place, so
    both are fixed.  Then a row's number is its partition's offset (running
    count over the ``num_ranges`` partition counts, a table of ``num_ranges``
    rows) plus its position in the partition.  Only the per-partition counts
    meet on one task; the rows never do.  Ties in ``order_cols`` should be
    broken by a unique column for a deterministic numbering.
    """
    tagged = _in_ranges(df, order_cols, keep, num_ranges)
    counts = tagged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select(
        "_part",
        F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    # offsets has one row per range partition (num_ranges rows): a proven bound.
    out = tagged.join(F.broadcast(offsets), "_part")
    pos = F.col("_mid") - F.shiftleft(F.col("_part").cast("long"), 33)
    return out.withColumn(idx_col, (F.col("_off") + pos).cast("long")).drop("_part", "_mid", "_off")


def rank_within(df: DataFrame, keys: list[str], order_cols: list[str], out: str = "_rn",
                count_col: str | None = None, num_ranges: int | None = None, keep: list[str] | None = None) -> DataFrame:
    """1-based rank of each row inside its group (``keys``) in ``order_cols``
    order, and optionally the group size, without putting a group in one task.

    Keyed form of :func:`number_rows`: range-partition by keys and order,
    write the split, then a row's rank is the count of its group's rows in
    earlier partitions plus its position in this one.  A group spread over
    many partitions (a hot key) stays spread; the per (partition, group)
    counts table has at most one row per partition for each group.  ``keep``
    names the columns that are wanted beside ``keys`` (default: all).
    """
    order = [*keys, *order_cols]
    tagged = _in_ranges(df, order, None if keep is None else list(dict.fromkeys([*keys, *keep])), num_ranges)
    pk = tagged.groupBy("_part", *keys).agg(F.count(F.lit(1)).alias("_c"), F.min("_mid").alias("_m0"))
    w = Window.partitionBy(*keys).orderBy("_part")
    offs = pk.withColumn("_off", F.coalesce(F.sum("_c").over(
        w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    if count_col:
        offs = offs.withColumn(count_col, F.sum("_c").over(Window.partitionBy(*keys)))
    res = tagged.join(offs.drop("_c"), ["_part", *keys])
    rank = F.col("_off") + (F.col("_mid") - F.col("_m0")) + F.lit(1)
    return res.withColumn(out, rank.cast("long")).drop("_part", "_mid", "_m0", "_off")


def read_results(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """S10 + A10: saved model results (``batch_id=N`` folders; hidden folders
    such as ``_state`` are skipped).  With ``check``, every batch must hold
    exactly one record."""
    res = spark.read.parquet(path)
    if check:
        bad = res.groupBy("batch_id").count().where(F.col("count") != 1).limit(1).collect()
        if bad:
            raise ValueError(f"batch {bad[0]['batch_id']} holds {bad[0]['count']} results, expected 1")
    return res
