"""Line sources and the two point line formats.

Dense line:  ``x1 x2 ... xd last``  -- at least two tokens; the last token (a
label or weight) is dropped unless ``drop_last=False``.
Sparse line: ``row size i1 v1 i2 v2 ...`` -- an even token count >= 2,
``row`` a long (dropped), indices 1-based in the file and 0-based after
parsing, each in 1..size; a repeated index keeps its last value.

Parsing is pure column expressions (``split``/``transform``/``try_cast``).
Bad lines follow ``mode``: ``PERMISSIVE`` keeps them with ``_corrupt=true``
and null features, ``DROPMALFORMED`` drops them, ``FAILFAST`` raises on the
executor (the reference asserts and fails the job).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftcore.functions.vectors import sparse_struct

MODES = ("PERMISSIVE", "DROPMALFORMED", "FAILFAST")


# Order of the lines of a bulk scan: file path, then place in the file.
LINE_ORDER = ["_file", "_block", "_line_no"]


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Bulk text scan, one row per line in ``value``, with the columns of
    ``LINE_ORDER``.  Spark deals files to tasks by size, so only these give
    the order of the input: lines of one block of a file stand together in a
    task and are numbered there in order.  (S4: the number of partitions is
    set where the lines are numbered, not before.)"""
    return spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_line_no"))


def read_lines_stream(
    spark: SparkSession,
    source: str,
    max_files_per_trigger: int | None = None,
    max_file_age: str | None = None,
    num_partitions: int | None = None,
    max_bytes_per_trigger: int | str | None = None,
) -> DataFrame:
    """Streaming lines from a directory, or ``socket://host:port``.

    New files in the directory form the next micro-batch; files older than
    ``max_file_age`` are forgotten (the reference remembers 100 periods).
    T12: a micro-batch takes at most ``max_files_per_trigger`` files, or files
    of about ``max_bytes_per_trigger`` bytes in all (one larger file is a batch
    of its own); not both.
    The socket form is exposed for completeness and never opened in tests.
    """
    if max_files_per_trigger and max_bytes_per_trigger:
        raise ValueError("a micro-batch is limited by files or by bytes, not both")
    if source.startswith("socket://"):
        host, port = source[len("socket://"):].rsplit(":", 1)
        df = (spark.readStream.format("socket").option("host", host)
              .option("port", int(port)).load())
    else:
        reader = spark.readStream.format("text")
        if max_files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
        if max_bytes_per_trigger:
            reader = reader.option("maxBytesPerTrigger", str(max_bytes_per_trigger))
        if max_file_age:
            reader = reader.option("maxFileAge", max_file_age)
        df = reader.load(source)
    if num_partitions:
        df = df.repartition(int(num_partitions))
    return df


def _finish(df: DataFrame, features: Column, corrupt: Column, mode: str,
            keep: list[str], line: str) -> DataFrame:
    mode = mode.upper()
    if mode not in MODES:
        raise ValueError(f"mode must be one of {MODES}, got {mode!r}")
    out = df.select(*keep, F.when(corrupt, F.lit(None)).otherwise(features).alias("features"),
                    corrupt.alias("_corrupt"), F.col(line).alias("_line"))
    if mode == "DROPMALFORMED":
        return out.where(~F.col("_corrupt")).drop("_corrupt", "_line")
    if mode == "FAILFAST":
        checked = F.when(F.col("_corrupt"), F.raise_error(
            F.concat(F.lit("malformed point line: "), F.col("_line")))).otherwise(F.col("features"))
        return (out.withColumn("features", checked.cast(out.schema["features"].dataType))
                .drop("_corrupt", "_line"))
    return out.drop("_line")


def parse_dense(df: DataFrame, col: str = "value", drop_last: bool = True,
                mode: str = "PERMISSIVE", keep: list[str] | None = None) -> DataFrame:
    """S5 (``drop_last=True``, needs >= 2 tokens) and S7 (legacy, no length check).

    Output: ``keep`` columns (default: the line), ``features ARRAY<DOUBLE>``.
    """
    keep = keep if keep is not None else [col]
    tokens = F.split(F.col(col), " ")
    n = F.size(tokens)
    coords = F.slice(tokens, 1, n - 1) if drop_last else tokens
    feats = F.transform(coords, lambda t: t.try_cast("double"))
    bad_token = F.exists(feats, lambda x: x.isNull())
    corrupt = F.col(col).isNull() | bad_token
    if drop_last:
        corrupt = corrupt | (n < 2)
    return _finish(df, feats, corrupt, mode, keep, col)


def parse_sparse(df: DataFrame, col: str = "value", mode: str = "PERMISSIVE",
                 keep: list[str] | None = None) -> DataFrame:
    """``row size (index value)*`` into a sparse struct (sorted 0-based indices).

    ``"3 4"`` is a valid empty vector of size 4.  Repeated indices keep the
    last value (``mapKeyDedupPolicy=LAST_WIN``).
    """
    df.sparkSession.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    keep = keep if keep is not None else [col]
    # columns of their own, each computed once a line: tokens, pairs, then the checked parts
    made = {x: x for x in ("_tokens", "_idx", "_vals", "_size", "_row")}
    for x in made:
        while made[x] in df.columns:
            made[x] += "_"
    df = df.withColumn(made["_tokens"], F.split(F.col(col), " "))
    t = F.col(made["_tokens"])
    n = F.size(t)
    npairs = F.floor((n - 2) / 2).cast("int")
    ks = F.when(npairs > 0, F.sequence(F.lit(0), npairs - 1)).otherwise(
        F.array().cast("array<int>"))
    df = df.withColumns({
        made["_idx"]: F.transform(ks, lambda k: F.element_at(t, 2 * k + 3).try_cast("int") - 1),
        made["_vals"]: F.transform(ks, lambda k: F.element_at(t, 2 * k + 4).try_cast("double")),
        made["_size"]: F.element_at(t, 2).try_cast("int"), made["_row"]: F.element_at(t, 1).try_cast("long")})
    idx, vals, size, row = (F.col(made[x]) for x in ("_idx", "_vals", "_size", "_row"))
    # entries that already rise need no map and no sort
    rising = F.forall(F.sequence(F.lit(2), F.greatest(F.size(idx), F.lit(2))), lambda k: (k > F.size(idx)) | (F.try_element_at(idx, k) > F.try_element_at(idx, k - 1)))
    entries = F.array_sort(F.map_entries(F.map_from_arrays(
        F.transform(idx, lambda i: F.coalesce(i, F.lit(-1))), vals)))
    sv = F.when(F.coalesce(rising, F.lit(False)), sparse_struct(size, idx, vals)).otherwise(
        sparse_struct(size, F.transform(entries, lambda e: e["key"]), F.transform(entries, lambda e: e["value"])))
    corrupt = (F.col(col).isNull() | (n < 2) | (n % 2 != 0) | row.isNull() | size.isNull()
               | (size < 0)
               | F.exists(idx, lambda i: i.isNull() | (i < 0) | (i >= size))
               | F.exists(vals, lambda v: v.isNull()))
    return _finish(df, sv, F.coalesce(corrupt, F.lit(True)), mode, keep, col)


def dense_line(features: Column | str, label: Column | str | None = None) -> Column:
    """Inverse of :func:`parse_dense`: ``x1 ... xd label`` (label defaults to 0)."""
    f = F.col(features) if isinstance(features, str) else features
    lab = F.lit("0") if label is None else (F.col(label) if isinstance(label, str) else label)
    return F.concat_ws(" ", F.array_join(f.cast("array<string>"), " "), lab.cast("string"))


def sparse_line(row: Column | str, sv: Column | str) -> Column:
    """Inverse of :func:`parse_sparse`: ``row size i v ...`` with 1-based indices."""
    row = F.col(row) if isinstance(row, str) else row
    sv = F.col(sv) if isinstance(sv, str) else sv
    pairs = F.zip_with(sv["indices"], sv["values"],
                       lambda i, v: F.concat_ws(" ", (i + 1).cast("string"), v.cast("string")))
    return F.concat_ws(" ", row.cast("string"), sv["size"].cast("string"),
                       F.array_join(pairs, " "))
