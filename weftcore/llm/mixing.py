"""Mixing sources to target weights by systematic sampling.

Every source gets a target number of words: ``share`` of all words, dealt by
the sources' weights, at most ``most`` times what the source has; what a
source cannot take goes to the others by weight until none is above.  A
document's expected copies are target / words of its source.  Within the
source, documents stand in order of size (ties: md5 of the id); with one
random offset per source, a document is taken once for each integer that
the running sum of expected copies crosses.  In that order the taken words
miss the target by less than about one largest document.

The running sum is expected copies times rank.  Ranks come from counts per
(source, size, first hex digits of md5) and a rank inside such a cell, so no
source meets in one task; equal rows are counted together first and split
again at the end.

Null text or a text without words has size 0, and a source without words
takes nothing.  A null source is a source of its own, the last in order.
Repeated rows are separate documents.  No rows: an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftcore.llm.common import expand, materialize, prepare

WORD = "[^\\x20\\x09-\\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target), one row per source.

    Sources in code point order, null last, weigh ``weights``, repeated.  A
    source is full below some common level of target per weight; sources in
    order of most * size / weight fill up one after another."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    full, rest = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    per = per.withColumn("goal", F.sum("source_size").over(everything) * F.lit(float(share)))
    per = per.withColumn("level", (F.col("goal") - F.coalesce(F.sum("cap").over(full), F.lit(0.0))) / F.sum("weight").over(rest))
    fits = F.col("level") <= F.col("cap") / F.col("weight")
    per = per.withColumn("level", F.min(F.when(fits, F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("l")))).over(everything)["l"])
    return per.select("source", "source_size", F.coalesce(F.least("cap", F.col("weight") * F.col("level")), F.col("cap")).alias("target"))


def offset(source: Column, seed: int) -> Column:
    """A random number in [0, 1) for each source, a multiple of 1 / 4096."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), source), F.lit("null")))), 1, 3), 16, 10).cast("int") / 4096


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 11, most: float = 2.0,
        key: Column | None = None, **more) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies,
    taken, and ``key``, which tells rows of one id, source and size apart."""
    prepare(docs.sparkSession)
    key = F.lit(None).cast("binary") if key is None else key
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), words(F.col(text)).alias("size"), key.alias("key"))
    units = materialize(rows.groupBy("doc_id", "source", "size", "key").agg(F.count(F.lit(1)).alias("n")), "units")
    target = source_targets(units.select("source", (F.col("size") * F.col("n")).alias("size")), most=most, **more)
    tag = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    units = units.withColumn("tag", tag).withColumn("cell", F.substring("tag", 1, 2))
    by = ["source", "size", "cell"]
    cells = units.groupBy(*by).agg(F.sum("n").alias("n"))
    by_size = cells.groupBy("source", "size").agg(F.sum("n").alias("n"))
    # distinct sizes of a source: at most its longest text's number of words
    before = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    by_size = by_size.select(F.col("source").alias("s"), F.col("size").alias("z"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("source", "size").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("source", "size", "cell", F.coalesce(F.sum("n").over(within), F.lit(0)).alias("ahead"))
    cells = cells.join(by_size, cells["source"].eqNullSafe(by_size["s"]) & (cells["size"] == by_size["z"])).select(
        F.col("source").alias("s"), F.col("size").alias("z"), F.col("cell").alias("c"), (F.col("base") + F.col("ahead")).alias("begin"))
    inside = Window.partitionBy(*by).orderBy("tag", F.col("doc_id").asc_nulls_first(), "key").rowsBetween(Window.unboundedPreceding, -1)
    ranked = units.withColumn("ahead", F.coalesce(F.sum("n").over(inside), F.lit(0)))
    ranked = ranked.join(cells, ranked["source"].eqNullSafe(cells["s"]) & (ranked["size"] == cells["z"]) & (ranked["cell"] == cells["c"]))
    ranked = ranked.select("doc_id", "source", "size", "key", "n", (F.col("begin") + F.col("ahead")).alias("first"))
    ranked = expand(ranked, "first", "n", "rank")
    t = target.select(F.col("source").alias("t"), "source_size", "target")
    joined = ranked.join(t, ranked["source"].eqNullSafe(t["t"]))
    rate = F.col("target") / F.nullif(F.col("source_size"), F.lit(0))
    u = offset(F.col("source"), seed)
    crossed = F.floor((F.col("rank") + 1) * rate + u) - F.floor(F.col("rank") * rate + u)
    copies = F.least(F.coalesce(crossed, F.lit(0)), F.lit(int(-(-most // 1)))).cast("long")  # rounding never makes one more
    return joined.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "key")


def take_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **more) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it.

    Equal rows are interchangeable, so one of them stands for all and is
    repeated by their copies together."""
    cols = [F.col(f"`{c}`") for c in docs.columns]
    parts = [F.coalesce(F.concat(F.lit("+"), F.col(c).cast("string")), F.lit("-")) for c in (doc_id, source, text)]
    key = F.unhex(F.md5(F.concat_ws(":", *parts, F.xxhash64(*cols).cast("string"))))
    found = mix(docs, doc_id, text, source, key=key, **more).groupBy("key").agg(F.sum("copies").alias("copies")).where("copies > 0")
    rows = docs.select(key.alias("key"), F.struct(*cols).alias("row")).groupBy("key").agg(F.first("row").alias("row"))
    return expand(rows.join(found, "key").withColumn("zero", F.lit(0)), "zero", "copies", "copy").select("row.*")
