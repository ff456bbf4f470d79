"""Consistent-hash ring with virtual nodes and bounded loads.

Every shard has ``vnodes`` points on a ring of ``TICKS`` ticks; a document's
ring place is a hash of its id.  The arc between two neighbouring points
belongs to the shard of the point at its end, and a document whose shard is
full goes on clockwise to the next shard with room.  With n documents the
limit of a shard is ``(1 + slack) * n / shards``, rounded up; slack 0 makes
the limits n / shards rounded so that they add up to n, and all shards end
within one document of each other.

Documents enter arc by arc, inside an arc by (hash cell, hash, id, size,
checksum), so all of an arc's documents meet the same shards and only the
counts per arc, a table of ``shards * vnodes`` rows, decide where the limits
fall.  These cut each arc into a few ranges of positions; a document's
position is the count of the cells before it plus its place in its cell.
A shard's ranges follow each other, which also gives gapless slots.

Equal rows (id, size, checksum) are counted together first, and expanded
again at the end, so no hot key meets in one task.  Null text has no bytes;
a null id is hashed as null.  No rows: an empty result.  Columns and
expressions only.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftcore.llm.common import expand, materialize, prepare

TICKS = 1 << 16
CELLS = 64  # of an arc


def ring(spark: SparkSession, shards: int, vnodes: int, seed: int) -> list[tuple[int, int]]:
    """(tick, shard) of the ring's points in order; of points on one tick the smallest shard's counts."""
    points = spark.range(shards).select(F.col("id").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(vnodes - 1))).alias("v"))
    points = points.select("shard", F.pmod(F.xxhash64(F.lit(seed), "shard", "v"), F.lit(TICKS)).alias("tick"))
    return [tuple(r) for r in points.groupBy("tick").agg(F.min("shard")).orderBy("tick").collect()]  # at most shards * vnodes rows


def limits(n: int, shards: int, slack: float) -> list[int]:
    if slack <= 0:
        return [n // shards + (s < n % shards) for s in range(shards)]
    return [max(-(-n // shards), math.ceil((1 + slack) * n / shards))] * shards


def ranges(points: list[tuple[int, int]], counts: dict[int, int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first position, end, shard, slot of the first) as documents enter arc by arc."""
    load, out, k = [0] * len(room), [], len(points)
    for arc in range(k):
        at, left = 0, counts.get(arc, 0)
        step = 0
        while left:
            shard = points[(arc + step) % k][1]
            take = min(left, room[shard] - load[shard])
            if take:
                out.append((arc, at, at + take, shard, load[shard]))
                load[shard] += take
                at, left = at + take, left - take
            step += 1
            if step > k and left:  # shards without a point of their own
                shard = max(range(len(room)), key=lambda s: (room[s] - load[s], -s))
                take = min(left, room[shard] - load[shard])
                out.append((arc, at, at + take, shard, load[shard]))
                load[shard] += take
                at, left = at + take, left - take
    return out


def _small_table(spark: SparkSession, names: list[str], rows: list[tuple]) -> DataFrame:
    """A literal table (its rows are bounded by the ring)."""
    if not rows:
        return spark.range(0).select(*[F.lit(0).cast("long").alias(c) for c in names])
    text = ",".join("(" + ",".join(f"{v}L" for v in r) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {text} AS t({', '.join(names)})")


def shard(docs: DataFrame, shards: int = 8, vnodes: int = 64, slack: float = 0.0, doc_id: str = "doc_id", text: str = "text", seed: int = 5) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot."""
    spark = docs.sparkSession
    prepare(spark)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"))
    units = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))

    points = ring(spark, shards, vnodes, seed)
    # tick -> arc, as a table of TICKS rows: an arc ends with its point's tick, the first also holds what follows the last
    spans = [(arc, points[arc - 1][0] + 1 if arc else 0, t) for arc, (t, _) in enumerate(points)] + [(0, points[-1][0] + 1, TICKS - 1)]
    spans = [s for s in spans if s[1] <= s[2]]
    ticks = _small_table(spark, ["arc", "lo", "hi"], spans).select("arc", F.explode(F.sequence("lo", "hi")).alias("tick"))
    units = units.withColumn("tick", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id"), F.lit(TICKS))).join(F.broadcast(ticks), "tick").drop("tick")
    place = F.xxhash64(F.lit(seed + 2), "doc_id", "size", "text_crc32")
    units = materialize(units.withColumn("place", place).withColumn("cell", F.pmod("place", F.lit(CELLS))), "units")

    cells = units.groupBy("arc", "cell").agg(F.sum("n").alias("n"))
    counts = {a: n for a, n in cells.groupBy("arc").agg(F.sum("n")).collect()}  # at most shards * vnodes rows
    cut = ranges(points, counts, limits(sum(counts.values()), shards, slack))
    cut = _small_table(spark, ["arc", "lo", "hi", "shard", "slot"], cut)

    ahead = Window.partitionBy("arc").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("arc", "cell", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("begin"))
    order = Window.partitionBy("arc", "cell").orderBy("place", F.col("doc_id").asc_nulls_first(), "size", "text_crc32").rowsBetween(Window.unboundedPreceding, -1)
    placed = units.withColumn("inside", F.coalesce(F.sum("n").over(order), F.lit(0))).join(cells, ["arc", "cell"])
    placed = placed.select("doc_id", "size", "text_crc32", "arc", "n", (F.col("begin") + F.col("inside")).alias("first"))
    placed = expand(placed, "first", "n", "position")
    found = placed.join(F.broadcast(cut), (placed["arc"] == cut["arc"]) & (placed["position"] >= cut["lo"]) & (placed["position"] < cut["hi"]))
    return found.select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (cut["slot"] + F.col("position") - cut["lo"]).alias("slot"))
