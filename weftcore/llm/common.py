"""What the operators share: session settings, tables, scratch tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftcore.session import ARROW_ROWS, bound_workers, ensure_checkpoint_dir, scratch_path
from weftcore.sources.points import materialize

__all__ = ["ARROW_ROWS", "BROADCAST_ROWS", "F", "bounded", "ensure_checkpoint_dir", "expand", "join_counted", "materialize", "prepare", "scratch_path", "table", "text_digest"]


def prepare(spark: SparkSession) -> None:
    """Session settings of the subpackage; the checkpoint folder is read, not replaced."""
    ensure_checkpoint_dir(spark)
    bound_workers(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_digest(text: Column | str) -> Column:
    """16-byte md5 of a text (null: empty)."""
    return F.unhex(F.md5(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))))


#: A table of at most this many rows (a few numbers each) may be broadcast.
BROADCAST_ROWS = 1_000_000


def bounded(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if a count shows that it is small; a larger one is shuffled."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def join_counted(rows: DataFrame, facts: DataFrame, keys: list[str], n: str, total: int | None = None) -> DataFrame:
    """Inner join of rows with ``facts``, one fact a key, of which ``n`` says how
    many rows it meets (``total`` in all, or their sum).  Keys of more than
    1 / 10,000 of all rows (and of 64) are at most 10,000: their facts are
    broadcast, and their rows stay where they are.  All others are shuffled."""
    if total is None:
        total = facts.agg(F.sum(n)).first()[0] or 0
    limit = max(64, total // 10_000)
    hot = facts.where(F.col(n) > limit)
    most = rows.join(F.broadcast(hot), keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(facts.where(F.col(n) <= limit), keys)
    return most.unionByName(rest)


def expand(df: DataFrame, first: str, n: str, out: str, step: int = 1 << 16) -> DataFrame:
    """Each row n times, numbered first, first + 1, ... in ``out``; made in
    pieces of ``step``, so a large n needs no large array."""
    part = df.withColumn("_step", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(`{n}` - 1) div {step}"))))
    lo = F.col("_step") * step
    hi = F.least(lo + step, F.col(n)) - 1
    return part.withColumn(out, F.explode(F.sequence((F.col(first) + lo).cast("long"), (F.col(first) + hi).cast("long")))).drop("_step")
