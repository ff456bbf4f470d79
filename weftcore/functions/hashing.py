"""Repeatable per-row random numbers.

Samplers never call ``rand()``: a row's random number is a pure function of
its ``pid`` and the seed, so a retried task, a re-run batch or a different
partitioning gives the same sample, and SQL engines can reproduce it.

    u(pid, seed) = (int(first 13 hex digits of md5(pid || ':' || seed)) + 1) / 2^52

which lies in (0, 1].  The DuckDB form is ``uniform_sql``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_52 = float(2 ** 52)


def md5_key(pid: Column | str, seed: int) -> Column:
    """md5 hex of ``pid:seed``; ordering by it (then pid) is bottom-k order."""
    pid = F.col(pid) if isinstance(pid, str) else pid
    return F.md5(F.concat(pid.cast("string"), F.lit(f":{int(seed)}")))


def uniform01(pid: Column | str, seed: int) -> Column:
    """Repeatable uniform number in (0, 1] per pid (JVM-side, codegen)."""
    h = F.substring(md5_key(pid, seed), 1, 13)
    return (F.conv(h, 16, 10).cast("double") + F.lit(1.0)) / F.lit(TWO_52)


def uniform_sql(pid_expr: str, seed: int) -> str:
    """DuckDB expression equal to :func:`uniform01`."""
    return (f"((CAST(('0x' || substr(md5(CAST({pid_expr} AS VARCHAR) || ':{int(seed)}'), 1, 13))"
            f"::BIGINT AS DOUBLE) + CAST(1 AS DOUBLE)) / CAST(4503599627370496 AS DOUBLE))")


def bucket(pid: Column | str, n: int) -> Column:
    """Balanced bucket in [0, n) from a 64-bit hash of the id."""
    pid = F.col(pid) if isinstance(pid, str) else pid
    return F.pmod(F.xxhash64(pid), F.lit(int(n)))
