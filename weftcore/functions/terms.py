"""S9 on text: hashed term counts of a text as a sparse vector, in one pass.

The bucket of a token is the first 32 bits of its md5, modulo ``buckets``.  A
worker keeps the buckets of short tokens it has met (at most ``KEPT`` of at
most ``SHORT`` bytes, then it starts anew); rows are counted where they stand,
so no shuffle is needed.  Memory is one Arrow batch and these tokens, however
many rows a task has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

KEPT = 1 << 17
SHORT = 64


class _Buckets(dict):
    def __init__(self, buckets: int):
        super().__init__()
        self.buckets = buckets

    def __missing__(self, token: bytes) -> int:
        b = int.from_bytes(hashlib.md5(token).digest()[:4], "big") % self.buckets
        if len(token) <= SHORT:
            if len(self) >= KEPT:
                self.clear()
            self[token] = b
        return b


def hashed_terms(text: Column | str, buckets: int) -> Column:
    """Sparse struct (size, indices, values) of the counts of ``text``'s
    tokens between single spaces; null text gives null, no token no entry.

    Declared non-deterministic, though it is not: else a filter on the result
    moves below the column and every text is sent and counted twice, by two
    Python workers a task."""
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        seen = _Buckets(buckets)
        for column in columns:
            idx, val, ends = [], [], [0]
            for t in column:  # one text at a time leaves Arrow's buffer
                t = t.as_py()
                tokens = [x for x in t.split(b" ") if x] if t else []
                at, n = np.unique(np.fromiter(map(seen.__getitem__, tokens), np.int32, len(tokens)), return_counts=True)
                idx.append(at)
                val.append(n.astype(np.float64))
                ends.append(ends[-1] + len(at))
            flat = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts])
            offsets = pa.array(np.array(ends, np.int32))
            yield pa.StructArray.from_arrays([
                pa.array(np.full(len(column), buckets, np.int32)), pa.ListArray.from_arrays(offsets, pa.array(flat(idx, np.int32))),
                pa.ListArray.from_arrays(offsets, pa.array(flat(val, np.float64)))], names=["size", "indices", "values"])

    t = F.col(text) if isinstance(text, str) else text
    counts = F.arrow_udf(run, "size int, indices array<int>, values array<double>").asNondeterministic()
    made = counts(t.cast("string").cast("binary"))
    return F.when(t.isNotNull(), made)
