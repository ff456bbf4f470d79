"""Vectorised tokens and n-gram hashes over the texts of an Arrow batch.

Everything works on the UTF-8 bytes of many texts at once.  A token is a
maximal run of bytes of one class; its 64-bit hash depends only on the
mapped bytes, so equal tokens have equal hashes in every task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

#: Bytes handled at once (a worker holds about 50 times as many); a longer text is handled alone.
CHUNK = 1 << 18

U64 = np.uint64
_ODD = U64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """Final avalanche of a 64-bit hash (splitmix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def seeds(n: int, start: int) -> np.ndarray:
    """n pseudo-random 64-bit constants of a stream."""
    return mix64((np.arange(1, n + 1, dtype=U64) + U64(start) * U64(1 << 32)) * _ODD)


@cache
def word_tables() -> tuple[np.ndarray, np.ndarray]:
    """Classes and values of bytes for words: A-Z count as a-z, digits and
    bytes from 0x80 belong to words, all else separates."""
    cls = np.zeros(256, np.uint8)
    cls[0x30:0x3A] = cls[0x41:0x5B] = cls[0x61:0x7B] = cls[0x80:] = 1
    val = seeds(256, 1)
    val[0x41:0x5B] = val[0x61:0x7B]
    return cls, val


@cache
def mark_tables() -> tuple[np.ndarray, np.ndarray]:
    """As word_tables, but case counts and runs of punctuation are tokens too."""
    cls = np.full(256, 2, np.uint8)
    cls[:0x21] = cls[0x7F] = 0
    cls[0x30:0x3A] = cls[0x41:0x5B] = cls[0x61:0x7B] = cls[0x80:] = 1
    return cls, seeds(256, 1)


_BASE = 0x2545F4914F6CDD1D  # odd, so it has an inverse mod 2**64


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE ** k and _BASE ** -k mod 2 ** 64 for k < n."""
    out = []
    for b in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n, b, U64)
        p[:1] = 1
        out.append(np.multiply.accumulate(p, dtype=U64))
    return out[0], out[1]


_chunk_powers = cache(lambda: _powers(CHUNK + 1))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and n + 1 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    if len(column) == 0 or off is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    first, last = int(offsets[0]), int(offsets[-1])
    return (np.frombuffer(data, np.uint8)[first:last] if last > first else np.zeros(0, np.uint8)), offsets - first


def chunks(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about CHUNK bytes together."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + CHUNK, "right")) - 1
        b = min(n, max(a + 1, b))
        yield a, b
        a = b


class Tokens:
    """Tokens of some texts: byte spans, 64-bit hashes, the text of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, tables=None):
        cls_of, val_of = tables or word_tables()
        n = len(data)
        self.n_texts = len(offsets) - 1
        cls = cls_of[data]
        edge = np.ones(n + 1, bool)
        edge[1:n] = cls[1:] != cls[:-1]
        edge[offsets] = True
        at = np.flatnonzero(edge)
        if n == 0:
            at = at[:1]
        start, end = at[:-1], at[1:]
        keep = cls[start] > 0
        self.start, self.end = start[keep], end[keep]
        self.kind = cls[self.start]
        up, down = _chunk_powers() if n <= CHUNK else _powers(n + 1)
        run = np.zeros(n + 1, U64)
        np.cumsum(val_of[data] * up[:n], dtype=U64, out=run[1:])
        h = (run[self.end] - run[self.start]) * down[self.start]
        self.hash = mix64(h + (self.end - self.start).astype(U64) * _ODD)
        self.text = np.searchsorted(offsets, self.start, "right") - 1
        self.first = np.searchsorted(self.start, offsets)  # first token of each text, and the end

    def windows(self, w: int) -> tuple[np.ndarray, np.ndarray]:
        """Where windows of w tokens of one text begin, and their hashes."""
        m = len(self.hash) - w + 1
        if m <= 0:
            return np.zeros(0, np.int64), np.zeros(0, U64)
        inside = np.flatnonzero(self.text[:m] == self.text[w - 1:])
        acc = self.hash[:m].copy()
        for j in range(1, w):
            acc *= _ODD
            acc += self.hash[j:j + m]
        return inside, mix64(acc[inside] + U64(w))


def batch_tokens(column: pa.Array, tables=None) -> Iterator[tuple[int, int, np.ndarray, Tokens]]:
    """(first text, end, bytes, tokens) for each chunk of a column."""
    data, offsets = buffers(column)
    for a, b in chunks(offsets):
        lo, hi = int(offsets[a]), int(offsets[b])
        part = data[lo:hi]
        yield a, b, part, Tokens(part, offsets[a:b + 1] - lo, tables)
