"""Runs of words with a period, found in overlapping tiles for every octave of periods.

A run is a stretch of consecutive words with smallest period q (words q apart
are identical) and length at least ``max(shortest, power * q)`` that no
neighbouring word extends keeping period q.  With ``E_q`` the places i where
word i equals word i + q, it is a maximal interval of E_q.

- Tiles.  For periods P <= q < 2P (P a power of two) the words are cut into
  tiles of 6P words around boundaries that lie 2P apart; an interval of at least
  2P places holds a boundary.  A task makes the tiles of its documents from one
  array of word numbers, in which each document ends with a number of its own.
- Boundary Z-functions.  For every q of the octave, how far the words from the
  boundary b agree with those from b + q, to the right and to the left, at most
  2P each.  Agreement over windows of 2^k words is read from hashes of windows
  (made from two of half the length); only where a window of P words agrees
  is the exact length found, by halving.  So a tile costs its words, not their
  square.
- Fragments.  The agreement around a boundary is a piece of an interval of E_q:
  it is kept if it reaches the tile's edge or is long enough in itself.  Pieces
  that touch are joined within the task before they travel, then all pieces are
  shuffled by document and period and stitched.  The same stretch found with
  several periods belongs to the smallest one.

Windows are equal if their 64-bit hashes are; no comparison by chance of two
different windows is expected below 10^18 comparisons.

Null and empty texts have no words and no run.  A document is a row: equal rows
get equal results, and a null id is an id of its own.  A task holds 8 bytes a
word and octave of at most ``WORDS`` words, or of one longer text.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftcore.llm.common import materialize, prepare
from weftcore.llm.textgrams import U64, mix64

#: Documents of a batch are searched together, so many words at a time.
WORDS = 1 << 18

#: What may be done to the words of a document before runs are sought: (doc_id, words) -> words.
Change = Callable[[int | None, list], list]

FRAGMENTS = "array<struct<q:long,lo:long,hi:long>>"


def agreement(levels: list[np.ndarray], a: np.ndarray, q: np.ndarray, most: int, back: bool) -> np.ndarray:
    """For every pair of places a and a + q: how many words from there on (``back``: before them) agree, at most ``most``."""
    n, here = np.zeros(len(a), np.int64), a.copy()
    for k in range(len(levels) - 1, -1, -1):
        size, level = 1 << k, levels[k]
        for _ in range(2 if k == len(levels) - 1 else 1):
            at = here - size if back else here
            ok = (at >= 0) & (at + q < len(level)) & (n + size <= most)
            safe = np.where(ok, at, 0)
            ok &= level[safe] == level[np.where(ok, at + q, 0)]
            n += ok * size
            here = np.where(ok, at if back else at + size, here)
    return n


def tile_fragments(words: np.ndarray, ends: list[tuple[int, int]], shortest: int = 6, power: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(q, lo, hi): maximal intervals of E_q that make a run, for words of
    documents one after the other.  ``ends`` holds (length, end) of each by
    falling length; word numbers at ends are unique."""
    found = [np.zeros((3, 0), np.int64)]
    levels, p = [mix64(words.astype(U64) + U64(1))], 1
    while ends and ends[0][0] >= max(shortest, power * p):
        inside = max(e for n, e in ends if n >= max(shortest, power * p))
        use = -(-(inside + 1) // (2 * p)) * 2 * p
        top = levels[-1]
        if len(top) < use + 2 * p:  # past the last word every place differs from all others
            extra = mix64(np.arange(len(top), use + 2 * p, dtype=U64) ^ U64(1 << 63))
            top = levels[-1] = np.concatenate([top, extra])
        tile = top[:use].reshape(-1, 2 * p)
        # windows of p words at b + q and at b, then at b + q - p and at b - p
        right_t, right_q = np.nonzero(tile[:, p:] == tile[:, :1])
        left_t, left_q = np.nonzero(tile[1:, :p] == tile[:-1, p:p + 1])
        b = np.concatenate([right_t, left_t + 1]) * 2 * p
        q = np.concatenate([right_q, left_q]) + p
        if len(b):
            both = np.unique(np.stack([q, b]), axis=1)
            q, b = both
            r = agreement(levels, b, q, 2 * p, False)
            l = agreement(levels, b, q, 2 * p, True)  # noqa: E741
            least = np.maximum(shortest, power * q) - q
            some = (l == 2 * p) | (r == 2 * p) | (l + r >= least)
            q, lo, hi = q[some], (b - l)[some], (b + r)[some]
            if len(q):  # pieces are in order of (q, b): those that touch are one
                new = np.flatnonzero(np.concatenate([[True], (q[1:] != q[:-1]) | (lo[1:] > hi[:-1])]))
                last = np.concatenate([new[1:], [len(q)]]) - 1
                q, lo, hi = q[new], lo[new], hi[last]
                whole = hi - lo >= np.maximum(shortest, power * q) - q
                found.append(np.stack([q, lo, hi])[:, whole])
        # windows of 2p words, from two of p words
        n = len(top)
        after = np.concatenate([top[p:], mix64(np.arange(n, n + p, dtype=U64) ^ U64(1 << 62))])[:n]
        levels.append(mix64(top ^ mix64(after + U64(0x9E3779B97F4A7C15))))
        p *= 2
    q, lo, hi = np.concatenate(found, axis=1)
    return q, lo, hi


def _shortest_periods(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of equal stretches, the one with the smallest period."""
    order = np.lexsort((q, hi + q, lo))
    q, lo, hi = q[order], lo[order], hi[order]
    keep = np.concatenate([[True], (lo[1:] != lo[:-1]) | ((hi + q)[1:] != (hi + q)[:-1])])[:len(q)]
    return q[keep], lo[keep], hi[keep]


def _groups(sizes: list[int]) -> Iterator[list[int]]:
    """Documents by falling size, in groups of at most WORDS words."""
    group, held = [], 0
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        if group and held + sizes[k] > WORDS:
            yield group
            group, held = [], 0
        group.append(k)
        held += sizes[k] + 1
    if group:
        yield group


def document_fragments(texts: list[list], shortest: int = 6, power: int = 4) -> list[list]:
    """For every list of words the intervals (q, lo, hi) of E_q that make runs."""
    out: list = [[] for _ in texts]
    for group in _groups([len(t) for t in texts]):
        number: dict = defaultdict()
        number.default_factory = number.__len__
        total = sum(len(texts[k]) + 1 for k in group)
        words, ends, starts, at = np.empty(total, np.int64), [], [], 0
        for k in group:
            n = len(texts[k])
            words[at:at + n] = np.fromiter(map(number.__getitem__, texts[k]), np.int64, n)
            words[at + n] = -1 - at  # a number of its own
            starts.append(at)
            ends.append((n, at + n))
            at += n + 1
        q, lo, hi = _shortest_periods(*tile_fragments(words, ends, shortest, power))
        whose = np.searchsorted(starts, lo, side="right") - 1
        for d, *f in zip(whose.tolist(), q.tolist(), (lo - np.array(starts)[whose]).tolist(), (hi - np.array(starts)[whose]).tolist()):
            out[group[d]].append(f)
    return out


def _same(doc_id: int | None, words: list) -> list:
    return words


def _search(batches: Iterator[pa.RecordBatch], change: Change, shortest: int, power: int) -> Iterator[pa.RecordBatch]:
    """Per document: its number of words, the hash of them, its fragments, and its words where it has some."""
    for batch in batches:
        texts = [change(i, (t or b"").split()) for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())]
        found = document_fragments(texts, shortest, power)
        body = [b" ".join(t) for t in texts]
        yield pa.RecordBatch.from_arrays([
            *[batch.column(c) for c in ("doc_id", "k1", "k2")], pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(b).hexdigest() for b in body]),
            pa.array([[{"q": q, "lo": lo, "hi": hi} for q, lo, hi in f] for f in found], pa.list_(pa.struct([(x, pa.int64()) for x in ("q", "lo", "hi")]))),
            pa.array([b if f else None for b, f in zip(body, found)], pa.binary())],
            names=["doc_id", "k1", "k2", "n_words", "sha", "fragments", "body"])


def stitch(fragments: DataFrame, keys: list[str], shortest: int = 6, power: int = 4) -> DataFrame:
    """keys..., start, length, period of every run, from pieces (keys..., q, lo,
    hi) of intervals: shuffled by document and period, joined where they touch."""
    w = Window.partitionBy(*keys, "q").orderBy("lo", "hi")
    before = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    island = fragments.withColumn("new", F.when(before >= F.col("lo"), 0).otherwise(1)).withColumn("island", F.sum("new").over(w))
    whole = island.groupBy(*keys, "q", "island").agg(F.min("lo").alias("start"), F.max("hi").alias("hi"))
    runs = whole.select(*keys, "q", "start", (F.col("hi") - F.col("start") + F.col("q")).alias("length"))
    runs = runs.where((F.col("length") >= shortest) & (F.col("length") >= power * F.col("q")))
    return runs.groupBy(*keys, "start", "length").agg(F.min("q").alias("period"))


def _kept(words: list, runs: list) -> list:
    """Words that no run holds after its first period."""
    gone = np.zeros(len(words) + 1, np.int64)
    for r in runs:
        gone[r["start"] + r["period"]] += 1
        gone[r["start"] + r["length"]] -= 1
    return [w for w, g in zip(words, np.cumsum(gone).tolist()) if g == 0]


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        done = [b" ".join(_kept(b.split(), runs)) for b, runs in zip(batch.column("body").to_pylist(), batch.column("runs").to_pylist())]
        keep = [batch.column(c) for c in ("doc_id", "n_words", "runs")]
        yield pa.RecordBatch.from_arrays([*keep, pa.array(done, pa.binary())], names=["doc_id", "n_words", "runs", "collapsed"])


RUNS = "array<struct<start:long,period:long,length:long>>"


def find_runs(docs: DataFrame, change: Change = _same, shortest: int = 6, power: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, runs (by start, then period), collapsed (kept
    words joined by one space, as bytes; null without a run), collapsed_sha256."""
    if power < 3:
        raise ValueError(f"a tile shows runs of 3 periods or more, not {power}")
    prepare(docs.sparkSession)
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), t.cast("binary").alias("text"))
    rows = rows.select("*", F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", "doc_id").alias("k2"))
    schema = f"doc_id long, k1 long, k2 long, n_words long, sha string, fragments {FRAGMENTS}, body binary"
    found = materialize(rows.mapInArrow(partial(_search, change=change, shortest=shortest, power=power), schema), "fragments")
    none = found.where(F.size("fragments") == 0).select("doc_id", "n_words", F.array().cast(RUNS).alias("runs"), F.lit(None).cast("binary").alias("collapsed"), F.col("sha").alias("collapsed_sha256"))
    some = found.where(F.size("fragments") > 0)
    pieces = some.select("k1", "k2", F.explode("fragments").alias("f")).select("k1", "k2", "f.*")
    runs = stitch(pieces, ["k1", "k2"], shortest, power).groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    with_runs = some.select("doc_id", "k1", "k2", "n_words", "body").join(runs, ["k1", "k2"]).select("doc_id", "n_words", "runs", "body")
    done = with_runs.mapInArrow(_collapse, f"doc_id long, n_words long, runs {RUNS}, collapsed binary")
    return none.unionByName(done.withColumn("collapsed_sha256", F.sha2("collapsed", 256)))


def run_digests(found: DataFrame) -> DataFrame:
    """Per row of :func:`find_runs`: doc_id, n_runs, the longest run (ties: smallest
    start, then period) as start, length, period, exponent_milli, and the two hashes."""
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    text = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    d = found.withColumn("top", top)
    return d.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.start")).alias("start"), F.col("top.length").alias("length"), (-F.col("top.period")).alias("period"),
        F.expr("top.length * 1000 div (-top.period)").cast("long").alias("exponent_milli"), F.sha2(text, 256).alias("runs_sha256"), "collapsed_sha256")
