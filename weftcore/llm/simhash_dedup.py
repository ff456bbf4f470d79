"""SimHash near duplicates by one-wildcard segment variants.

A text is lower-cased (A-Z), cut into words at white space and into shingles
of ``words`` words, repeats included (a shorter text is one shingle).  A bit of
its 64-bit fingerprint is 1 if more than half of the shingles' XXH64 hashes
(UTF-8, seed 42) have it; without words it is zero.  Fingerprints link at two
or fewer differing bits.

Two differing bits over two segments of 32 bits leave one segment with at most
one.  So each distinct fingerprint enters 64 variants, a segment with one of
its bits made a wildcard; fingerprints within the bound share a variant, met
by equality and verified by their differing bits.  Work within a variant:

- two fingerprints: they are its smallest and largest one, verified by their
  differing bits;
- more: every member enters its 65 points at no or one flipped bit.  Two
  fingerprints link exactly if they share a point, and a point has at most 65
  members, which all link; each is linked to the first of them.  So a crowded
  variant takes work in proportion to its members, and no pairs are listed.

Components come from star contraction; equal fingerprints are one node.

Null and empty texts have no words.  Null ids take part; the component's id is
the smallest id that is not null (null if there is none).  Repeated rows keep
their rows.  No rows give none.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftcore.llm.common import BROADCAST_ROWS, join_counted, materialize, prepare
from weftcore.llm.components import components

BITS = 64
#: A text is cut into words piece by piece, so many bytes at a time.
PIECE = 1 << 20

LANES = np.uint64(0x0101010101010101)


def _shingle_hashes(text: bytes, words: int, seed: int = 42) -> Iterator[np.ndarray]:
    """Arrays of the hashes of a text's shingles, in order."""
    from xxhash import xxh64_intdigest

    held, seen, at = [], False, 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and text[end] not in b" \t\n\v\f\r":
            end += 1
        held += text[at:end].lower().split()
        at = end
        n = len(held) - words + 1
        if n > 0:
            seen = True
            line = b" ".join(held)
            size = np.fromiter(map(len, held), np.int64, len(held))
            stop = np.cumsum(size + 1) - 1
            start = (stop - size)[:n].tolist()
            yield np.fromiter((xxh64_intdigest(line[a:b], seed) for a, b in zip(start, stop[words - 1:].tolist())), np.uint64, n)
            held = held[n:]
    if held and not seen:
        yield np.array([xxh64_intdigest(b" ".join(held), seed)], np.uint64)


def fingerprints(texts: list[bytes | None], words: int = 3) -> np.ndarray:
    """64-bit fingerprints.  Bits are counted in byte lanes over at most 255 hashes at a time."""
    parts, owner = [], []
    for k, t in enumerate(texts):
        for h in _shingle_hashes(t or b"", words):
            parts.append(h)
            owner.append(k)
    out = np.zeros(len(texts), np.uint64)
    if not parts:
        return out
    h = np.concatenate(parts)
    sizes = np.array([len(p) for p in parts])
    first = np.cumsum(sizes) - sizes
    pieces = -(-sizes // 255)
    cut = np.repeat(first, pieces) + 255 * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    who = np.repeat(owner, pieces)
    change = np.flatnonzero(np.diff(who, prepend=-1))
    total = np.bincount(owner, weights=sizes, minlength=len(texts))[who[change]]
    for j in range(8):
        lanes = np.add.reduceat((h >> np.uint64(j)) & LANES, cut)
        count = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), change, axis=0)
        for byte in range(8):
            set_ = (2 * count[:, byte] > total).astype(np.uint64)
            out[who[change]] |= set_ << np.uint64(8 * byte + j)
    return out


def _fingerprint_rows(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = fingerprints(batch.column("text").to_pylist(), words)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])


def fingerprint_table(docs: DataFrame, words: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) of every row."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(partial(_fingerprint_rows, words=words), "doc_id long, fp long")


def _variants(fps: DataFrame) -> DataFrame:
    """(key, fp): the 64 variants; a key holds the segment, the wildcard's place and the other bits."""
    v = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(BITS - 1))).alias("v"))
    segment = "shiftrightunsigned(fp, cast(v div 32 as int) * 32) & 4294967295"
    return v.select(F.expr(f"shiftleft(cast(v as bigint), 32) | ({segment} & ~shiftleft(1L, v % 32))").alias("key"), "fp")


def _near(a: str, b: str) -> F.Column:
    return F.expr(f"bit_count({a} ^ {b}) <= 2")


def links(fps: DataFrame) -> DataFrame:
    """(a, b): verified links that connect all distinct fingerprints within two bits."""
    keyed = _variants(fps)
    groups = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    groups = materialize(groups, "variants")
    found = groups.where("n = 2").where(_near("a", "b")).select("a", "b")
    large = groups.where("n > 2").select("key", "n")
    size, held = large.agg(F.count(F.lit(1)), F.sum("n")).first()
    if size:
        member = keyed.join(F.broadcast(large), "key") if size <= BROADCAST_ROWS else join_counted(keyed, large, ["key"], "n", held)
        crowd = materialize(member.select("fp").distinct(), "crowd")
        point = F.explode(F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.expr("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))))
        balls = crowd.select("fp", point.alias("point")).groupBy("point").agg(F.sort_array(F.collect_list("fp")).alias("c")).where(F.size("c") > 1)
        found = found.union(balls.select(F.col("c")[0].alias("a"), F.explode(F.slice("c", 2, BITS + 1)).alias("b")).where(_near("a", "b")))
    return found.distinct()


def near_duplicates(docs: DataFrame, words: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, fingerprint (16 hex digits), component_id (smallest id of its component)."""
    prepare(docs.sparkSession)
    rows = materialize(fingerprint_table(docs, words, doc_id, text), "fingerprints")
    fps = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints")
    node = components(links(fps.select("fp")), "a", "b")
    linked = node.withColumnRenamed("node", "fp").join(fps, "fp")
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("m"))
    least = materialize(least, "least")
    of_node = materialize(join_counted(linked.select("fp", "root"), least, ["root"], "m").select("fp", "component_id"), "of-fingerprint")
    facts = fps.join(of_node.withColumn("linked", F.lit(True)), "fp", "left").select("fp", "n", F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("least")).alias("component_id"))
    out = join_counted(rows, facts, ["fp"], "n", rows.count())
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
