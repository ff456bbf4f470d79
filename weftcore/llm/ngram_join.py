"""Similarity join of texts on their word n-gram sets (Jaccard), by MinHash banding.

1. Equal texts are one *text* (md5 digest) and take part once.
2. Every text gets ``bands * rows`` MinHashes of its set of ``n``-word
   shingles (fewer words: one shingle of all; no words: no shingles, linked
   to nothing).  ``choose_bands`` takes the most rows, hence the fewest false
   candidates, whose band count still meets the target recall at the
   threshold within ``max_hashes``.
3. Band hashes are shuffled; texts of one band hash are joined to the
   smallest number among them, and star contraction turns these edges into
   candidate groups.  Any two texts that share a band are in one group.
4. A group of bounded size is verified at once on the full shingle sets, as a
   product of 0/1 matrices.  A larger one is cut into blocks of neighbours
   (:func:`block_pairs`), and only blocks that share a band hash meet: a chain
   of groups costs its length, a crowd of near copies its pairs of blocks.
   Only counts of links per text and a spanning forest of the links leave a
   task, never the pairs.
5. Star contraction of the forests gives the classes.

A link is a pair of different texts with Jaccard similarity of at least
``threshold``.  Per document: ``class_id`` (smallest doc_id of the class, null
only if all are null), ``n_copies`` (other documents with an equal text),
``n_links`` (different texts linked to it), ``n_linked_docs`` (documents with
those texts).  Null and empty texts are equal texts.  Repeated rows are
copies of each other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftcore.llm.common import bounded, join_counted, materialize, prepare, text_digest
from weftcore.llm.components import components
from weftcore.llm.textgrams import Tokens, batch_tokens, mix64, seeds

#: Texts and shingles of a verification block.
BLOCK_TEXTS, BLOCK_SHINGLES = 512, 400_000


def choose_bands(threshold: float, recall: float, max_hashes: int) -> tuple[int, int]:
    """(bands, rows per band): the most rows whose bands fit into max_hashes."""
    best = None
    for rows in range(1, 65):
        hit = threshold ** rows
        bands = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-hit))
        if bands * rows <= max_hashes:
            best = (max(1, bands), rows)
    if best is None:
        raise ValueError("no banding meets that recall within max_hashes")
    return best


def shingles(tok: Tokens, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes in text order, and where each text's begin (and the end)."""
    at, hashes = tok.windows(n)
    owner = tok.text[at]
    words = np.diff(tok.first)
    short = np.flatnonzero((words > 0) & (words < n))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for j in range(n - 1):  # all the words of a short text
            has = words[short] > j
            place = np.minimum(tok.first[short] + j, len(tok.hash) - 1)
            extra = np.where(has, extra * np.uint64(0x9E3779B97F4A7C15) + tok.hash[place], extra)
        extra = mix64(extra + words[short].astype(np.uint64))
        owner, hashes = np.concatenate([owner, short]), np.concatenate([hashes, extra])
        order = np.argsort(owner, kind="stable")
        owner, hashes = owner[order], hashes[order]
    return hashes, np.searchsorted(owner, np.arange(tok.n_texts + 1))


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def _sign(n: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = bands * rows
        mul = (seeds(k, 7) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        add = (seeds(k, 8) >> np.uint64(32)).astype(np.uint32)
        for batch in batches:
            sizes, keys, counts = [], [], []
            for a, b, _, tok in batch_tokens(batch.column("text")):
                hashes, first = shingles(tok, n)
                size = np.diff(first)
                some = np.flatnonzero(size)
                sizes.append(size)
                counts.append(np.where(size > 0, bands, 0))
                if not len(some):
                    continue
                x, starts = (hashes >> np.uint64(32)).astype(np.uint32), first[some]
                least = np.empty((k, len(some)), np.uint32)
                work = np.empty_like(x)
                for i in range(k):
                    np.multiply(x, mul[i], out=work)
                    np.add(work, add[i], out=work)
                    least[i] = np.minimum.reduceat(work, starts)
                part = np.empty((len(some), bands), np.uint64)
                for j in range(bands):
                    acc = np.full(len(some), j + 1, np.uint64)
                    for i in range(j * rows, (j + 1) * rows):
                        acc = mix64(acc ^ least[i].astype(np.uint64))
                    part[:, j] = acc
                keys.append(part.ravel())
            yield pa.RecordBatch.from_arrays([
                batch.column("digest"), pa.array(np.concatenate([*sizes, np.zeros(0, np.int64)]), pa.int64()),
                _lists(np.concatenate([*keys, np.zeros(0, np.uint64)]), np.concatenate([*counts, np.zeros(0, np.int64)]))], names=["digest", "n", "bands"])

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, _, _, tok in batch_tokens(batch.column("text")):
                hashes, first = shingles(tok, n)
                out += [np.unique(hashes[a:b]).tobytes() for a, b in zip(first[:-1], first[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(out, pa.binary())], names=["digest", "set"])

    return run


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs."""
    m = len(sets)
    if m == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]])
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    owner, column = owner[keep], number[column[keep]]
    total, width = np.zeros((m, m)), max(1, (1 << 22) // m)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for a in range(0, int(shared.sum()), width):
        lo, hi = np.searchsorted(column, (a, a + width))
        part = np.zeros((m, width), np.float32)
        part[owner[lo:hi], column[lo:hi] - a] = 1
        total += part @ part.T
    return np.rint(total).astype(np.int64)


def _linked(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    sizes = np.array([len(s) for s in sets])
    both = _common(sets)
    out = both >= threshold * (sizes[:, None] + sizes[None, :] - both) - 1e-9
    np.fill_diagonal(out, False)
    return out


def _verify(threshold: float):
    """One packet of groups: texts of a candidate group (or of one block) that
    meet each other, or the texts of two blocks that meet those of the other."""

    def run(tab: pa.Table) -> pa.Table:
        digest, copies, block = tab["digest"].to_pylist(), tab["copies"].to_numpy(), tab["block"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in tab["set"].to_pylist()]
        across = tab["across"].to_numpy(zero_copy_only=False)
        groups: dict = {}
        for k, g in enumerate(tab["group"].to_pylist()):
            groups.setdefault(g, []).append(k)
        out: list = []
        for rows in groups.values():
            at = np.array(rows)
            link = _linked([sets[k] for k in rows], threshold)
            if across[at[0]]:  # pairs inside a block belong to that block with itself
                link &= block[at][:, None] != block[at][None, :]
            texts, docs = link.sum(1), link @ copies[at]
            root = list(range(len(rows)))

            def find(x: int) -> int:
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            for x in np.flatnonzero(texts):
                for y in np.flatnonzero(link[x, :x]):
                    a, b = find(int(x)), find(int(y))
                    root[a] = root[b] = min(a, b)
            for x in np.flatnonzero(texts):
                out.append((digest[rows[x]], int(texts[x]), int(docs[x]), digest[rows[find(int(x))]]))
        cols = list(zip(*out)) if out else [[], [], [], []]
        return pa.table({"digest": pa.array(cols[0], pa.binary()), "links": pa.array(cols[1], pa.int64()), "linked": pa.array(cols[2], pa.int64()), "other": pa.array(cols[3], pa.binary())})

    return run


def block_pairs(member: DataFrame, keyed: DataFrame, hops: int = 2) -> tuple[DataFrame, DataFrame]:
    """Blocks of texts of large candidate groups, and the pairs of blocks to verify.

    ``member`` (node, n) and ``keyed`` (node, key): their texts and band
    hashes.  A text's label is the smallest number within ``hops`` steps of
    texts that share a band, so a block (a label's texts, cut to a bounded
    size) is a neighbourhood, not a whole chain of them.  Two blocks are a
    pair if some band hash occurs in both.  Returns (node, block) and
    (pair, block, across): each block alone, and each pair of blocks twice."""
    label = member.select("node", F.col("node").alias("label"))
    total = keyed.count()
    for _ in range(hops):
        of_key = materialize(keyed.join(label, "node").groupBy("key").agg(F.min("label").alias("label"), F.count(F.lit(1)).alias("m")), "labels")
        label = materialize(join_counted(keyed, of_key, ["key"], "m", total).groupBy("node").agg(F.min("label").alias("label")), "labels")
    sized = member.join(label, "node")
    room = sized.groupBy("label").agg(F.count(F.lit(1)).alias("m"), F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / BLOCK_TEXTS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    room = materialize(room, "labels")
    blocks = join_counted(sized, room, ["label"], "m").select("node", F.xxhash64("label", F.pmod(F.xxhash64("node", F.lit(3)), F.col("blocks"))).alias("block"))
    blocks = materialize(blocks, "blocks")
    met = keyed.join(blocks, "node").groupBy("key", "block").agg(F.count(F.lit(1))).groupBy("key").agg(F.sort_array(F.collect_list("block")).alias("b"))
    two = met.where(F.size("b") > 1).select(F.explode(F.transform("b", lambda x, i: F.struct(x.alias("x"), F.slice("b", i + 2, F.size("b")).alias("ys")))).alias("p"))
    two = two.select("p.x", F.explode("p.ys").alias("y")).distinct()
    alone = blocks.select("block").distinct().select(F.xxhash64("block").alias("pair"), "block", F.lit(False).alias("across"))
    pair = two.select(F.xxhash64("x", "y").alias("pair"), F.explode(F.array("x", "y")).alias("block"), F.lit(True).alias("across"))
    return blocks, materialize(alone.union(pair), "block-pairs")


def text_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = 5, threshold: float = 0.8,
                 recall: float = 0.9999, max_hashes: int = 300) -> DataFrame:
    """One row per different text: digest, copies, min_id, class (a digest),
    class_id, links, linked."""
    spark = docs.sparkSession
    prepare(spark)
    bands, rows = choose_bands(threshold, recall, max_hashes)
    base = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("digest", text_digest("text"))
    ids = base.groupBy("digest").agg(F.min("id").alias("min_id"), F.count(F.lit(1)).alias("copies"))
    signed = base.select("digest", "text").mapInArrow(_sign(n, bands, rows), "digest binary, n long, bands array<long>")
    signed = signed.groupBy("digest").agg(F.first("n").alias("n"), F.first("bands").alias("bands"))
    # candidates go by 64-bit numbers: two texts of one number only share a candidate group
    texts = materialize(signed.join(ids, "digest").withColumn("node", F.xxhash64("digest")), "texts")

    keyed = texts.select("node", F.explode("bands").alias("key"))
    hub = materialize(keyed.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("m")).where("m > 1"), "hubs")
    shared = join_counted(keyed, hub, ["key"], "m").select("node", "key", "hub")
    near = shared.where("node <> hub").select("node", "hub").distinct()
    member = components(near, "node", "hub").withColumnRenamed("root", "comp")
    member = materialize(member.join(texts.select("node", "digest", "n", "copies"), "node"), "members")

    size = member.groupBy("comp").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / BLOCK_TEXTS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"), F.count(F.lit(1)).alias("m"))
    sized = materialize(join_counted(member, materialize(size, "sizes"), ["comp"], "m").drop("m"), "members")
    # texts of candidates only, by their 64-bit numbers; another text of an equal number goes at the join below
    few = bounded(member.select("node").distinct())
    sets = base.withColumn("node", F.xxhash64("digest")).join(few, "node", "left_semi").select("digest", "text").mapInArrow(_sets(n), "digest binary, set binary")
    sets = sets.groupBy("digest").agg(F.first("set").alias("set"))
    dealt = sized.where("blocks = 1").select("digest", "copies", F.col("comp").alias("group"), F.lit(0).cast("long").alias("block"), F.lit(False).alias("across"))
    large = sized.where("blocks > 1")
    if not large.isEmpty():
        mine = materialize(shared.select("node", "key").join(large.select("node"), "node", "left_semi"), "large-keys")
        blocks, pairs = block_pairs(large.select("node", "n"), mine)
        dealt = dealt.union(large.join(blocks, "node").join(pairs, "block").select("digest", "copies", F.col("pair").alias("group"), "block", "across"))
    dealt = materialize(dealt, "dealt")
    packets = max(1, dealt.count() // (2 * BLOCK_TEXTS))
    dealt = sets.join(dealt, "digest").withColumn("packet", F.pmod(F.xxhash64("group"), F.lit(packets)))
    links = dealt.groupBy("packet").applyInArrow(_verify(threshold), "digest binary, links long, linked long, other binary")
    links = materialize(links, "links")

    root = components(links, "digest", "other").select(F.col("node").alias("digest"), F.col("root").alias("class"))
    counts = links.groupBy("digest").agg(F.sum("links").alias("links"), F.sum("linked").alias("linked"))
    out = texts.select("digest", "min_id", "copies").join(root.join(counts, "digest", "left"), "digest", "left")
    out = out.select("digest", "min_id", "copies", F.coalesce("class", "digest").alias("class"), F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("linked", F.lit(0)).alias("linked"))
    linked = out.where(F.col("links") > 0).groupBy("class").agg(F.min("min_id").alias("class_id"))
    return out.join(linked, "class", "left").withColumn("class_id", F.when(F.col("links") > 0, F.col("class_id")).otherwise(F.col("min_id")))


def similarity_join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """One row per document: doc_id, class_id, n_copies, n_links, n_linked_docs."""
    found = text_classes(docs, doc_id, text, **more).select("digest", "class_id", "copies", "links", "linked")
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_digest(text).alias("digest"))
    return rows.join(found, "digest").select("doc_id", "class_id", (F.col("copies") - 1).alias("n_copies"), F.col("links").alias("n_links"), F.col("linked").alias("n_linked_docs"))


def keep_one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **more) -> DataFrame:
    """One document of each class, the one with the smallest doc_id among the
    class's smallest (ties: one of the equal rows).  Same columns as ``docs``."""
    found = text_classes(docs, doc_id, text, **more)
    # of the texts of a class, the one holding class_id (ties: smallest digest)
    lead = found.where(F.col("min_id").eqNullSafe(F.col("class_id"))).groupBy("class").agg(F.min("digest").alias("digest"))
    losers = found.join(lead, "digest", "left_anti").select(F.col("digest").alias("_digest"))
    # one row of each text: partial aggregation takes copies together before the shuffle
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    keyed = docs.select(text_digest(text).alias("_digest"), row.alias("_row"), F.struct(F.col(doc_id).isNull(), F.col(doc_id)).alias("_key"))
    first = keyed.groupBy("_digest").agg(F.min_by("_row", "_key").alias("_row"))
    return first.join(losers, "_digest", "left_anti").select("_row.*")
