"""Benchmark decontamination against a broadcast hash set of test n-grams.

The words of every test item (A-Z lower-cased, anything but letters, digits
and non-ASCII separates) give windows of ``window`` consecutive words; an
item of fewer words is one window.  The set of window hashes is broadcast;
every training text is scanned window by window, a hash hit is verified on
the words themselves, and a word inside any occurrence of a window is hit.

The broadcast is bounded: items are dealt into slices of about ``max_bytes``
of text, which take some five times that in a worker.  With more than one
slice the documents pass through one scan per slice, each adding to the hits
of the one before; every scan but the last is written to the shared folder,
so a worker holds one slice at a time.

Nulls, empty texts: no words, so never hit.  Repeated documents are judged
one by one.  Benchmark rows that share an item id are one item; a null id
counts as the id ``null``.  A document column named as the output column is
replaced by it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftcore.llm.common import materialize
from weftcore.llm.textgrams import batch_tokens

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

RESULT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("runs", T.ArrayType(T.LongType())),  # word positions: begin, end, begin, end, ...
])


def normalise(raw: bytes) -> bytes:
    return b" ".join(WORD.findall(raw.lower()))


class WindowSet:
    """The windows of some test items, by length: sorted hashes, and for each
    its bytes in the normalised text of all items and its item."""

    def __init__(self, rows: list[tuple], window: int):
        self.ids = ["null" if i is None else str(i) for i, _ in rows]
        texts = [normalise((t or "").encode()) for _, t in rows]
        self.body = b"".join(texts)
        held: dict[int, list] = {}
        base = 0
        for a, _, part, tok in batch_tokens(pa.array(texts, pa.binary())):
            n_words = np.diff(tok.first)
            for w in range(1, window + 1):
                mine = n_words >= w if w == window else n_words == w
                if mine.any():
                    at, hashes = tok.windows(w)
                    use = mine[tok.text[at]]
                    at, hashes = at[use], hashes[use]
                    held.setdefault(w, []).append((hashes, (tok.start[at] + base).astype(np.int32), (tok.end[at + w - 1] + base).astype(np.int32), (tok.text[at] + a).astype(np.int32)))
            base += len(part)
        self.by_length = {}
        for w, parts in held.items():
            hashes, *place = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(hashes, kind="stable")
            maybe = np.zeros(1 << min(26, max(20, (8 * len(order)).bit_length())), bool)
            maybe[hashes & np.uint64(len(maybe) - 1)] = True
            self.by_length[w] = (hashes[order], maybe, *(x[order] for x in place))

    def _of_hash(self, w: int, lo: int) -> dict[bytes, set[str]]:
        """Words and items of the windows with the hash at place ``lo``."""
        order, _, start, end, item = self.by_length[w]
        out: dict[bytes, set[str]] = {}
        for k in range(lo, int(np.searchsorted(order, order[lo], "right"))):
            out.setdefault(self.body[start[k]:end[k]], set()).add(self.ids[item[k]])
        return out

    def hits(self, part: np.ndarray, tok) -> tuple[np.ndarray, dict[int, set[str]]]:
        """Which tokens lie in an occurrence, and the items found in each text."""
        edge = np.zeros(len(tok.hash) + 1, np.int64)
        found: dict[int, set[str]] = {}
        for w, (order, maybe, *_) in self.by_length.items():
            at, hashes = tok.windows(w)
            few = np.flatnonzero(maybe[hashes & np.uint64(len(maybe) - 1)])
            if not len(few):
                continue
            at, hashes = at[few], hashes[few]
            place = np.minimum(np.searchsorted(order, hashes), len(order) - 1)
            same = order[place] == hashes
            known: dict[int, dict[bytes, set[str]]] = {}
            for i, k in zip(at[same].tolist(), place[same].tolist()):
                if k not in known:
                    known[k] = self._of_hash(w, k)
                items = known[k].get(normalise(part[tok.start[i]:tok.end[i + w - 1]].tobytes()))
                if items:
                    edge[i] += 1
                    edge[i + w] -= 1
                    found.setdefault(int(tok.text[i]), set()).update(items)
        return np.cumsum(edge[:-1]) > 0, found


def _runs(hit: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
    """Begin and end of the runs of hit words of each text, counted from its first word."""
    out = []
    for a, b in zip(first[:-1], first[1:]):
        h = hit[a:b]
        out.append(np.flatnonzero(np.diff(np.concatenate(([False], h, [False])).astype(np.int8))) if h.any() else np.zeros(0, np.int64))
    return out


def _scan(shared, name: str, out: str, prior: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            before = batch.column(batch.schema.get_field_index(out)).to_pylist() if prior else None
            rows = []
            for a, _, part, tok in batch_tokens(batch.column(batch.schema.get_field_index(name))):
                hit, found = index.hits(part, tok)
                if prior:
                    for k in range(tok.n_texts):
                        old, f = before[a + k], int(tok.first[k])
                        for x, y in zip(old["runs"][::2], old["runs"][1::2]):
                            hit[f + x:f + y] = True
                        if old["items"]:
                            found.setdefault(k, set()).update(old["items"])
                for k, r in enumerate(_runs(hit, tok.first)):
                    rows.append({"n_words": int(tok.first[k + 1] - tok.first[k]), "n_hit": int((r[1::2] - r[::2]).sum()), "items": sorted(found.get(k, ())), "runs": r.tolist()})
            kept = [i for i, f in enumerate(batch.schema) if f.name != out]
            kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("runs", pa.list_(pa.int64()))])
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in kept] + [pa.array(rows, kind)], names=[batch.schema.field(i).name for i in kept] + [out])

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
                  window: int = 10, out: str = "contamination", max_bytes: int = 16 << 20) -> DataFrame:
    """Every row of ``docs`` with a struct column ``out``: words, hit words,
    items with occurring windows (sorted), runs of hit words."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item).alias("i"), F.col(item_text).alias("t"))
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    slices = max(1, -(-size // max_bytes))
    current = docs.drop(out)
    schema = T.StructType([*current.schema.fields, T.StructField(out, RESULT)])
    for k in range(slices):
        part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(slices)) == k) if slices > 1 else items
        shared = spark.sparkContext.broadcast(WindowSet([tuple(r) for r in part.collect()], window))
        current = current.mapInArrow(_scan(shared, text, out, k > 0), schema)
        if k + 1 < slices:
            current = materialize(current, "scan")
    return current


def _cut(name: str, out: str):
    def run(batches):
        for batch in batches:
            col, got = batch.column(batch.schema.get_field_index(name)), batch.column(batch.schema.get_field_index(out)).to_pylist()
            texts: list = []
            for a, b, part, tok in batch_tokens(col):
                for k in range(b - a):
                    runs = got[a + k]["runs"]
                    if not runs:
                        texts.append(col[a + k].as_py())
                        continue
                    raw, f, at, kept = col[a + k].as_py().encode(), int(tok.first[k]), 0, []
                    base = int(tok.start[f]) - WORD.search(raw.lower()).start()
                    for x, y in zip(runs[::2], runs[1::2]):
                        kept.append(raw[at:int(tok.start[f + x]) - base])
                        at = int(tok.end[f + y - 1]) - base
                    texts.append(b"".join([*kept, raw[at:]]).decode())
            i = batch.schema.get_field_index(name)
            yield batch.set_column(i, name, pa.array(texts, pa.string()))

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", remove: str = "documents", **more) -> DataFrame:
    """``docs`` without contaminated documents (``remove="documents"``), or
    with the hit word runs cut out of their texts (``remove="spans"``).
    Same columns as ``docs``."""
    mark = "_hits"
    while mark in docs.columns:
        mark = "_" + mark
    found = contamination(docs, benchmark, text=text, out=mark, **more)
    if remove == "documents":
        return found.where(F.col(mark)["n_hit"] == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
    if remove != "spans":
        raise ValueError(f"remove is documents or spans, not {remove!r}")
    return found.mapInArrow(_cut(text, mark), found.schema).select(*[F.col(f"`{c}`") for c in docs.columns])
