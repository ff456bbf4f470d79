"""Token ids as Arrow IPC files of fixed-size-list batches.

Documents are put in ascending doc_id order (range partitions, sorted), each
text is encoded once with a public tokenizer plus an end id, and every
partition writes one Arrow file: rows of ``length`` ids (``ids``), as many
mask bits (``mask``, false where the last row is padded) and the places at
which documents end (``ends``), so the files alone tell documents apart.  All rows of all
batches but the last have the same shape, so row ``i`` of a file is row
``i % rows`` of batch ``i // rows``: a memory map gives it without a copy.
A Parquet index beside the files holds, per document, its file, its first
position there and its number of ids; ``manifest`` adds each file's offset
in the whole stream.

A task writes to a name of its own and then renames it, so a lost or
repeated task leaves one whole file.  Files go to ``path``, a folder that
all executors share.

Null and empty texts give the end id alone.  Null doc_ids come first.
Repeated rows are separate documents; rows that share a doc_id are ordered
by a hash of the text.  No rows: no files, an empty index.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

INDEX = "doc_id long, shard int, at long, n_tokens long"

#: Words that the library encodes at once, and bytes of their text.
JOINED = 1 << 16
#: White space that is not a space or a line feed.
OTHER_SPACE = re.compile(r"[^\S \n]")


def irregular(text: str) -> bool:
    """Whether words of a text may not be encoded one by one: white space that
    is not one space or one line feed between words, or what may begin a
    special token."""
    if "  " in text or " \n" in text or "\n\n" in text or "<|" in text or text.endswith("\n "):
        return True
    if text.isascii():  # the rest of ASCII white space
        return not text.isprintable() and OTHER_SPACE.search(text) is not None
    return OTHER_SPACE.search(text) is not None


def by_words(path: str) -> bool:
    """Whether a tokenizer file splits at single spaces and line feeds, keeps
    bytes as they are, and gives a word the same ids in every text: a
    byte-level BPE with the usual pattern, no prefix space, no normaliser and
    no dropout, and added tokens that begin with ``<|``."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    return (spec.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("add_prefix_space") is False and pre.get("use_regex", True)
            and model.get("type") == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
            and all(t["content"].startswith("<|") for t in spec.get("added_tokens") or []))


class Encoder:
    """Encodes texts with the tokenizers library.

    A byte-level BPE (:func:`by_words`) never joins a non-space character with
    a space after it, so the ids of a regular text are those of its words,
    each with the space or line feed before it.  The library encodes new
    words, many in one text; where a word ends among the ids is known from
    the tokens' bytes.  Ids of known words are kept, at most ``keep`` of them
    in each of two generations.  Irregular texts, and all texts of other
    tokenizers, go to the library whole.
    """

    def __init__(self, path: str, end_id: int, keep: int = 700_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = max(self.tokenizer.get_vocab_size(), end_id + 1)
        self.kind = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
        self.end = np.array([end_id], self.kind).tobytes()
        self.keep, self.young, self.old = keep, {}, {}
        self.by_words = by_words(path)
        self.bytes = np.zeros(size, np.int64)
        if self.by_words:  # a token has one character for each of its bytes
            for token, i in self.tokenizer.get_vocab().items():
                self.bytes[i] = len(token)

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of many words, each with its line feed or a space before it."""
        out: list[bytes] = []
        for a in range(0, len(words), JOINED):
            some = words[a:a + JOINED]
            text = (" " + " ".join(some)).replace(" \n", "\n")
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)
            done = np.cumsum(self.bytes[ids])
            raw = np.frombuffer(text.encode(), np.uint8)
            ends = np.append(np.flatnonzero((raw == 32) | (raw == 10))[1:], len(raw))  # a word ends where the next begins
            cut = np.searchsorted(done, ends)
            if len(ends) != len(some) or len(ids) != cut[-1] + 1 or not np.array_equal(done[cut], ends):
                out += self._encode([w if w[0] == "\n" else " " + w for w in some])  # a token over the end of a word
                continue
            flat, step = ids.tobytes(), self.kind.itemsize
            place = [0, *((cut + 1) * step).tolist()]
            out += [flat[x:y] for x, y in zip(place, place[1:])]
        return out

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """All of words, none of them young; a word begins with its line feed or else follows a space."""
        again = words & self.old.keys()
        self.young.update(zip(again, map(self.old.__getitem__, again)))
        bare = [w for w in ("", "\n") if w in words and w not in again]  # nothing but the white space itself
        new = list(words - again - {"", "\n"})
        self.young.update(zip(bare, self._encode([w or " " for w in bare])))
        self.young.update(zip(new, self._encode_words(new)))
        return self.young

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text with the end id, as little-endian bytes."""
        out: list = [None] * len(texts)
        split, whole, new = [], [], set()
        for k, t in enumerate(texts):
            if not t:
                out[k] = self.end
            elif not self.by_words or irregular(t):
                whole.append((k, t))
            else:
                first, *rest = t.replace("\n", " \n").split(" ")
                parts = list(map(self.young.get, rest))  # one look at each word
                missing = [i for i, p in enumerate(parts) if p is None] if None in parts else []
                words = [rest[i] for i in missing]
                new.update(words)
                split.append((k, first, parts, missing, words))
        young = self._learn(new)
        for (k, _, parts, missing, words), head in zip(split, self._encode([s[1] for s in split])):
            for i, w in zip(missing, words):
                parts[i] = young[w]
            out[k] = b"".join([head, *parts, self.end])
        for (k, _), ids in zip(whole, self._encode([t for _, t in whole])):
            out[k] = ids + self.end
        if len(self.young) > self.keep:
            self.old, self.young = self.young, {}
        return out


_encoders: dict = {}


def encoder(path: str, end_id: int) -> Encoder:
    """One for each worker process; its known words serve later tasks too,
    until the worker reads files (:func:`_crc`)."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = Encoder(path, end_id)
    return _encoders[path, end_id]


class SequenceWriter:
    """Cuts a stream of ids into rows of one length and writes them in batches."""

    def __init__(self, sink, kind: np.dtype, length: int, rows: int):
        self.kind, self.length, self.rows = kind, length, rows
        item = pa.uint16() if kind.itemsize == 2 else pa.uint32()
        self.ids, self.mask, self.ends = pa.list_(item, length), pa.list_(pa.bool_(), length), pa.list_(pa.int32())
        self.schema = pa.schema([("ids", self.ids), ("mask", self.mask), ("ends", self.ends)])
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.parts, self.held, self.total, self.written, self.last = [], 0, 0, 0, []

    def add(self, ids: bytes) -> None:
        self.parts.append(ids)
        self.held += len(ids)
        self.total += len(ids) // self.kind.itemsize
        self.last.append(self.total - 1)
        size = self.length * self.rows * self.kind.itemsize
        if self.held >= size:
            data = b"".join(self.parts)
            whole = len(data) // size * size
            for a in range(0, whole, size):
                self._batch(np.frombuffer(data, self.kind, self.length * self.rows, a))
            self.parts, self.held = [data[whole:]], len(data) - whole

    def _batch(self, flat: np.ndarray) -> None:
        n = -(-len(flat) // self.length)
        real = len(flat)
        if n * self.length != real:
            flat = np.concatenate([flat, np.zeros(n * self.length - real, self.kind)])
        mask = np.arange(n * self.length) < real
        arrays = [pa.FixedSizeListArray.from_arrays(pa.array(x), type=t) for x, t in ((flat, self.ids), (mask, self.mask))]
        # places in each row at which a document ends
        last = np.array(self.last, np.int64) - self.written
        now = last < real
        self.last = (last[~now] + self.written).tolist()
        self.written += real
        offsets = np.searchsorted(last[now], np.arange(n + 1) * self.length).astype(np.int32)
        ends = pa.ListArray.from_arrays(pa.array(offsets), pa.array((last[now] % self.length).astype(np.int32)))
        self.writer.write_batch(pa.RecordBatch.from_arrays([*arrays, ends], schema=self.schema))

    def close(self) -> None:
        if self.held:
            self._batch(np.frombuffer(b"".join(self.parts), self.kind))
        self.writer.close()


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"\w+:", path) else (fs.LocalFileSystem(), path)


def _writer(path: str, tokenizer: str, end_id: int, length: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, out, sink = TaskContext.get().partitionId(), None, None
        system, folder = _file_system(path)
        own, final = f"{folder}/.{shard:06d}-{uuid.uuid4().hex}", f"{folder}/{shard:06d}.arrow"
        enc = encoder(tokenizer, end_id)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if out is None:
                system.create_dir(folder, recursive=True)
                sink = system.open_output_stream(own)
                out = SequenceWriter(sink, enc.kind, length, rows)
            at, n = [], []
            for ids in enc.encode(batch.column("text").to_pylist()):
                at.append(out.total)
                out.add(ids)
                n.append(out.total - at[-1])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([shard] * len(n), pa.int32()), pa.array(at, pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "shard", "at", "n_tokens"])
        if out is not None:
            out.close()
            sink.close()
            system.move(own, final)

    return run


def write_sequences(docs: DataFrame, path: str, tokenizer: str, end_id: int, length: int = 2048, rows: int = 64,
                    doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode ``docs``, write files and index under ``path``; returns the index
    (doc_id, shard, at, n_tokens), one row per document."""
    key = [F.col("doc_id"), F.xxhash64("text"), F.monotonically_increasing_id()]
    part = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = part.select("doc_id", "text", *[k.alias(f"k{i}") for i, k in enumerate(key[1:])])
    order = ["doc_id", "k0", "k1"]
    part = part.repartitionByRange(n, *order).sortWithinPartitions(*order).select("doc_id", "text")
    part.mapInArrow(_writer(f"{path}/sequences", tokenizer, end_id, length, rows), INDEX).write.mode("overwrite").parquet(f"{path}/index")
    return docs.sparkSession.read.schema(INDEX).parquet(f"{path}/index")


def manifest(index: DataFrame) -> DataFrame:
    """Per file: ids in it and ids in all files before it (one row per file)."""
    files = index.groupBy("shard").agg(F.sum("n_tokens").alias("shard_tokens"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("shard_start", F.coalesce(F.sum("shard_tokens").over(before), F.lit(0)))


class SequenceFile:
    """Random access to one file; rows and their masks are views of the file."""

    def __init__(self, path: str):
        system, name = _file_system(path)
        from pyarrow import fs

        self.source = pa.memory_map(name) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(name)
        self.reader = pa.ipc.open_file(self.source)
        self.length = self.reader.schema.field("ids").type.list_size
        self.rows = len(self.reader.get_batch(0)) if self.reader.num_record_batches else 0
        self.batches: dict = {}
        self.last: np.ndarray | None = None

    def _flat(self, k: int) -> np.ndarray:
        if k not in self.batches:
            if len(self.batches) >= 8:
                self.batches.pop(next(iter(self.batches)))
            self.batches[k] = self.reader.get_batch(k).column("ids").flatten().to_numpy(zero_copy_only=True)
        return self.batches[k]

    def row(self, i: int) -> tuple[np.ndarray, pa.BooleanArray]:
        """Ids and mask of sequence i."""
        k, j = divmod(i, self.rows)
        batch = self.reader.get_batch(k)
        return self._flat(k)[j * self.length:(j + 1) * self.length], batch.column("mask").flatten().slice(j * self.length, self.length)

    def ids(self, at: int, n: int) -> np.ndarray:
        """n ids from position ``at`` of the file's stream."""
        size = self.rows * self.length
        parts = [self._flat(k)[max(0, at - k * size):at + n - k * size] for k in range(at // size, (at + n - 1) // size + 1)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def ends(self) -> np.ndarray:
        """Positions of the documents' last ids in the file's stream, in order."""
        if self.last is None:
            found = [np.zeros(0, np.int64)]
            for k in range(self.reader.num_record_batches):
                col = self.reader.get_batch(k).column("ends")
                row = np.repeat(np.arange(len(col)), np.diff(np.asarray(col.offsets)))
                found.append((k * self.rows + row) * self.length + np.asarray(col.flatten()))
            self.last = np.concatenate(found)
        return self.last

    def close(self) -> None:
        self.batches = {}
        self.source.close()


def _crc(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _encoders.clear()  # the files are written: later stages get the memory of the known words
        opened, file = None, None
        for batch in batches:
            out, sizes = [], []
            for shard, at in zip(*(batch.column(c).to_pylist() for c in ("shard", "at"))):
                if shard != opened:
                    if file:
                        file.close()
                    opened, file = shard, SequenceFile(f"{path}/sequences/{shard:06d}.arrow")
                ends = file.ends()
                n = int(ends[np.searchsorted(ends, at)]) + 1 - at  # up to the end of the document that begins there
                sizes.append(n)
                out.append(zlib.crc32(file.ids(at, n).astype("<u4", copy=False).tobytes()))
            batch = batch.set_column(batch.schema.get_field_index("n_tokens"), "n_tokens", pa.array(sizes, pa.int64()))
            yield batch.append_column("ids_crc32", pa.array(out, pa.int64()))
        if file:
            file.close()

    return run


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32, shard."""
    index = spark.read.schema(INDEX).parquet(f"{path}/index")
    read = index.mapInArrow(_crc(path), INDEX + ", ids_crc32 long")
    return read.join(manifest(index), "shard").select("doc_id", (F.col("shard_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", "shard")
