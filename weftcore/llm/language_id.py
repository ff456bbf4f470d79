"""Language identification with language-bitmask n-gram filters.

Training counts the character n-grams of every language over all training
texts and keeps, per language, those with at least ``least`` of the
language's n-gram occurrences (so at most ``1 / least`` of them).  All
languages share one bit-sliced Bloom filter: position ``p`` holds a word
whose bit ``l`` belongs to language ``l``; an n-gram sets its languages' bits
at ``hashes`` positions, and the AND of those words at lookup gives the mask
of all languages that hold the n-gram at once.

A text's languages are scored by popcounts: the share of its n-gram
occurrences whose mask has the language's bit, corrected for the false
positives of that language's slice (fill ** hashes).  The best share wins;
``score`` is its part of the sum of all shares.

N-grams are runs of ``n`` letters, lower-cased, with one space at either end
of a word.  Text null or without a letter: ``und``, score 0.  Training rows
with null text or language are not learned from; with none, every text is
``und``.  Equal shares: the language first in code point order.  Rows are
judged one by one, so repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftcore.llm.common import prepare
from weftcore.llm.textgrams import mix64

CHUNK = 1 << 15  # characters at once: arrays small enough to be reused, not mapped anew


@cache
def letter_table() -> np.ndarray:
    """Whether a code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(texts: list[str | None], sizes: tuple[int, ...]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, text of each n-gram, n-gram hash), by chunks of texts."""
    a = 0
    while a < len(texts):
        b, size = a, 0
        while b < len(texts) and (b == a or size + len(texts[b] or "") < CHUNK):
            size += len(texts[b] or "")
            b += 1
        parts = [np.frombuffer((t or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts[a:b]]
        gap = np.full(max(sizes), 0x20, np.uint32)
        code = np.concatenate([x for p in parts for x in (gap, p)] + [gap])
        owner = np.repeat(np.arange(b - a), [len(p) + len(gap) for p in parts])
        owner = np.concatenate([owner, np.full(len(gap), b - a - 1)])
        letter = letter_table()[code]
        sign = np.where(letter, code.astype(np.uint64), np.uint64(0x20))
        run = np.concatenate([[0], np.cumsum(~letter)])
        texts_of, hashes = [], []
        for n in sizes:
            m = len(code) - n + 1
            # at most the two ends are no letters, and one letter is inside
            inner = run[n - 1:n - 1 + m] - run[1:1 + m] == 0 if n > 2 else np.ones(m, bool)
            ok = inner & (run[n:n + m] - run[:m] < n)
            if n == 2:
                ok &= letter[:m] | letter[1:]
            at = np.flatnonzero(ok)
            h = np.full(len(at), n, np.uint64)
            for j in range(n):
                h = h * np.uint64(0x100000001B3) + sign[at + j]
            hashes.append(mix64(h))
            texts_of.append(owner[at])
        yield a, b, np.concatenate(texts_of), np.concatenate(hashes)
        a = b


def has_letter(t: str | None) -> bool:
    return bool(t) and any(map(str.isalpha, t))


class BitSliced:
    """Bloom filters of many languages in one array of bitmask words."""

    def __init__(self, languages: list[str], words: np.ndarray, hashes: int):
        self.languages, self.words, self.hashes = languages, words, hashes
        self.width = words.shape[1]
        bits = np.unpackbits(words.view(np.uint8).reshape(len(words), -1), axis=1, bitorder="little")[:, :len(languages)]
        self.false = bits.mean(0) ** hashes

    @staticmethod
    def places(h: np.ndarray, hashes: int, size: int) -> np.ndarray:
        """Positions of each n-gram, by double hashing."""
        step = mix64(h) | np.uint64(1)
        return ((h[None, :] + np.arange(hashes, dtype=np.uint64)[:, None] * step) & np.uint64(size - 1)).astype(np.int64)

    def masks(self, h: np.ndarray) -> np.ndarray:
        out = None
        for p in self.places(h, self.hashes, len(self.words)):
            out = self.words[p] if out is None else out & self.words[p]
        return out

    def shares(self, owner: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
        """Per text and language: n-grams held, corrected for false positives."""
        masks, total = self.masks(h), np.maximum(1, np.bincount(owner, minlength=n))
        out = np.empty((n, len(self.languages)))
        for l in range(len(self.languages)):
            held = (masks[:, l // 64] >> np.uint64(l % 64)) & np.uint64(1)
            out[:, l] = np.bincount(owner, held, minlength=n) / total
        return np.clip((out - self.false) / (1 - np.minimum(self.false, 0.999999)), 0, 1)


def _count(sizes: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}

        def flush(lang: str) -> pa.RecordBatch:
            h, at = np.unique(np.concatenate([x for x, _ in held[lang]]), return_inverse=True)
            n = np.bincount(at, np.concatenate([x for _, x in held[lang]])).astype(np.int64)
            held[lang] = [(h, n)]
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(h)), pa.array(h.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])

        for batch in batches:
            lang, text = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
            for l in sorted(set(lang)):
                for _, _, _, h in grams([t for t, x in zip(text, lang) if x == l], sizes):
                    held.setdefault(l, []).append(np.unique(h, return_counts=True))
                if sum(len(x) for x, _ in held.get(l, [])) > 1 << 21:
                    out = flush(l)
                    if out.num_rows > 1 << 20:  # else only merged, to be counted on
                        yield out
                        held[l] = []
        for l in list(held):
            if held[l]:
                yield flush(l)

    return run


def learn(training: DataFrame, text: str = "text", lang: str = "lang", sizes: tuple[int, ...] = (2, 3, 4),
          least: float = 2e-5, bits: int = 20, hashes: int = 4) -> BitSliced | None:
    """The filter from the rows of ``training`` with text and language.

    The filter has ``2 ** bits`` words of 64 languages: a broadcast of fixed
    size for a given number of languages."""
    prepare(training.sparkSession)
    rows = training.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("text is not null and lang is not null")
    counted = rows.mapInArrow(_count(sizes), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    from weftcore.llm.common import materialize

    counted = materialize(counted, "grams")
    total = counted.groupBy("lang").agg(F.sum("n").alias("total"))
    sums = {r["lang"]: r["total"] for r in total.collect()}  # one row per language
    languages = sorted(sums)
    if not languages:
        return None
    width = -(-len(languages) // 64)
    words = np.zeros((1 << bits, width), np.uint64)
    for l, name in enumerate(languages):  # at most 1 / least n-grams a language
        kept = counted.where((F.col("lang") == name) & (F.col("n") >= F.lit(least * sums[name]))).select("gram").toPandas()
        h = kept["gram"].to_numpy(np.int64).view(np.uint64)
        for p in BitSliced.places(h, hashes, 1 << bits):
            words[p, l // 64] |= np.uint64(1 << (l % 64))
    return BitSliced(languages, words, hashes)


def _predict(shared, sizes: tuple[int, ...], name: str, schema: pa.Schema | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(name)).to_pylist()
            pred, score = ["und"] * len(texts), np.zeros(len(texts))
            for a, b, owner, h in grams(texts, sizes) if model else ():
                share = model.shares(owner, h, b - a)
                best, total = share.argmax(1), share.sum(1)
                for k in range(a, b):
                    if has_letter(texts[k]):
                        pred[k] = model.languages[best[k - a]]
                        score[k] = share[k - a, best[k - a]] / total[k - a] if total[k - a] > 0 else 0.0
            yield batch.append_column("lang_pred", pa.array(pred)).append_column("score", pa.array(score))

    return run


def predict(docs: DataFrame, model: BitSliced | None, text: str = "text", sizes: tuple[int, ...] = (2, 3, 4)) -> DataFrame:
    """``docs`` with lang_pred and score (columns of those names are replaced)."""
    prepare(docs.sparkSession)
    current = docs.drop("lang_pred", "score")
    schema = T.StructType([*current.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return current.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model), sizes, text), schema)


def held_out(doc_id: Column, folds: int = 4, fold: int = 2) -> Column:
    """Whether crc32 of the id as text falls into the held-out fold (null id: of the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == fold
