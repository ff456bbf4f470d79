"""Quality by importance resampling: hashed n-gram models and Gumbel top-k.

Two bag-of-n-gram models over ``buckets`` hashed buckets are counted: the
target model on documents labelled as good, the raw model on all documents.
The importance weight of a document is the log ratio of its probability
under the two.  The sample is the ``k`` documents with the largest
``weight + Gumbel noise``, which draws without replacement in proportion to
the weights.

Features are runs of word bytes (case kept) and runs of punctuation, and
their bigrams; a bigram of equal tokens counts as one common "repeat"
feature.  A document's two log probabilities are sums over its features.

Only the choice of labelled rows is bounded (``max_labels`` ids by hash
order, broadcast); counts, weights and the k-th key cover all documents.
``k`` comes from the labels: the share of documents whose weight lies above
the cut that best separates good labels from bad ones by the share of each
that it gets wrong (no bad labels, or weights that do not separate them: all
are kept; no good ones: every weight is 0 and all are kept).  A label on an
id of several rows is judged by their mean weight.

Null and empty texts have no features and weight 0.  Repeated rows get the
same weight and noise; rows tied with the k-th key all stay.  Labels with a
null id or quality say nothing; a document counts once however often its
label is repeated, and as bad if its labels disagree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftcore.llm.common import materialize, prepare
from weftcore.llm.textgrams import Tokens, batch_tokens, mark_tables, mix64

REPEAT = np.uint64(0x5EED)


def features(tok: Tokens, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of every unigram and bigram."""
    one = tok.hash % np.uint64(buckets)
    inside = np.flatnonzero(tok.text[:-1] == tok.text[1:]) if len(tok.hash) else np.zeros(0, np.int64)
    a, b = tok.hash[inside], tok.hash[inside + 1]
    two = np.where(a == b, REPEAT, mix64(a * np.uint64(0x9E3779B97F4A7C15) + b)) % np.uint64(buckets)
    return np.concatenate([one, two]).astype(np.int64), np.concatenate([tok.text, tok.text[inside]])


def _count(good, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, raw, target = good.value, np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            mine = np.array([x in ids for x in batch.column("id").to_pylist()], bool)
            for a, b, _, tok in batch_tokens(batch.column("text"), mark_tables()):
                bucket, text = features(tok, buckets)
                raw += np.bincount(bucket, minlength=buckets)
                if mine[a:b].any():
                    target += np.bincount(bucket[mine[a:b][text]], minlength=buckets)
        used = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(raw[used]), pa.array(target[used])], names=["bucket", "raw", "target"])

    return run


def _weigh(ratio, name: str, out: str, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = ratio.value
        for batch in batches:
            col, w = batch.column(batch.schema.get_field_index(name)), [np.zeros(0)]
            for a, b, _, tok in batch_tokens(col, mark_tables()):
                bucket, text = features(tok, len(gain))
                w.append(np.bincount(text, gain[bucket], minlength=b - a))
            if not keep:  # texts do not travel back
                batch = batch.select([f for f in batch.schema.names if f != name])
            yield batch.append_column(out, pa.array(np.concatenate(w).round(9) + 0.0, pa.float64()))

    return run


def log_ratio(docs: DataFrame, good: list, doc_id: str, text: str, buckets: int, smooth: float) -> np.ndarray:
    """log p_target - log p_raw of each bucket."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(frozenset(good))
    counted = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).mapInArrow(_count(shared, buckets), "bucket long, raw long, target long")
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for b, r, t in counted.groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect():  # at most `buckets` rows
        raw[b], target[b] = r, t
    if not target.any():
        return np.zeros(buckets)
    # the target is smoothed towards the raw model, so unseen buckets of a small target cost a bounded amount
    p = (raw + smooth) / (raw + smooth).sum()
    q = (target + smooth * buckets * p) / (target.sum() + smooth * buckets)
    return np.log(q) - np.log(p)


def best_cut(good: np.ndarray, bad: np.ndarray) -> float:
    """The middle of the cut between weights with the least share of good
    labels below it plus share of bad ones above it (ties: the lowest).  A cut
    keeps at least one good label; no cut at all (-inf) keeps every label and
    errs by 1, so weights that do not separate the labels cut nothing."""
    if not len(bad) or not len(good):
        return -math.inf
    value = np.concatenate([good, bad])
    kind = np.concatenate([np.ones(len(good)), np.zeros(len(bad))])
    order = np.argsort(value, kind="stable")
    value, kind = value[order], kind[order]
    # cutting before place i loses the good ones below it and keeps the bad ones from it
    lost = np.concatenate([[0], np.cumsum(kind)])
    loss = lost / len(good) + 1 - np.concatenate([[0], np.cumsum(1 - kind)]) / len(bad)
    loss[1:-1][value[1:] == value[:-1]] = np.inf
    loss[lost == len(good)] = np.inf
    i = int(np.argmin(loss.round(12)))
    return -math.inf if i == 0 else float((value[i - 1] + value[i]) / 2)


def kth_largest(keys: DataFrame, key: str, k: int, bins: int = 1024, small: int = 4096) -> float:
    """The k-th largest value, by counting in bins and narrowing to one bin."""
    lo, hi, n = keys.agg(F.min(key), F.max(key), F.count(key)).first()
    if k >= n:
        return -math.inf
    if k <= 0:
        return math.inf
    above = 0
    col = F.col(key)
    while True:
        inside = keys.where((col >= lo) & (col <= hi))
        width = (hi - lo) / bins
        if width <= 0 or lo + width <= lo:
            return lo if width <= 0 else float(inside.orderBy(F.desc(key)).limit(max(1, k - above)).agg(F.min(key)).first()[0])
        binned = inside.groupBy(F.least(F.lit(bins - 1), F.floor((col - lo) / width)).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi"))
        for b, m, x, y in sorted(binned.collect(), reverse=True):  # at most `bins` rows
            if above + m >= k:
                lo, hi = x, y
                break
            above += m
        if lo == hi:
            return lo
        if m <= small:
            values = sorted((r[0] for r in keys.where((col >= lo) & (col <= hi)).select(key).collect()), reverse=True)  # at most `small`
            return values[k - above - 1]


def _noise(doc_id: str, text: str, seed: int):
    """Gumbel noise from a hash of id and text: the same in every run and for repeated rows."""
    unit = (F.pmod(F.xxhash64(F.lit(seed), F.col(doc_id), F.col(text)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(unit))


def draw(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", quality: str = "quality",
         buckets: int = 10_000, smooth: float = 1.0, max_labels: int = 100_000, seed: int = 17, k: int | None = None) -> tuple[DataFrame, float, np.ndarray]:
    """(id, w, key) of every row, the k-th largest key, and the log ratio of each bucket."""
    spark = docs.sparkSession
    prepare(spark)
    kind = docs.schema[doc_id].dataType.simpleString()
    good = F.col(quality).cast("double") > 0
    judged = labels.select(F.col(doc_id).cast(kind).alias("id"), good.cast("int").alias("q")).where("id is not null and q is not null")
    judged = judged.groupBy("id").agg(F.min("q").alias("q")).orderBy(F.xxhash64("id"), "id").limit(max_labels).collect()
    judged = [tuple(r) for r in judged]
    gain = log_ratio(docs, [i for i, q in judged if q > 0], doc_id, text, buckets, smooth)
    part = docs.select(F.col(doc_id).alias("id"), _noise(doc_id, text, seed).alias("noise"), F.col(text).alias("text"))
    weighed = part.mapInArrow(_weigh(spark.sparkContext.broadcast(gain), "text", "w", False), f"id {kind}, noise double, w double")
    small = materialize(weighed.select("id", "w", (F.col("w") + F.col("noise")).alias("key")), "weights")
    if k is None:
        known = spark.createDataFrame(judged, f"id {kind}, q int")  # at most max_labels rows
        seen = small.join(F.broadcast(known), "id").groupBy("id", "q").agg(F.avg("w").alias("w")).collect()  # a row per label
        cut = best_cut(np.array([r["w"] for r in seen if r["q"] > 0]), np.array([r["w"] for r in seen if r["q"] <= 0]))
        k = small.where(F.col("w") >= cut).count() if math.isfinite(cut) else small.count()
    return small, kth_largest(small, "key", k), gain


def sample_table(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", **more) -> DataFrame:
    """Per row: the id, log_weight, sample_key, sampled."""
    small, least, _ = draw(docs, labels, doc_id=doc_id, **more)
    return small.select(F.col("id").alias(doc_id), F.col("w").alias("log_weight"), F.col("key").alias("sample_key"), (F.col("key") >= F.lit(least)).alias("sampled"))


def resample(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 17,
             names: tuple[str, str, str] = ("log_weight", "sample_key", "sampled"), **more) -> DataFrame:
    """``docs`` with the log weight, the Gumbel key and whether the row is sampled."""
    _, least, gain = draw(docs, labels, doc_id=doc_id, text=text, seed=seed, **more)
    weight, key, chosen = names
    noise = "_noise"
    while noise in docs.columns:
        noise += "_"
    current = docs.drop(*names).withColumn(noise, _noise(doc_id, text, seed))
    schema = T.StructType([*current.schema.fields, T.StructField(weight, T.DoubleType())])
    weighed = current.mapInArrow(_weigh(docs.sparkSession.sparkContext.broadcast(gain), text, weight, True), schema)
    weighed = weighed.withColumn(key, F.col(weight) + F.col(noise)).drop(noise)
    return weighed.withColumn(chosen, F.col(key) >= F.lit(least))


def keep_sampled(docs: DataFrame, labels: DataFrame, **more) -> DataFrame:
    """The sampled documents, with the columns of ``docs``."""
    names = ["_weight", "_key", "_sampled"]
    while set(names) & set(docs.columns):
        names = [n + "_" for n in names]
    return resample(docs, labels, names=tuple(names), **more).where(F.col(names[2])).drop(*names)
