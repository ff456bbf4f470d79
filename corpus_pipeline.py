"""A corpus pipeline: quality, near duplicates, benchmark passages, mixing, token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run``
writes each stage's rows as Parquet to the shared scratch folder and reads
them again as the next one's docs.  All stages but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftcore.llm import decontaminate, importance, mixing, ngram_join, queries
from weftcore.llm.common import materialize, prepare, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling towards good labels draws."""
    prepare(spark)
    return importance.keep_sampled(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of equal and similar texts."""
    prepare(spark)
    return ngram_join.keep_one_of_each(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of benchmark words."""
    prepare(spark)
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, each as often as the mix of sources takes it."""
    prepare(spark)
    return mixing.take_copies(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids in Arrow files, and per document its place and checksum."""
    prepare(spark)
    return queries.token_digests(spark, docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_passages),
    ("mixing to target weights", source_mix),
    ("token-ID output", token_ids),
]

#: Hash noise, MinHash and tokenizer have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
