"""Registered queries over the given tables, and the DuckDB SQL of those that SQL can state."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftcore.llm import (decontaminate, importance, language_id, line_dedup, mixing, ngram_join, periodic_runs, pii, sharding, simhash_dedup,
                          token_output, vafile, whitening)
from weftcore.llm.common import prepare, scratch_path, table

END_ID = 2


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as ids in Arrow files of equal-length sequences, read back: start, number and checksum of its ids."""
    return token_digests(spark, table(spark, sf_dir, "documents"))


def token_digests(spark: SparkSession, docs: DataFrame) -> DataFrame:
    path = scratch_path(spark, "tokens")
    token_output.write_sequences(docs, path, tokenizer_path(), END_ID)
    return token_output.read_digests(spark, path)


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every text: exact patterns, and spans that weakly supervised training adds."""
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op3_bounded_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents on a consistent-hash ring of 8 shards with loads at most one apart."""
    found = sharding.shard(table(spark, sf_dir, "documents"), shards=8, vnodes=64, slack=0.0)
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_va_file_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 highest integer inner products of each vector whose id is divisible by 50."""
    return vafile.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines that each document keeps when equal lines and lines at most two edits apart keep their earliest."""
    return line_dedup.line_report(table(spark, sf_dir, "documents"), edits=2)


def op6_language_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, learned on three of four folds of the ids."""
    docs = table(spark, sf_dir, "documents")
    out = language_id.held_out(F.col("doc_id"))
    model = language_id.learn(docs.where(~out))
    return language_id.predict(docs.select("doc_id", out.alias("held_out"), "text"), model).drop("text")


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and number of links of every document: five-word shingles, Jaccard 0.8 or more."""
    return ngram_join.similarity_join(table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside benchmark windows of ten words, and the items found."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark"), out="c")
    return found.select(
        "doc_id", F.col("c.n_words").alias("n_words"), F.col("c.n_hit").alias("n_hit"), F.size("c.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("c.items", ","), 256).alias("items_sha256"), (F.col("c.n_hit") > 0).alias("contaminated"))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op10_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance weight and Gumbel key of every document, and whether it is sampled."""
    return importance.sample_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding on the 32 whitened components of all embeddings' covariance."""
    return whitening.whiten(table(spark, sf_dir, "embeddings"), components=32)


def planted_period(doc_id: int | None, words: list) -> list:
    """A document whose id's crc32 is divisible by 10 repeats some of its words to its end; a null id changes nothing."""
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    n = len(words)
    if h is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    part = words[a:a + p]
    return words[:a] + (part * ((n - a) // len(part) + 1))[:n - a]


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of four or more periods in the words of every document, and the text without their repeats."""
    return periodic_runs.run_digests(periodic_runs.find_runs(table(spark, sf_dir, "documents"), planted_period, shortest=6, power=4))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document: three-word shingles, two bits or fewer apart."""
    return simhash_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=3)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of corpus_pipeline.py on documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_token_sequences, op2_personal_data, op3_bounded_ring, op4_va_file_search, op5_line_dedup, op6_language_filters,
    op7_ngram_join, op8_decontaminate, op9_source_mix, op10_importance, op11_whitening, op12_periodic_runs, op13_simhash, pipeline)}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _words_sql(text: str) -> str:
    return f"regexp_extract_all(translate(coalesce({text}, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


ORACLES: dict[str, str] = {
    "op4_va_file_search": """
WITH v AS (SELECT vec_id, UNNEST(range(len(embedding))) AS j, floor(256 * CAST(UNNEST(embedding) AS DOUBLE)) AS x FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
      FROM v q JOIN v c ON q.j = c.j AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY q.vec_id, c.vec_id),
r AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5""",

    "op8_decontaminate": f"""
WITH d AS (SELECT doc_id, {_words_sql('text')} AS w FROM documents),
b AS (SELECT item_id, {_words_sql('text')} AS w FROM benchmark),
n AS (SELECT item_id, w, least(10, len(w)) AS k FROM b WHERE len(w) > 0),
ni AS (SELECT item_id, w, k, UNNEST(range(1, len(w) - k + 2)) AS i FROM n),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM ni),
ks AS (SELECT DISTINCT k FROM n),
di AS (SELECT doc_id, w, k, UNNEST(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k),
dw AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM di),
hit AS (SELECT dw.doc_id, dw.i, dw.k, win.item_id FROM dw JOIN win ON dw.k = win.k AND dw.g = win.g),
place AS (SELECT DISTINCT doc_id, i, k FROM hit),
p AS (SELECT doc_id, UNNEST(range(i, i + k)) AS p FROM place),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM p GROUP BY doc_id),
ids AS (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM ids GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(it.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(it.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id""",

    "op9_source_mix": """
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
                  md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS tag FROM documents),
s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM s),
c AS (SELECT source, CAST(source_size AS BIGINT) AS source_size, CASE n % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight,
             CAST(2 * source_size AS DOUBLE) AS cap, 1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) AS goal FROM w),
l AS (SELECT cap / weight AS ratio,
             (goal - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM c),
f AS (SELECT min(ratio) AS ratio FROM l WHERE level <= ratio),
g AS (SELECT min(l.level) AS level FROM l, f WHERE l.ratio = f.ratio),
t AS (SELECT c.source, c.source_size, least(c.cap, c.weight * g.level) AS target FROM c, g),
r AS (SELECT doc_id, source, size, CAST(row_number() OVER (PARTITION BY source ORDER BY size, tag, doc_id) - 1 AS DOUBLE) AS k,
             CAST(('0x' || substr(md5('11:' || coalesce('s' || source, 'null')), 1, 3))::BIGINT AS DOUBLE) / 4096 AS u FROM d),
x AS (SELECT r.doc_id, r.size, t.source_size, t.target, r.k, r.u, t.target / nullif(t.source_size, 0) AS rate
      FROM r JOIN t ON r.source IS NOT DISTINCT FROM t.source),
n AS (SELECT doc_id, size, source_size, target, CAST(least(coalesce(floor((k + 1) * rate + u) - floor(k * rate + u), 0), 2) AS BIGINT) AS copies FROM x)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM n""",
}
