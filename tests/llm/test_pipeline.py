"""The corpus pipeline, stage by stage, against plain-Python versions."""

from collections import Counter

import brute as B
import corpus_pipeline
from conftest import SF001
from weftcore.llm import queries
from weftcore.llm.common import materialize, table


def rows(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_stages(spark):
    docs = table(spark, SF001, "documents")
    columns, labels = docs.columns, {r.doc_id: (r.quality, r.toxic) for r in table(spark, SF001, "labels").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "mixing to target weights", "token-ID output"]
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, steps[-1], SF001), "step")
        if name != "token-ID output":
            assert out.columns == columns
        steps.append(out)
    start, good, one, clean, mixed = (rows(s) for s in steps[:5])
    assert set(good) <= set(start)
    kept = {i for i, _ in good}
    assert sum(q == 1 and i not in kept for i, (q, _) in labels.items()) <= 2 and sum(q == 0 and i in kept for i, (q, _) in labels.items()) <= 2
    assert sorted(i for i, _ in one) == sorted({c for _, c, _, _, _ in B.join(good)}) and set(one) <= set(good)
    items = [(r.item_id, r.text) for r in table(spark, SF001, "benchmark").collect()]
    hit = {r[0] for r in B.contamination(one, items) if r[5]}
    assert sorted(clean) == sorted(r for r in one if r[0] not in hit)
    source = {r.doc_id: r.source for r in docs.collect()}
    want = Counter()
    for i, z, _, _, t in B.mix([(i, source[i], x) for i, x in clean]):
        want[i] += t // z if z else 0
    got = Counter(i for i, x in mixed if B.mix_size(x))
    assert got == +want
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(queries.tokenizer_path())
    tokens = sorted((r.start, r.n_tokens, r.doc_id, r.ids_crc32) for r in steps[5].collect())
    assert [(i, a, n, c) for a, n, i, c in tokens] == B.tokens(sorted(mixed), plain, queries.END_ID)
    whole = corpus_pipeline.run(spark, SF001).select(*steps[5].columns)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, steps[5].collect()))
    assert corpus_pipeline.ORACLE_SQL is None


def test_hard_documents(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows and clashing extra columns go through every stage."""
    long = " ".join(f"w{k % 977} and so on" for k in range(20_000))
    plain = [(r.doc_id, r.text) for r in table(spark, SF001, "documents").limit(20).collect()]
    texts = plain + [(None, plain[0][1]), (None, None), (900, None), (901, ""), (902, " \n "), (903, long), (904, long + " end"), (905, plain[1][1]), (905, plain[1][1]), (905, "other text of that id"), (906, "é 中文 <|endoftext|> x")]
    cols = "doc_id long, text string, lang string, source string, n_chars long, digest string, row string, size string, key string, w string, copies string, shard string, group string, node string"
    rows_ = [(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else f"s{k % 3}", None if k % 5 == 0 else 3, *["x"] * 9) for k, (i, t) in enumerate(texts)]
    docs = spark.createDataFrame(rows_, cols)
    for name, stage in corpus_pipeline.STAGES:
        before, out = docs, materialize(stage(spark, docs, SF001), "hard")
        if name == "token-ID output":
            assert out.count() == before.count() and out.where("doc_id is null").count() == before.where("doc_id is null").count()
        else:
            assert out.columns == docs.columns
            assert {r.text for r in out.collect()} <= {r.text for r in before.collect()}
        docs = out
    assert docs.where("n_tokens < 1").count() == 0


def test_empty_documents(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        table(spark, SF001, t).limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
