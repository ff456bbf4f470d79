"""What a Python worker holds while it counts terms does not grow with the rows."""

import hashlib
from collections import Counter

from weftcore.functions import terms
from weftcore.plans import registered as reg


def bucket(token, buckets):
    return int.from_bytes(hashlib.md5(token.encode()).digest()[:4], "big") % buckets


def test_texts_are_counted_once_in_small_batches(spark, tmp_path):
    texts = [None, "", "  ", "a b a", "é  é x", "w" * 5000 + " w"] + [f"t{i} t{i % 7} u" for i in range(600)]
    rows = list(enumerate(texts)) + [(3, "a b a"), (None, "only")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    pts = reg.document_points(spark, str(tmp_path))
    # the filter on the counts must not send every text to a second worker
    plan = pts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 256
    got = Counter((r.pid, r.features["size"], tuple(r.features["indices"]), tuple(r.features["values"])) for r in pts.collect())
    want = Counter()
    for i, t in rows:
        counts = Counter(bucket(x, reg.TERM_BUCKETS) for x in (t or "").split(" ") if x)
        if counts:
            at = sorted(counts)
            want[i, reg.TERM_BUCKETS, tuple(at), tuple(float(counts[j]) for j in at)] += 1
    assert got == want


def test_kept_tokens_are_few_and_short(monkeypatch):
    monkeypatch.setattr(terms, "KEPT", 10)
    seen = terms._Buckets(97)
    for i in range(100):
        for token in (f"t{i}", "x" * 1000 + str(i), f"t{i}"):
            assert seen[token.encode()] == bucket(token, 97)
        assert len(seen) <= 10 and max(map(len, seen)) <= 64
