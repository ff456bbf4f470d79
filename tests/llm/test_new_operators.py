"""Whitening, periodic runs and SimHash near duplicates against plain-Python versions."""

import random
from collections import Counter

import numpy as np
import pytest
import xxhash

import brute_new as N
from conftest import SF001
from weftcore.llm import periodic_runs, queries, simhash_dedup, whitening
from weftcore.llm.common import join_counted, prepare, table


def test_join_counted_hot_and_rare_keys(spark):
    rows = spark.createDataFrame([(7, i) for i in range(300)] + [(i, i) for i in range(100, 140)] + [(-1, 0)], "k long, v long")
    facts = rows.where("k >= 0").groupBy("k").count().withColumnRenamed("count", "n")
    got = join_counted(rows, facts, ["k"], "n")
    assert Counter((r.k, r.v, r.n) for r in got.collect()) == Counter([(7, i, 300) for i in range(300)] + [(i, i, 1) for i in range(100, 140)])


# ------------------------------------------------------------ op11: whitening

VEC = "vec_id long, embedding array<float>, label int, x string, n long, h1 long, whitened string, component int"


def vectors(rows, spark):
    return spark.createDataFrame([(i, v, 0, "a", 5, 6, "b", 7) for i, v in rows], VEC)


def same_up_to_sign(got, rows, components=32, **more):
    n, want, share = N.whiten(rows, components, **more)
    k = len(share)
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.deviation), []).append(r)
        assert r.n == n and r.explained == pytest.approx(share[r.component - 1], rel=1e-4)
        assert r.identity_error <= 1e-4 or more
    assert len(got) == k * len(want)
    z = {}
    for i, d, w in want:
        z.setdefault((i, d), []).append(w)
    assert {a: len(x) // k for a, x in by.items()} == {a: len(x) for a, x in z.items()}
    mine = np.array([[sum(r.whitened for r in x if r.component == c + 1) / len(z[a]) for c in range(k)] for a, x in sorted(by.items(), key=repr)])
    theirs = np.array([np.mean(z[a], axis=0) for a, _ in sorted(by.items(), key=repr)])
    sign = np.sign((mine * theirs).sum(axis=0))
    np.testing.assert_allclose(mine * sign, theirs, atol=1e-6)


def test_whitening_of_hard_rows(spark):
    r = random.Random(2)
    d = 6
    rows = [(i, [r.gauss(0, 1 + k) for k in range(d)]) for i in range(60)]
    rows += [(100 + i, rows[0][1]) for i in range(200)]  # a hot vector
    rows += [(None, rows[1][1]), (None, None), (300, None), (301, [None] * d), (302, [float("nan")] * d), (303, [float("inf")] + [0.0] * (d - 1)), (5, rows[5][1]), (5, rows[6][1])]
    plain = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows]
    df = vectors(rows, spark)
    same_up_to_sign(whitening.whiten(df).collect(), plain)
    same_up_to_sign(whitening.whiten(df, components=2).collect(), plain, 2)
    same_up_to_sign(whitening.whiten(df, weights="one").collect(), plain, weights="one")
    ragged = vectors([*rows, (900, [1.0]), (901, [])], spark)
    same_up_to_sign(whitening.whiten(ragged).collect(), plain)
    with pytest.raises(ValueError):
        whitening.whiten(df, weights="some")


def test_whitening_without_variance(spark):
    for rows in ([], [(1, None)], [(1, [])], [(1, [1.0, 2.0])] * 3):
        got = whitening.whiten(vectors(rows, spark))
        assert got.count() == 0 and len(got.columns) == 7
    # a constant dimension and one that repeats another: one direction of variance
    rows = [(i, [float(i), 3.0, float(i)]) for i in range(10)]
    got = whitening.whiten(vectors(rows, spark)).collect()
    assert len(got) == 10 and {r.component for r in got} == {1} and got[0].explained == pytest.approx(1)


def test_deviation_beyond_a_long(spark):
    model = whitening.Whitening(10**9, np.array([0, 0]), np.eye(2), np.ones(2), 2.0)
    assert model.deviation(np.array([[5, 1], [0, 0]])) == [None, 0]
    assert model.deviation(np.array([[1, 1]])) == [2 * 10**18]


def test_op11_on_given_vectors(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in table(spark, SF001, "embeddings").collect()]
    same_up_to_sign(queries.op11_whitening(spark, SF001).collect(), rows)


# -------------------------------------------------------- op12: periodic runs

def random_words(r):
    kind = r.randrange(4)
    if kind == 0:
        return [r.choice("ab") for _ in range(r.randrange(80))]
    if kind == 1:
        return ["x"] * r.randrange(70)
    out = []
    for _ in range(r.randrange(1, 5)):
        part = [f"w{r.randrange(3 if kind == 2 else 400)}" for _ in range(r.randrange(1, 14))]
        out += part * r.randrange(1, 9)
        out += [f"w{r.randrange(400)}" for _ in range(r.randrange(6))]
    return out


def test_fragments_equal_all_periods():
    r = random.Random(9)
    for _ in range(60):
        texts = [random_words(r) for _ in range(r.randrange(1, 40))]
        for got, t in zip(periodic_runs.document_fragments(texts), texts):
            assert sorted((lo, hi - lo + q, q) for q, lo, hi in got) == sorted(N.runs(t))
        for got, t in zip(periodic_runs.document_fragments(texts, 3, 3), texts):
            assert sorted((lo, hi - lo + q, q) for q, lo, hi in got) == sorted(N.runs(t, 3, 3))


def test_long_periods_and_groups(monkeypatch):
    r = random.Random(3)
    part = [f"w{r.randrange(10**6)}" for _ in range(700)]
    texts = [["a"] * 5000, part * 5 + ["end"], ["b"] + part * 3, (["a", "b"] * 40 + ["c"]) * 6, part * 4, []]
    want = [sorted(N.runs(t)) for t in texts]
    for words in (periodic_runs.WORDS, 4000):  # in one group, and in several
        monkeypatch.setattr(periodic_runs, "WORDS", words)
        assert [sorted((lo, hi - lo + q, q) for q, lo, hi in got) for got in periodic_runs.document_fragments(texts)] == want


def test_thue_morse_words_have_no_run():
    t = [str(i.bit_count() % 2) for i in range(1 << 13)]  # no stretch of more than two periods
    assert periodic_runs.document_fragments([t, t + t[:1]]) == [[], []]


def test_stitch_joins_pieces(spark):
    pieces = [(1, 2, 0, 5), (1, 2, 5, 9), (1, 2, 4, 6), (1, 4, 0, 7), (1, 2, 20, 22), (2, 1, 3, 9), (2, 1, 3, 9)]
    got = periodic_runs.stitch(spark.createDataFrame(pieces, "k long, q long, lo long, hi long"), ["k"])
    assert sorted(map(tuple, got.collect())) == [(1, 0, 11, 2), (2, 3, 7, 1)]


def test_run_digests_of_hard_rows(spark):
    r = random.Random(6)
    texts = [None, "", " \n\t ", "a", "a a a a a", "a a a a a a", "é é\té\né é é", "a b " * 4, "x " + "a b c " * 30 + "y " + "a b " * 30, "b c " * 8, "q" * 20_000, "one two " * 8000,
             "a a a a a a b a a a a a a", "n o p " * 4 + "z " + "k l m " * 4]
    texts += [" ".join(random_words(r)) for _ in range(120)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a b " * 9), (None, "a b " * 9), (None, None), (3, "m " * 9), (3, "m " * 9)]
    df = spark.createDataFrame([(i, t, "x", 1, "y", 2, 3, []) for i, t in rows], "doc_id long, text string, runs string, k1 long, sha string, n_words long, q long, fragments array<int>")
    got = periodic_runs.run_digests(periodic_runs.find_runs(df, queries.planted_period))
    key = lambda x: repr(x)
    assert sorted(map(tuple, got.collect()), key=key) == sorted((N.run_row(i, N.planted(i, N.run_words(t))) for i, t in rows), key=key)
    assert periodic_runs.run_digests(periodic_runs.find_runs(df.limit(0))).count() == 0
    with pytest.raises(ValueError):
        periodic_runs.find_runs(df, power=2)


def test_op12_on_given_documents(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF001, "documents").collect() if len(r.text or "") < 20_000]
    got = {r.doc_id: tuple(r) for r in queries.op12_periodic_runs(spark, SF001).collect()}
    assert any(r[1] for r in got.values())
    for i, t in rows:
        assert got[i] == N.run_row(i, N.planted(i, N.run_words(t)))


# ------------------------------------------------------------- op13: simhash

def test_hash_is_that_of_spark(spark):
    from pyspark.sql import functions as F

    got = spark.range(1).select(F.xxhash64(F.lit("one two three")).alias("h")).first().h
    assert got % 2**64 == xxhash.xxh64_intdigest(b"one two three", 42)


def test_fingerprints_in_pieces(monkeypatch):
    r = random.Random(8)
    texts = ["", " ", "A", "A b", "a b C", "É é x", *[" ".join(f"w{r.randrange(50)}" for _ in range(r.randrange(900))) + "\r\n" for _ in range(60)]]
    want = [N.fingerprint(t) for t in texts]
    for piece in (1 << 20, 64, 1):
        monkeypatch.setattr(simhash_dedup, "PIECE", piece)
        assert simhash_dedup.fingerprints([t.encode() for t in texts]).tolist() == want
    assert simhash_dedup.fingerprints([]).tolist() == [] and simhash_dedup.fingerprints([None]).tolist() == [0]


def signed(x):
    return x - 2**64 if x >> 63 else x


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_links_connect_all_within_two_bits(spark, monkeypatch, most):
    monkeypatch.setattr(simhash_dedup, "BROADCAST_ROWS", most)  # the table of crowded variants by a broadcast, and by a shuffle
    prepare(spark)
    r = random.Random(5)
    centre = [r.getrandbits(64) for _ in range(6)]
    fps = set(centre) | {0, 2**64 - 1, 1 << 63}
    for c in centre:
        for _ in range(60):
            x = c
            for _ in range(r.randrange(1, 5)):
                x ^= 1 << r.randrange(64)
            fps.add(x)
    half = r.getrandbits(32)
    fps |= {half << 32 | r.getrandbits(32) for _ in range(150)}  # a crowded variant without links
    got = {tuple(x % 2**64 for x in p) for p in simhash_dedup.links(spark.createDataFrame([(signed(x),) for x in fps], "fp long")).collect()}
    assert all((a ^ b).bit_count() <= 2 for a, b in got)

    def classes(edges):
        root = {x: x for x in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        return {x: find(x) for x in fps}

    order = sorted(fps)
    assert classes(got) == classes((a, b) for k, a in enumerate(order) for b in order[:k] if (a ^ b).bit_count() <= 2)


def test_near_duplicates_of_hard_rows(spark):
    r = random.Random(7)
    base = [f"w{r.randrange(3000)}" for _ in range(1500)]
    rows = [(1, None), (2, ""), (None, " \t\n"), (3, "One"), (4, "one"), (5, "one two"), (6, "ONE  two\nthree"), (7, "one two three"), (8, "é É"), (9, "x" * 30_000), (9, "x" * 30_000), (9, "other"), (None, "only null"), (None, None)]
    for k in range(150):  # near copies of one long text, in many shades
        t = list(base)
        for _ in range(k % 4):
            t[r.randrange(len(t))] = "changed"
        rows.append((1000 - k, " ".join(t)))
    rows += [(2000 + k, " ".join(base)) for k in range(120)]
    df = spark.createDataFrame([(i, t, 1, "a", 2, 3, 4) for i, t in rows], "doc_id long, text string, fp long, fingerprint string, component_id long, n long, least long")
    key = lambda x: repr(x)
    got = simhash_dedup.near_duplicates(df)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(N.simhash(rows), key=key)
    assert simhash_dedup.near_duplicates(df.limit(0)).count() == 0


def test_op13_on_given_documents(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SF001, "documents").collect()]
    assert sorted(map(tuple, queries.op13_simhash(spark, SF001).collect())) == sorted(N.simhash(rows))
