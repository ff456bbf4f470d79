"""Line formats: dense (last token dropped) and sparse (1-based, last wins)."""

import pytest
from pyspark.sql import functions as F

from weftcore.functions.vectors import dense_to_sparse, sparse_to_dense
from weftcore.sources.text import dense_line, parse_dense, parse_sparse, sparse_line


def _lines(spark, values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_dense_drops_last_token(spark):
    rows = parse_dense(_lines(spark, ["1.0 2.0 7", "1 2 3", "5"])).collect()
    assert rows[0].features == [1.0, 2.0] and not rows[0]._corrupt
    assert rows[1].features == [1.0, 2.0]
    assert rows[2]._corrupt and rows[2].features is None


def test_dense_legacy_keeps_all(spark):
    r = parse_dense(_lines(spark, ["5"]), drop_last=False).first()
    assert r.features == [5.0] and not r._corrupt


def test_dense_modes(spark):
    df = _lines(spark, ["1 2 3", "x 2 3"])
    assert parse_dense(df, mode="DROPMALFORMED").count() == 1
    with pytest.raises(Exception):
        parse_dense(df, mode="FAILFAST").collect()


def test_sparse_format(spark):
    rows = parse_sparse(_lines(spark, ["4 5 1 2.5 5 1.0", "3 4", "1 3 2 1.0 2 9.0",
                                       "1 3 1", "1 3 4 1.0", "x 3 1 1.0"])).collect()
    assert (rows[0].features.size, rows[0].features.indices, rows[0].features.values) == (5, [0, 4], [2.5, 1.0])
    assert (rows[1].features.size, rows[1].features.indices) == (4, [])
    assert (rows[2].features.indices, rows[2].features.values) == ([1], [9.0])  # last wins
    assert [r._corrupt for r in rows] == [False, False, False, True, True, True]


def test_sparse_sorted_and_explicit_zero(spark):
    r = parse_sparse(_lines(spark, ["0 100 10 10.0 1 0.0 2 1.0"])).first()
    assert r.features.indices == [0, 1, 9] and r.features.values == [0.0, 1.0, 10.0]


def test_round_trips(spark):
    df = spark.createDataFrame([(1, [0.0, 2.5, 0.0, -1.0])], "pid long, f array<double>")
    sv = df.select("pid", dense_to_sparse("f").alias("sv"))
    assert sv.select(sparse_to_dense("sv").alias("d")).first().d == [0.0, 2.5, 0.0, -1.0]
    line = sv.select(sparse_line("pid", "sv").alias("value")).first().value
    assert line == "1 4 2 2.5 4 -1.0"
    back = parse_sparse(_lines(spark, [line])).first().features
    assert back.indices == [1, 3] and back.values == [2.5, -1.0]
    dl = df.select(dense_line("f", F.lit(9)).alias("value"))
    assert parse_dense(dl).first().features == [0.0, 2.5, 0.0, -1.0]
