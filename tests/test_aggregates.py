import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.aggregates import (
    count_rows,
    count_where,
    estimate_pi,
    latest_by,
    next_id,
    pi_from_points,
    pi_vectorized,
    progress,
    recover,
    recovery_summary,
    sum_mapped,
)
from millrace.operators.words import lines_with, tokenize, top_word, word_count, word_lengths

NINE = "the quick brown fox jumped over the lazy dog"


def test_drawn_points_are_independent(spark):
    from pyspark.sql import functions as f

    from millrace.operators.aggregates import _APART

    points = spark.range(0, 400, 1, 8).select(f.spark_partition_id().alias("p"), f.rand(3).alias("x"), f.rand(3 + _APART).alias("y"))
    rows = points.collect()
    assert not {r.x for r in rows} & {r.y for r in rows}
    assert abs(estimate_pi(spark, 200_000, 8, seed=3).first()[0] - 3.1416) < 0.03


def test_doubled_sum(spark):
    assert sum_mapped(spark.range(100), F.col("id") * 2).first()[0] == 9900


@pytest.mark.parametrize("n", [5, 100, 3, 0])
@pytest.mark.parametrize("partitions", [1, 10])
def test_counts_do_not_depend_on_partitions(spark, n, partitions):
    assert count_rows(spark.range(n), partitions).first()[0] == n


def test_typed_filter(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "value int")
    assert count_where(df, F.col("value") >= 2).first()[0] == 2


def test_words(spark):
    df = spark.createDataFrame([(NINE,), (None,), ("",)], "line string")
    words = tokenize(df, "line")
    assert words.count() == 9
    assert {r.word: r.length for r in word_lengths(words, "word").collect()}["jumped"] == 6
    counts = {r.word: r.word_count for r in word_count(words).collect()}
    assert counts["the"] == 2 and len(counts) == 8
    assert tuple(top_word(words).first()) == ("the", 2)
    ties = spark.createDataFrame([("b",), ("a",), (None,)], "word string")
    assert tuple(top_word(ties).first()) == ("a", 1)
    assert lines_with(df, "line", "fox").count() == 1 and lines_with(df, "line", "Fox").count() == 0


@pytest.mark.parametrize("variant", ["quadrant", "square", "square_inclusive"])
def test_estimate_pi(spark, variant):
    pi = estimate_pi(spark, 100_000, 4, variant, seed=3)
    assert abs(pi.first()[0] - math.pi) < 0.05
    assert pi.first() == estimate_pi(spark, 100_000, 4, variant, seed=3).first()


def test_estimate_pi_checks_its_variant(spark):
    with pytest.raises(ValueError):
        estimate_pi(spark, 10, 1, "cube")


def test_pi_edge(spark):
    points = spark.createDataFrame([(1.0, 0.0), (0.0, 0.5), (1.0, 1.0), (0.6, 0.8)], "x double, y double")
    assert pi_from_points(points, F.col("x"), F.col("y")).first()[0] == 1.0
    assert pi_from_points(points, F.col("x"), F.col("y"), inclusive=True).first()[0] == 3.0
    assert pi_vectorized(points).first()[0] == 1.0


def test_progress(spark):
    groups = spark.createDataFrame([(1, "running"), (2, "running"), (3, "running"), (4, "available")], "g int, state string")
    stages = spark.createDataFrame([(1, 2, 2), (3, 1, 4), (3, 3, 4), (4, 0, 5)], "g int, done int, total int")
    got = progress(groups, stages, "g", F.col("done"), F.col("total"), F.col("state").isin("available", "cancelled"))
    assert {r.g: r.progress for r in got.collect()} == {1: 1.0, 2: 0.0, 3: 0.5, 4: 1.0}


def test_progress_of_a_group_with_two_jobs(spark):
    groups = spark.createDataFrame([(1,)], "g int")
    stages = spark.createDataFrame([(1, 2, 2), (1, 3, 3)], "g int, done int, total int")
    assert progress(groups, stages, "g", F.col("done"), F.col("total"), F.lit(False)).first().progress == 1.0


def test_latest(spark):
    df = spark.createDataFrame([(1, 5, 1, "a"), (1, 5, 2, "b"), (2, 1, 3, None), (1, 4, 9, "c")], "k int, t int, id int, s string")
    assert {r.k: r.s for r in latest_by(df, "k", ["t", "id"], "s").collect()} == {1: "b", 2: None}


STORE = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("owner", T.StringType())])


def test_recovery(spark):
    rows = [
        ("0", '{"id":0,"owner":"a"}'), ("5", None), ("77", '{"id":77,"owner":null}'), ("7", "{bad"),
        ("11212", '{"id":"x"}'), ("notes", '{"id":1}'), ("1.5", '{"id":1}'), (" 8", '{"id":1}'),
        ("99999999999", '{"id":1}'), ("99999999999999999999", '{"id":1}'), (None, '{"id":1}'),
    ]
    got = recover(spark.createDataFrame(rows, "key string, doc string"), "key", "doc", STORE)
    by_id = {r.id: r for r in got.collect()}
    assert set(by_id) == {0, 77, 7, 11212, 99999999999}
    assert by_id[0].record.owner == "a" and by_id[77].record.owner is None and by_id[77].error is None
    assert by_id[7].record is None and by_id[7].error == "Error getting session 7"
    assert by_id[11212].record is None
    assert tuple(recovery_summary(got).first()) == (3, 2)
    assert tuple(recovery_summary(got.filter("id < 0")).first()) == (0, 0)


def test_next_id(spark):
    def one(rows):
        return next_id(spark.createDataFrame(rows, "doc string"), "doc").first()[0]

    assert one([]) == 0
    assert one([('{"nextSessionId":100}',)]) == 100
    assert one([('{"nextSessionId":5000000000}',)]) == 5_000_000_000
    with pytest.raises(Exception, match="[Mm]alformed"):
        one([("{bad",)])
