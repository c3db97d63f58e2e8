import pytest
from pyspark.sql import functions as F

from millrace.operators.paging import (
    fetch_range,
    log_tail,
    page,
    page_summary,
    preview,
    retain,
    top_rows,
)


@pytest.fixture
def numbers(spark):
    return spark.range(250).select(F.pmod(F.col("id") * 7, F.lit(50)).alias("t"), "id").repartition(5)


def test_pages(numbers):
    want = sorted(tuple(r) for r in numbers.collect())
    for start, size in [(0, 100), (100, 100), (200, 100), (249, 1), (250, 10), (400, 10)]:
        assert [tuple(r) for r in page(numbers, ["t", "id"], start, size).collect()] == want[start : start + size]
    assert [tuple(r) for r in page(numbers, ["t", "id"]).collect()] == want[:100]
    assert [tuple(r) for r in page(numbers, ["t", "id"], 0, None).collect()] == want
    rest = page(numbers, ["t", "id"], 30, None, rows_per_chunk=20)
    assert [tuple(r) for r in rest.collect()] == want[30:]
    assert page(numbers, ["t", "id"], 20_000, 10, rows_per_chunk=20).isEmpty()


def test_total_is_the_full_size(numbers):
    assert tuple(page_summary(numbers, 200).first()) == (200, 250, 50)
    assert tuple(page_summary(numbers, 900).first()) == (900, 250, 0)
    assert tuple(page_summary(numbers, 10, None).first()) == (10, 250, 240)
    assert tuple(page_summary(numbers.filter("id < 0")).first()) == (0, 0, 0)


def test_fetch_range(spark):
    df = spark.createDataFrame([(i,) for i in (9, 1, 4, 2, 8)], "id int")
    assert [r.id for r in fetch_range(df, "id", 2, 7).collect()] == [2, 4, 8]
    assert [r.id for r in fetch_range(df, "id", 4, 1).collect()] == [4]
    assert fetch_range(df, "id", 5, 1).isEmpty()


def lines(df):
    return {
        key: [r.line for r in sorted(df.filter(F.col("k") == key).collect(), key=lambda r: r.line)]
        for key in (1, 2)
    }


@pytest.mark.parametrize("layout", [{}, {"rows_per_chunk": 20}])
def test_log_tail(spark, layout):
    logs = spark.createDataFrame([(1, i * 2) for i in range(150)] + [(2, 7)], "k int, no int")
    assert lines(log_tail(logs, "k", "no", **layout)) == {1: list(range(50, 150)), 2: [0]}
    assert lines(log_tail(logs, "k", "no", size=10, **layout)) == {1: list(range(140, 150)), 2: [0]}
    assert lines(log_tail(logs, "k", "no", 0, 3, **layout)) == {1: [0, 1, 2], 2: [0]}
    assert lines(log_tail(logs, "k", "no", 149, 9, **layout)) == {1: [149], 2: []}
    unnamed = logs.union(spark.createDataFrame([(None, 3), (None, 5)], "k int, no int"))
    kept = log_tail(unnamed, "k", "no", size=1, **layout).filter("k IS NULL").collect()
    assert [(r.no, r.line, r.total) for r in kept] == [(5, 1, 2)]
    tail = log_tail(logs, "k", "no", size=1, **layout).collect()
    assert {(r.k, r.no, r.total) for r in tail} == {(1, 298, 150), (2, 7, 1)}


def test_retention(spark):
    """Statements 0, 1, 2, 3 arrive one by one with room for two."""
    for n, kept in [(1, [0]), (2, [0, 1]), (3, [1, 2]), (4, [2, 3])]:
        df = spark.range(n).select(F.lit("s").alias("k"), "id")
        assert sorted(r.id for r in retain(df, "k", ["id"], 2).collect()) == kept


def test_retention_of_hot_keys(skewed):
    for layout in ({}, {"rows_per_chunk": 20}):
        got = retain(skewed, "key", ["t", "id"], 70, **layout).collect()
        for key in (7, None, 2):
            mine = sorted((r.t, r.id) for r in skewed.collect() if r.key == key)
            assert sorted((r.t, r.id) for r in got if r.key == key) == mine[-70:]


def test_preview_and_top_rows(spark):
    df = spark.range(30).withColumn("n", F.pmod("id", F.lit(3)))
    assert [r.id for r in preview(df, ["id"]).collect()] == list(range(10))
    assert preview(df, n=4).count() == 4
    got = top_rows(df, "some_numbers", ["id"], "n DESC, id", 3)
    assert [r.id for r in got.collect()] == [2, 5, 8]
