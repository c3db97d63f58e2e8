"""Chunked windows and salted joins against plain ones, on skewed keys."""

import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.plans import (
    chunked,
    global_slice,
    hot_keys,
    key_slice,
    latest_before,
    positions,
    previous,
    running_before,
    spread_join,
)

KEYS, ORDER = ["key"], ["t", "id"]
LAYOUTS = [{"rows_per_chunk": 20}, {"rows_per_chunk": 20, "max_chunks": 6}, {}]


def plain(*order):
    return Window.partitionBy("key").orderBy(*(order or ORDER))


def same(got, want):
    cols = want.columns
    return got.select(cols).exceptAll(want).isEmpty() and want.exceptAll(got.select(cols)).isEmpty()


@pytest.mark.parametrize("layout", LAYOUTS)
def test_positions(skewed, layout):
    want = skewed.withColumn("position", F.row_number().over(plain()).cast("long") - 1)
    assert same(positions(skewed, KEYS, ORDER, **layout), want)


@pytest.mark.parametrize("layout", LAYOUTS)
def test_previous(skewed, layout):
    want = skewed.withColumn("before", F.lag("state").over(plain()))
    got = previous(chunked(skewed, KEYS, ORDER, **layout), KEYS, ORDER, "state", "before")
    assert same(got, want)


@pytest.mark.parametrize("layout", LAYOUTS)
def test_latest_before(skewed, layout):
    rows = skewed.withColumn("rare", F.when(F.col("id") % 11 == 0, F.col("state")))
    w = plain().rowsBetween(Window.unboundedPreceding, -1)
    want = rows.withColumns({"a": F.last("rare", True).over(w), "b": F.last("value", True).over(w)})
    got = latest_before(chunked(rows, KEYS, ORDER, **layout), KEYS, ORDER, {"a": "rare", "b": "value"})
    assert same(got, want)


def rows_shuffled_by_key(df):
    """The most rows that a shuffle by the key alone moves while a query runs."""
    df.collect()
    todo, total = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStage"):
            todo.append(node.plan())
        if name == "Exchange" and re.search(r"hashpartitioning\(key#\d+L?, \d+\)", node.toString().split("\n")[0]):
            total = max(total, node.metrics().apply("shuffleRecordsWritten").value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


def test_a_small_slice_of_a_hot_key_does_not_grow_with_the_tasks(spark):
    def sent(tasks):
        df = spark.range(0, 60_000, 1, tasks).select((F.col("id") % 1).alias("key"), (F.col("id") * 7919 % 60_000).alias("t"), "id")
        got = key_slice(df, KEYS, ORDER, 20, from_end=True, rows_per_chunk=1000)
        rows = rows_shuffled_by_key(got)
        assert sorted(r.t for r in got.collect()) == list(range(59_980, 60_000))
        return rows

    assert 20 <= sent(20) <= 2500
    assert 20 <= sent(200) <= 2500


@pytest.mark.parametrize("layout", LAYOUTS)
def test_running_before(skewed, layout):
    w = plain().rowsBetween(Window.unboundedPreceding, -1)
    want = skewed.withColumn("top", F.max("value").over(w))
    got = running_before(chunked(skewed, KEYS, ORDER, **layout), KEYS, ORDER, "value", "top")
    assert same(got, want)


@pytest.mark.parametrize("layout", LAYOUTS)
@pytest.mark.parametrize("from_end", [False, True])
@pytest.mark.parametrize("start,size", [(0, 45), (130, 60), (490, 100)])
def test_key_slice(skewed, layout, from_end, start, size):
    by = [F.desc(c) if from_end else F.asc(c) for c in ORDER]
    at = F.row_number().over(plain(*by)).cast("long") - 1
    want = skewed.withColumn("position", at).filter(
        (F.col("position") >= start) & (F.col("position") < start + size)
    )
    assert same(key_slice(skewed, KEYS, ORDER, size, start, from_end, **layout), want)


@pytest.mark.parametrize("layout", LAYOUTS)
@pytest.mark.parametrize("start,size", [(700, 333), (2000, 5), (300, None)])
def test_global_slice(skewed, layout, start, size):
    ordered = skewed.orderBy(*ORDER).offset(start)
    want = (ordered if size is None else ordered.limit(size)).collect()
    assert global_slice(skewed, ORDER, start, size, **layout).collect() == want


@pytest.mark.parametrize("layout", LAYOUTS)
@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_spread_join(skewed, layout, how):
    per_key = skewed.filter("key is null or key % 2 = 1").groupBy("key").agg(F.min("id").alias("first"))
    a, b = skewed.alias("a"), per_key.alias("b")
    want = a.join(b, F.col("a.key").eqNullSafe(F.col("b.key")), how)
    right = [] if how in ("left_semi", "left_anti") else ["b.first"]
    want = want.select("a.*", *right)
    assert same(spread_join(skewed, per_key, KEYS, ORDER, how, **layout), want)


def test_hot_keys_are_cut_into_bounded_chunks(skewed):
    rows = chunked(skewed, KEYS, ORDER, rows_per_chunk=20)
    sizes = rows.groupBy("key", "_chunk").count()
    assert skewed.filter("key = 7").count() >= 500
    assert sizes.agg(F.max("count")).first()[0] <= 60
    assert rows.filter("key = 7").select("_chunk").distinct().count() > 10


def test_chunks_are_capped(skewed):
    cut = chunked(skewed, KEYS, ORDER, rows_per_chunk=20, max_chunks=6).filter("_chunk > 0")
    assert cut.select("key", "_chunk").distinct().count() <= 6
    parts = hot_keys(skewed, KEYS, ORDER, rows_per_chunk=20, max_chunks=6)
    assert 0 < parts.agg(F.sum("_parts")).first()[0] <= 6


def test_cold_keys_stay_whole(skewed):
    assert chunked(skewed, KEYS, ORDER).filter("_chunk > 0 or _hot").isEmpty()
    assert hot_keys(skewed, KEYS, ORDER).isEmpty()


def test_empty_input(skewed):
    none = skewed.filter("id < 0")
    assert positions(none, KEYS, ORDER).isEmpty()
    assert key_slice(none, KEYS, ORDER, 5).isEmpty()
    assert global_slice(none, ORDER, 3, 5).isEmpty()


def test_join_type_is_checked(skewed):
    with pytest.raises(ValueError):
        spread_join(skewed, skewed, KEYS, ORDER, "full")


def test_slices_without_hot_keys_are_a_plain_window(spark):
    df = spark.range(3000).select((F.col("id") % 30).alias("key"), (F.col("id") * 7 % 3000).alias("t"), "id")

    def plan(**layout):
        return key_slice(df, KEYS, ORDER, 5, from_end=True, **layout)._jdf.queryExecution().optimizedPlan().toString()

    assert "Join" not in plan() and "scalar-subquery" not in plan() and "WindowGroupLimit" in plan()
    assert "Join" in plan(rows_per_chunk=50)
    assert key_slice(df.limit(0), KEYS, ORDER, 5).collect() == []


def test_the_sample_for_a_slice_does_not_grow_with_a_hot_key(spark):
    """At a rate that follows the rows, a slice of a hot key is still the right one."""
    df = spark.range(40_000).select(F.lit(None).cast("long").alias("key"), (F.col("id") * 7919 % 40_000).alias("t"), "id")
    for start in (0, 777):
        got = key_slice(df, KEYS, ORDER, 10, start=start, rows_per_chunk=100, max_chunks=3)
        assert sorted((r.t, r.position) for r in got.collect()) == [(i, i) for i in range(start, start + 10)]
