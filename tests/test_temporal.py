"""Joins by time against direct comparison of all rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from millrace.functions.instants import instant
from millrace.operators.temporal import asof_join, overlap_join

SF_DIR = "/root/testdata/sf0.001"
SMALL = {"rows_per_chunk": 64}


def history(seed, n, hot):
    """Rows (key, t, id); one key holds a third, the null key some; few distinct times, some of them null."""
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        key = hot if i % 3 == 0 else None if i % 11 == 0 else draw.randrange(12)
        rows.append((key, None if draw.random() < 0.03 else draw.randrange(400), i))
    return rows + rows[:5]


def nearest(left, right, forward=False, exact=True, tolerance=None):
    out = []
    for key, t, i in left:
        best = None
        for k, u, j in right:
            if key is None or t is None or k != key or u is None:
                continue
            away = u - t if forward else t - u
            if away < 0 or (away == 0 and not exact):
                continue
            if best is None or (away, -j) < best[0]:
                best = ((away, -j), (u, j))
        match = best[1] if best and (tolerance is None or best[0][0] <= tolerance) else (None, None)
        out.append((key, t, i, *match))
    return sorted(out, key=repr)


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("exact", [True, False])
@pytest.mark.parametrize("tolerance", [None, 3])
@pytest.mark.parametrize("layout", [{}, SMALL])
def test_asof_join(spark, forward, exact, tolerance, layout):
    left, right = history(1, 900, 5), history(2, 500, 5)
    schema = "key int, t int, id int"
    got = asof_join(
        spark.createDataFrame(left, schema),
        spark.createDataFrame(right, schema),
        ["key"],
        "t",
        "t",
        {"other_t": "t", "other_id": "id"},
        tie=["id"],
        tolerance_s=tolerance,
        direction="forward" if forward else "backward",
        exact=exact,
        **layout,
    )
    assert got.columns == ["key", "t", "id", "other_t", "other_id"]
    assert sorted(map(tuple, got.collect()), key=repr) == nearest(left, right, forward, exact, tolerance)


def test_asof_join_of_nothing_and_inner(spark):
    left = spark.createDataFrame([(1, 5), (1, 1), (2, 5)], "key int, t int")
    none = spark.createDataFrame([], "key int, t int, v string")
    one = spark.createDataFrame([(1, 3, "x"), (1, 4, None)], "key int, t int, v string")
    take = {"t2": "t", "v": "v"}
    assert sorted(map(tuple, asof_join(left, none, ["key"], "t", "t", take).collect())) == [(1, 1, None, None), (1, 5, None, None), (2, 5, None, None)]
    assert list(map(tuple, asof_join(left, one, ["key"], "t", "t", take, how="inner").collect())) == [(1, 5, 4, None)]
    assert asof_join(none, one, ["key"], "t", "t", {"w": "v"}).collect() == []
    with pytest.raises(ValueError):
        asof_join(left, one, ["key"], "t", "t", take, direction="sideways")


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp", "date"])
def test_asof_join_of_times(spark, kind):
    left = spark.createDataFrame([(1, "2024-03-31 02:30:00.000001"), (1, "1969-12-31 23:59:59.5")], "k int, s string")
    right = spark.createDataFrame([(1, "2024-03-30 02:30:00.000001"), (1, "1969-12-30 23:59:59.4")], "k int, s string")
    left, right = (df.select("k", F.col("s").cast(kind).alias("at")) for df in (left, right))
    near = asof_join(left, right, ["k"], "at", "at", {"then": "at"}, tolerance_s=86_400).orderBy("at").collect()
    assert [r.then is not None for r in near] == [kind == "date", True]


def test_instants_do_not_depend_on_the_zone(spark):
    df = spark.createDataFrame([("1969-12-31 23:59:58.123456",), ("2024-03-31 02:30:00",)], "s string").select(F.col("s").cast("timestamp_ntz").alias("at"))
    epoch = dt.datetime(1970, 1, 1)
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        for row in df.select("at", instant(df, "at").alias("n")).collect():
            assert row.n == (row.at - epoch) // dt.timedelta(microseconds=1)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def intervals(seed, n, longest):
    draw = random.Random(seed)
    rows = []
    for i in range(n):
        start = draw.randrange(-900, 900)
        length = draw.choice([0, 0, draw.randrange(20), draw.randrange(20), draw.randrange(longest)])
        rows.append((7 if i % 3 == 0 else None if i % 13 == 0 else draw.randrange(4), start, start + length - (5 if i % 17 == 0 else 0), i))
    return rows + [(1, None, 5, -1), (1, 5, None, -2)] + rows[:3]


@pytest.mark.parametrize("closed", [True, False])
@pytest.mark.parametrize("keyed", [True, False])
@pytest.mark.parametrize("longest", [40, 100_000_000])
def test_overlap_join(spark, closed, keyed, longest):
    left, right = intervals(3, 260, longest), intervals(4, 200, 300)
    schema = "key int, start bigint, stop bigint, id int"
    got = overlap_join(
        spark.createDataFrame(left, schema),
        spark.createDataFrame(right, schema),
        ["key"] if keyed else [],
        ("start", "stop"),
        ("start", "stop"),
        {"other": "id"},
        closed=closed,
    )

    def meet(a, b):
        if None in (a[1], a[2], b[1], b[2]) or (keyed and (a[0] is None or a[0] != b[0])):
            return False
        if closed:
            return a[1] <= a[2] and b[1] <= b[2] and a[1] <= b[2] and b[1] <= a[2]
        return a[1] < a[2] and b[1] < b[2] and a[1] < b[2] and b[1] < a[2]

    want = sorted((*a, b[3]) for a in left for b in right if meet(a, b) and a[0] is not None) + sorted(
        (*a, b[3]) for a in left for b in right if a[0] is None and meet(a, b)
    )
    assert len(want) > 100
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_overlap_of_points_and_of_nothing(spark):
    points = spark.createDataFrame([(1, 4), (1, 4), (2, 4)], "k int, t int")
    none = spark.createDataFrame([], "k int, t int")
    at = ("t", "t")
    assert len(overlap_join(points, points, ["k"], at, at, {"u": "t"}).collect()) == 5
    assert overlap_join(points, points, ["k"], at, at, {"u": "t"}, closed=False).collect() == []
    assert overlap_join(points, none, ["k"], at, at, {"u": "t"}).collect() == []
    assert overlap_join(none, none, [], at, at, {"u": "t"}).collect() == []


@pytest.mark.parametrize("name", ["latest_view", "next_purchase", "errors_in_spans", "spans_at_once"])
def test_plans_compare_no_rows_of_a_key_pairwise(spark, capsys, name):
    queries()[name](spark, SF_DIR).explain("formatted")
    text = capsys.readouterr().out
    assert "CartesianProduct" not in text
    if "spans" in name:
        assert "_bucket" in text.split("Join")[1] and "NestedLoopJoin" not in text
    else:
        # One window over both sides; no join of purchases with views, only lookups of chunk summaries.
        assert "SortMergeJoin" not in text and "Window" in text


def test_a_hot_key_is_spread_over_chunks(spark, capsys):
    rows = spark.range(4000).selectExpr("CAST(IF(id % 3 = 0, 1, id) AS INT) AS key", "id AS t", "id")
    asof_join(rows, rows, ["key"], "t", "t", {"other": "id"}, exact=False, rows_per_chunk=64).explain("formatted")
    assert "_chunk" in capsys.readouterr().out

@pytest.mark.parametrize("closed", [True, False])
@pytest.mark.parametrize("keyed", [True, False])
@pytest.mark.parametrize("apart", [True, False])
def test_overlap_totals(spark, closed, keyed, apart):
    """Pairs that are counted, against pairs that are made."""
    schema = "key int, start bigint, stop bigint, id int, of int"
    left, right = (
        spark.createDataFrame([(*r, None if r[3] % 19 == 0 else r[3] % 5) for r in rows], schema)
        for rows in (intervals(3, 260, 4_000), intervals(4, 200, 300))
    )
    common = {"on": ["key"] if keyed else [], "left_span": ("start", "stop"), "right_span": ("start", "stop"), "closed": closed}
    common["apart"] = ("of", "of") if apart else None
    pairs = overlap_join(left, right, take={"other_stop": "stop"}, **common)
    want = pairs.groupBy("key", "id").agg(F.count(F.lit(1)), F.max(F.least("stop", "other_stop"))).collect()
    got = overlap_join(left, right, per=["key", "id"], **common, **SMALL)
    assert got.columns == ["key", "id", "pairs", "until"] and len(want) > 50
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want), key=repr)
    with pytest.raises(ValueError):
        overlap_join(left, right, take={"x": "stop"}, per=["id"], **common)


def test_the_work_of_counting_does_not_grow_with_the_pairs(spark, capsys):
    # All 20,000 intervals of 1,000 keys overlap: 400 million pairs.
    rows = spark.range(20_000).selectExpr("id % 1000 AS of", "id AS start", "id + 100000 AS stop")
    span = ("start", "stop")
    got = overlap_join(rows, rows, [], span, span, apart=("of", "of"), per=["of", "start"], rows_per_chunk=4_096)
    got.explain("formatted")
    # The one join is that of rows with the sums of earlier buckets.
    text = capsys.readouterr().out.split("\n\n")[0]
    assert text.count("Join") == 1 and "BroadcastHashJoin LeftOuter" in text
    told = got.agg(F.min("pairs"), F.max("pairs"), F.min(F.col("until") - F.col("start")), F.count(F.lit(1))).first()
    assert tuple(told) == (19_980, 19_980, 99_999, 20_000)
