"""Stored partial aggregates, sketches and streams that keep them up to date."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from millrace.operators.sketches import DISTINCT_ERROR, estimates, merge_sketches, sketch
from millrace.sources.deltas import Deltas, summed
from millrace.streaming.windows import LateWindows, run_to_files, running_word_counts, within

WORDS = "word string, n bigint"


def counts(df):
    return dict(map(tuple, df.collect()))


@pytest.fixture
def deltas(spark, tmp_path):
    return Deltas(spark, str(tmp_path / "d"), WORDS, summed(["word"], "n"))


def test_a_replayed_batch_changes_nothing(spark, deltas):
    assert counts(deltas.total()) == {} and deltas.compact() == -1
    one, two = ([("a", 1), ("b", 2)], [("a", 10), (None, 5)])
    for batch, rows in ((0, one), (1, two), (1, two), (0, one)):
        deltas.put(batch, spark.createDataFrame(rows, WORDS))
    assert counts(deltas.total()) == {"a": 11, "b": 2, None: 5}


def test_compaction_keeps_totals_and_old_batches_stay_merged(spark, deltas):
    for batch in range(4):
        deltas.put(batch, spark.createDataFrame([("a", 10**batch)], WORDS))
    assert deltas.compact() == 3 and deltas.upto() == 3
    deltas.put(2, spark.createDataFrame([("a", 999)], WORDS))
    deltas.put(4, spark.createDataFrame([("a", 10_000), ("b", 1)], WORDS))
    assert counts(deltas.total()) == {"a": 11_111, "b": 1}
    assert deltas.compact() == 4 and deltas.compact() == 4
    assert counts(deltas.total()) == {"a": 11_111, "b": 1}


def test_a_base_without_its_mark_is_not_read(spark, deltas):
    deltas.put(0, spark.createDataFrame([("a", 1)], WORDS))
    spark.createDataFrame([("a", 77)], WORDS).write.parquet(f"{deltas.path}/bases/upto=0")
    assert counts(deltas.total()) == {"a": 1}
    assert deltas.compact() == 0 and counts(deltas.total()) == {"a": 1}


def test_sketches_merge_and_roll_up(spark):
    rows = spark.range(60_000).selectExpr("CAST(id % 3 AS INT) AS g", "id % 4 AS h", "id % 20000 AS user", "CAST(id AS DOUBLE) AS v", "IF(id % 2 = 0, 'hot', CAST(id AS STRING)) AS item")
    rows = rows.union(spark.createDataFrame([(None, 0, None, None, None)], "g int, h bigint, user bigint, v double, item string"))
    parts = [sketch(rows.filter(F.col("h") == h), ["g", "h"], {"user": "user"}, {"v": "v"}, {"item": "item"}) for h in range(4)]
    states = parts[0].union(parts[1]).union(parts[2]).union(parts[3])
    for keys, groups in ((["g"], 4), ([], 1)):
        told = estimates(merge_sketches(states, keys), keys, at=[0.1, 0.5], top=1).collect()
        assert len(told) == groups
        for r in told:
            if keys and r.g is None:
                assert (r.rows, r.user_distinct, r.v_quantiles, r.item_frequent) == (1, 0, None, [])
                continue
            whole = 60_000 if not keys else 20_000
            assert abs(r.user_distinct - 20_000) < 4 * DISTINCT_ERROR * 20_000
            assert abs(r.v_quantiles[1] - 30_000) < 2_000 and abs(r.v_quantiles[0] - 6_000) < 2_000
            assert r.item_frequent[0]["item"] == "hot" and abs(r.item_frequent[0]["count"] - whole / 2) <= whole / 1024
    empty = estimates(merge_sketches(sketch(rows.limit(0), ["g"], {"user": "user"}, {"v": "v"}), ["g"]), ["g"])
    assert empty.collect() == []


def test_no_value_is_surely_frequent(spark, tmp_path):
    """More users than a state keeps track of, all of them rare: none is told, which is no error."""
    rows = spark.range(40_000).selectExpr("id AS event_id", "TIMESTAMP_NTZ '2024-01-01' AS ts", "id % 8000 AS user_id", "IF(id < 30000, 'view', 'click') AS event_type", "CAST(id AS DOUBLE) AS value", "'' AS props")
    # A user with a tenth of the purchases, among too many others.
    some = spark.range(20_000).selectExpr("id AS event_id", "TIMESTAMP_NTZ '2024-01-01' AS ts", "IF(id % 10 = 0, -1, id) AS user_id", "'purchase' AS event_type", "CAST(id AS DOUBLE) AS value", "'' AS props")
    rows.union(some).write.parquet(str(tmp_path / "events.parquet"))
    assert estimates(sketch(rows, [], frequent={"u": "user_id"}), []).first().u_frequent == []
    got = {r.event_type: tuple(r)[1:] for r in queries()["sketched_types"](spark, str(tmp_path)).collect()}
    assert got == {"view": (30_000, 8_000, True, True, True), "click": (10_000, 8_000, True, True, True), "purchase": (20_000, 18_001, True, True, True)}


def test_word_counts_go_on_where_they_stopped(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / n) for n in ("src", "out", "ckpt"))
    schema = "text string"
    for texts in (["b a a", None], ["a", ""], []):
        spark.createDataFrame([(t,) for t in texts], schema).coalesce(1).write.mode("append").parquet(src)
        kept = running_word_counts(spark.readStream.schema(schema).parquet(src), "text", out, ckpt)
    assert counts(kept.total()) == {"a": 3, "b": 1}
    kept.compact()
    spark.createDataFrame([("c a",)], schema).write.mode("append").parquet(src)
    assert counts(running_word_counts(spark.readStream.schema(schema).parquet(src), "text", out, ckpt).total()) == {"a": 4, "b": 1, "c": 1}


def at(minute):
    return dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(minutes=minute)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_stream_join_waits_drops_late_rows_and_restarts(spark, tmp_path, how):
    schema = "k int, t timestamp, id int"
    folders = {n: str(tmp_path / n) for n in ("left", "right", "out", "ckpt")}

    def step(left, right):
        for name, rows in (("left", left), ("right", right)):
            spark.createDataFrame([(k, at(m), i) for k, m, i in rows], schema).coalesce(1).write.mode("append").parquet(folders[name])
        a, b = (spark.readStream.schema(schema).parquet(folders[n]) for n in ("left", "right"))
        # Each step is a run of its own, so state comes back from the checkpoint.
        pairs = within(a, b, ["k"], "t", "t", {"other": "id"}, 3600, 600, 600, how)
        run_to_files(pairs, folders["out"], folders["ckpt"])
        return sorted((r.id, r.other) for r in spark.read.schema(pairs.schema).parquet(folders["out"]).collect())

    first = step([(1, 0, 1), (2, 0, 2), (None, 0, 3)], [(1, 60, 10), (1, 61, 11), (None, 1, 12)])
    assert (1, 10) in first and (1, 11) not in first
    assert step([], [(2, 55, 13)]).count((2, 13)) == 1
    # Time goes on by hours on both sides; what comes for the old rows now is too late.
    step([(9, 400, 90)], [(9, 400, 91)])
    step([(9, 800, 92)], [(9, 800, 93)])
    last = step([(2, 1, 4)], [(2, 50, 14)])
    assert (2, 14) not in last and (4, 14) not in last and (4, 13) not in last
    assert (9, None) not in [(i, o) for i, o in last if i == 9] and {(90, 91), (92, 93), (1, 10), (2, 13)} <= set(last)
    assert ((3, None) in last) == (how == "left")


@pytest.mark.parametrize("size,slide", [(60, 60), (120, 30)])
def test_windows_and_late_rows_are_all_rows(spark, tmp_path, size, slide):
    draw = random.Random(size)
    schema = "k int, t timestamp, v double"
    batches, now = [], 0
    for _ in range(5):
        now += draw.randint(20, 200)
        rows = [(draw.choice([1, 2, None]), max(0, now - draw.choice([0, 5, 50, 400])) , float(i)) for i in range(30)]
        batches.append(rows + [(1, None, 1.0)])
    batches.insert(2, [])
    empty = spark.createDataFrame([], schema)
    windows = LateWindows(spark, str(tmp_path), empty, ["k"], "t", "v", size * 60, slide * 60, 30 * 60)
    for b in [0, 1, 2, 1, 3, 4, 5, 5]:
        windows.add(spark.createDataFrame([(k, None if m is None else at(m), v) for k, m, v in batches[b]], schema), b)
    want, late, latest = {}, [], None
    for rows in batches:
        known = [r for r in rows if r[1] is not None]
        for k, m, v in known:
            starts = range(m // slide * slide, m - size, -slide)
            still = [s for s in starts if latest is None or s + size > latest - 30]
            for s in still:
                n, total = want.get((k, s), (0, 0.0))
                want[k, s] = n + 1, total + v
            if not still:
                late.append((k, m, v))
        latest = max([m for _, m, _ in known] + ([] if latest is None else [latest]))
    assert late
    zero = at(0).replace(tzinfo=None)
    got = windows.windows().selectExpr("k", "CAST(start AS timestamp_ntz) AS s", "rows", "sum").collect()
    assert {(r.k, (r.s - zero) // dt.timedelta(minutes=1)): (r.rows, r["sum"]) for r in got} == want
    assert sorted((repr(r.k), r.v) for r in windows.late().collect()) == sorted((repr(k), v) for k, _, v in late)


def test_late_windows_of_a_stream(spark, tmp_path):
    src, schema = str(tmp_path / "src"), "k int, t timestamp, v double"
    empty = spark.createDataFrame([], schema)

    def run(minutes):
        spark.createDataFrame([(1, at(m), 1.0) for m in minutes], schema).coalesce(1).write.mode("append").parquet(src)
        windows = LateWindows(spark, str(tmp_path / "out"), empty, ["k"], "t", "v", 600, 600, 0)
        windows.run(spark.readStream.schema(schema).parquet(src), str(tmp_path / "ckpt"))
        return sorted(r.rows for r in windows.windows().collect()), windows.late().count()

    assert run([0, 1, 15]) == ([1, 2], 0)
    assert run([2, 16]) == ([2, 2], 1)
