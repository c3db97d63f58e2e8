"""Folds with kept state against the fold over all rows at once."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators.history import accepted_session_states
from millrace.streaming.states import EXPIRED, run_states, session_states

SCHEMA = "k int, t timestamp, id bigint, state string"
STATES = ["starting", "idle", "busy", "error", "success", "dead", "shutting_down", None, "unheard"]


def at(second):
    return dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc) + dt.timedelta(seconds=second)


def runs(spark, tmp_path, batches, **settings):
    """Each batch in a run of its own, so that states come back from the checkpoint."""
    src, out, ckpt = (str(tmp_path / n) for n in ("src", "out", "ckpt"))
    for rows in batches:
        data = [(k, None if s is None else at(s), i, state) for k, s, i, state in rows]
        spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(src)
        changes = session_states(spark.readStream.schema(SCHEMA).parquet(src), "k", "t", "id", **settings)
        run_states(changes, out, ckpt)
    rows = spark.read.schema(changes.schema).parquet(out).collect()
    return sorted(((r.k, int(r.t.replace(tzinfo=dt.timezone.utc).timestamp() - at(0).timestamp()), r.id, r.state, r.late) for r in rows), key=repr)


def test_batches_give_what_all_rows_give(spark, tmp_path):
    draw = random.Random(3)
    rows = [(draw.choice([1, 1, 2, 3, 4, 5]), i // 3, i, draw.choice(STATES)) for i in range(400)] + [(None, 1, 1, "busy"), (6, None, 2, "busy")]
    ordered = sorted(rows, key=lambda r: (r[1] is None, r[1] or 0))
    batches = [ordered[i : i + 135] for i in range(0, len(ordered), 135)]
    for b in batches:
        draw.shuffle(b)
    got = runs(spark, tmp_path, batches)
    data = [(k, at(s), i, state) for k, s, i, state in rows if s is not None and k is not None]
    want = accepted_session_states(spark.createDataFrame(data, SCHEMA), ["k"], ["t", "id"]).select("k", "id", "state").collect()
    assert sorted((k, i, state) for k, _, i, state, late in got if not late) == sorted(map(tuple, want))
    # Batches are cut within a second, so a few rows come after later ones of the same second.
    assert sum(late for *_, late in got) <= 4


def test_a_row_before_one_that_was_taken_is_late(spark, tmp_path):
    got = runs(spark, tmp_path, [[(1, 10, 5, "busy")], [(1, 9, 9, "idle"), (1, 10, 4, "idle"), (1, 10, 6, "idle")], []])
    assert got == sorted([(1, 10, 5, "busy", False), (1, 9, 9, "idle", True), (1, 10, 4, "idle", True), (1, 10, 6, "idle", False)], key=repr)


def test_silent_keys_expire(spark, tmp_path):
    """By the watermark, or by the key's own next row; a row at the deadline itself still counts."""
    batches = [
        [(1, 0, 1, "success"), (1, 60, 2, "busy"), (1, 121, 3, "busy"), (2, 0, 4, "busy")],
        [(3, 1000, 5, "idle")],
        [(3, 1001, 6, "idle"), (2, 1002, 7, "busy")],
    ]
    got = runs(spark, tmp_path, batches, timeout_s=60, delay_s=10)
    changes = [r for r in got if r[3] != EXPIRED]
    assert [r[:4] for r in changes] == sorted([(1, 0, 1, "success"), (1, 121, 3, "busy"), (2, 0, 4, "busy"), (3, 1000, 5, "idle"), (2, 1002, 7, "busy")], key=repr)
    assert {(1, 120), (1, 181), (2, 60)} == {r[:2] for r in got if r[3] == EXPIRED}
