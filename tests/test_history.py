"""Folds against a plain sequential fold, and the rules with their edge cases."""

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.functions.codes import (
    JOB_FINAL_FROM,
    JOB_STATES,
    SESSION_ACTIVE,
    STATEMENT_PREDECESSORS,
)
from millrace.operators.history import (
    accepted_job_states,
    accepted_session_states,
    effective_state,
    expired,
    first_terminal,
    illegal_transitions,
    live_spans,
    number_rows,
)

ORDER = ["id"]
FEW = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
NOW = dt.datetime(2024, 1, 2)


def histories(names):
    return st.lists(st.lists(st.sampled_from(names), max_size=40), min_size=1, max_size=8)


def frame(spark, seqs):
    rows = [(k, i * 10 + k, s) for k, seq in enumerate(seqs) for i, s in enumerate(seq)]
    return spark.createDataFrame(rows, "key int, id int, state string")


def rows_of(df):
    return sorted((r.key, r.id, r.state) for r in df.select("key", "id", "state").collect())


def fold(seqs, initial, step):
    out = []
    for k, seq in enumerate(seqs):
        current = initial
        for i, s in enumerate(seq):
            if step(current, s):
                current = s
                out.append((k, i * 10 + k, s))
    return sorted(out)


@FEW
@given(histories(JOB_STATES))
def test_job_fold(spark, seqs):
    def step(old, new):
        return JOB_STATES.index(new) > JOB_STATES.index(old) and JOB_STATES.index(old) < JOB_FINAL_FROM

    got = accepted_job_states(frame(spark, seqs), ["key"], ORDER)
    assert rows_of(got) == fold(seqs, "SENT", step)


@FEW
@given(histories([*SESSION_ACTIVE, "weird", None]), st.sampled_from([4, 1000]))
def test_session_fold(spark, seqs, chunk):
    def step(old, new):
        return new in SESSION_ACTIVE and old != new and not (not SESSION_ACTIVE[old] and SESSION_ACTIVE[new])

    got = accepted_session_states(frame(spark, seqs), ["key"], ORDER, rows_per_chunk=chunk)
    assert rows_of(got) == fold(seqs, "starting", step)


def test_session_fold_of_a_hot_key(skewed):
    """The chunked fold agrees with the fold in one piece."""
    whole = accepted_session_states(skewed, ["key"], ["t", "id"])
    cut = accepted_session_states(skewed, ["key"], ["t", "id"], rows_per_chunk=20)
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, cut.collect()))


@FEW
@given(histories([*STATEMENT_PREDECESSORS, "weird", None]), st.sampled_from([4, 1000]))
def test_illegal_transitions(spark, seqs, chunk):
    known = [[(i, s) for i, s in enumerate(seq) if s is not None] for seq in seqs]
    want = sorted(
        (k, i * 10 + k, s, before)
        for k, seq in enumerate(known)
        for (_, before), (i, s) in zip(seq, seq[1:])
        if before not in STATEMENT_PREDECESSORS.get(s, ())
    )
    got = illegal_transitions(frame(spark, seqs), "key", ORDER, rows_per_chunk=chunk)
    assert sorted(tuple(r) for r in got.select("key", "id", "state", "from_state").collect()) == want


def test_numbers_start_at_zero(spark):
    got = number_rows(frame(spark, [["a", "b", "c"], ["d"]]).withColumnRenamed("id", "at"), "key", ["at"])
    assert sorted((r.key, r.state, r.id) for r in got.collect()) == [
        (0, "a", 0), (0, "b", 1), (0, "c", 2), (1, "d", 0),
    ]


def test_effective_state(spark):
    server = spark.createDataFrame(
        [(1, "running"), (2, "running"), (3, "dead")], "key int, state string"
    )
    repl = spark.createDataFrame([(1, "idle"), (3, "busy")], "key int, state string")
    got = {r.key: r.state for r in effective_state(server, repl, "key").collect()}
    assert got == {1: "idle", 2: "busy", 3: "dead"}


def _expiry(spark, check):
    rows = []
    for key, (state, age_s, batch) in enumerate(
        [
            ("error", 601, False), ("dead", 601, True), ("success", 601, False), ("success", 600, True),
            ("idle", 3601, False), ("idle", 3600, False), ("idle", 99999, True), ("busy", 10, False),
        ]
    ):
        rows.append((key, 0, NOW - dt.timedelta(days=3), "starting", batch))
        rows.append((key, 1, NOW - dt.timedelta(seconds=age_s), state, batch))
    df = spark.createDataFrame(rows, "key int, id int, ts timestamp_ntz, state string, batch boolean")
    now = F.lit(NOW).cast("timestamp_ntz")
    got = expired(df, "key", "ts", ["ts", "id"], now, F.col("batch"), check=check)
    return sorted(r.key for r in got.collect())


def test_expiry(spark):
    assert _expiry(spark, True) == [0, 1, 2, 4]
    assert _expiry(spark, False) == [0, 1, 2]


@pytest.mark.parametrize("timeout", [60, 7])
def test_live_spans(spark, timeout):
    start = dt.datetime(2024, 1, 1)
    beats = [(k, start + dt.timedelta(seconds=(i * i * (k + 3)) % 2000)) for k in range(3) for i in range(90)]
    # Two beats exactly one timeout apart belong to one span.
    beats += [(9, start), (9, start + dt.timedelta(seconds=timeout))]
    want = []
    for k in {k for k, _ in beats}:
        span = []
        for t in [*sorted(t for j, t in beats if j == k), None]:
            if span and (t is None or t - span[-1] > dt.timedelta(seconds=timeout)):
                want.append((k, span[0], span[-1] + dt.timedelta(seconds=timeout), len(span)))
                span = []
            span.append(t)
    df = spark.createDataFrame(beats, "key int, ts timestamp_ntz")
    got = live_spans(df, "key", "ts", timeout).select("key", "first_beat", "expires_at", "beats")
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_a_key_that_never_beat_never_expires(spark):
    rows = [(1, None), (1, None), (2, None), (2, NOW)]
    df = spark.createDataFrame(rows, "key int, ts timestamp_ntz")
    got = {tuple(r) for r in live_spans(df, "key", "ts", 60).select("key", "first_beat", "expires_at", "beats").collect()}
    assert got == {(1, None, None, 0), (2, NOW, NOW + dt.timedelta(seconds=60), 1)}
    assert {r.key for r in live_spans(df, "key", "ts", 0).collect()} == {1, 2}


def test_timeout_zero_never_expires(spark):
    df = spark.createDataFrame([(1, NOW), (1, NOW + dt.timedelta(days=9))], "key int, ts timestamp_ntz")
    assert [tuple(r) for r in live_spans(df, "key", "ts", 0).collect()] == [(1, NOW, None, 2)]


@pytest.mark.parametrize("layout", [{}, {"rows_per_chunk": 20}])
def test_terminal_status_is_delivered_once(skewed, layout):
    ends = F.col("state").isin("dead", "success")
    got = first_terminal(skewed, "key", ["t", "id"], ends, **layout).collect()
    want = {}
    for r in skewed.filter(ends).collect():
        want.setdefault(r.key, []).append((r.t, r.id))
    assert len(got) == sum(map(len, want.values()))
    assert {(r.key, (r.t, r.id)) for r in got if r.delivered} == {(k, min(v)) for k, v in want.items()}
