"""Queries over state histories. Events of a user stand for the history of a session."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.codes import map_codes
from millrace.operators.aggregates import latest_by
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
from millrace.queries.registry import query
from millrace.tables import table

ORDER = ["ts", "event_id"]

# Test mappings from event types to states. A share of the session and statement rows has no state, and one type
# of event has a state that sessions and statements do not know.
SESSION = {"signup": "starting", "view": "idle", "click": "busy", "purchase": "success", "error": "error"}
STATEMENT = {
    "signup": "waiting",
    "view": "running",
    "click": "available",
    "error": "cancelling",
    "purchase": "cancelled",
}
JOB = {"signup": "SENT", "view": "QUEUED", "click": "STARTED", "error": "FAILED", "purchase": "SUCCEEDED"}
SERVER = {"signup": "starting", "view": "running", "click": "running", "purchase": "success", "error": "error"}


ODD_SESSION = {**SESSION, "signup": "hibernating"}
ODD_STATEMENT = {**STATEMENT, "signup": "lost"}


def _case(mapping: Mapping[str, str]) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"CASE event_type {whens} END"


def odd_case(mapping: Mapping[str, str]) -> str:
    return f"CASE WHEN event_id % 7 <> 3 THEN {_case(mapping)} END"


def odd_states(spark: SparkSession, sf_dir: str, mapping: Mapping[str, str]) -> DataFrame:
    known = F.when(F.col("event_id") % 7 != 3, F.col("state"))
    return states(spark, sf_dir, mapping).withColumn("state", known)


def states(spark: SparkSession, sf_dir: str, mapping: Mapping[str, str]) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", map_codes(F.col("event_type"), mapping).alias("state")
    )


@query(
    "statement_sequence",
    "SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS id FROM events",
)
def statement_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    return number_rows(events, "user_id", ORDER).drop("ts")


@query(
    "transition_check",
    f"""
    WITH h AS (
        SELECT event_id, user_id, {odd_case(ODD_STATEMENT)} AS state, ts FROM events),
    steps AS (
        SELECT *, lag(state) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_state FROM h
        WHERE state IS NOT NULL)
    SELECT event_id, user_id, from_state, state FROM steps
    WHERE from_state IS NOT NULL AND NOT (
        (from_state = 'waiting' AND state IN ('running', 'cancelled'))
        OR (from_state = 'running' AND state IN ('available', 'cancelling'))
        OR (from_state = 'cancelling' AND state = 'cancelled'))
    """,
)
def transition_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return illegal_transitions(odd_states(spark, sf_dir, ODD_STATEMENT), "user_id", ORDER).drop("ts")


@query(
    "job_state_fold",
    f"""
    WITH h AS (
        SELECT event_id, user_id, ts, CAST(ts AS DATE) AS day, {_case(JOB)} AS state,
            CASE event_type WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2
                WHEN 'error' THEN 4 ELSE 5 END AS ord FROM events),
    f AS (
        SELECT *, coalesce(max(ord) OVER (PARTITION BY user_id, day ORDER BY ts, event_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cur FROM h)
    SELECT event_id, user_id, day, state FROM f WHERE cur < 3 AND ord > cur
    """,
)
def job_state_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = states(spark, sf_dir, JOB).withColumn("day", F.to_date("ts"))
    return accepted_job_states(days, ["user_id", "day"], ORDER).drop("ts")


@query(
    "session_state_fold",
    f"""
    WITH h AS (
        SELECT * FROM (SELECT event_id, user_id, ts, CAST(ts AS DATE) AS day, {odd_case(ODD_SESSION)} AS state
            FROM events) WHERE state IN ('idle', 'busy', 'success', 'error')),
    e AS (
        SELECT *, coalesce(max(CASE WHEN state = 'success' THEN 1 ELSE 0 END)
            OVER (PARTITION BY user_id, day ORDER BY ts, event_id
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM h),
    c AS (
        SELECT *, coalesce(lag(state) OVER (PARTITION BY user_id, day ORDER BY ts, event_id),
            'starting') AS before FROM e WHERE state = 'success' OR ended = 0)
    SELECT event_id, user_id, day, state FROM c WHERE state <> before
    """,
)
def session_state_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = odd_states(spark, sf_dir, ODD_SESSION).withColumn("day", F.to_date("ts"))
    return accepted_session_states(days, ["user_id", "day"], ORDER).drop("ts")


@query(
    "effective_state",
    f"""
    WITH server AS (
        SELECT user_id, {_case(SERVER)} AS state FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1),
    repl AS (
        SELECT user_id, {_case(SESSION)} AS state FROM events
        WHERE event_type IN ('view', 'click') AND value > 250
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
    SELECT server.user_id, CASE WHEN server.state = 'running' THEN coalesce(repl.state, 'busy')
        ELSE server.state END AS state
    FROM server LEFT JOIN repl ON server.user_id = repl.user_id
    """,
)
def effective_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value")
    kind = F.col("event_type")
    server = events.withColumn("state", map_codes(kind, SERVER))
    repl = events.filter(kind.isin("view", "click") & (F.col("value") > 250)).withColumn(
        "state", map_codes(kind, SESSION)
    )
    return effective_state(
        latest_by(server, "user_id", ORDER, "state"), latest_by(repl, "user_id", ORDER, "state"), "user_id"
    )


@query(
    "idle_expiry",
    f"""
    WITH last AS (
        SELECT user_id, {_case(SESSION)} AS state, ts AS last_activity FROM events
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
    SELECT * FROM last WHERE CASE WHEN state IN ('error', 'dead', 'success')
        THEN TIMESTAMP '2024-01-31 00:00:00' - last_activity > INTERVAL 600 SECOND
        ELSE user_id % 2 <> 0
            AND TIMESTAMP '2024-01-31 00:00:00' - last_activity > INTERVAL 3600 SECOND END
    """,
)
def idle_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    batch = F.col("user_id") % 2 == 0
    return expired(states(spark, sf_dir, SESSION), "user_id", "ts", ORDER, now, batch)


SPANS_SQL = """
    WITH g AS (
        SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w > INTERVAL 30 MINUTE
            THEN 1 ELSE 0 END AS fresh
        FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (
        SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS span FROM g)
    SELECT user_id, min(ts) AS first_beat, max(ts) + INTERVAL 30 MINUTE AS expires_at,
        count(*) AS beats
    FROM s GROUP BY user_id, span
"""


# Some users never beat, and a share of the others' rows has no time either.
_SILENT_SQL = """
    WITH beats AS (
        SELECT user_id, CASE WHEN user_id % 10 <> 4 AND event_id % 7 <> 3 THEN ts END AS ts, event_id FROM events)
    SELECT * FROM (
"""


@query(
    "heartbeat_spans",
    _SILENT_SQL
    + SPANS_SQL.replace("FROM events", "FROM (SELECT * FROM beats WHERE ts IS NOT NULL)")
    + """) UNION ALL
    SELECT user_id, NULL, NULL, 0 FROM beats GROUP BY user_id HAVING count(ts) = 0
    """,
)
def heartbeat_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    beating = (F.col("user_id") % 10 != 4) & (F.col("event_id") % 7 != 3)
    beats = table(spark, sf_dir, "events").select("user_id", F.when(beating, F.col("ts")).alias("ts"))
    return live_spans(beats, "user_id", "ts", 1800)


@query(
    "terminal_once",
    f"""
    SELECT event_id, user_id, {_case(JOB)} AS state,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1 AS delivered
    FROM events WHERE event_type IN ('error', 'purchase')
    """,
)
def terminal_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    final = F.col("state").isin("CANCELLED", "FAILED", "SUCCEEDED")
    return first_terminal(states(spark, sf_dir, JOB), "user_id", ORDER, final).drop("ts")
