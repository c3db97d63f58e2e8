"""Queries that join histories by time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.history import live_spans
from millrace.operators.temporal import asof_join, overlap_join
from millrace.queries.history import SPANS_SQL
from millrace.queries.registry import query
from millrace.tables import table


def _events(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").filter(F.col("event_type") == kind)
    return rows.select("event_id", "user_id", "ts", "value")


def _nearest_sql(of: str, kind: str, join: str, order: str) -> str:
    return f"""
    SELECT e.event_id, e.user_id, e.ts, e.value, o.event_id AS other_id, o.ts AS other_ts
    FROM (SELECT * FROM events WHERE event_type = '{of}') e
    LEFT JOIN (SELECT * FROM events WHERE event_type = '{kind}') o ON e.user_id = o.user_id AND {join}
    QUALIFY row_number() OVER (PARTITION BY e.event_id ORDER BY {order}) = 1
    """


@query(
    "latest_view",
    _nearest_sql(
        "purchase", "view", "o.ts <= e.ts AND o.ts >= e.ts - INTERVAL 1 DAY", "o.ts DESC NULLS LAST, o.event_id DESC"
    ),
)
def latest_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases with the user's latest view of the last day."""
    views = _events(spark, sf_dir, "view")
    taken = {"other_id": "event_id", "other_ts": "ts"}
    return asof_join(_events(spark, sf_dir, "purchase"), views, ["user_id"], "ts", "ts", taken, tolerance_s=86_400)


@query("next_purchase", _nearest_sql("click", "purchase", "o.ts > e.ts", "o.ts NULLS LAST, o.event_id DESC"))
def next_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks with the user's first purchase after them."""
    bought = _events(spark, sf_dir, "purchase")
    taken = {"other_id": "event_id", "other_ts": "ts"}
    clicks = _events(spark, sf_dir, "click")
    return asof_join(clicks, bought, ["user_id"], "ts", "ts", taken, direction="forward", exact=False)


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live_spans(table(spark, sf_dir, "events").select("user_id", "ts"), "user_id", "ts", 1800)


@query(
    "errors_in_spans",
    f"""
    SELECT s.*, e.event_id, e.ts FROM ({SPANS_SQL}) s
    JOIN events e ON e.user_id = s.user_id AND e.event_type = 'error' AND e.ts BETWEEN s.first_beat AND s.expires_at
    """,
)
def errors_in_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live spans with the errors in them."""
    errors = _events(spark, sf_dir, "error")
    span = ("first_beat", "expires_at")
    return overlap_join(_spans(spark, sf_dir), errors, ["user_id"], span, ("ts", "ts"), {"event_id": "event_id", "ts": "ts"})


@query(
    "spans_at_once",
    f"""
    WITH s AS ({SPANS_SQL})
    SELECT a.user_id, a.first_beat, count(*) AS others, max(least(a.expires_at, b.expires_at)) AS latest
    FROM s a JOIN s b ON a.user_id <> b.user_id AND a.first_beat < b.expires_at AND b.first_beat < a.expires_at
    GROUP BY a.user_id, a.first_beat
    """,
)
def spans_at_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many spans of other users each live span overlaps, and until when."""
    spans, span = _spans(spark, sf_dir), ("first_beat", "expires_at")
    pairs = overlap_join(
        spans, spans, [], span, span, closed=False, apart=("user_id", "user_id"), per=["user_id", "first_beat"]
    )
    return pairs.select("user_id", "first_beat", F.col("pairs").alias("others"), F.col("until").alias("latest"))
