"""Queries that run a stream over a table's files to its end and read what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.codes import map_codes
from millrace.operators.words import word_count
from millrace.queries.aggregates import TOP_WORD_SQL, WORD_COUNT_SQL
from millrace.queries.history import ODD_SESSION, SPANS_SQL, odd_case
from millrace.queries.registry import query
from millrace.scratch import scratch_path
from millrace.sources.json import json_scan
from millrace.streaming.heartbeats import expire_stream
from millrace.streaming.states import run_states, session_states
from millrace.streaming.windows import LateWindows, run_to_files, running_word_counts, within
from millrace.streaming.words import WORD_SCHEMA, filter_stream, ingest_words, run_word_app
from millrace.tables import table, table_stream

# Large enough to keep a cluster busy, small enough to repeat.
FILES_PER_BATCH = 10_000


@query("stream_word_ingest", WORD_COUNT_SQL)
def stream_word_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = scratch_path(spark, "ingest")
    lines = table_stream(spark, sf_dir, "documents", FILES_PER_BATCH)
    ingest_words(lines, "text", f"{work}/words", f"{work}/checkpoint")
    return word_count(json_scan(spark, f"{work}/words", WORD_SCHEMA))


@query(
    "stream_keyword_filter",
    "SELECT doc_id, source, text FROM documents WHERE contains(text, 'The')",
)
def stream_keyword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = scratch_path(spark, "filter")
    lines = table_stream(spark, sf_dir, "documents", FILES_PER_BATCH).select(
        "doc_id", "source", "text"
    )
    filter_stream(lines, "text", "The", f"{work}/lines", f"{work}/checkpoint")
    return spark.read.schema(lines.schema).parquet(f"{work}/lines")


@query("stream_then_top_word", TOP_WORD_SQL)
def stream_then_top_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table_stream(spark, sf_dir, "documents", FILES_PER_BATCH)
    return run_word_app(spark, lines, "text", scratch_path(spark, "word-app"))


_DELAY_S = 600


@query(
    "stream_heartbeat_expiry",
    f"""
    SELECT * FROM ({SPANS_SQL})
    WHERE expires_at <= (SELECT max(ts) FROM events) - INTERVAL {_DELAY_S} SECOND
    """,
)
def stream_heartbeat_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = scratch_path(spark, "expiry")
    # Watermarks need a zoned timestamp. Both casts use the session's zone, so they cancel out.
    beats = table_stream(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    expire_stream(beats, "user_id", "ts", 1800, _DELAY_S, f"{work}/spans", f"{work}/checkpoint")
    spans = spark.read.parquet(f"{work}/spans")
    return spans.select(
        "user_id",
        F.col("first_beat").cast("timestamp_ntz").alias("first_beat"),
        F.col("expires_at").cast("timestamp_ntz").alias("expires_at"),
        "beats",
    )


@query("stream_word_totals", WORD_COUNT_SQL)
def stream_word_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts kept up to date by batches; equal to counting all words at once."""
    work = scratch_path(spark, "totals")
    lines = table_stream(spark, sf_dir, "documents", FILES_PER_BATCH).select("text")
    return running_word_counts(lines, "text", f"{work}/counts", f"{work}/checkpoint").total()


@query(
    "stream_view_to_purchase",
    """
    SELECT v.event_id, v.user_id, v.ts, p.event_id AS purchase_id, p.ts AS purchase_ts
    FROM events v JOIN events p ON p.user_id = v.user_id AND p.ts >= v.ts AND p.ts <= v.ts + INTERVAL 1 HOUR
    WHERE v.event_type = 'view' AND p.event_type = 'purchase'
    """,
)
def stream_view_to_purchase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views followed by a purchase of the same user within an hour, as two streams joined."""
    work = scratch_path(spark, "follow")

    def kind(name: str) -> DataFrame:
        rows = table_stream(spark, sf_dir, "events").filter(F.col("event_type") == name)
        return rows.select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))

    taken = {"purchase_id": "event_id", "purchase_ts": "ts"}
    pairs = within(kind("view"), kind("purchase"), ["user_id"], "ts", "ts", taken, 3600, _DELAY_S, _DELAY_S)
    run_to_files(pairs, f"{work}/pairs", f"{work}/checkpoint")
    found = spark.read.schema(pairs.schema).parquet(f"{work}/pairs")
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("ts", "purchase_ts")})


# One event in ten arrives three days after its time; batches are weeks of arrival.
_ARRIVALS_SQL = """
    WITH arrived AS (
        SELECT event_id, event_type, ts,
            CAST(floor(epoch(ts + CASE WHEN event_id % 10 = 0 THEN INTERVAL 3 DAY ELSE INTERVAL 0 DAY END - TIMESTAMP '2024-01-01') / 604800) AS BIGINT) AS batch
        FROM events),
    marks AS (SELECT batch, max(ts) AS latest FROM arrived GROUP BY batch),
    told AS (
        SELECT a.*, (SELECT max(latest) FROM marks m WHERE m.batch < a.batch) - INTERVAL 1 DAY AS watermark,
            time_bucket(INTERVAL 12 HOUR, ts) AS slot
        FROM arrived a)
"""


def _late_windows(spark: SparkSession, sf_dir: str) -> LateWindows:
    events = table(spark, sf_dir, "events").select("event_id", "event_type", "ts", "value")
    lag = F.when(F.col("event_id") % 10 == 0, F.expr("INTERVAL 3 DAY")).otherwise(F.expr("INTERVAL 0 DAY"))
    week = F.floor(F.date_diff((F.col("ts") + lag).cast("date"), F.lit("2024-01-01").cast("date")) / 7)
    arrived = events.withColumn("week", week)
    rows = arrived.drop("week")
    windows = LateWindows(spark, scratch_path(spark, "late"), rows, ["event_type"], "ts", "value", 86_400, 43_200, 86_400)
    for batch in [r.week for r in arrived.select("week").distinct().orderBy("week").collect()]:
        windows.add(arrived.filter(F.col("week") == batch).drop("week"), batch)
    return windows


@query(
    "late_windows",
    f"""
    {_ARRIVALS_SQL}
    SELECT event_type, start, start + INTERVAL 1 DAY AS stop, count(*) AS rows
    FROM (SELECT *, unnest([slot, slot - INTERVAL 12 HOUR]) AS start FROM told)
    WHERE watermark IS NULL OR start + INTERVAL 1 DAY > watermark
    GROUP BY event_type, start
    """,
)
def late_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliding windows of a day over events that arrive in weekly batches."""
    return _late_windows(spark, sf_dir).windows().select("event_type", "start", "stop", "rows")


@query(
    "late_rows",
    f"{_ARRIVALS_SQL} SELECT event_id, event_type, ts FROM told WHERE slot + INTERVAL 1 DAY <= watermark",
)
def late_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that arrive after all their windows have closed."""
    return _late_windows(spark, sf_dir).late().select("event_id", "event_type", "ts")


@query(
    "stream_session_states",
    f"""
    WITH h AS (
        SELECT * FROM (SELECT event_id, user_id, ts, {odd_case(ODD_SESSION)} AS state FROM events)
        WHERE state IN ('idle', 'busy', 'success', 'error')),
    e AS (
        SELECT *, coalesce(max(CASE WHEN state = 'success' THEN 1 ELSE 0 END)
            OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM h),
    c AS (
        SELECT *, coalesce(lag(state) OVER (PARTITION BY user_id ORDER BY ts, event_id), 'starting') AS before
        FROM e WHERE state = 'success' OR ended = 0)
    SELECT user_id, ts, event_id AS id, state, false AS late FROM c WHERE state <> before
    """,
)
def stream_session_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The session fold as a stream that keeps a state for each user."""
    work = scratch_path(spark, "states")
    rows = table_stream(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_id") % 7 != 3, map_codes(F.col("event_type"), ODD_SESSION)).alias("state"),
    )
    changes = session_states(rows, "user_id", "ts", "event_id")
    run_states(changes, f"{work}/changes", f"{work}/checkpoint")
    return spark.read.schema(changes.schema).parquet(f"{work}/changes").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
