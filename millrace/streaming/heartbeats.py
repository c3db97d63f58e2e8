"""Expiry of keys whose heartbeats stop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from millrace.streaming.runner import StreamRunner, append_to

LOCAL_MERGE = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"


def expirations(beats: DataFrame, key: str, ts: str, timeout_s: int, delay_s: int) -> DataFrame:
    """``key, first_beat, expires_at, beats`` for each span of a stream that ended: no beat came
    within the timeout, and the watermark (``delay_s`` behind the latest beat) has passed its end.

    ``ts`` must be a timestamp (not NTZ).
    """
    spans = beats.withWatermark(ts, f"{delay_s} seconds").groupBy(
        key, F.session_window(ts, f"{timeout_s} seconds").alias("_span")
    )
    return spans.agg(F.count(F.lit(1)).alias("beats")).select(
        key,
        F.col("_span.start").alias("first_beat"),
        F.col("_span.end").alias("expires_at"),
        "beats",
    )


def expire_stream(
    beats: DataFrame, key: str, ts: str, timeout_s: int, delay_s: int, out: str, checkpoint: str
) -> None:
    """Append the spans that ended to a parquet dataset.

    Beats are merged into spans in the map tasks before the shuffle, so a key with many beats sends
    spans, not beats.
    """
    spark = beats.sparkSession
    runner = StreamRunner(spark).create()
    begin = append_to(expirations(beats, key, ts, timeout_s, delay_s), "parquet", out, checkpoint)

    def start(trigger: dict) -> StreamingQuery:
        # A query keeps the settings it starts with, so others do not see this one while it runs.
        before = spark.conf.get(LOCAL_MERGE, "false")
        spark.conf.set(LOCAL_MERGE, "true")
        try:
            return begin(trigger)
        finally:
            spark.conf.set(LOCAL_MERGE, before)

    try:
        runner.run(start)
    finally:
        runner.stop()
