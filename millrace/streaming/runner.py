"""The life of one stream inside a session."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery


class StreamRunner:
    """Starts and stops one streaming query at a time; the session stays alive.

    Creating twice, or reading or stopping before creating, is an error; create, stop and create
    again works.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._trigger: dict | None = None
        self._query: StreamingQuery | None = None

    def create(self, interval_ms: int | None = None) -> StreamRunner:
        """Open the stream: a batch every ``interval_ms``, or all available input once if None."""
        if self._trigger is not None:
            raise RuntimeError("a stream is already created")
        self._trigger = (
            {"availableNow": True}
            if interval_ms is None
            else {"processingTime": f"{interval_ms} milliseconds"}
        )
        return self

    @property
    def trigger(self) -> dict:
        if self._trigger is None:
            raise RuntimeError("no stream is created")
        return self._trigger

    def run(
        self, start: Callable[[dict], StreamingQuery], timeout_s: float | None = None
    ) -> StreamingQuery:
        """Start a query with the stream's trigger, then wait for its end or the timeout."""
        self._query = start(self.trigger)
        if timeout_s is None:
            self._query.awaitTermination()
        else:
            self._query.awaitTermination(timeout_s)
        return self._query

    def stop(self, patience_s: float = 600) -> None:
        """Stop the query once the batch it is in has ended, or after ``patience_s`` in any case; the next one
        resumes from its checkpoint."""
        _ = self.trigger
        query = self._query
        if query is not None and query.isActive:
            until = time.monotonic() + patience_s
            while query.isActive and query.status["isTriggerActive"] and time.monotonic() < until:
                query.awaitTermination(0.05)
            query.stop()
        self._query = self._trigger = None


def append_to(
    df: DataFrame, fmt: str, path: str, checkpoint: str
) -> Callable[[dict], StreamingQuery]:
    """A file sink for :meth:`StreamRunner.run`. Files of a failed batch are not seen by readers."""

    def start(trigger: dict) -> StreamingQuery:
        writer = df.writeStream.format(fmt).outputMode("append")
        return (
            writer.option("path", path)
            .option("checkpointLocation", checkpoint)
            .trigger(**trigger)
            .start()
        )

    return start
