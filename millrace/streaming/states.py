"""Folds over state histories as streams: what a key's rows so far leave behind is kept between batches."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from millrace.functions.codes import is_active
from millrace.functions.instants import instant
from millrace.streaming.runner import StreamRunner, append_to

# The processor travels to the executors with its job, which need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
EXPIRED = "expired"
_OUT = "us bigint, id bigint, state string, late boolean"


class SessionStates(StatefulProcessor):
    """Takes the changes of a session's state as :func:`millrace.operators.history.accepted_session_states` does, batch by batch.

    Kept for each key: the state, whether it has ended, and the place of the last row. With a timeout, a key that is silent for
    longer expires: its state is forgotten, and its next row starts anew.
    """

    def __init__(self, key: str, initial: str, timeout_us: int | None) -> None:
        self.key, self.initial, self.timeout_us = key, initial, timeout_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.current = handle.getValueState("current", "state string, ended boolean, us bigint, id bigint")

    def _frame(self, key, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["us", "id", "state", "late"])
        out["id"] = out["id"].astype("Int64")
        out.insert(0, self.key, pd.Series([key[0]] * len(out), dtype=object))
        return out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["us", "id"])
        fresh = (self.initial, False, None, None)
        state, ended, last, last_id = tuple(self.current.get()) if self.current.exists() else fresh
        before, out = last, []
        for us, id_, new, active in zip(*[batch[c].tolist() for c in ("us", "id", "state", "active")]):
            if last is not None and (us, id_) < (last, last_id):
                out.append((us, id_, new, True))
                continue
            if self.timeout_us is not None and last is not None and us - last > self.timeout_us:
                out.append((last + self.timeout_us, None, EXPIRED, False))
                state, ended = fresh[:2]
            last, last_id = us, id_
            if new != state and not (ended and active):
                state, ended = new, not active
                out.append((us, id_, new, False))
        self.current.update((state, ended, last, last_id))
        if self.timeout_us is not None and last != before:
            if before is not None:
                self.handle.deleteTimer(self._due(before))
            self.handle.registerTimer(self._due(last))
        yield self._frame(key, out)

    def _due(self, us: int) -> int:
        """The first millisecond strictly past the deadline."""
        return (us + self.timeout_us) // 1000 + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.current.exists():
            last = self.current.get()[2]
            # A timer of a row that another has followed is of no account.
            if self._due(last) == expiredTimerInfo.getExpiryTimeInMs():
                out.append((last + self.timeout_us, None, EXPIRED, False))
                self.current.clear()
        yield self._frame(key, out)

    def close(self) -> None:
        pass


def session_states(
    rows: DataFrame,
    key: str,
    ts: str,
    id_col: str,
    state: str = "state",
    initial: str = "starting",
    timeout_s: int | None = None,
    delay_s: int = 0,
) -> DataFrame:
    """``key, ts, id, state, late`` for each change that a session takes; ``ts`` must be a timestamp with zone.

    Rows of a batch are taken in order of ``ts`` and id, so a stream whose batches come in order of time gives what the batch
    operator gives for all rows. A row before one that an earlier batch has taken cannot change what was told: it is told as
    ``late`` and takes no part. Rows without key, time, id or a known state change nothing and are left out.

    With ``timeout_s`` a key expires when the watermark, ``delay_s`` behind the latest row, or its own next row is past its
    last row by more: that is told as a row with state ``expired`` and no id. Rows behind the watermark are dropped then.

    A task holds the rows of one key in one batch; bound these by the size of batches. What is kept for a key is four values.
    """
    known = rows.withColumn("active", is_active(F.col(state))).dropna(subset=[key, ts, id_col, "active"])
    if timeout_s is not None:
        known = known.withWatermark(ts, f"{delay_s} seconds")
    put = known.select(key, F.col(id_col).cast("bigint").alias("id"), F.col(state).alias("state"), "active", instant(rows, ts).alias("us"), *([ts] if timeout_s is not None else []))
    kind = rows.schema[key].dataType.simpleString()
    fold = SessionStates(key, initial, None if timeout_s is None else timeout_s * 1_000_000)
    mode = "None" if timeout_s is None else "EventTime"
    out = put.groupBy(key).transformWithStateInPandas(fold, f"{key} {kind}, {_OUT}", "Append", mode)
    return out.select(key, F.timestamp_micros("us").alias(ts), "id", "state", "late")


def run_states(df: DataFrame, out: str, checkpoint: str) -> None:
    """Run :func:`session_states` over what there is and append to parquet files; run again, it goes on with the states it kept."""
    spark = df.sparkSession
    runner = StreamRunner(spark).create()
    begin: Callable[[dict], StreamingQuery] = append_to(df, "parquet", out, checkpoint)

    def start(trigger: dict) -> StreamingQuery:
        # A query keeps the settings it starts with, so others do not see this one while it runs.
        before = spark.conf.get(STORE, None)
        spark.conf.set(STORE, ROCKS)
        try:
            return begin(trigger)
        finally:
            spark.conf.unset(STORE) if before is None else spark.conf.set(STORE, before)

    try:
        runner.run(start)
    finally:
        runner.stop()
