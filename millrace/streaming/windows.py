"""Event-time joins and windows over streams, with late rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from millrace.operators.words import tokenize
from millrace.sources.deltas import Deltas, summed
from millrace.streaming.runner import StreamRunner, append_to


def within(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    left_time: str,
    right_time: str,
    take: Mapping[str, str],
    within_s: int,
    left_delay_s: int,
    right_delay_s: int,
    how: str = "inner",
) -> DataFrame:
    """Rows of one stream with those of another of the same keys that come no earlier and at most ``within_s`` seconds later, with
    columns of ``right`` under the names in ``take``. With ``how="left"`` a row of ``left`` without any comes once it can have none any more.

    Both sides have a watermark, so each row waits in state only as long as rows that match may still come: a row of
    ``left`` for ``within_s`` and the delay of ``right``, one of ``right`` for the delay of ``left``. Rows later than the delay are dropped.
    Times must be timestamps with zone. Null keys or times match nothing.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"unsupported join type: {how}")
    a = left.withWatermark(left_time, f"{left_delay_s} seconds").alias("a")
    chosen = right.select(*[F.col(k).alias(f"_on_{k}") for k in on], F.struct(*[F.col(c).alias(n) for n, c in take.items()]).alias("_take"), F.col(right_time).alias("_then"))
    b = chosen.withWatermark("_then", f"{right_delay_s} seconds").alias("b")
    # A literal, by which Spark finds out how long a row may wait.
    reach = F.expr(f"INTERVAL {int(within_s)} SECONDS")
    cond = (F.col("_then") >= F.col(f"a.{left_time}")) & (F.col("_then") <= F.col(f"a.{left_time}") + reach)
    for k in on:
        cond = cond & (F.col(f"a.{k}") == F.col(f"_on_{k}"))
    return a.join(b, cond, "left_outer" if how == "left" else how).select("a.*", *[F.col(f"b._take.{name}") for name in take])


def run_to_files(df: DataFrame, out: str, checkpoint: str) -> None:
    """Run a stream over what there is and append its rows to parquet files. Run again, it goes on where it stopped."""
    runner = StreamRunner(df.sparkSession).create()
    try:
        runner.run(append_to(df, "parquet", out, checkpoint))
    finally:
        runner.stop()


class LateWindows:
    """Counts and sums of event-time windows, and the rows that came too late for theirs, under ``path``.

    A window is closed once the latest time of *earlier* batches is ``delay_s`` past its end; it takes no rows then, and a row that
    has none of its windows open goes to the late ones instead. So all rows with a time are either in windows or late.
    Windows are ``size_s`` long and start every ``slide_s``; a row that slides into several counts in those still open.

    Each batch writes its partial windows, its late rows and its latest time into folders of its own and replaces them
    when it is run again; the watermark comes from the batches before it, so a replay decides alike.
    """

    def __init__(self, spark: SparkSession, path: str, rows: DataFrame, keys: Sequence[str], ts: str, value: str, size_s: int, slide_s: int, delay_s: int) -> None:
        self.keys, self.ts, self.value = list(keys), ts, value
        self.size_s, self.slide_s, self.delay_s = size_s, slide_s, delay_s
        names = [*self.keys, "start", "stop"]
        empty = self._windows(rows.limit(0))
        kinds = {f.name: f.dataType for f in empty.schema.fields}
        self._counts = Deltas(spark, f"{path}/windows", empty.select(*names, "rows", "sum").schema, summed(names, "rows", "sum"))
        self._late = Deltas(spark, f"{path}/late", rows.schema, lambda late: late)
        self._marks = Deltas(spark, f"{path}/latest", f"latest {kinds['stop'].simpleString()}", lambda marks: marks)

    def _windows(self, rows: DataFrame) -> DataFrame:
        slots = rows.withColumn("_slot", F.window(self.ts, f"{self.size_s} seconds", f"{self.slide_s} seconds"))
        return (
            slots.groupBy(*self.keys, F.col("_slot.start").alias("start"), F.col("_slot.end").alias("stop"))
            .agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col(self.value).cast("double")).alias("sum"))
        )

    def add(self, rows: DataFrame, batch: int) -> None:
        """Take a batch. Rows without a time belong to no window and are left out."""
        # Folders of later batches may be there when an old one is run again.
        before = self._marks.rows(batch - 1).agg(F.max("latest")).first()[0]
        known = rows.filter(F.col(self.ts).isNotNull()).persist()
        self._marks.put(batch, known.agg(F.max(self.ts).alias("latest")))
        windows, late = self._windows(known), known.limit(0)
        if before is not None:
            watermark = F.lit(before) - F.make_dt_interval(secs=F.lit(self.delay_s))
            windows = windows.filter(F.col("stop") > watermark)
            # The last window of a row starts at or before it, on the grid of starts.
            told = known.withColumn("_start", F.window(self.ts, f"{self.slide_s} seconds").start)
            closes = F.col("_start") + F.make_dt_interval(secs=F.lit(self.size_s))
            late = told.filter(closes <= watermark).drop("_start")
        self._counts.put(batch, windows)
        self._late.put(batch, late)
        known.unpersist()

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        """Take all that a stream has, and go on from there when run again."""
        runner = StreamRunner(stream.sparkSession).create()

        def start(trigger: dict) -> StreamingQuery:
            writer = stream.writeStream.foreachBatch(self.add).option("checkpointLocation", checkpoint)
            return writer.trigger(**trigger).start()

        try:
            runner.run(start)
        finally:
            runner.stop()

    def windows(self) -> DataFrame:
        """``keys, start, stop, rows, sum``."""
        return self._counts.total()

    def late(self) -> DataFrame:
        """The late rows, with all their columns."""
        return self._late.total()


def running_word_counts(lines: DataFrame, col: str, path: str, checkpoint: str) -> Deltas:
    """Word counts of a stream of lines, kept up to date: run again, only new lines are read. Counts are made before they are
    written, so a batch writes words, not lines; a batch that is run twice counts once."""
    spark = lines.sparkSession
    counts = Deltas(spark, path, "word string, word_count bigint", summed(["word"], "word_count"))

    def add(rows: DataFrame, batch: int) -> None:
        words = tokenize(rows, col)
        counts.put(batch, words.groupBy("word").agg(F.count("word").alias("word_count")))

    runner = StreamRunner(spark).create()

    def start(trigger: dict) -> StreamingQuery:
        return lines.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**trigger).start()

    try:
        runner.run(start)
    finally:
        runner.stop()
    return counts
