"""Words of a stream of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.operators.words import lines_with, tokenize, top_word
from millrace.sources.json import json_scan
from millrace.streaming.runner import StreamRunner, append_to

WORD_SCHEMA = "word string"


def ingest_words(
    lines: DataFrame,
    col: str,
    out: str,
    checkpoint: str,
    interval_ms: int | None = None,
    timeout_s: float | None = None,
) -> None:
    """Append the words of a stream of lines to a JSON dataset, batch by batch, and stop."""
    runner = StreamRunner(lines.sparkSession).create(interval_ms)
    try:
        runner.run(append_to(tokenize(lines, col), "json", out, checkpoint), timeout_s)
    finally:
        runner.stop()


def filter_stream(
    lines: DataFrame, col: str, keyword: str, out: str, checkpoint: str
) -> None:
    """Append the lines with a keyword to a parquet dataset."""
    runner = StreamRunner(lines.sparkSession).create()
    try:
        runner.run(append_to(lines_with(lines, col, keyword), "parquet", out, checkpoint))
    finally:
        runner.stop()


def run_word_app(spark: SparkSession, lines: DataFrame, col: str, work: str) -> DataFrame:
    """Both stages of the word example: ingest the stream, then find the top word of the dataset."""
    ingest_words(lines, col, f"{work}/words", f"{work}/checkpoint")
    return top_word(json_scan(spark, f"{work}/words", WORD_SCHEMA))
