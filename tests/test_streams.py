import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from millrace.operators.history import live_spans
from millrace.operators.words import tokenize, top_word, word_count
from millrace.sources.json import json_scan
from millrace.streaming.heartbeats import LOCAL_MERGE, expire_stream
from millrace.streaming.runner import StreamRunner, append_to
from millrace.streaming.words import WORD_SCHEMA, filter_stream, ingest_words, run_word_app

LINES = ["the quick brown fox", "jumped over the lazy dog", "", "the end"]


@pytest.fixture
def lines(spark, tmp_path):
    src = str(tmp_path / "src")
    df = spark.createDataFrame([(x,) for x in LINES], "line string").repartition(3)
    df.write.parquet(src)
    return spark.readStream.schema("line string").option("maxFilesPerTrigger", 1).parquet(src)


def test_ingest_then_top_word(spark, lines, tmp_path):
    got = run_word_app(spark, lines, "line", str(tmp_path / "work"))
    assert tuple(got.first()) == ("the", 3)


def test_restart_adds_nothing_twice(spark, lines, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    for _ in range(2):
        ingest_words(lines, "line", out, checkpoint)
    static = tokenize(spark.createDataFrame([(x,) for x in LINES], "line string"), "line")
    words = json_scan(spark, out, WORD_SCHEMA)
    assert sorted(map(tuple, word_count(words).collect())) == sorted(map(tuple, word_count(static).collect()))


def test_interval_and_timeout(spark, lines, tmp_path):
    out = str(tmp_path / "out")
    start = time.time()
    ingest_words(lines, "line", out, str(tmp_path / "checkpoint"), interval_ms=200, timeout_s=6)
    assert time.time() - start < 30
    assert not spark.streams.active
    assert top_word(json_scan(spark, out, WORD_SCHEMA)).first().word == "the"


def test_stop_lets_the_running_batch_end(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    spark.range(40).repartition(8).write.parquet(src)
    stream = spark.readStream.schema("id long").parquet(src)

    @F.udf("long")
    def slowly(x):
        time.sleep(0.4)
        return x

    runner = StreamRunner(spark).create(interval_ms=50)
    query = runner.run(append_to(stream.select(slowly("id").alias("id")), "parquet", out, str(tmp_path / "checkpoint")), 0.5)
    while not query.status["isTriggerActive"]:
        time.sleep(0.05)
    runner.stop()
    assert not query.isActive and query.exception() is None
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == list(range(40))


def test_filter(spark, lines, tmp_path):
    out = str(tmp_path / "out")
    filter_stream(lines, "line", "fox", out, str(tmp_path / "checkpoint"))
    assert [r.line for r in spark.read.parquet(out).collect()] == ["the quick brown fox"]


def test_lifecycle(spark, lines, tmp_path):
    runner = StreamRunner(spark)
    with pytest.raises(RuntimeError):
        runner.stop()
    with pytest.raises(RuntimeError):
        _ = runner.trigger
    runner.create()
    with pytest.raises(RuntimeError):
        runner.create()
    runner.stop()
    with pytest.raises(RuntimeError):
        runner.stop()
    runner.create(interval_ms=100)
    start = append_to(lines, "parquet", str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    assert runner.run(start, timeout_s=1).isActive
    runner.stop()
    assert not spark.streams.active
    assert spark.range(3).count() == 3


def test_expired_spans_match_the_batch_form(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    beats = [(k, start + dt.timedelta(seconds=(i * i * (k + 3)) % 4000)) for k in range(3) for i in range(80)]
    beats += [(9, start), (9, start + dt.timedelta(seconds=60))]
    df = spark.createDataFrame(beats, "key int, ts timestamp")
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    df.write.parquet(src)
    stream = spark.readStream.schema("key int, ts timestamp").parquet(src)
    before = spark.conf.get(LOCAL_MERGE, "false")
    expire_stream(stream, "key", "ts", 60, 300, out, str(tmp_path / "checkpoint"))
    assert spark.conf.get(LOCAL_MERGE, "false") == before
    seen = df.agg(F.max("ts")).first()[0] - dt.timedelta(seconds=300)
    want = live_spans(df, "key", "ts", 60).filter(F.col("expires_at") <= F.lit(seen))
    cols = ["key", "first_beat", "expires_at", "beats"]
    got = spark.read.parquet(out).select(cols)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(cols).collect()))
    assert got.count() > 3
