import os

import pytest
from pyspark.sql import functions as F

import millrace.sources.word_codes as word_codes
from millrace.operators.paging import top_rows
from millrace.scratch import scratch_path
from millrace.sources.json import append_json, json_scan, nested_project
from millrace.sources.pairs import read_pairs, write_pairs
from millrace.sources.roundtrip import differences, roundtrip
from millrace.sources.shared import (
    module_udf,
    scale_by_file,
    scale_by_shipped_file,
    ship_file,
    ship_module,
)

TWEET = (
    '{"id":1,"text":"Adventures With Coffee, Code, and Writing.","retweetCount":0,"hashtagEntities":[],'
    '"user":{"id":7,"screenName":"someone","followersCount":12,"isVerified":false}}'
)


def test_json_with_inferred_schema(spark, tmp_path):
    path = str(tmp_path / "tweets")
    spark.createDataFrame([(TWEET,)], "value string").write.text(path)
    tweets = json_scan(spark, path)
    got = top_rows(tweets, "tweets", ["text", "retweetCount"], "retweetCount, id")
    assert tuple(got.first()) == ("Adventures With Coffee, Code, and Writing.", 0)
    nested = nested_project(tweets, ["user.screenName", "user.isVerified"])
    assert nested.columns == ["user_screenName", "user_isVerified"]
    assert tuple(nested.first()) == ("someone", False)
    assert json_scan(spark, path, "id long").columns == ["id"]


def test_append_creates_and_extends(spark, tmp_path):
    path = str(tmp_path / "words")
    words = spark.createDataFrame([("a",), ("b",)], "word string")
    append_json(words, path)
    append_json(words, path)
    assert json_scan(spark, path).count() == 4


def test_pairs(spark, tmp_path):
    path = str(tmp_path / "pairs")
    write_pairs(spark.range(0, 100, 1, 10).select(F.col("id").alias("x"), (F.col("id") * 2).alias("y")), path)
    assert len([f for f in os.listdir(path) if f.startswith("part-")]) == 10
    assert "(3,6)" in {r.value for r in spark.read.text(path).collect()}
    assert {(int(r.x), int(r.y)) for r in read_pairs(spark, path, "x", "y").collect()} == {
        (i, 2 * i) for i in range(100)
    }


def test_odd_pairs(spark, tmp_path):
    odd = [None, "", "\\N", "a,b", "x\ny", "\r", "\\", "\\n", "\\\n", "\\c", ",\\,", "(a,b)", "\\\\c,"]
    rows = [(x, y) for x in odd for y in odd]
    path = str(tmp_path / "pairs")
    write_pairs(spark.createDataFrame(rows, "x string, y string"), path)
    assert sorted(map(tuple, read_pairs(spark, path).collect()), key=repr) == sorted(rows, key=repr)


def test_scaling_by_a_file(spark, tmp_path):
    path = tmp_path / "hundredfold.txt"
    path.write_text("100\n")
    df = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "n int")
    want = [100.0, 200.0, 300.0, 400.0]
    assert sorted(r.s for r in scale_by_file(df, "n", str(path), "s").collect()) == want
    shipped = scale_by_shipped_file(df, "n", ship_file(spark, str(path)), "s")
    assert sorted(r.s for r in shipped.collect()) == want


def test_a_scaling_file_has_one_line(spark, tmp_path):
    path = tmp_path / "two.txt"
    path.write_text("1\n2\n")
    with pytest.raises(Exception, match="SCALAR_SUBQUERY_TOO_MANY_ROWS"):
        scale_by_file(spark.range(3), "id", str(path), "s").collect()


def test_module(spark):
    module = ship_module(spark, os.path.abspath(word_codes.__file__))
    df = spark.createDataFrame([("quick brown",), (None,)], "s string")
    got = df.select(module_udf(module, "initials", F.col("s"), "string").alias("o")).collect()
    assert [r.o for r in got] == ["qb", None]


@pytest.mark.parametrize("fmt", ["parquet", "json", "orc"])
def test_typed_values_survive(spark, tmp_path, fmt):
    df = spark.createDataFrame(
        [
            ("s", [1, 2, 3, 4], {"1": 2, "3": 4}, ("v",), ([1],), None),
            ("t", [], {}, (None,), (None,), "some"),
            ("t", [], {}, (None,), (None,), "some"),
        ],
        "a string, b array<int>, c map<string,int>, d struct<value string>, e struct<value array<int>>, f string",
    )
    back = roundtrip(df, fmt, str(tmp_path / fmt))
    assert differences(df, back).isEmpty()
    assert back.schema == df.schema


def test_differences(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    b = spark.createDataFrame([(1,), (2,), (3,)], "x int")
    assert {(r.x, r.surplus) for r in differences(a, b).collect()} == {(1, -1), (3, 1)}


def test_scratch_follows_the_session(spark):
    paths = {scratch_path(spark, "x") for _ in range(2)}
    assert len(paths) == 2
    root = spark.conf.get("spark.checkpoint.dir", None)
    assert root is None or all(p.startswith(root) for p in paths)
