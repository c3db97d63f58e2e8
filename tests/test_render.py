import datetime as dt
import decimal
import json

from pyspark.sql import functions as F

from millrace.operators.render import (
    collection_uniformity,
    envelope,
    inferred_headers,
    json_rows,
    rendered_table,
    table_rows,
    type_conflicts,
)


def docs(spark, *rows):
    return spark.createDataFrame([(r if isinstance(r, str) else json.dumps(r),) for r in rows], "doc string")


def headers(df):
    return [tuple(r) for r in inferred_headers(df, "doc").collect()]


def test_positional_rows(spark):
    assert headers(docs(spark, [1, "a"], [3, "b"])) == [("0", "BIGINT_TYPE"), ("1", "STRING_TYPE")]
    wide = headers(docs(spark, list(range(12))))
    assert [n for n, _ in wide] == [str(i) for i in range(12)]


def test_scalar_rows(spark):
    assert headers(docs(spark, "1", " 2")) == [("0", "BIGINT_TYPE")]
    assert headers(docs(spark, '"x"')) == [("0", "STRING_TYPE")]


def test_null_yields_to_other_types(spark):
    want = [("a", "STRING_TYPE"), ("b", "BIGINT_TYPE")]
    assert headers(docs(spark, {"a": "1", "b": None}, {"a": "2", "b": 2})) == want
    assert headers(docs(spark, {"a": None, "b": None}, {"a": "2", "b": 2})) == want
    assert headers(docs(spark, {"a": None})) == [("a", "NULL_TYPE")]


def test_all_tags(spark):
    row = {"a": True, "b": 1.5, "c": [1], "d": {"x": 1}, "e": 1e40, "f": "s", "g": []}
    assert dict(headers(docs(spark, row))) == {
        "a": "BOOLEAN_TYPE", "b": "DOUBLE_TYPE", "c": "ARRAY_TYPE", "d": "MAP_TYPE",
        "e": "DOUBLE_TYPE", "f": "STRING_TYPE", "g": "ARRAY_TYPE",
    }


def test_conflicts(spark):
    df = docs(spark, {"a": 1, "b": None, "c": 1}, {"a": "x", "b": 2, "c": 3})
    assert [tuple(r) for r in type_conflicts(df, "doc").collect()] == [("a", "table rows have different types")]
    assert {r.name for r in type_conflicts(df, "doc", strict=True).collect()} == {"a", "b"}


def test_mixed_cells_conflict(spark):
    df = docs(spark, {"a": [1], "b": [1, "x"]}, {"a": [2], "b": [2]}, {"a": ["y"], "b": [{"c": [1, None]}]})
    assert [tuple(r) for r in type_conflicts(df, "doc").collect()] == [("b", "value has inconsistent types")]


def test_uniformity(spark):
    cases = [
        ("[1,2]", True), ('[1,"a"]', False), ("[]", True), ("[null,1]", False), ("[1,1.5]", False),
        ('[[1],["a"]]', True), ('[[1,"a"],[2]]', False), ('{"a":1,"b":2}', True), ('{"a":1,"b":null}', False),
        ("5", True), ("null", True), ('{"a":[1],"b":[null,2]}', False), ("{}", True), ("[[[[[1]]]]]", True), ('[[[[[[1,"a"]]]]]]', False), ('{"a":{"b":{"c":{"d":{"e":{"f":[1,null]}}}}}}', False),
        ("[1,99999999999999999999]", False), (None, True),
    ]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i int, doc string")
    got = {r.i: r.uniform for r in collection_uniformity(df, "doc", "i").collect()}
    assert [got[i] for i in range(len(cases))] == [want for _, want in cases]


def test_table_rows(spark):
    df = spark.createDataFrame(
        [(2, "x", decimal.Decimal("1.50"), dt.date(2024, 1, 2), dt.datetime(2024, 1, 2, 3, 4, 5), [1, 2], {"k": 1.5}, None, True, b"ab")],
        "b int, a string, d decimal(5,2), c date, t timestamp_ntz, l array<int>, m map<string,double>, n string, o boolean, p binary",
    )
    assert json.loads(table_rows(df).first().row) == [
        "x", 2, "2024-01-02", "1.50", [1, 2], {"k": 1.5}, None, True, "ab", "2024-01-02 03:04:05",
    ]
    quoted = spark.createDataFrame([('say "hi"\n',)], "s string")
    assert json.loads(table_rows(quoted).first().row) == ['say "hi"\n']


def test_json_rows(spark):
    df = spark.range(30).select("id", F.lit(None).cast("string").alias("none"))
    got = [json.loads(r.json) for r in json_rows(df, ["id"]).collect()]
    assert got == [{"id": i, "none": None} for i in range(10)]
    assert json_rows(df, ["id"], None).count() == 30


def test_envelopes(spark):
    df = spark.createDataFrame([(0, "ok"), (1, "error"), (2, "incomplete"), (3, "aborted")], "id int, kind string")
    reply = envelope(
        F.col("id"), F.col("kind"), F.create_map(F.lit("text/plain"), F.lit("1")),
        F.lit("NameError"), F.lit("boom"), F.array(F.lit("t")),
    )
    got = [json.loads(r[0]) for r in df.orderBy("id").select(reply).collect()]
    error = {"status": "error", "ename": "Error", "traceback": []}
    assert got == [
        {"status": "ok", "execution_count": 0, "data": {"text/plain": "1"}},
        {**error, "execution_count": 1, "ename": "NameError", "evalue": "boom", "traceback": ["t"]},
        {**error, "execution_count": 2, "evalue": "incomplete statement"},
        {**error, "execution_count": 3, "evalue": "Interpreter died:\nboom"},
    ]


def rendered(spark, *rows, n=10, strict=False):
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)], "i int, doc string")
    got = rendered_table(df.repartition(3), "doc", ["i"], n, strict).first()
    return json.loads(got.document) if got.error is None else got.error


def test_rendered_table(spark):
    bigint, string = "BIGINT_TYPE", "STRING_TYPE"
    assert rendered(spark, [1, "a"], [3, "b"]) == {
        "headers": [{"type": bigint, "name": "0"}, {"type": string, "name": "1"}],
        "data": [[1, "a"], [3, "b"]],
    }
    assert rendered(spark, {"b": "1", "a": None}, {"b": "2", "a": 2, "c": [1]}) == {
        "headers": [
            {"type": bigint, "name": "a"}, {"type": string, "name": "b"}, {"type": "ARRAY_TYPE", "name": "c"},
        ],
        "data": [[None, "1", None], [2, "2", [1]]],
    }
    assert rendered(spark, 1, 2)["data"] == [[1], [2]]
    assert rendered(spark, *[{"k": i} for i in range(30)])["data"] == [[i] for i in range(10)]
    assert rendered(spark, {"a": 1}, {"a": "x"}) == "table rows have different types"
    assert rendered(spark, {"a": [1, "x"]}, {"a": [2]}) == "value has inconsistent types"
    assert rendered(spark, {"a": {"b": [[1], [None, 2]]}}) == "value has inconsistent types"
    assert rendered(spark, {"a": [1]}, {"a": [1, "x"]}, n=1)["data"] == [[[1]]]
    assert rendered(spark, {"a": 1}, {"a": None}, strict=True) == "table rows have different types"
    assert rendered(spark, {"a": None}, {"a": None}, strict=True)["data"] == [[None], [None]]
    assert rendered(spark, {"a": 1}, {"a": "x"}, n=1)["data"] == [[1]]
    assert rendered(spark, {}, []) == {"headers": [], "data": [[], []]}


def test_uniformity_of_malformed_and_very_deep_texts(spark):
    deep = 50_000
    cases = {
        "[" * deep + "]" * deep: True,
        "[" * deep + '1, "a"' + "]" * deep: False,
        '{"a":' * deep + "1" + "}" * deep: True,
        '{"a":' * deep + '{"x": 1, "x": true, "y": false}' + "}" * deep: True,
        '{"a":' * deep + '{"x": 1, "y": 2.5}' + "}" * deep: False,
        "[" * deep + '"]\\"", ' + '"é"' + "]" * deep + " \n": True,
        "[" * deep + "123456789012345678901, 1.5" + "]" * deep: True,
        "[" * deep + "]" * (deep - 1): None,
        "[" * deep + "]" * (deep + 1): None,
        "[" * deep + "1 2" + "]" * deep: None,
        "[" * deep + "1," + "]" * deep: None,
        "[" * deep + "{1: 2}" + "]" * deep: None,
        "[1, 2": None,
        "nonsense": None,
        "": None,
        "[1, 2]": True,
    }
    rows = spark.createDataFrame([(i, text) for i, text in enumerate(cases)] + [(99, None)], "i int, text string")
    got = dict(map(tuple, collection_uniformity(rows, "text", "i").collect()))
    assert got == {**dict(enumerate(cases.values())), 99: True}
