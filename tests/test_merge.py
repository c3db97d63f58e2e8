import pytest
from pyspark.sql import functions as F

from millrace.operators.access import visible_rows
from millrace.operators.merge import (
    concat_logs,
    effective_settings,
    merge_layers,
    reconcile,
    split_by_blacklist,
)


@pytest.mark.parametrize("layout", [{}, {"rows_per_chunk": 20}])
def test_blacklist(spark, layout):
    rows = [("a", "x", 1), ("a", "bad", 2), ("a", "worse", 3), ("a", "bad", 4)]
    rows += [("b", f"k{i}", 10 + i) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, key string, id int")
    accepted, rejected = split_by_blacklist(df, ["g"], "key", ["bad", "worse"], ["id"], **layout)
    assert accepted.count() == 200 and accepted.select("g").distinct().first().g == "b"
    assert [tuple(r) for r in rejected.collect()] == [
        ("a", "Blacklisted configuration values in session config: bad, worse")
    ]


def test_later_layer_wins(spark):
    df = spark.createDataFrame([("g", "k", "user", 0), ("g", "k", "server", 1), ("g", "j", "user", 0)], "g string, key string, value string, layer int")
    got = {(r.key, r.value) for r in merge_layers(df, ["g"], "key", "value", ["layer"]).collect()}
    assert got == {("k", "server"), ("j", "user")}


def test_settings(spark):
    settings = spark.createDataFrame(
        [(1, "spark.master", "mine"), (1, "spark.jars", "/file1.txt"), (2, "x", "y"), (3, "spark.jars", "/ok, far/away")],
        "id int, key string, value string",
    )
    lists = spark.createDataFrame(
        [
            (1, "spark.jars", ["/file2.txt"]), (1, "spark.files", []), (2, "spark.files", ["file:/allowed/f", ""]),
            (3, "spark.jars", None), (3, "spark.files", ["file:/tmp/../etc/passwd"]),
        ],
        "id int, key string, files array<string>",
    )
    got = effective_settings(settings, ["id"], {"spark.master": "local"}, lists, "dummy:///", ["/allowed/"])
    assert {tuple(r) for r in got.select("id", "key", "value", "error").collect()} == {
        (1, "spark.master", "local", None),
        (1, "spark.jars", "dummy:///file2.txt,dummy:///file1.txt", None),
        (2, "x", "y", None),
        (2, "spark.master", "local", None),
        (2, "spark.files", "file:/allowed/f", None),
        (3, "spark.master", "local", None),
        (3, "spark.jars", None, "Path 'far/away' is not absolute."),
        (3, "spark.files", None, "Local path /tmp/../etc/passwd cannot be added to user sessions."),
    }


def test_a_file_of_many_settings_is_dealt_over_tasks(spark, tmp_path, capsys):
    spark.range(150_000).selectExpr("id", "'spark.jars' AS key", "'/a' AS value").coalesce(1).write.parquet(str(tmp_path / "one"))
    settings = spark.read.parquet(str(tmp_path / "one"))
    lists = settings.filter("id % 3 = 0").select("id", "key", F.array(F.lit("/b")).alias("files"))
    got = effective_settings(settings, ["id"], {"spark.master": "yarn"}, lists, "dummy:///")
    got.explain("formatted")
    plan = capsys.readouterr().out
    # Four tasks for 200,000 rows; no settings are sent to all tasks, and paths are checked once (the check names its message twice).
    assert plan.count("REPARTITION_BY_NUM") >= 3 and ", 4), REPARTITION_BY_NUM" in plan and "BroadcastHashJoin" not in plan
    assert plan.count("is not absolute") == 2
    assert {tuple(r) for r in got.groupBy("key", "value", "error").count().collect()} == {
        ("spark.master", "yarn", None, 150_000), ("spark.jars", "/a", None, 100_000), ("spark.jars", "dummy:///b,dummy:///a", None, 50_000),
    }
    merge_layers(settings, ["id"], "key", "value", ["value"]).explain("formatted")
    assert "REPARTITION_BY_NUM" in capsys.readouterr().out


def test_reconcile(spark):
    apps = spark.createDataFrame([(1, ["t1", "x"]), (2, ["t1", "t1"]), (3, [])], "app int, tags array<string>")
    wanted = spark.createDataFrame([("T1", 0), ("old", 0), ("new", 95)], "tag string, added int")
    got = reconcile(apps, "app", "tags", wanted, F.lit(100), 10)
    assert {tuple(r) for r in got.collect()} == {
        ("T1", 1, 2, False), ("old", None, 0, True), ("new", None, 0, False),
    }


def test_log_sections(spark):
    def log(rows):
        return spark.createDataFrame(rows, "app int, line_no int, line string")

    got = concat_logs(log([(1, 0, "o0"), (1, 1, "o1")]), log([(2, 0, "e0")]), log([]), "app")
    text = {}
    for r in sorted(got.collect(), key=lambda r: (r.section, r.line_no)):
        text.setdefault(r.app, []).append(r.line)
    assert text == {
        1: ["stdout: ", "o0", "o1", "\nstderr: ", "\nYARN Diagnostics: "],
        2: ["stdout: ", "\nstderr: ", "e0", "\nYARN Diagnostics: "],
    }


@pytest.mark.parametrize("viewer,full", [(None, {1, 2, 3}), ("bob", {1}), ("root", {1, 2, 3}), ("eve", set())])
def test_visible_rows(spark, viewer, full):
    df = spark.createDataFrame(
        [(1, "bob", "s", ["l"]), (2, "amy", "s", ["l"]), (3, None, "s", ["l"])],
        "id int, owner string, secret string, log array<string>",
    )
    got = visible_rows(df, "owner", viewer, ["root"], ["secret"], ["log"]).collect()
    assert len(got) == 3
    assert {r.id for r in got if r.secret == "s" and r.log == ["l"]} == full
    assert all(r.secret is None and r.log == [] for r in got if r.id not in full)
