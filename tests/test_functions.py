"""Scalar functions, with the values the reference's tests fix."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as tx
from millrace.functions.codes import app_state, session_kind, session_state
from millrace.functions.durations import duration_error, duration_ms
from millrace.functions.paths import merge_lists, resolve_path
from millrace.functions.words import word_array


def apply(spark, fn, values, type_="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {type_}")
    rows = df.select("i", fn(F.col("v")).alias("o")).collect()
    return [r.o for r in sorted(rows, key=lambda r: r.i)]


def test_words(spark):
    texts = ["The quick, brown fox!", " Don't\tstop\n", "", None, "...", "Été 2x"]
    assert apply(spark, word_array, texts) == [
        ["the", "quick", "brown", "fox"], ["dont", "stop"], [], None, [], ["t", "2x"],
    ]


def test_durations(spark):
    texts = ["15", "-3s", "2M", "2min", "1h", "1D", "1999us", "-1999us", "7MS", "99999999999999999d",
             "-99999999999999999d", "", "1.5s", "s", "3 s", "1w", "99999999999999999999", "5\n", None]
    assert apply(spark, duration_ms, texts) == [
        15, -3000, 120000, 120000, 3600000, 86400000, 1, -1, 7, 2**63 - 1, -(2**63),
        None, None, None, None, None, None, None, None,
    ]
    errors = apply(spark, duration_error, texts)
    assert errors[:11] == [None] * 11
    assert errors[12] == "Invalid time string: 1.5s"
    assert errors[15] == 'Invalid suffix: "w"'
    assert errors[11] == "Invalid time string: " and errors[16].startswith("Invalid time string")
    assert errors[18] is None


@pytest.mark.parametrize(
    "state,final,want",
    [
        ("NEW", "UNDEFINED", "starting"), ("NEW_SAVING", "UNDEFINED", "starting"),
        ("SUBMITTED", "UNDEFINED", "starting"), ("ACCEPTED", "UNDEFINED", "starting"),
        ("RUNNING", "UNDEFINED", "running"), ("FINISHED", "SUCCEEDED", "finished"),
        ("FINISHED", "FAILED", "failed"), ("FINISHED", "KILLED", "killed"),
        ("FINISHED", "UNDEFINED", "failed"), ("FINISHED", None, "failed"),
        ("FAILED", "UNDEFINED", "failed"), ("KILLED", "UNDEFINED", "killed"), ("LOST", "FAILED", None),
    ],
)
def test_app_state(spark, state, final, want):
    df = spark.createDataFrame([(state, final)], "s string, f string")
    assert df.select(app_state(F.col("s"), F.col("f"))).first()[0] == want


def test_session_state_and_kinds(spark):
    apps = ["starting", "running", "finished", "killed", "failed", None]
    assert apply(spark, lambda c: session_state(c, F.lit("starting")), apps) == [
        "starting", "running", "success", "dead", "dead", "starting",
    ]
    names = ["spark", "scala", "pyspark", "python", "pyspark3", "python3", "sparkr", "r", "sql", None]
    assert apply(spark, session_kind, names) == [
        "spark", "spark", "pyspark", "pyspark", "pyspark3", "pyspark3", "sparkr", "sparkr", None, None,
    ]


def test_paths(spark):
    def check(default):
        return lambda c: resolve_path(c, default, ["/allowed/", "/also_allowed"])

    paths = ["http://example.com/foo", "hdfs:/bar", "/baz", "relative_path", "file:/allowed/x", "file:/no", "/a b"]
    got = apply(spark, check("dummy:///"), paths)
    assert [g.resolved for g in got] == [
        "http://example.com/foo", "hdfs:/bar", "dummy:///baz", None, "file:/allowed/x", None, None,
    ]
    assert got[3].error == "Path 'relative_path' is not absolute."
    assert got[5].error == "Local path /no cannot be added to user sessions."
    assert got[6].error.startswith("Illegal character")
    local = ["/allowed/file", "/also_allowed/file", "/not_allowed", "/allowed_not_really"]
    got = apply(spark, check("file:///"), local)
    assert [g.resolved for g in got] == ["file:///allowed/file", "file:///also_allowed/file", None, None]


def test_encoded_paths(spark):
    paths = ["file:/%61llowed/x", "file:/a%20llowed/x", "/a%2Bb+c", "/a%20b", "/a?q#f", "file:rel"]
    got = apply(spark, lambda c: resolve_path(c, "dummy:///", ["/allowed"]), paths)
    assert [g.resolved for g in got] == [
        "file:/%61llowed/x", None, "dummy:///a+b+c", None, "dummy:///a", None,
    ]
    assert got[1].error == "Local path /a llowed/x cannot be added to user sessions."
    assert got[3].error.startswith("Illegal character")


def test_merged_lists_put_the_users_first(spark):
    df = spark.createDataFrame(
        [
            (["/file2.txt"], "/file1.txt"), ([], "/a, /b,,hdfs:/c"), (None, None), (["file:/ok/x", ""], None),
            (["/a", "b"], "c"), (["/a"], "file:/no"),
        ],
        "files array<string>, conf string",
    )
    merged = merge_lists(F.col("files"), F.col("conf"), "dummy:///", ["/ok/"])
    assert [tuple(r) for r in df.select(merged.alias("m")).select("m.*").collect()] == [
        ("dummy:///file2.txt,dummy:///file1.txt", None), ("dummy:///a,dummy:///b,hdfs:/c", None), (None, None),
        ("file:/ok/x", None), (None, "Path 'b' is not absolute."),
        (None, "Local path /no cannot be added to user sessions."),
    ]


COMPILE_ERROR = """<console>:27: error: type mismatch;
 found   : Int
 required: String
       sc.setJobGroup(groupName, groupName, true)
                      ^
"""


def test_error_split(spark):
    texts = [COMPILE_ERROR, "", "one", "a\n", "\nb", "  x \t\ny\n\nz", None]
    assert apply(spark, tx.error_name, texts) == [
        "<console>:27: error: type mismatch;", "", "one", "a", "", "x", None,
    ]
    assert apply(spark, tx.error_traceback, texts) == [
        COMPILE_ERROR.splitlines(keepends=True)[1:], [], [], [], ["b"], ["y\n", "\n", "z"], None,
    ]


def test_clean_trace(spark):
    trace = [
        "        at $iwC$$iwC$$iwC$$iwC$$iwC.error(<console>:25)\n",
        "        at $iwC$$iwC$$iwC.error2(<console>:27)\n",
        "        at $iwC$$iwC.<init>(<console>:41)\n",
        "        at $iwC.<init>(<console>:43)\n",
        "        at .<clinit>(<console>)\n",
        "        at sun.reflect.NativeMethodAccessorImpl.invoke0(Native Method)\n",
    ]
    user = ["        at <user code>.error(<console>:25)\n", "        at <user code>.error2(<console>:27)\n"]
    cause = ["Caused by: x\n", "  at $iwC.f\n"]
    odd = ["not a frame: $iwC$$iwC.<init>\n", "  at y\n"]
    got = apply(spark, tx.clean_trace, [trace, trace + cause, ["a $iwC\n"], [], odd, None], "array<string>")
    assert got == [
        user, user + ["Caused by: x\n", "  at <user code>.f\n"], ["a $iwC\n"], [],
        ["not a frame: <user code>.<init>\n", "  at y\n"], None,
    ]


def test_clean_python_trace(spark):
    top = '  File "<stdin>", line 1, in <module>\n'
    traces = [["Traceback\n", "shell\n", top, "mine\n", top, "E: x\n"], ["Traceback\n", "E\n"], [top, "a"], []]
    assert apply(spark, tx.clean_python_trace, traces, "array<string>") == [
        ["Traceback\n", "mine\n", top, "E: x\n"], ["Traceback\n", "E\n"], [top, "a"], [],
    ]


def test_ansi(spark):
    texts = ["a\u001b[31mb\u001b[0;1mc\u001b[2Gd\u001b[K", "plain [0m", None]
    assert apply(spark, tx.strip_ansi, texts) == ["abcd\u001b[K", "plain [0m", None]


def test_cells(spark):
    code = "x = 1\n\ny = 2\n%table df now\n%json\n%\n%foo  bar\nz\n \n"
    got = apply(spark, tx.cell_chunks, [code, "", "%matplot plt", None])
    assert [tuple(c) for c in got[0]] == [
        ("x = 1\n\ny = 2", "code", None, None),
        ("%table df now", "table", "table", "df now"),
        ("%json", "json", "json", None),
        ("%", "empty", "", None),
        ("%foo  bar", "unknown", "foo", " bar"),
        ("z", "code", None, None),
    ]
    assert [tuple(c) for c in got[1]] == [("", "code", None, None)]
    assert [tuple(c) for c in got[2]] == [("%matplot plt", "matplot", "matplot", "plt")]
    assert got[3] is None


def test_long_cell(spark):
    lines = [("%json x" if i % 7 == 0 else f"line {i}") for i in range(5000)]
    got = apply(spark, tx.cell_chunks, ["\n".join(lines)])[0]
    assert "\n".join(c.chunk for c in got) == "\n".join(lines)


def test_plot_calls(spark):
    code = ["pie3D(x)", "scatterplot3d(x)", "a; hist(x); plot(y)", "myplot", "scatterplot.matrix(x)", "x", None]
    assert apply(spark, tx.plot_call, code) == [
        "pie", "scatterplot", "hist", "plot", "scatterplot", None, None,
    ]


def test_magic_lines(spark):
    lines = ["%table df", "%json  (x, y)", "%json", "%", "x %table", "%a b\nc", None]
    got = apply(spark, tx.magic_line, lines)
    assert [g and tuple(g) for g in got] == [
        ("table", "df"), ("json", "x, y)"), ("json", ""), None, None, None, None,
    ]
