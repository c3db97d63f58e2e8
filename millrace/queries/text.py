"""Queries over errors, traces, terminal output and notebook cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import (
    FRAME_MARKER,
    cell_chunks,
    clean_python_trace,
    clean_trace,
    error_name,
    error_traceback,
    magic_line,
    strip_ansi,
)
from millrace.operators.words import plot_call_counts
from millrace.queries.registry import query
from millrace.tables import table


@query(
    "error_split",
    r"""
    WITH lines AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents)
    SELECT doc_id, regexp_replace(parts[1], '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') AS ename,
        CASE WHEN contains(text, chr(10)) THEN substr(text, strpos(text, chr(10)) + 1) ELSE '' END
            AS traceback,
        CAST(len(parts) - 1 - (CASE WHEN len(parts) > 1 AND parts[len(parts)] = '' THEN 1 ELSE 0 END)
            AS INTEGER) AS n_lines
    FROM lines
    """,
)
def error_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, trace = F.col("text"), F.col("trace")
    return (
        table(spark, sf_dir, "documents")
        .select("doc_id", error_name(text).alias("ename"), error_traceback(text).alias("trace"))
        .select("doc_id", "ename", F.array_join(trace, "").alias("traceback"), F.size(trace).alias("n_lines"))
    )


# One trace per line item: user frames, then for most rows the shell's marker and internal frames,
# for some followed by a cause with a frame of its own.
_TRACE_PARTS = {
    "user": "  at $iwC$$iwC$$iwC.run(<console>:",
    "top": "  at $iwC.<init>(<console>:9)\n",
    "inner": "  at $print(<console>)\n",
    "cause": "Caused by: java.lang.RuntimeException: ",
}


@query(
    "frame_clean",
    f"""
    WITH traces AS (
        SELECT l_orderkey, l_linenumber, list_concat(
            ['{_TRACE_PARTS["user"]}' || l_partkey || ')' || chr(10)],
            CASE WHEN l_returnflag = 'A' THEN []
                ELSE ['  at {FRAME_MARKER}(<console>:' || l_suppkey || ')' || chr(10),
                    '{_TRACE_PARTS["top"][:-1]}' || chr(10), '{_TRACE_PARTS["inner"][:-1]}' || chr(10)] END,
            CASE WHEN l_linestatus = 'F' THEN []
                ELSE ['{_TRACE_PARTS["cause"]}' || l_suppkey || chr(10),
                    '{_TRACE_PARTS["top"][:-1]}' || chr(10)] END) AS lines
        FROM lineitem),
    found AS (
        SELECT *, list_position(list_transform(lines, lambda x: contains(x, '{FRAME_MARKER}')), true) AS a
        FROM traces),
    ends AS (
        SELECT *, list_position(list_transform(lines, lambda x, i: i >= a
            AND NOT starts_with(trim(x), 'at')), true) AS z FROM found)
    SELECT l_orderkey, l_linenumber, array_to_string(CASE WHEN a IS NULL OR a = 0 THEN lines ELSE
        list_transform(list_filter(lines, lambda x, i: i < a OR (z > 0 AND i >= z)),
            lambda x: regexp_replace(x, '(\\$iwC\\$)*\\$iwC', '<user code>', 'g')) END, '') AS trace
    FROM ends
    """.replace("\\\\", "\\"),
)
def frame_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.array().cast("array<string>")
    part, supp = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    internal = F.array(
        F.concat(F.lit(f"  at {FRAME_MARKER}(<console>:"), supp, F.lit(")\n")),
        F.lit(_TRACE_PARTS["top"]),
        F.lit(_TRACE_PARTS["inner"]),
    )
    cause = F.array(F.concat(F.lit(_TRACE_PARTS["cause"]), supp, F.lit("\n")), F.lit(_TRACE_PARTS["top"]))
    lines = F.concat(
        F.array(F.concat(F.lit(_TRACE_PARTS["user"]), part, F.lit(")\n"))),
        F.when(F.col("l_returnflag") == "A", none).otherwise(internal),
        F.when(F.col("l_linestatus") == "F", none).otherwise(cause),
    )
    return (
        table(spark, sf_dir, "lineitem")
        .select("l_orderkey", "l_linenumber", lines.alias("lines"))
        .select("l_orderkey", "l_linenumber", F.array_join(clean_trace(F.col("lines")), "").alias("trace"))
    )


@query(
    "python_frame_clean",
    """
    SELECT l_orderkey, l_linenumber, 'Traceback:' || chr(10)
        || CASE WHEN l_returnflag = 'A' THEN '  File "lib.py", line ' || l_partkey || chr(10) ELSE '' END
        || 'Error: ' || l_suppkey AS trace
    FROM lineitem
    """,
)
def python_frame_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, supp = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    frame = F.concat(F.lit('  File "lib.py", line '), part, F.lit("\n"))
    top = F.lit('  File "<stdin>", line 1, in <module>\n')
    none = F.array().cast("array<string>")
    # Frames before the top-level frame belong to the shell; those after it to the user.
    lines = F.concat(
        F.array(F.lit("Traceback:\n")),
        F.when(F.col("l_returnflag") == "A", none).otherwise(F.array(frame)),
        F.when(F.col("l_returnflag") == "A", F.array(frame, top, frame)).otherwise(F.array(top)),
        F.array(F.concat(F.lit("Error: "), supp)),
    )
    return (
        table(spark, sf_dir, "lineitem")
        .select("l_orderkey", "l_linenumber", lines.alias("lines"))
        .select(
            "l_orderkey", "l_linenumber", F.array_join(clean_python_trace(F.col("lines")), "").alias("trace")
        )
    )


@query(
    "ansi_strip",
    r"""
    SELECT doc_id, regexp_replace(replace(replace(text, ' ', chr(27) || '[1;31m '), 'e',
        'e' || chr(27) || '[0G' || chr(27) || '[K'), '\x1b\[[0-9;]*[mG]', '', 'g') AS text
    FROM documents
    """,
)
def ansi_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Colour codes go in before each space; a cursor code and an unrelated code after each e.
    coloured = F.replace(F.col("text"), F.lit(" "), F.lit("\u001b[1;31m "))
    coded = F.replace(coloured, F.lit("e"), F.lit("e\u001b[0G\u001b[K"))
    return table(spark, sf_dir, "documents").select("doc_id", strip_ansi(coded).alias("text"))


@query(
    "cell_split",
    r"""
    WITH cells AS (
        SELECT conv_id, turn, rtrim('%table ' || role || chr(10) || text || chr(10) || '%json a b'
            || chr(10) || '%' || chr(10) || 'x = 1' || chr(10) || '%plot' || chr(10) || ' ',
            ' ' || chr(9) || chr(10) || chr(13)) AS code
        FROM conversations),
    lines AS (
        SELECT conv_id, turn, unnest(string_split(code, chr(10))) AS line,
            generate_subscripts(string_split(code, chr(10)), 1) AS i FROM cells),
    marks AS (
        SELECT *, CASE WHEN i = 1 OR starts_with(line, '%')
            OR starts_with(lag(line) OVER (PARTITION BY conv_id, turn ORDER BY i), '%')
            THEN 1 ELSE 0 END AS fresh FROM lines),
    runs AS (
        SELECT *, sum(fresh) OVER (PARTITION BY conv_id, turn ORDER BY i) - 1 AS pos FROM marks),
    chunks AS (
        SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos, string_agg(line, chr(10) ORDER BY i) AS chunk
        FROM runs GROUP BY ALL),
    named AS (
        SELECT *, starts_with(chunk, '%') AS magic, string_split(substr(chunk, 2), ' ')[1] AS word
        FROM chunks)
    SELECT conv_id, turn, pos, chunk, CASE WHEN NOT magic THEN 'code' WHEN word = '' THEN 'empty'
            WHEN word IN ('table', 'json', 'matplot') THEN word ELSE 'unknown' END AS kind,
        CASE WHEN magic THEN word END AS name,
        CASE WHEN magic AND contains(chunk, ' ') THEN substr(chunk, strpos(chunk, ' ') + 1) END AS argument
    FROM named
    """,
)
def cell_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.concat(
        F.lit("%table "), F.col("role"), F.lit("\n"), F.col("text"),
        F.lit("\n%json a b\n%\nx = 1\n%plot\n "),
    )
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.posexplode(cell_chunks(code)).alias("pos", "c")
    ).select("conv_id", "turn", "pos", "c.*")


@query(
    "magic_lines",
    r"""
    WITH lines AS (
        SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS part, role,
            CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS line_no FROM conversations),
    marked AS (
        SELECT conv_id, turn, line_no, (CASE role WHEN 'user' THEN '%table  (' WHEN 'system' THEN '%'
            ELSE '' END) || part AS line FROM lines)
    SELECT conv_id, turn, line_no,
        CASE WHEN regexp_matches(line, '^%[0-9A-Za-z_]') THEN regexp_extract(line, '^%([0-9A-Za-z_]+)', 1) END AS name,
        CASE WHEN regexp_matches(line, '^%[0-9A-Za-z_]') THEN
            regexp_extract(line, '^%[0-9A-Za-z_]+[^0-9A-Za-z_]*(.*)', 1) END AS argument
    FROM marked
    """,
)
def magic_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.col("role")
    prefix = F.when(role == "user", "%table  (").when(role == "system", "%").otherwise("")
    lines = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", prefix.alias("prefix"), F.posexplode(F.split("text", "\n")).alias("line_no", "part")
    )
    line = F.concat("prefix", "part")
    return lines.select("conv_id", "turn", "line_no", magic_line(line).alias("m")).select(
        "conv_id", "turn", "line_no", "m.*"
    )


@query(
    "plot_calls",
    r"""
    WITH code AS (
        SELECT text || CASE role WHEN 'user' THEN ' pie3D(x)' WHEN 'system' THEN ' scatterplot3d(x)'
            ELSE ' x.scatterplot.matrix(y); hist(z)' END AS code FROM conversations),
    calls AS (
        SELECT regexp_extract(code, '(bagplot|barplot|boxplot|dotchart|hist|lines|pie|pie3D|plot|qqline|qqnorm|scatterplot|scatterplot3d|scatterplot\.matrix|splom|stripchart|vioplot)', 1) AS plot
        FROM code)
    SELECT plot, count(*) AS n FROM calls WHERE plot <> '' GROUP BY plot
    """,
)
def plot_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.col("role")
    call = (
        F.when(role == "user", " pie3D(x)").when(role == "system", " scatterplot3d(x)")
        .otherwise(" x.scatterplot.matrix(y); hist(z)")
    )
    code = table(spark, sf_dir, "conversations").select(F.concat("text", call).alias("code"))
    return plot_call_counts(code, "code")
