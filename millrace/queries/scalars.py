"""Queries over projections, predicates and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.codes import app_state, session_kind, session_state
from millrace.functions.durations import with_duration
from millrace.functions.paths import resolve_path
from millrace.operators.access import visible_rows
from millrace.operators.aggregates import count_where
from millrace.operators.words import lines_with, tokenize, word_lengths
from millrace.queries.registry import query
from millrace.tables import table

# DuckDB: the words of documents.
DOCUMENT_WORDS = r"""
    SELECT doc_id, word FROM (
        SELECT doc_id, unnest(regexp_split_to_array(
            regexp_replace(lower(text), '[^a-zA-Z0-9\s]', '', 'g'), '\s+')) AS word
        FROM documents WHERE text IS NOT NULL)
    WHERE word <> ''
"""


@query("tokenize_words", DOCUMENT_WORDS)
def tokenize_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize(table(spark, sf_dir, "documents"), "text", "doc_id")


@query(
    "word_length_pairs",
    """
    SELECT word, CAST(length(word) AS INTEGER) AS length
    FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part)
    """,
)
def word_length_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_lengths(tokenize(table(spark, sf_dir, "part"), "p_name"), "word")


@query(
    "keyword_line_filter",
    "SELECT doc_id, source, text FROM documents WHERE contains(text, 'The')",
)
def keyword_line_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return lines_with(docs, "text", "The")


@query("typed_filter_count", "SELECT count(*) AS n FROM lineitem WHERE l_quantity >= 2")
def typed_filter_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_where(table(spark, sf_dir, "lineitem"), F.col("l_quantity") >= 2)


# One time string per line item: a number, at times signed or fractional, and a unit.
_TIME_TEXT_SQL = """
    SELECT l_orderkey, l_linenumber, l_partkey,
        (CASE WHEN l_returnflag = 'A' THEN '-' ELSE '' END)
        || CAST(l_partkey * 997 AS VARCHAR)
        || (CASE WHEN l_tax = 0.01 THEN '.5' ELSE '' END)
        || (CASE l_linenumber WHEN 1 THEN 'us' WHEN 2 THEN 'MS' WHEN 3 THEN 's' WHEN 4 THEN 'm'
            WHEN 5 THEN 'Min' WHEN 6 THEN 'h' ELSE
            (CASE WHEN l_linestatus = 'F' THEN 'd' WHEN l_tax > 0.04 THEN 'weeks' ELSE '' END) END)
        AS text
    FROM lineitem
"""


@query(
    "duration_to_ms",
    f"""
    WITH texts AS ({_TIME_TEXT_SQL}),
    parts AS (
        SELECT *, regexp_full_match(lower(text), '(-?[0-9]+)([a-z]+)?') AS shaped,
            regexp_extract(lower(text), '^(-?[0-9]+)([a-z]+)?$', 1) AS digits,
            regexp_extract(lower(text), '^(-?[0-9]+)([a-z]+)?$', 2) AS unit FROM texts),
    scaled AS (
        SELECT *, CASE unit WHEN 'us' THEN 1 WHEN 'ms' THEN 1000 WHEN '' THEN 1000
            WHEN 's' THEN 1000000 WHEN 'm' THEN 60000000 WHEN 'min' THEN 60000000
            WHEN 'h' THEN 3600000000 WHEN 'd' THEN 86400000000 END AS micros FROM parts)
    SELECT l_orderkey, l_linenumber, l_partkey, text,
        CASE WHEN shaped AND micros IS NOT NULL
            THEN CAST(trunc(CAST(digits AS HUGEINT) * micros // 1000) AS BIGINT) END AS ms,
        CASE WHEN NOT shaped THEN 'Invalid time string: ' || text
             WHEN micros IS NULL THEN 'Invalid suffix: "' || unit || '"' END AS error
    FROM scaled
    """,
)
def duration_to_ms(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    late = F.when(F.col("l_linestatus") == "F", "d").when(F.col("l_tax") > 0.04, "weeks").otherwise("")
    unit = (
        F.when(n == 1, "us").when(n == 2, "MS").when(n == 3, "s").when(n == 4, "m")
        .when(n == 5, "Min").when(n == 6, "h").otherwise(late)
    )
    text = F.concat(
        F.when(F.col("l_returnflag") == "A", "-").otherwise(""),
        (F.col("l_partkey") * 997).cast("string"),
        F.when(F.col("l_tax") == 0.01, ".5").otherwise(""),
        unit,
    )
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", text.alias("text"))
    return with_duration(rows, "text")


@query(
    "code_map",
    """
    WITH reports AS (
        SELECT event_id,
            CASE event_type WHEN 'signup' THEN 'NEW_SAVING' WHEN 'view' THEN 'RUNNING'
                WHEN 'click' THEN 'FINISHED' WHEN 'purchase' THEN 'KILLED' ELSE 'LOST' END AS state,
            CASE WHEN value < 20 THEN 'SUCCEEDED' WHEN value < 40 THEN 'KILLED'
                WHEN value < 60 THEN 'FAILED' ELSE 'UNDEFINED' END AS final
        FROM events),
    apps AS (
        SELECT event_id, CASE state WHEN 'NEW_SAVING' THEN 'starting' WHEN 'RUNNING' THEN 'running'
            WHEN 'KILLED' THEN 'killed' WHEN 'FINISHED' THEN
                CASE final WHEN 'SUCCEEDED' THEN 'finished' WHEN 'KILLED' THEN 'killed'
                ELSE 'failed' END END AS app FROM reports)
    SELECT event_id, app, CASE app WHEN 'running' THEN 'running' WHEN 'finished' THEN 'success'
        WHEN 'killed' THEN 'dead' WHEN 'failed' THEN 'dead' ELSE 'not_started' END AS session,
        app IS NULL AS unknown
    FROM apps
    """,
)
def code_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, value = F.col("event_type"), F.col("value")
    state = (
        F.when(kind == "signup", "NEW_SAVING").when(kind == "view", "RUNNING")
        .when(kind == "click", "FINISHED").when(kind == "purchase", "KILLED").otherwise("LOST")
    )
    final = (
        F.when(value < 20, "SUCCEEDED").when(value < 40, "KILLED")
        .when(value < 60, "FAILED").otherwise("UNDEFINED")
    )
    apps = table(spark, sf_dir, "events").select("event_id", app_state(state, final).alias("app"))
    return apps.select(
        "event_id",
        "app",
        session_state(F.col("app"), F.lit("not_started")).alias("session"),
        F.col("app").isNull().alias("unknown"),
    )


@query(
    "kind_aliases",
    """
    WITH named AS (
        SELECT doc_id, CASE lang WHEN 'en' THEN 'scala' WHEN 'fr' THEN 'python3'
            WHEN 'de' THEN 'r' ELSE source END AS name FROM documents)
    SELECT doc_id, name, CASE name WHEN 'scala' THEN 'spark' WHEN 'python3' THEN 'pyspark3'
        WHEN 'r' THEN 'sparkr' END AS kind FROM named
    """,
)
def kind_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    lang = F.col("lang")
    name = (
        F.when(lang == "en", "scala").when(lang == "fr", "python3").when(lang == "de", "r")
        .otherwise(F.col("source"))
    )
    named = table(spark, sf_dir, "documents").select("doc_id", name.alias("name"))
    return named.withColumn("kind", session_kind(F.col("name")))


_PATH_TEXT_SQL = r"""
    SELECT page_id, CASE page_id % 5 WHEN 0 THEN url
        WHEN 1 THEN regexp_replace(url, '^[a-z]+://[^/]*', '')
        WHEN 2 THEN regexp_replace(url, '^[a-z]+://[^/]*/', '')
        WHEN 3 THEN regexp_replace(url, '^[a-z]+://[^/]*', 'file:/allowed')
        ELSE regexp_replace(url, '^[a-z]+://[^/]*', 'file:/allowed_not_really') END AS path
    FROM pages
"""


@query(
    "path_allowlist",
    rf"""
    WITH paths AS ({_PATH_TEXT_SQL}),
    parts AS (
        SELECT *, regexp_matches(path, '^[A-Za-z][A-Za-z0-9+.-]*:') AS has_scheme,
            regexp_extract(path, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1) AS own
        FROM paths),
    checked AS (
        SELECT *, CASE
            WHEN regexp_matches(path, '[\x00-\x20"<>\\^`{{|}}\x7f]')
                OR regexp_matches(regexp_replace(path, '%[0-9A-Fa-f]{{2}}', '', 'g'), '%')
                THEN 'Illegal character in path: ' || path
            WHEN NOT has_scheme AND NOT starts_with(own, '/')
                THEN 'Path ''' || own || ''' is not absolute.'
            WHEN starts_with(path, 'file:') AND NOT (starts_with(own, '/allowed/')
                OR starts_with(own, '/also_allowed/'))
                THEN 'Local path ' || own || ' cannot be added to user sessions.' END AS error
        FROM parts)
    SELECT page_id, CASE WHEN error IS NULL THEN
        CASE WHEN has_scheme THEN path ELSE 'dummy://' || own END END AS resolved, error
    FROM checked
    """,
)
def path_allowlist(spark: SparkSession, sf_dir: str) -> DataFrame:
    url, kind = F.col("url"), F.col("page_id") % 5
    host = "^[a-z]+://[^/]*"
    path = (
        F.when(kind == 0, url)
        .when(kind == 1, F.regexp_replace(url, host, ""))
        .when(kind == 2, F.regexp_replace(url, host + "/", ""))
        .when(kind == 3, F.regexp_replace(url, host, "file:/allowed"))
        .otherwise(F.regexp_replace(url, host, "file:/allowed_not_really"))
    )
    checked = resolve_path(path, "dummy:///", ["/allowed/", "/also_allowed"])
    return table(spark, sf_dir, "pages").select("page_id", checked.alias("p")).select("page_id", "p.*")


_VISIBLE_SQL = """
    SELECT doc_id, source, lang, {text} AS text, {lines} AS n_lines FROM documents
"""


@query(
    "owner_row_filter",
    _VISIBLE_SQL.format(
        text="CASE WHEN source = 'src3' THEN text END",
        lines="CASE WHEN source = 'src3' THEN CAST(len(string_split(text, chr(10))) AS INTEGER) ELSE 0 END",
    ),
)
def owner_row_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _visible(spark, sf_dir, "src3")


@query(
    "superuser_row_filter",
    _VISIBLE_SQL.format(text="text", lines="CAST(len(string_split(text, chr(10))) AS INTEGER)"),
)
def superuser_row_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _visible(spark, sf_dir, "admin")


def _visible(spark: SparkSession, sf_dir: str, viewer: str | None) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang", "text", F.split("text", "\n").alias("log")
    )
    seen = visible_rows(docs, "source", viewer, ["admin"], sensitive=["text"], logs=["log"])
    return seen.withColumn("n_lines", F.size("log")).drop("log")
