"""Queries over counts, sums, estimates and rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.aggregates import (
    count_rows,
    latest_by,
    next_id,
    pi_from_points,
    pi_vectorized,
    progress,
    recover,
    recovery_summary,
    sum_mapped,
)
from millrace.operators.sketches import DISTINCT_ERROR, FREQUENT_ERROR, QUANTILE_ERROR, estimates, merge_sketches, sketch
from millrace.operators.words import tokenize, top_word, word_count
from millrace.queries.registry import query
from millrace.queries.scalars import DOCUMENT_WORDS
from millrace.scratch import scratch_path
from millrace.sources.deltas import Deltas
from millrace.tables import table

WORD_COUNT_SQL = f"SELECT word, count(*) AS word_count FROM ({DOCUMENT_WORDS}) GROUP BY word"
TOP_WORD_SQL = f"{WORD_COUNT_SQL} ORDER BY word_count DESC, word LIMIT 1"


@query(
    "map_reduce_sum",
    "SELECT CAST(sum(l_orderkey * 2) AS BIGINT) AS doubled FROM lineitem",
)
def map_reduce_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sum_mapped(table(spark, sf_dir, "lineitem"), F.col("l_orderkey") * 2, "doubled")


@query("partitioned_count", "SELECT count(*) AS n FROM orders")
def partitioned_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_rows(table(spark, sf_dir, "orders"), 10)


@query("word_count", WORD_COUNT_SQL)
def document_word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_count(tokenize(table(spark, sf_dir, "documents"), "text"))


@query("top_word", TOP_WORD_SQL)
def document_top_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_word(tokenize(table(spark, sf_dir, "documents"), "text"))


# Points derived from the keys of line items, spread over the unit square.
_X_SQL = "((l_orderkey * 7919 + l_partkey * 31 + l_linenumber * 104729) % 10007) / 10007.0"
_Y_SQL = "((l_partkey * 6151 + l_suppkey * 1299709 + l_orderkey * 389) % 10009) / 10009.0"
_POINTS_SQL = f"SELECT CAST({_X_SQL} AS DOUBLE) AS x, CAST({_Y_SQL} AS DOUBLE) AS y FROM lineitem"


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok, pk, sk, ln = (F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
    x = ((ok * 7919 + pk * 31 + ln * 104729) % 10007) / F.lit(10007.0)
    y = ((pk * 6151 + sk * 1299709 + ok * 389) % 10009) / F.lit(10009.0)
    return table(spark, sf_dir, "lineitem").select(x.alias("x"), y.alias("y"))


def _pi_sql(x: str, y: str, op: str) -> str:
    hits = f"sum(CASE WHEN {x} * {x} + {y} * {y} {op} 1 THEN 1 ELSE 0 END)"
    return (
        f"WITH points AS ({_POINTS_SQL}) "
        f"SELECT CAST(4.0 AS DOUBLE) * CAST({hits} AS DOUBLE) / count(*) AS pi FROM points"
    )


@query("monte_carlo_pi", _pi_sql("x", "y", "<"))
def monte_carlo_pi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pi_from_points(_points(spark, sf_dir), F.col("x"), F.col("y"))


@query("monte_carlo_pi_square", _pi_sql("(x * 2 - 1)", "(y * 2 - 1)", "<"))
def monte_carlo_pi_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("x") * 2 - 1, F.col("y") * 2 - 1
    return pi_from_points(_points(spark, sf_dir), x, y)


@query("monte_carlo_pi_inclusive", _pi_sql("(x * 2 - 1)", "(y * 2 - 1)", "<="))
def monte_carlo_pi_inclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("x") * 2 - 1, F.col("y") * 2 - 1
    return pi_from_points(_points(spark, sf_dir), x, y, inclusive=True)


@query("vectorized_pi", _pi_sql("x", "y", "<"))
def vectorized_pi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pi_vectorized(_points(spark, sf_dir))


@query(
    "progress_ratio",
    """
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 1.0::DOUBLE
        ELSE coalesce(done / total, 0.0) END AS progress
    FROM orders LEFT JOIN (
        SELECT l_orderkey, CAST(sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS DOUBLE) AS done,
            CAST(count(*) AS DOUBLE) AS total
        FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey
    """,
)
def progress_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    return progress(
        table(spark, sf_dir, "orders"),
        tasks,
        "o_orderkey",
        done=F.when(F.col("l_linestatus") == "F", 1).otherwise(0),
        total=F.lit(1),
        terminal=F.col("o_orderstatus") == "P",
    )


@query(
    "latest_state",
    """
    SELECT user_id, event_type, event_id FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1
    """,
)
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return latest_by(events, "user_id", ["ts", "event_id"], "event_type", "event_id")


# Stored records: some keys are no numbers, some lie beyond 32 bits, some have no document, some documents are
# cut short.
_STORE_SQL = """
    SELECT CASE WHEN event_type = 'signup' AND value < 20 THEN 'x' ELSE '' END
            || CAST(event_id + CASE WHEN event_type = 'purchase' THEN 3000000000 ELSE 0 END AS VARCHAR) AS key,
        CASE WHEN event_type = 'view' AND value < 20 THEN NULL
            WHEN event_type = 'click' AND value < 20 THEN substr(props, 1, 5)
            ELSE props END AS doc
    FROM events
"""
_RECOVERED_SQL = f"""
    SELECT CAST(key AS BIGINT) AS id,
        CASE WHEN ends_with(doc, '}}') THEN CAST(json_extract_string(doc, '$.k') AS BIGINT) END AS k,
        CASE WHEN NOT ends_with(doc, '}}') THEN 'Error getting session ' || key END AS error
    FROM ({_STORE_SQL}) WHERE doc IS NOT NULL AND NOT starts_with(key, 'x')
"""


def _recovered(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, few = F.col("event_type"), F.col("value") < 20
    number = F.col("event_id") + F.when(kind == "purchase", 3_000_000_000).otherwise(0)
    key = F.concat(F.when((kind == "signup") & few, "x").otherwise(""), number.cast("string"))
    doc = (
        F.when((kind == "view") & few, F.lit(None))
        .when((kind == "click") & few, F.substring("props", 1, 5))
        .otherwise(F.col("props"))
    )
    store = table(spark, sf_dir, "events").select(key.alias("key"), doc.alias("doc"))
    return recover(store, "key", "doc", T.StructType([T.StructField("k", T.LongType())]))


@query("tolerant_recovery_scan", _RECOVERED_SQL)
def tolerant_recovery_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recovered(spark, sf_dir).select("id", "record.k", "error")


@query(
    "recovery_summary",
    f"SELECT count(k) AS recovered, count(error) AS failed FROM ({_RECOVERED_SQL})",
)
def recovery_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recovery_summary(_recovered(spark, sf_dir))


@query(
    "next_session_id",
    "SELECT CAST(max(event_id) + 3000000000 AS BIGINT) AS next_id FROM events",
)
def next_session_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = table(spark, sf_dir, "events").agg((F.max("event_id") + 3_000_000_000).alias("nextSessionId"))
    return next_id(used.select(F.to_json(F.struct("nextSessionId")).alias("doc")), "doc")


@query(
    "sketched_types",
    """
    SELECT event_type, count(*) AS rows, count(DISTINCT user_id) AS users, true AS users_ok, true AS median_ok, true AS frequent_ok
    FROM events GROUP BY event_type
    """,
)
def sketched_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches of two batches, stored and merged, held against exact figures: whether each lies within its stated error (four
    standard deviations of the distinct count, twice the 99 % bound of the quantile). Where no user is surely frequent, none may
    have more than twice the share by which counts are off."""
    events, keys = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id", "value"), ["event_type"]

    def states(rows: DataFrame) -> DataFrame:
        return sketch(rows, keys, {"user": "user_id"}, {"value": "value"}, {"user": "user_id"})

    stored = Deltas(spark, scratch_path(spark, "sketches"), states(events).schema, lambda s: merge_sketches(s, keys))
    for batch in range(2):
        stored.put(batch, states(events.filter(F.col("event_id") % 2 == batch)))
    told = estimates(stored.total(), keys, top=1)
    per_user = events.groupBy(*keys, "user_id").agg(F.count(F.lit(1)).alias("n"))
    exact = per_user.groupBy(*keys).agg(F.count(F.lit(1)).alias("users"), F.max("n").alias("most"))
    middle = told.select(*keys, F.col("value_quantiles")[0].alias("middle"))
    below = events.join(middle, keys).groupBy(*keys).agg(F.avg((F.col("value") <= F.col("middle")).cast("int")).alias("share"))
    count, share = F.get("user_frequent", F.lit(0))["count"], F.col("rows") * FREQUENT_ERROR
    frequent = F.when(count.isNull(), F.col("most") <= 2 * share).otherwise(F.abs(count - F.col("most")) <= share)
    return told.join(exact, keys).join(below, keys).select(
        *keys,
        "rows",
        "users",
        (F.abs(F.col("user_distinct") - F.col("users")) <= 4 * DISTINCT_ERROR * F.col("users")).alias("users_ok"),
        (F.abs(F.col("share") - 0.5) <= 2 * QUANTILE_ERROR).alias("median_ok"),
        frequent.alias("frequent_ok"),
    )
