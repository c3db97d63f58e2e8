"""Queries over pages, tails and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.operators.paging import (
    fetch_range,
    log_tail,
    page,
    page_summary,
    preview,
    retain,
    top_rows,
)
from millrace.queries.registry import query
from millrace.tables import table

_PAGE_ORDER = ["o_orderdate", "o_orderkey"]


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")


@query(
    "sort_limit_sql",
    "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 10",
)
def sort_limit_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_rows(
        table(spark, sf_dir, "orders"),
        "cheapest_orders",
        ["o_orderkey", "o_totalprice"],
        "o_totalprice, o_orderkey",
    )


@query("preview_take", "SELECT * FROM customer ORDER BY c_custkey LIMIT 10")
def preview_take(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preview(table(spark, sf_dir, "customer"), ["c_custkey"])


_PAGE_SQL = (
    "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders "
    "ORDER BY o_orderdate, o_orderkey {} OFFSET {}"
)


@query("history_page", _PAGE_SQL.format("LIMIT 100", 250))
def history_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page(_orders(spark, sf_dir), _PAGE_ORDER, 250)


@query("history_page_deep", _PAGE_SQL.format("LIMIT 700", 12_345))
def history_page_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page(_orders(spark, sf_dir), _PAGE_ORDER, 12_345, 700)


@query("history_page_rest", _PAGE_SQL.format("", 1_000))
def history_page_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page(_orders(spark, sf_dir), _PAGE_ORDER, 1_000, None)


@query(
    "history_page_summary",
    """
    SELECT CAST(250 AS BIGINT) AS start, count(*) AS total,
        least(greatest(count(*) - 250, 0), 100) AS returned FROM orders
    """,
)
def history_page_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_summary(_orders(spark, sf_dir), 250)


@query(
    "id_range_fetch",
    "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders "
    "WHERE o_orderkey >= 500 AND o_orderkey < 700",
)
def id_range_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fetch_range(_orders(spark, sf_dir), "o_orderkey", 500, 200)


@query(
    "id_point_fetch",
    "SELECT o_orderkey, o_orderdate, o_totalprice FROM orders WHERE o_orderkey = 77",
)
def id_point_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fetch_range(_orders(spark, sf_dir), "o_orderkey", 77, 1)


_LOG_SQL = """
    SELECT conv_id, turn, text, line, total FROM (
        SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS line,
            count(*) OVER (PARTITION BY conv_id) AS total FROM conversations)
    WHERE {}
"""


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")


@query("log_tail", _LOG_SQL.format("line >= greatest(0, total - 3)"))
def conversation_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_tail(_turns(spark, sf_dir), "conv_id", "turn", size=3)


@query("log_window", _LOG_SQL.format("line >= 1 AND line < 3"))
def conversation_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_tail(_turns(spark, sf_dir), "conv_id", "turn", start=1, size=2)


@query(
    "retain_last_n",
    """
    SELECT event_id, user_id, event_type FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20
    """,
)
def retain_last_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    return retain(events, "user_id", ["ts", "event_id"], 20).drop("ts")
