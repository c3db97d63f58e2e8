"""Queries over groupings, catalog tables and functions of a user's own."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.cubes import cube_sets, grouping_sets, rollup_sets
from millrace.operators.custom import CELL_LINES, CellParser, WeightedMedian, aggregate_with, apply_table_function
from millrace.queries.registry import query
from millrace.scratch import scratch_path
from millrace.sources.catalog import save_bucketed, save_partitioned
from millrace.tables import table

BUCKETS = 16


def _lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.select("l_returnflag", "l_linestatus", F.year("l_shipdate").alias("l_year"), "l_suppkey", "l_quantity")


def _sets_sql(sets: str) -> str:
    return f"""
    SELECT l_returnflag, l_linestatus, l_year, GROUPING(l_returnflag, l_linestatus, l_year) AS level, count(*) AS rows,
        sum(l_quantity) AS quantity, count(DISTINCT l_suppkey) AS suppliers
    FROM (SELECT *, year(l_shipdate) AS l_year FROM lineitem) GROUP BY {sets}
    """


_KEYS = ["l_returnflag", "l_linestatus", "l_year"]
_MEASURES = {"sums": {"quantity": "l_quantity"}, "distinct": ("suppliers", "l_suppkey")}


@query("grouping_sets", _sets_sql("GROUPING SETS ((l_returnflag, l_linestatus), (l_year), (l_returnflag, l_year), ())"))
def lineitem_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = [("l_returnflag", "l_linestatus"), ("l_year",), ("l_returnflag", "l_year"), ()]
    return grouping_sets(_lineitem(spark, sf_dir), _KEYS, sets, **_MEASURES)


@query("cube_counts", _sets_sql("CUBE (l_returnflag, l_linestatus, l_year)"))
def lineitem_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping_sets(_lineitem(spark, sf_dir), _KEYS, cube_sets(_KEYS), **_MEASURES)


@query("rollup_counts", _sets_sql("ROLLUP (l_returnflag, l_linestatus, l_year)"))
def lineitem_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grouping_sets(_lineitem(spark, sf_dir), _KEYS, rollup_sets(_KEYS), **_MEASURES)


@query(
    "bucketed_join",
    """
    SELECT o_orderkey, o_orderpriority, count(*) AS lines, sum(l_quantity) AS quantity
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_orderpriority
    """,
)
def bucketed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their lines, both saved in buckets by order."""
    work, mark = scratch_path(spark, "buckets"), uuid.uuid4().hex
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity")
    a = save_bucketed(orders, f"orders_{mark}", ["o_orderkey"], BUCKETS, f"{work}/orders")
    b = save_bucketed(lines, f"lines_{mark}", ["l_orderkey"], BUCKETS, f"{work}/lines")
    joined = a.join(b, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy("o_orderkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").alias("quantity"))


@query(
    "pruned_join",
    """
    WITH busy AS (
        SELECT CAST(o_orderdate AS DATE) AS day FROM orders GROUP BY day HAVING count(*) > 1 ORDER BY count(*) DESC, day LIMIT 5)
    SELECT l_month, count(*) AS lines, sum(l_quantity) AS quantity
    FROM (SELECT strftime(l_shipdate, '%Y-%m') AS l_month, l_quantity FROM lineitem)
    WHERE l_month IN (SELECT strftime(day, '%Y-%m') FROM busy) GROUP BY l_month
    """,
)
def pruned_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines shipped in the months of the five busiest days (of more than one order); the other months' folders are not read."""
    work, mark = scratch_path(spark, "months"), uuid.uuid4().hex
    lines = table(spark, sf_dir, "lineitem").select("l_quantity", F.date_format("l_shipdate", "yyyy-MM").alias("l_month"))
    by_month = save_partitioned(lines, f"lines_{mark}", ["l_month"], f"{work}/lines")
    days = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    busy = days.filter("n > 1").orderBy(F.desc("n"), "day").limit(5).select(F.date_format("day", "yyyy-MM").alias("l_month"))
    joined = by_month.join(busy, "l_month", "left_semi")
    return joined.groupBy("l_month").agg(F.count(F.lit(1)).alias("lines"), F.sum("l_quantity").alias("quantity"))


@query(
    "weighted_median",
    """
    SELECT l_returnflag, l_linestatus, min(l_quantity) AS median FROM (
        SELECT *, sum(w) OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_quantity) AS below,
            sum(w) OVER (PARTITION BY l_returnflag, l_linestatus) AS whole
        FROM (SELECT l_returnflag, l_linestatus, l_quantity, sum(l_linenumber) AS w FROM lineitem GROUP BY ALL))
    WHERE 2 * below >= whole GROUP BY l_returnflag, l_linestatus
    """,
)
def weighted_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    keys = ["l_returnflag", "l_linestatus"]
    return aggregate_with(lines, keys, WeightedMedian(), ["l_quantity", "l_linenumber"], "median", "double")


@query(
    "parsed_cells",
    """
    WITH cells AS (
        SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN '%table rows' || chr(10) || text ELSE text END AS text FROM conversations),
    lines AS (
        SELECT conv_id, turn, unnest(range(len(parts))) AS line, unnest(parts) AS text
        FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS parts FROM cells)),
    kinds AS (SELECT *, CASE WHEN starts_with(text, '%') THEN 'command' ELSE 'code' END AS kind FROM lines)
    SELECT conv_id, turn, CAST(line AS INTEGER) AS line, kind, text,
        CAST(sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn, line) AS INTEGER) AS chunk
    FROM (SELECT *, CASE WHEN kind = 'command' OR line = 0
            OR lag(kind) OVER (PARTITION BY conv_id, turn ORDER BY line) = 'command' THEN 1 ELSE 0 END AS fresh FROM kinds)
    """,
)
def parsed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as cells of a session, some with a command put before, through a table function."""
    text = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("%table rows\n"), F.col("text"))).otherwise(F.col("text"))
    cells = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.alias("text"))
    return apply_table_function(cells, CellParser, CELL_LINES, ["conv_id"], ["turn"])
