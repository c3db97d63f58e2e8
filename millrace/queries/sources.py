"""Queries over sources, sinks and shipped files."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import millrace.sources.word_codes as word_codes
from millrace.operators.words import tokenize, word_count
from millrace.queries.registry import query
from millrace.scratch import scratch_path
from millrace.sources.json import append_json, json_scan, nested_project, parse_nested
from millrace.sources.pairs import read_pairs, write_pairs
from millrace.sources.roundtrip import differences, roundtrip
from millrace.sources.shared import (
    module_udf,
    scale_by_file,
    scale_by_shipped_file,
    ship_file,
    ship_module,
)
from millrace.tables import table


@query(
    "json_scan",
    "SELECT event_id, user_id, event_type, value, props FROM events",
)
def json_scan_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "events-json")
    append_json(table(spark, sf_dir, "events"), path)
    return json_scan(spark, path).select("event_id", "user_id", "event_type", "value", "props")


@query(
    "nested_json_project",
    """
    SELECT event_id AS id, user_id AS user_id, event_type AS user_kind,
           CAST(json_extract_string(props, '$.k') AS BIGINT) AS user_props_k,
           CASE WHEN event_type = 'error' THEN 0 ELSE 2 END AS n_tags
    FROM events
    """,
)
def nested_json_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.struct(
        F.col("user_id").alias("id"),
        F.col("event_type").alias("kind"),
        F.from_json("props", "k bigint").alias("props"),
    )
    tags = F.when(F.col("event_type") == "error", F.array().cast("array<string>")).otherwise(
        F.array("event_type", "props")
    )
    docs = table(spark, sf_dir, "events").select(
        F.to_json(F.struct(F.col("event_id").alias("id"), user.alias("user"), tags.alias("tags"))).alias("doc")
    )
    schema = (
        "id bigint, user struct<id: bigint, kind: string, props: struct<k: bigint>>, "
        "tags array<string>"
    )
    rec = parse_nested(docs, "doc", schema, "rec").select("rec.*")
    return nested_project(
        rec.withColumn("n_tags", F.size("tags")),
        ["id", "user.id", "user.kind", "user.props.k", "n_tags"],
    )


@query(
    "text_pair_sink",
    """
    SELECT o_orderpriority || chr(10) || '\\,' || CAST(o_orderkey AS VARCHAR) AS x,
        CASE WHEN o_orderstatus = 'P' THEN NULL WHEN o_orderstatus = 'F' THEN '\\N,' || chr(13)
            ELSE CAST(2 * o_orderkey AS VARCHAR) END AS y FROM orders
    """,
)
def text_pair_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "pairs")
    keys, status = F.col("o_orderkey"), F.col("o_orderstatus")
    doubled = F.when(status == "F", "\\N,\r").when(status != "P", (keys * 2).cast("string"))
    named = F.concat("o_orderpriority", F.lit("\n\\,"), keys.cast("string"))
    write_pairs(table(spark, sf_dir, "orders").select(named.alias("x"), doubled.alias("y")), path)
    return read_pairs(spark, path, "x", "y")


@query(
    "json_append_sink",
    """
    WITH words AS (SELECT unnest(string_split(p_name, ' ')) AS word FROM part)
    SELECT word, count(*) AS word_count
    FROM (SELECT word FROM words UNION ALL SELECT word FROM words) GROUP BY word
    """,
)
def json_append_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "words")
    words = tokenize(table(spark, sf_dir, "part"), "p_name")
    append_json(words, path)
    append_json(words, path)
    return word_count(json_scan(spark, path, "word string"))


@query(
    "broadcast_file_scale",
    "SELECT l_orderkey, l_linenumber, l_quantity * 3.5 AS scaled FROM lineitem",
)
def broadcast_file_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "factor")
    spark.range(1).select(F.lit("3.5").alias("value")).coalesce(1).write.text(path)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return scale_by_file(rows, "l_quantity", path, "scaled").drop("l_quantity")


@query(
    "shipped_file_scale",
    "SELECT l_orderkey, l_linenumber, l_quantity * 3.5 AS scaled FROM lineitem",
)
def shipped_file_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = os.path.dirname(os.path.abspath(word_codes.__file__))
    name = ship_file(spark, f"{folder}/sample_factor.txt")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return scale_by_shipped_file(rows, "l_quantity", name, "scaled").drop("l_quantity")


@query(
    "shipped_module_udf",
    """
    SELECT p_partkey, array_to_string(
        list_transform(string_split(p_name, ' '), lambda w: substr(w, 1, 1)), '') AS initials
    FROM part
    """,
)
def shipped_module_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    module = ship_module(spark, os.path.abspath(word_codes.__file__))
    code = module_udf(module, "initials", F.col("p_name"), "string")
    return table(spark, sf_dir, "part").select("p_partkey", code.alias("initials"))


@query(
    "typed_roundtrip",
    "SELECT CAST(0 AS BIGINT) AS differences, count(*) AS n FROM embeddings",
)
def typed_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = F.col("label") % 2 == 0
    rows = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").cast("string").alias("text"),
        F.col("embedding").alias("numbers"),
        F.create_map(F.col("label"), F.col("vec_id")).alias("pairs"),
        F.struct(F.col("label").alias("value"), F.array("vec_id").alias("items")).alias("case"),
        F.when(half, F.lit("some")).alias("maybe"),
    )
    back = roundtrip(rows, "parquet", scratch_path(spark, "roundtrip"))
    total = back.agg(F.count(F.lit(1)).alias("n")).scalar()
    return differences(rows, back).agg(F.count(F.lit(1)).alias("differences")).select(
        "differences", total.alias("n")
    )
