"""Queries over typed tables and JSON views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.render import (
    TEXT_MIME,
    collection_uniformity,
    envelope,
    inferred_headers,
    json_rows,
    rendered_table,
    table_rows,
    type_conflicts,
)
from millrace.queries.registry import query
from millrace.tables import table

# JSON rows with a key whose type is clear, one that is null at times, one that is always null, one
# that mixes numbers and strings, and an array and an object.
_DOC_SQL = """
    SELECT event_id, '{"id":' || event_id || ',"kind":"' || event_type || '","n":'
        || (CASE WHEN event_type = 'view' THEN 'null' ELSE CAST(user_id AS VARCHAR) END)
        || ',"half":' || user_id || '.5,"none":null,"ok":'
        || (CASE WHEN value < 20 THEN 'true' ELSE 'false' END)
        || ',"mixed":' || (CASE WHEN event_type = 'click' THEN '"x"' ELSE '1' END)
        || ',"list":[1,' || (CASE WHEN event_type = 'error' THEN '"x"' ELSE '2' END) || '],"props":' || props || '}' AS doc
    FROM events
"""


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    doc = F.concat(
        F.lit('{"id":'), F.col("event_id").cast("string"), F.lit(',"kind":"'), kind, F.lit('","n":'),
        F.when(kind == "view", "null").otherwise(user),
        F.lit(',"half":'), user, F.lit('.5,"none":null,"ok":'),
        F.when(F.col("value") < 20, "true").otherwise("false"),
        F.lit(',"mixed":'), F.when(kind == "click", '"x"').otherwise("1"),
        F.lit(',"list":[1,'), F.when(kind == "error", '"x"').otherwise("2"), F.lit('],"props":'), F.col("props"), F.lit("}"),
    )
    return table(spark, sf_dir, "events").select(doc.alias("doc"))


_TAGS_SQL = f"""
    WITH docs AS ({_DOC_SQL}),
    keys AS (SELECT doc, unnest(json_keys(doc)) AS name FROM docs),
    cells AS (
        SELECT name, CASE json_type(doc, '$.' || name) WHEN 'NULL' THEN 'NULL_TYPE'
            WHEN 'BOOLEAN' THEN 'BOOLEAN_TYPE' WHEN 'VARCHAR' THEN 'STRING_TYPE'
            WHEN 'UBIGINT' THEN 'BIGINT_TYPE' WHEN 'BIGINT' THEN 'BIGINT_TYPE'
            WHEN 'DOUBLE' THEN 'DOUBLE_TYPE' WHEN 'ARRAY' THEN 'ARRAY_TYPE'
            WHEN 'OBJECT' THEN 'MAP_TYPE' END AS tag FROM keys),
    tags AS (
        SELECT name, min(tag) FILTER (tag <> 'NULL_TYPE') AS low,
            max(tag) FILTER (tag <> 'NULL_TYPE') AS high, bool_or(tag = 'NULL_TYPE') AS nulls
        FROM cells GROUP BY name)
"""


@query(
    "inferred_headers",
    f"""{_TAGS_SQL}
    SELECT name, CASE WHEN low IS NULL THEN 'NULL_TYPE' WHEN low = high THEN low END AS type
    FROM tags
    """,
)
def event_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inferred_headers(_docs(spark, sf_dir), "doc")


@query(
    "type_conflicts",
    f"""{_TAGS_SQL}
    SELECT name, 'table rows have different types' AS error FROM tags WHERE low <> high
    UNION ALL SELECT 'list', 'value has inconsistent types' FROM events WHERE event_type = 'error' GROUP BY 1
    """,
)
def event_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return type_conflicts(_docs(spark, sf_dir), "doc")


@query(
    "type_conflicts_strict",
    f"""{_TAGS_SQL}
    SELECT name, 'table rows have different types' AS error FROM tags
    WHERE low <> high OR (nulls AND low IS NOT NULL)
    UNION ALL SELECT 'list', 'value has inconsistent types' FROM events WHERE event_type = 'error' GROUP BY 1
    """,
)
def event_conflicts_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return type_conflicts(_docs(spark, sf_dir), "doc", strict=True)


# JSON collections: arrays of numbers, numbers beside a string or a null, nested arrays that are
# uniform or not, an empty one, and an object.
_COLLECTION_SQL = """
    SELECT l_orderkey, l_linenumber, l_linestatus, CASE l_linenumber
        WHEN 1 THEN '[' || l_partkey || ',' || l_suppkey || ']'
        WHEN 2 THEN '[' || l_partkey || ',"' || l_returnflag || '"]'
        WHEN 3 THEN (CASE WHEN l_linestatus = 'F' THEN '[]' ELSE '[null,' || l_partkey || ']' END)
        WHEN 4 THEN '[[' || l_partkey || '],["' || l_returnflag || '"]]'
        WHEN 5 THEN '[[' || l_partkey || ',"' || l_returnflag || '"],[1]]'
        WHEN 6 THEN '{"a":' || l_partkey || ',"b":' || l_suppkey || '}'
        ELSE '{"a":{"b":[{"c":[[' || l_partkey || (CASE WHEN l_linestatus = 'F' THEN ',"x"' ELSE ',1' END)
            || ']]}]}}' END AS doc
    FROM lineitem
"""


@query(
    "collection_uniformity",
    f"""
    WITH docs AS ({_COLLECTION_SQL}),
    items AS (
        SELECT l_orderkey, l_linenumber, l_linestatus, CASE WHEN json_type(doc) = 'ARRAY'
                THEN json_extract(doc, '$[*]') ELSE json_extract(doc, '$.*') END AS vals FROM docs),
    kinds AS (
        SELECT l_orderkey, l_linenumber, l_linestatus, list_transform(vals, lambda v: json_type(v)) AS tops,
            flatten(list_transform(vals, lambda v: CASE WHEN json_type(v) = 'ARRAY'
                AND len(list_distinct(list_transform(json_extract(v, '$[*]'), lambda w: json_type(w)))) > 1
                THEN ['bad'] ELSE [] END)) AS inner_bad FROM items)
    SELECT l_orderkey, l_linenumber, len(list_distinct(tops)) <= 1 AND len(inner_bad) = 0
        AND NOT (l_linenumber = 7 AND l_linestatus = 'F') AS uniform
    FROM kinds
    """,
)
def lineitem_uniformity(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, pk, sk, flag = (F.col(c).cast("string") for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"))
    third = F.when(F.col("l_linestatus") == "F", F.lit("[]")).otherwise(
        F.concat(F.lit("[null,"), pk, F.lit("]"))
    )
    doc = (
        F.when(n == "1", F.concat(F.lit("["), pk, F.lit(","), sk, F.lit("]")))
        .when(n == "2", F.concat(F.lit("["), pk, F.lit(',"'), flag, F.lit('"]')))
        .when(n == "3", third)
        .when(n == "4", F.concat(F.lit("[["), pk, F.lit('],["'), flag, F.lit('"]]')))
        .when(n == "5", F.concat(F.lit("[["), pk, F.lit(',"'), flag, F.lit('"],[1]]')))
        .when(n == "6", F.concat(F.lit('{"a":'), pk, F.lit(',"b":'), sk, F.lit("}")))
        .otherwise(
            F.concat(
                F.lit('{"a":{"b":[{"c":[['), pk, F.when(F.col("l_linestatus") == "F", ',"x"').otherwise(",1"), F.lit("]]}]}}")
            )
        )
    )
    docs = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", doc.alias("doc"))
    return collection_uniformity(docs, "doc", "l_orderkey", "l_linenumber")


@query(
    "table_rows",
    """
    SELECT '[' || o_custkey || ',"' || strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || '",'
        || o_orderkey || ',"' || o_orderpriority || '",' ||
        (CASE WHEN o_orderstatus = 'P' THEN 'null' ELSE '"' || o_orderstatus || '"' END) || ',"'
        || CAST(CAST(o_orderkey AS DECIMAL(12, 2)) AS VARCHAR) || '"]' AS row FROM orders
    """,
)
def order_table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(
        "o_custkey",
        "o_orderkey",
        "o_orderdate",
        "o_orderpriority",
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")).alias("o_orderstatus"),
        F.col("o_orderkey").cast("decimal(12,2)").alias("o_share"),
    )
    return table_rows(orders)


@query(
    "json_rows",
    """
    SELECT '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_mktsegment":'
        || (CASE WHEN c_mktsegment = 'BUILDING' THEN 'null' ELSE '"' || c_mktsegment || '"' END)
        || '}' AS json
    FROM customer ORDER BY c_custkey LIMIT 10
    """,
)
def customer_json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    segment = F.col("c_mktsegment")
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_name", F.when(segment != "BUILDING", segment).alias("c_mktsegment")
    )
    return json_rows(rows, ["c_custkey"])


@query(
    "rendered_table",
    f"""
    WITH shown AS (
        SELECT event_id, user_id, event_type FROM events ORDER BY event_id LIMIT 10)
    SELECT '{{"headers":[{{"type":"BIGINT_TYPE","name":"id"}},{{"type":"STRING_TYPE","name":"kind"}},'
        || '{{"type":"' || (CASE WHEN count(user_id) FILTER (event_type <> 'view') > 0
            THEN 'BIGINT_TYPE' ELSE 'NULL_TYPE' END) || '","name":"user"}}],"data":['
        || string_agg('[' || event_id || ',"' || event_type || '",'
            || (CASE WHEN event_type = 'view' THEN 'null' ELSE CAST(user_id AS VARCHAR) END) || ']',
            ',' ORDER BY event_id) || ']}}' AS document, CAST(NULL AS VARCHAR) AS error
    FROM shown
    """,
)
def event_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.when(F.col("event_type") != "view", F.col("user_id"))
    doc = F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), user.alias("user"))
    docs = table(spark, sf_dir, "events").select("event_id", F.to_json(doc).alias("doc"))
    return rendered_table(docs, "doc", ["event_id"])


@query(
    "rendered_table_mixed",
    """
    SELECT CAST(NULL AS VARCHAR) AS document, 'value has inconsistent types' AS error
    FROM (SELECT max(event_id) FROM events)
    """,
)
def mixed_event_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair = F.array(F.col("event_id").cast("variant"), F.col("event_type").cast("variant"))
    docs = table(spark, sf_dir, "events").select("event_id", F.to_json(F.struct(pair.alias("pair"))).alias("doc"))
    return rendered_table(docs, "doc", ["event_id"])


_ERROR_START = '{"status":"error","execution_count":'


@query(
    "statement_envelope",
    f"""
    SELECT event_id, CASE event_type
        WHEN 'error' THEN '{_ERROR_START}' || event_id || ',"ename":"ValueError","evalue":"bad '
            || user_id || '","traceback":["at ' || user_id || '"]}}'
        WHEN 'click' THEN '{_ERROR_START}' || event_id
            || ',"ename":"Error","evalue":"incomplete statement","traceback":[]}}'
        WHEN 'signup' THEN '{_ERROR_START}' || event_id
            || ',"ename":"Error","evalue":"Interpreter died:\\nbad ' || user_id || '","traceback":[]}}'
        ELSE '{{"status":"ok","execution_count":' || event_id || ',"data":{{"text/plain":"'
            || event_type || '"}}}}' END AS reply
    FROM events
    """,
)
def statement_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, user = F.col("event_type"), F.col("user_id").cast("string")
    outcome = (
        F.when(kind == "error", "error").when(kind == "click", "incomplete")
        .when(kind == "signup", "aborted").otherwise("ok")
    )
    reply = envelope(
        F.col("event_id"),
        outcome,
        F.create_map(F.lit(TEXT_MIME), kind),
        F.lit("ValueError"),
        F.concat(F.lit("bad "), user),
        F.array(F.concat(F.lit("at "), user)),
    )
    return table(spark, sf_dir, "events").select("event_id", reply.alias("reply"))
