"""Queries over membership, layers, tags and log sections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.merge import (
    LOG_HEADERS,
    concat_logs,
    effective_settings,
    merge_layers,
    reconcile,
    split_by_blacklist,
)
from millrace.queries.registry import query
from millrace.tables import table

_BLACKLIST = ["error", "purchase"]


def _blacklisted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, sf_dir, "events").select(
        "event_id", "user_id", F.to_date("ts").alias("day"), "event_type"
    )
    return split_by_blacklist(events, ["user_id", "day"], "event_type", _BLACKLIST, ["event_id"])


@query(
    "blacklist_reject",
    """
    SELECT user_id, CAST(ts AS DATE) AS day,
        'Blacklisted configuration values in session config: '
        || string_agg(DISTINCT event_type, ', ' ORDER BY event_type) AS error
    FROM events WHERE event_type IN ('error', 'purchase') GROUP BY 1, 2
    """,
)
def blacklist_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blacklisted(spark, sf_dir)[1]


@query(
    "blacklist_accept",
    """
    SELECT event_id, user_id, CAST(ts AS DATE) AS day, event_type FROM events e
    WHERE NOT EXISTS (SELECT 1 FROM events b WHERE b.user_id = e.user_id
        AND CAST(b.ts AS DATE) = CAST(e.ts AS DATE) AND b.event_type IN ('error', 'purchase'))
    """,
)
def blacklist_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blacklisted(spark, sf_dir)[0]


# Layers by event type; within a layer the later event wins.
_LAYERS = {"signup": 0, "view": 1, "click": 2, "purchase": 3, "error": 4}


@query(
    "layered_merge",
    """
    WITH rows AS (
        SELECT user_id, CAST(ts AS DATE) AS key, props, event_id, CASE event_type
            WHEN 'signup' THEN 0 WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3
            ELSE 4 END AS layer FROM events)
    SELECT user_id, key, props FROM rows
    QUALIFY row_number() OVER (PARTITION BY user_id, key ORDER BY layer DESC, event_id DESC) = 1
    """,
)
def layered_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    layer = F.create_map(*[F.lit(x) for kv in _LAYERS.items() for x in kv])[F.col("event_type")]
    rows = table(spark, sf_dir, "events").select(
        "user_id", F.to_date("ts").alias("key"), "props", "event_id", layer.alias("layer")
    )
    return merge_layers(rows, ["user_id"], "key", "props", ["layer", "event_id"])


@query(
    "effective_settings",
    """
    WITH settings AS (
        SELECT p_partkey, unnest(['spark.files', 'spark.master', 'label']) AS key,
            unnest(['/' || replace(p_name, ' ', ', /'), 'mine', p_brand]) AS value FROM part),
    files AS (
        SELECT p_partkey, 'dummy:///' || replace(p_name, ' ', ',dummy:///') AS conf,
            CASE WHEN p_size % 3 = 0 THEN 'Path ' || chr(39) || p_type || chr(39) || ' is not absolute.'
                WHEN p_size % 7 = 0 THEN 'Local path /etc/' || p_type || ' cannot be added to user sessions.' END AS error,
            CASE WHEN p_size % 5 = 0 THEN 'file:/open/' || p_type
                WHEN p_size % 2 = 0 THEN 'dummy:///' || p_type END AS own FROM part)
    SELECT s.p_partkey, s.key, CASE s.key WHEN 'spark.master' THEN 'yarn' WHEN 'spark.files' THEN
            CASE WHEN f.error IS NULL THEN coalesce(f.own || ',', '') || f.conf END ELSE s.value END AS value,
        CASE WHEN s.key = 'spark.files' THEN f.error END AS error
    FROM settings s JOIN files f USING (p_partkey)
    UNION ALL
    SELECT p_partkey, 'spark.submit.deployMode', 'cluster', NULL FROM part
    UNION ALL
    SELECT p_partkey, 'spark.jars', CASE WHEN error IS NULL THEN own END, error FROM files
    WHERE error IS NOT NULL OR own IS NOT NULL
    """,
)
def effective_settings_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    # Raw paths in the settings; the user's files are relative, local and forbidden, local, raw, or none.
    conf = F.concat(F.lit("/"), F.replace("p_name", F.lit(" "), F.lit(", /")))
    own = {"spark.files": conf, "spark.master": F.lit("mine"), "label": F.col("p_brand")}
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in own.items()])
    settings = part.select("p_partkey", F.explode(pairs).alias("kv")).select("p_partkey", "kv.*")
    size, path = F.col("p_size"), F.col("p_type")
    named = (
        F.when(size % 3 == 0, F.array(path))
        .when(size % 7 == 0, F.array(F.concat(F.lit("file:/etc/"), path)))
        .when(size % 5 == 0, F.array(F.concat(F.lit("file:/open/"), path)))
        .when(size % 2 == 0, F.array(F.concat(F.lit("/"), path)))
    )
    lists = part.select(
        "p_partkey",
        F.explode(F.array(F.lit("spark.files"), F.lit("spark.jars"))).alias("key"),
        named.alias("files"),
    )
    forced = {"spark.master": "yarn", "spark.submit.deployMode": "cluster"}
    return effective_settings(settings, ["p_partkey"], forced, lists, "dummy:///", ["/open/"])


@query(
    "tag_reconcile",
    """
    WITH carriers AS (
        SELECT tag, min(p_partkey) AS app_id, count(*) AS matches
        FROM (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS tag FROM part)
        GROUP BY tag),
    wanted AS (
        SELECT upper(p_type) || CAST(p_size AS VARCHAR) AS tag, min(p_partkey) AS added
            FROM part GROUP BY 1
        UNION ALL
        SELECT upper(word), CAST(0 AS BIGINT) FROM (
            SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part))
    SELECT wanted.tag, app_id, coalesce(matches, 0) AS matches,
        app_id IS NULL AND 500 - added > 300 AS stale
    FROM wanted LEFT JOIN carriers ON lower(wanted.tag) = carriers.tag
    """,
)
def tag_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    apps = part.select("p_partkey", F.split("p_name", " ").alias("tags"))
    lost = part.groupBy(F.concat(F.upper("p_type"), F.col("p_size").cast("string")).alias("tag")).agg(
        F.min("p_partkey").alias("added")
    )
    known = apps.select(F.explode("tags").alias("tag")).select(F.upper("tag").alias("tag")).distinct()
    wanted = lost.unionByName(known.withColumn("added", F.lit(0).cast("bigint")))
    return reconcile(apps, "p_partkey", "tags", wanted, F.lit(500), 300)


@query(
    "log_sections",
    f"""
    WITH lines AS (
        SELECT conv_id, CASE role WHEN 'assistant' THEN 0 WHEN 'user' THEN 1 ELSE 2 END AS section,
            turn AS line_no, text AS line FROM conversations)
    SELECT * FROM lines
    UNION ALL
    SELECT conv_id, section, CAST(-1 AS BIGINT), line FROM (SELECT DISTINCT conv_id FROM lines), (
        VALUES (0, '{LOG_HEADERS[0]}'), (1, chr(10) || '{LOG_HEADERS[1].strip(chr(10))}'),
            (2, chr(10) || '{LOG_HEADERS[2].strip(chr(10))}')) h(section, line)
    """,
)
def log_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(
        "conv_id", F.col("turn").alias("line_no"), F.col("text").alias("line"), "role"
    )
    # Turns of any other role, or of none, count as diagnostics.
    role = F.when(F.col("role").isin("assistant", "user"), F.col("role")).otherwise("other")
    parts = [turns.filter(role == r).drop("role") for r in ("assistant", "user", "other")]
    return concat_logs(*parts, key="conv_id")
