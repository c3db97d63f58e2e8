"""Membership checks, layered settings, tags and log sections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.paths import merge_lists
from millrace.plans import in_even_tasks, spread_join

# Header lines of the sections of an application log, in order.
LOG_HEADERS = ("stdout: ", "\nstderr: ", "\nYARN Diagnostics: ")
# Fixed value: start of the message about forbidden keys.
BLACKLIST_MESSAGE = "Blacklisted configuration values in session config: "


def rejected_groups(
    df: DataFrame, group: Sequence[str], key: str, blacklist: Sequence[str]
) -> DataFrame:
    """``group, error`` for every group that holds a forbidden key; the message lists its forbidden
    keys, sorted. A set per group holds at most the blacklist."""
    bad = df.filter(F.col(key).isin(*blacklist))
    found = F.array_join(F.array_sort(F.collect_set(key)), ", ")
    return bad.groupBy(*group).agg(F.concat(F.lit(BLACKLIST_MESSAGE), found).alias("error"))


def split_by_blacklist(
    df: DataFrame,
    group: Sequence[str],
    key: str,
    blacklist: Sequence[str],
    order: Sequence[str],
    **layout,
) -> tuple[DataFrame, DataFrame]:
    """``(accepted, rejected)``: the rows of the groups without a forbidden key, and the groups with
    one. ``order`` names columns that tell the rows of a group apart."""
    rejected = rejected_groups(df, group, key, blacklist)
    accepted = spread_join(df, rejected.select(*group), group, order, "left_anti", **layout)
    return accepted, rejected


def merge_layers(
    df: DataFrame, group: Sequence[str], key: str, value: str, layer: Sequence[str], even: bool = False
) -> DataFrame:
    """``group, key, value``: the value of the last layer for every key of a group. ``layer`` names
    the columns by which layers rank; end them in a unique column.

    Spark sorts the rows of each task for this, so they are counted and dealt over even tasks first, a hot key by its
    layers; ``even`` tells that they lie so.
    """
    if not even:
        df = in_even_tasks(df, [*group, key, *layer], df.count())
    return df.groupBy(*group, key).agg(F.max_by(value, F.struct(*layer)).alias(value))


def effective_settings(
    settings: DataFrame,
    group: Sequence[str],
    forced: Mapping[str, str],
    lists: DataFrame,
    default_fs: str,
    allowed: Sequence[str] = (),
) -> DataFrame:
    """``group, key, value, error`` after all layers: the user's settings, then the forced ones, then the
    merged file lists.

    ``settings`` has one row ``(group, key, value)`` per setting; ``lists`` has rows
    ``(group, key, files array<string>)`` with the files a user named for a list setting. A list
    setting becomes the user's files followed by the configured ones, both put under ``default_fs`` and checked
    against the ``allowed`` local folders; empty lists are dropped. A list with a path that cannot be used has no
    value but an error, which rejects its group. Every group of ``settings`` gets the forced settings.

    Both inputs are counted and dealt over even tasks by group and key, so that what a task sorts does not grow with its
    file; the join is no broadcast, as Spark's guess of the size is that of the file.
    """
    rows, at = settings.count() + lists.count(), [*group, "key"]
    settings = in_even_tasks(settings.select(*at, "value"), at, rows)
    cols = [*group, "key", "value", "error", "_layer"]
    fine = F.lit(None).cast("string")
    user = settings.withColumns({"_layer": F.lit(0), "error": fine}).select(cols)
    server = (
        settings.select(*group)
        .distinct()
        .withColumn(
            "_kv",
            F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.lit(v).alias("value")) for k, v in forced.items()])),
        )
        .select(*group, "_kv.*", fine.alias("error"), F.lit(1).alias("_layer"))
    )
    list_keys = in_even_tasks(lists.select(*at, "files"), at, rows)
    merged = (
        list_keys.join(settings.hint("merge"), at, "left")
        # Generated, so that the optimizer does not write the check out twice, in the filter and for its result.
        .withColumn("_list", F.explode(F.array(merge_lists(F.col("files"), F.col("value"), default_fs, allowed))))
        .withColumns({"value": F.col("_list.value"), "error": F.col("_list.error"), "_layer": F.lit(2)})
        .filter(F.col("value").isNotNull() | F.col("error").isNotNull())
        .select(cols)
    )
    every = user.unionByName(server).unionByName(merged)
    held = every.select(*group, "key", F.struct("value", "error").alias("_held"), "_layer")
    return merge_layers(held, group, "key", "_held", ["_layer"], even=True).select(*group, "key", "_held.*")


def reconcile(
    apps: DataFrame, app_id: str, tags: str, wanted: DataFrame, now: Column, timeout: Column | int
) -> DataFrame:
    """Look for the application of every wanted tag: ``tag, app_id, matches, stale``.

    ``apps`` has an array column ``tags``; ``wanted`` has one row ``(tag, added)`` per tag. The
    first application (by id) that carries the lowercased tag is reported. A tag without one is
    stale when it is older than the timeout. Applications are reduced to one row per tag before the
    join, so a tag on a third of all applications is one row there too.
    """
    carriers = (
        apps.select(F.col(app_id).alias("_app"), F.explode(F.array_distinct(tags)).alias("_tag"))
        .groupBy("_tag")
        .agg(F.min("_app").alias("app_id"), F.count(F.lit(1)).alias("matches"))
    )
    found = wanted.join(carriers, F.lower("tag") == F.col("_tag"), "left")
    missing = F.col("app_id").isNull()
    return found.select(
        "tag",
        "app_id",
        F.coalesce("matches", F.lit(0)).alias("matches"),
        (missing & (now - F.col("added") > timeout)).alias("stale"),
    )


def concat_logs(
    stdout: DataFrame,
    stderr: DataFrame,
    diagnostics: DataFrame,
    key: str,
    headers: Sequence[str] = LOG_HEADERS,
) -> DataFrame:
    """``key, section, line_no, line``: the three logs of each key as one, ordered by
    ``(section, line_no)``. Each section starts with its header at line -1, also when it is empty.
    Inputs are ``(key, line_no, line)``."""
    parts = [
        d.select(key, F.lit(i).alias("section"), F.col("line_no").cast("bigint"), "line")
        for i, d in enumerate((stdout, stderr, diagnostics))
    ]
    body = parts[0].unionByName(parts[1]).unionByName(parts[2])
    titles = F.array(
        *[F.struct(F.lit(i).alias("section"), F.lit(-1).cast("bigint").alias("line_no"), F.lit(h).alias("line")) for i, h in enumerate(headers)]
    )
    heads = body.select(key).distinct().select(key, F.explode(titles).alias("_t")).select(key, "_t.*")
    return heads.unionByName(body)
