"""Tables of the session's catalog with a layout: buckets for repeated joins, partitions for pruned scans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def save_bucketed(df: DataFrame, name: str, keys: Sequence[str], buckets: int, path: str | None = None) -> DataFrame:
    """Save ``df`` as table ``name``, bucketed and sorted by ``keys``, and read it back.

    Tables with the same number of buckets join by the same keys, in the same order, without a shuffle, as often as they are used; so
    does an aggregate by these keys. Rows are dealt by key before they are written, so a bucket is one file and not one for each
    task. With ``path`` the table's files lie there, else in the warehouse. An existing table is replaced.
    """
    writer = df.repartition(buckets, *keys).write.mode("overwrite").format("parquet")
    writer = writer.bucketBy(buckets, keys[0], *keys[1:]).sortBy(keys[0], *keys[1:])
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)


def save_partitioned(df: DataFrame, name: str, by: Sequence[str], path: str | None = None, sort: Sequence[str] = ()) -> DataFrame:
    """Save ``df`` as table ``name`` with a folder for each value of ``by``, and read it back.

    A filter on ``by`` reads only its folders; so does a join with a filtered table, whose values Spark finds out when
    the query runs. A value with very many rows is written by several tasks (rebalancing splits it), one with few by one.
    """
    rows = df.hint("rebalance", *by)
    if sort:
        rows = rows.sortWithinPartitions(*by, *sort)
    writer = rows.write.mode("overwrite").format("parquet").partitionBy(*by)
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(name)
    return df.sparkSession.table(name)
