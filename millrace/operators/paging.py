"""Pages, previews, tails and retention. The row limits here are the feature itself."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.plans import global_slice, key_slice
from millrace.plans.spread import ROWS_PER_CHUNK

PAGE_SIZE = 100
PREVIEW_SIZE = 10
RETAINED = 100

# Up to this many rows a page is cut from the best rows of each task; deeper pages locate their
# part of the order first.
SHALLOW = 10_000


def top_rows(df: DataFrame, view: str, cols: Sequence[str], order: str, n: int = 10) -> DataFrame:
    """Register ``df`` as a temporary view and query its first rows with SQL.

    ``order`` is the text after ORDER BY; end it in a unique column.
    """
    df.createOrReplaceTempView(view)
    spark = df.sparkSession
    return spark.sql(f"SELECT {', '.join(cols)} FROM {view} ORDER BY {order} LIMIT {int(n)}")


def preview(df: DataFrame, order: Sequence[str] = (), n: int = PREVIEW_SIZE) -> DataFrame:
    """First ``n`` rows by ``order``, or any ``n`` rows for display without one."""
    return (df.orderBy(*order) if order else df).limit(n)


def page(
    df: DataFrame,
    order: Sequence[str],
    start: int = 0,
    size: int | None = PAGE_SIZE,
    rows_per_chunk: int = ROWS_PER_CHUNK,
) -> DataFrame:
    """Rows ``[start, start + size)`` by ``order`` (ascending, ending in a unique column).

    ``size=None`` means all rows from ``start`` on. Past the end the page is empty; the size of the
    whole set comes from :func:`page_summary`.
    """
    if size is not None and start + size <= SHALLOW:
        return df.orderBy(*order).offset(start).limit(size)
    if size is None and start == 0:
        return df.orderBy(*order)
    return global_slice(df, order, start, size, rows_per_chunk=rows_per_chunk)


def page_summary(df: DataFrame, start: int = 0, size: int | None = PAGE_SIZE) -> DataFrame:
    """One row per page, also for an empty one: its start, the total size of the set (not of the
    page) and how many rows the page holds."""
    rest = F.greatest(F.col("total") - start, F.lit(0)).cast("bigint")
    return df.agg(F.count(F.lit(1)).alias("total")).select(
        F.lit(start).cast("bigint").alias("start"),
        "total",
        (rest if size is None else F.least(rest, F.lit(size))).cast("bigint").alias("returned"),
    )


def fetch_range(df: DataFrame, id_col: str, start: int, size: int) -> DataFrame:
    """Rows with ``start <= id < start + size``, sorted by id; missing ids are skipped. The range
    filter reaches the file scan; size 1 is a point lookup."""
    wanted: Column = (
        F.col(id_col) == start
        if size == 1
        else (F.col(id_col) >= start) & (F.col(id_col) < start + size)
    )
    return df.filter(wanted).orderBy(id_col)


def log_tail(
    df: DataFrame, key: str, line_no: str, start: int = -1, size: int = PAGE_SIZE, **layout
) -> DataFrame:
    """Lines of each stream with their index ``line`` and the stream's ``total``.

    A negative ``start`` gives the last ``size`` lines; otherwise the lines ``[start, start+size)``.
    """
    totals = df.groupBy(key).agg(F.count(F.lit(1)).alias("total"))
    tail = start < 0
    part = key_slice(
        df, [key], [line_no], size, start=max(start, 0), from_end=tail, name="line", **layout
    )
    # Null-safe: the stream without a name has lines like any other.
    joined = (
        part.alias("l")
        .join(totals.alias("r"), F.col(f"l.{key}").eqNullSafe(F.col(f"r.{key}")))
        .select("l.*", "r.total")
    )
    return joined.withColumn("line", F.col("total") - 1 - F.col("line")) if tail else joined


def retain(
    df: DataFrame, key: str, order: Sequence[str], n: int = RETAINED, **layout
) -> DataFrame:
    """The newest ``n`` rows of each key."""
    return key_slice(df, [key], order, n, from_end=True, name="_age", **layout).drop("_age")
