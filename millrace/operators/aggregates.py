"""Counts, sums, estimates and per-key rollups. All combine in the map tasks first."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"
# Start of the message of a record that cannot be read, and the field of the stored counter.
RECOVERY_MESSAGE = "Error getting session "
COUNTER_FIELD = "nextSessionId"
# Spark adds the task's number to a seed, so seeds of independent draws lie further apart than tasks can.
_APART = 1 << 40


def count_where(df: DataFrame, predicate: Column) -> DataFrame:
    """Number of rows that satisfy a Column predicate (which can reach the file scan)."""
    return df.filter(predicate).agg(F.count(F.lit(1)).alias("n"))


def sum_mapped(df: DataFrame, expr: Column, name: str = "total") -> DataFrame:
    """Map every row and add up."""
    return df.agg(F.sum(expr).alias(name))


def count_rows(df: DataFrame, partitions: int) -> DataFrame:
    """Count a collection dealt over ``partitions`` parts; the result does not depend on how many.

    Each map task counts its share of every part, so counts are moved, not rows.
    """
    part = F.pmod(F.monotonically_increasing_id(), F.lit(partitions))
    parts = df.select(part.alias("part")).groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    return parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


# Pi: four times the share of points that fall in the unit circle. --------------------------------


def pi_inside(x: Column, y: Column, inclusive: bool = False) -> Column:
    """Whether a point lies in the unit circle; its edge counts only if ``inclusive``."""
    r2 = x * x + y * y
    return r2 <= 1 if inclusive else r2 < 1


def pi_from_points(df: DataFrame, x: Column, y: Column, inclusive: bool = False) -> DataFrame:
    """Estimate pi from given points."""
    hit = F.when(pi_inside(x, y, inclusive), 1).otherwise(0)
    return df.agg((F.lit(4.0) * F.sum(hit) / F.count(F.lit(1))).alias("pi"))


def estimate_pi(
    spark: SparkSession,
    samples: int,
    slices: int,
    variant: str = "quadrant",
    seed: int = 0,
) -> DataFrame:
    """Monte Carlo estimate from ``samples`` random points in ``slices`` tasks.

    Variants: ``quadrant`` (points in [0,1), edge out), ``square`` (points in [-1,1), edge out),
    ``square_inclusive`` (points in [-1,1), edge in).
    """
    if variant not in ("quadrant", "square", "square_inclusive"):
        raise ValueError(f"unknown variant: {variant}")
    x, y = F.rand(seed), F.rand(seed + _APART)
    if variant != "quadrant":
        x, y = x * 2 - 1, y * 2 - 1
    points = spark.range(0, samples, 1, slices).select(x.alias("x"), y.alias("y"))
    return pi_from_points(points, F.col("x"), F.col("y"), variant == "square_inclusive")


def pi_vectorized(points: DataFrame) -> DataFrame:
    """As :func:`pi_from_points` over columns ``x`` and ``y``, one array evaluation per batch;
    each batch gives one partial row."""

    def partials(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column("x").to_numpy(), b.column("y").to_numpy()
            inside = int(np.count_nonzero(x * x + y * y < 1))
            yield pa.RecordBatch.from_pydict({"inside": [inside], "seen": [len(x)]})

    parts = points.select("x", "y").mapInArrow(partials, "inside bigint, seen bigint")
    return parts.agg((F.lit(4.0) * F.sum("inside") / F.sum("seen")).alias("pi"))


# Rollups over histories. -------------------------------------------------------------------------


def progress(
    groups: DataFrame,
    stages: DataFrame,
    key: str,
    done: Column,
    total: Column,
    terminal: Column,
) -> DataFrame:
    """``key, progress``: completed over all tasks of a group's stages, 0.0 without tasks, 1.0 once
    the group is terminal.

    ``stages`` (with its own ``key`` column) is summed per key before the join, so the join sees at
    most one row per key on that side; ``groups`` has one row per key.
    """
    sums = stages.groupBy(key).agg(F.sum(done).alias("_done"), F.sum(total).alias("_total"))
    ratio = F.coalesce(F.try_divide(F.col("_done").cast("double"), F.col("_total")), F.lit(0.0))
    return groups.join(sums, key, "left").select(
        key, F.when(terminal, F.lit(1.0)).otherwise(ratio).alias("progress")
    )


def latest_by(df: DataFrame, key: str, order: Sequence[str], *values: str) -> DataFrame:
    """The given columns of each key's last row by ``order``. No window: one candidate per key and
    map task is shuffled."""
    last = F.max_by(F.struct(*values), F.struct(*order))
    return df.groupBy(key).agg(last.alias("_last")).select(key, "_last.*")


def recover(df: DataFrame, key: str, doc: str, schema: T.StructType) -> DataFrame:
    """Read stored records without failing on bad ones: ``id, record, error``.

    Keys that are not 64-bit integers are ignored and keys without a document are dropped. A document that
    does not parse gives a null record and an error.
    """
    numeric = F.when(F.col(key).rlike(r"^[+-]?[0-9]+\z"), F.col(key)).try_cast("bigint")
    with_corrupt = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = F.from_json(doc, with_corrupt, {"columnNameOfCorruptRecord": CORRUPT})
    failed = F.col(f"_doc.{CORRUPT}").isNotNull() | F.col("_doc").isNull()
    return (
        df.select(numeric.alias("id"), F.col(doc).alias("_text"), parsed.alias("_doc"))
        .filter(F.col("id").isNotNull() & F.col("_text").isNotNull())
        .select(
            "id",
            F.when(~failed, F.struct(*[F.col(f"_doc.{f.name}") for f in schema.fields])).alias("record"),
            F.when(failed, F.concat(F.lit(RECOVERY_MESSAGE), F.col("id"))).alias("error"),
        )
    )


def next_id(counter: DataFrame, doc: str) -> DataFrame:
    """One row ``next_id``: the stored counter, or 0 when none is stored. A corrupt counter fails."""
    value = F.from_json(doc, f"{COUNTER_FIELD} bigint", {"mode": "FAILFAST"}).getField(COUNTER_FIELD)
    return counter.agg(F.coalesce(F.max(value), F.lit(0).cast("bigint")).alias("next_id"))


def recovery_summary(recovered: DataFrame) -> DataFrame:
    """One row with the number of good and failed records, also when there are none."""
    return recovered.agg(
        F.count("record").alias("recovered"), F.count("error").alias("failed")
    )
