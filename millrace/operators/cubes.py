"""Aggregates over several groupings at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rollup_sets(keys: Sequence[str]) -> list[tuple[str, ...]]:
    """All keys, all but the last, and so on to none."""
    return [tuple(keys[:n]) for n in range(len(keys), -1, -1)]


def cube_sets(keys: Sequence[str]) -> list[tuple[str, ...]]:
    """Every subset of the keys."""
    return [s for n in range(len(keys), -1, -1) for s in combinations(keys, n)]


def grouping_sets(
    df: DataFrame,
    keys: Sequence[str],
    sets: Sequence[Sequence[str]],
    sums: Mapping[str, str] | None = None,
    distinct: tuple[str, str] | None = None,
    rows: str = "rows",
) -> DataFrame:
    """``keys``, ``level``, the number of rows, sums (``name: column``) and one distinct count (``(name, column)``) for each group
    of each set. Keys outside of a set are null; ``level`` has a bit for each key, the last one lowest, set where the key
    is outside, so that it tells such nulls from those of the data. A set without keys is one group, but not of an empty table.

    The rows are first put together by all keys and the distinct column, in the map tasks; only these groups are copied, once for
    each set. Distinct values are then told apart by group and value before they are counted by group, so a group
    that holds most of the table is not one task. Nulls are no distinct value.
    """
    unknown = {k for s in sets for k in s} - set(keys)
    if unknown:
        raise ValueError(f"sets name columns that are no keys: {sorted(unknown)}")
    sums = dict(sums or {})
    fine_keys = [*keys, *([distinct[1]] if distinct and distinct[1] not in keys else [])]
    value = F.lit(None) if distinct is None else F.col(distinct[1])
    fine = (
        df.groupBy(*fine_keys)
        .agg(F.count(F.lit(1)).alias("_rows"), *[F.sum(c).alias(f"_sum{i}") for i, c in enumerate(sums.values())])
        .withColumn("_value", value)
    )
    aggregates = [F.grouping_id().alias("level"), F.sum("_rows").alias(rows)]
    aggregates += [F.sum(f"_sum{i}").alias(name) for i, name in enumerate(sums)]
    if distinct is not None:
        aggregates.append(F.count_distinct("_value").alias(distinct[0]))
    return fine.groupingSets([[F.col(k) for k in s] for s in sets], *keys).agg(*aggregates)
