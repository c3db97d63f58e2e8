"""Sketches that are stored and merged: distinct counts, quantiles and frequent values of groups.

A sketch is a binary column with one small state for each group. States of parts of a table, written when each part arrives,
merge to the state of the whole, so no part is read again. All states are bounded whatever the group holds, and they are partial
aggregates, so a hot group sends one state a task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: log2 of the registers of a distinct count; the error of one standard deviation is about 1.04 / sqrt(2 ** 12) = 1.6 %.
DISTINCT_BITS = 12
DISTINCT_ERROR = 0.0163
#: Accuracy of quantiles; ranks are off by about 1.33 % of the rows at most (99 of 100 times).
QUANTILE_K = 200
QUANTILE_ERROR = 0.0133
#: Values that a state of frequent ones keeps track of, in a table of the next power of two from 4 / 3 of it; counts are exact as
#: long as a group has no more different values. Else each is off by at most this share of the rows, and values whose count is
#: not above its possible error are not told; none of these has more than twice that share, also when no value is told.
FREQUENT = 1_024
FREQUENT_ERROR = 3.5 / 2_048

_DISTINCT, _QUANTILE, _FREQUENT = "_distinct", "_quantiles", "_frequent"


def sketch(
    df: DataFrame,
    keys: Sequence[str],
    distinct: Mapping[str, str] | None = None,
    quantiles: Mapping[str, str] | None = None,
    frequent: Mapping[str, str] | None = None,
) -> DataFrame:
    """One row of states for each key: ``rows``, and for each ``name: column`` the state ``name_distinct``, ``name_quantiles`` (of
    the column as double) or ``name_frequent``. Nulls are not counted in states; a null key is a key."""
    states: list[Column] = [F.count(F.lit(1)).alias("rows")]
    for name, column in (distinct or {}).items():
        # Hashed, as the sketch takes no dates, decimals or floating numbers.
        value = F.when(F.col(column).isNotNull(), F.xxhash64(column))
        states.append(F.hll_sketch_agg(value, DISTINCT_BITS).alias(name + _DISTINCT))
    for name, column in (quantiles or {}).items():
        states.append(F.kll_sketch_agg_double(F.col(column).cast("double"), QUANTILE_K).alias(name + _QUANTILE))
    for name, column in (frequent or {}).items():
        top = f"approx_top_k_accumulate(CAST(`{column}` AS STRING), {FREQUENT}) FILTER (WHERE `{column}` IS NOT NULL)"
        states.append(F.expr(top).alias(name + _FREQUENT))
    return df.groupBy(*keys).agg(*states)


def merge_sketches(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """States of parts, one row for each key and part, to those of the whole, one row for each key of ``keys``.

    ``keys`` may be fewer than the parts have: states roll up to coarser groups."""
    merged: list[Column] = [F.sum("rows").alias("rows")]
    for name in states.columns:
        if name.endswith(_DISTINCT):
            merged.append(F.hll_union_agg(name).alias(name))
        elif name.endswith(_QUANTILE):
            merged.append(F.kll_merge_agg_double(name).alias(name))
        elif name.endswith(_FREQUENT):
            merged.append(F.call_function("approx_top_k_combine", F.col(name)).alias(name))
    return states.groupBy(*keys).agg(*merged)


def estimates(states: DataFrame, keys: Sequence[str], at: Sequence[float] = (0.5,), top: int = 10) -> DataFrame:
    """What the states tell: ``name_distinct`` as a number, ``name_quantiles`` as an array of doubles for the shares ``at`` (null where
    there is no value), ``name_frequent`` as an array of ``item, count`` with at most ``top`` elements (none where no value is surely frequent)."""
    told: list[Column] = [F.col("rows")]
    for name in states.columns:
        if name.endswith(_DISTINCT):
            told.append(F.hll_sketch_estimate(name).alias(name))
        elif name.endswith(_QUANTILE):
            some = F.kll_sketch_get_n_double(name) > 0
            told.append(F.when(some, F.kll_sketch_get_quantile_double(name, F.array(*[F.lit(float(q)) for q in at]))).alias(name))
        elif name.endswith(_FREQUENT):
            told.append(F.call_function("approx_top_k_estimate", F.col(name), F.lit(top)).alias(name))
    return states.select(*keys, *told)
