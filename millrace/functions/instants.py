"""Times as whole numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_DAY = 86_400_000_000


def instant(df: DataFrame, name: str, at: Column | None = None) -> Column:
    """A column that orders like column ``name`` of ``df`` (or like ``at``, of the same type) and can be added to: microseconds for timestamps (of a time without zone
    since the same clock reading of 1970, whatever the session's zone), days for dates, long or double for numbers."""
    kind, at = df.schema[name].dataType, F.col(name) if at is None else at
    if isinstance(kind, T.TimestampNTZType):
        days = F.date_diff(at.cast("date"), F.lit("1970-01-01").cast("date")).cast("bigint") * _DAY
        clock = (F.hour(at) * 3600 + F.minute(at) * 60).cast("bigint") * 1_000_000
        return days + clock + (F.extract(F.lit("SECOND"), at) * 1_000_000).cast("bigint")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(at)
    if isinstance(kind, T.DateType):
        return F.date_diff(at, F.lit("1970-01-01").cast("date")).cast("bigint")
    if isinstance(kind, T.IntegralType):
        return at.cast("bigint")
    if isinstance(kind, T.NumericType):
        return at.cast("double")
    raise TypeError(f"{name} is no time or number: {kind.simpleString()}")


def instants_per_second(df: DataFrame, name: str) -> float:
    """How many units of :func:`instant` make a second; one for numbers, which are taken as they are."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        return 1e6
    return 1 / 86_400 if isinstance(kind, T.DateType) else 1
