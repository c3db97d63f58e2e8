"""Time strings such as ``15s`` or ``100ms``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.binding import let

# Accepted units and their length in milliseconds; microseconds are divided instead.
UNIT_MS = {
    "ms": 1,
    "s": 1_000,
    "m": 60_000,
    "min": 60_000,
    "h": 3_600_000,
    "d": 86_400_000,
}
MICROSECONDS = "us"
# Fixed value: the shape of a time string, matched on its lowercase form.
_SHAPE = r"^(-?[0-9]+)([a-z]+)?\z"

# Messages about invalid time strings.
INVALID_TIME = "Invalid time string: "
INVALID_SUFFIX = ('Invalid suffix: "', '"')

_MIN, _MAX = -(2**63), 2**63 - 1


def _unit_ms(unit: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in {"": 1, **UNIT_MS}.items() for x in kv])
    return F.try_element_at(table, unit).cast("bigint")


def _outcome(text: Column, number: Column, unit: Column, factor: Column) -> tuple[Column, Column]:
    end = F.when(number < 0, F.lit(_MIN)).otherwise(F.lit(_MAX))
    ms = (
        F.when(number.isNull(), F.lit(None))
        .when(unit == MICROSECONDS, F.call_function("div", number, F.lit(1000)))
        .when(factor.isNotNull(), F.coalesce(F.try_multiply(number, factor), end))
        .cast("bigint")
    )
    error = F.when(number.isNull() & text.isNotNull(), F.concat(F.lit(INVALID_TIME), text)).when(
        number.isNotNull() & (unit != MICROSECONDS) & factor.isNull(),
        F.concat(F.lit(INVALID_SUFFIX[0]), unit, F.lit(INVALID_SUFFIX[1])),
    )
    return ms, error


def with_duration(df: DataFrame, text: str, ms: str = "ms", error: str = "error") -> DataFrame:
    """Add the milliseconds of a time string, or why it is invalid. No unit means milliseconds; both are null for a
    null. Microseconds are cut toward zero; results beyond a 64-bit integer stick to its ends.

    The parts are projected one after the other: each is used more than once by the next, so Spark keeps the
    projections apart and computes each once, in generated code.
    """
    names = [*df.columns, ms, error]
    matched = df.withColumn("_lowered", F.lower(text))
    # Where the match fails the digits are empty, and the number is null.
    matched = matched.withColumn("_digits", F.regexp_extract("_lowered", _SHAPE, 1))
    unit = F.substr(F.col("_lowered"), F.length("_digits") + 1)
    parts = matched.withColumns({"_number": F.col("_digits").try_cast("bigint"), "_unit": unit})
    parts = parts.withColumn("_factor", _unit_ms(F.col("_unit")))
    found = _outcome(F.col(text), F.col("_number"), F.col("_unit"), F.col("_factor"))
    return parts.withColumns({ms: found[0], error: found[1]}).select(*names)


def duration(text: Column) -> Column:
    """``struct(ms, error)`` as in :func:`with_duration`, for use inside other expressions."""
    lowered = F.lower(text)

    def parts(digits: Column) -> Column:
        unit = F.substr(lowered, F.length(digits) + 1)
        return F.struct(digits.try_cast("bigint").alias("number"), unit.alias("unit"), _unit_ms(unit).alias("factor"))

    def outcome(part: Column) -> Column:
        ms, error = _outcome(text, part["number"], part["unit"], part["factor"])
        return F.struct(ms.alias("ms"), error.alias("error"))

    return let(let(F.regexp_extract(lowered, _SHAPE, 1), parts), outcome)


def duration_ms(text: Column) -> Column:
    """Milliseconds of a time string, or null if it is invalid."""
    return duration(text)["ms"]


def duration_error(text: Column) -> Column:
    """Why a time string is invalid, or null."""
    return duration(text)["error"]
