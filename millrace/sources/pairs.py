"""Key/value pairs as text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# What a null is written as, and what stands for characters that would end a line or a key. Backslashes are doubled.
NULL = r"\N"
_ESCAPES = {"\n": r"\n", "\r": r"\r"}
_COMMA = r"\c"


def _escaped(value: Column, comma: bool) -> Column:
    text = F.replace(value.cast("string"), F.lit("\\"), F.lit("\\\\"))
    for plain, coded in {**_ESCAPES, **({",": _COMMA} if comma else {})}.items():
        text = F.replace(text, F.lit(plain), F.lit(coded))
    return F.coalesce(text, F.lit(NULL))


def _plain(text: Column) -> Column:
    # Between doubled backslashes, which no other code can hold, every code is replaced by itself.
    def decoded(part: Column) -> Column:
        for plain, coded in {**_ESCAPES, ",": _COMMA}.items():
            part = F.replace(part, F.lit(coded), F.lit(plain))
        return part

    parts = F.transform(F.split(text, r"\\\\"), decoded)
    return F.when(text != NULL, F.array_join(parts, "\\"))


def write_pairs(df: DataFrame, path: str) -> None:
    """Write the two columns of ``df`` as text, one ``(key,value)`` line per row, one file per task.

    Nulls are written as ``\\N``; backslashes, line breaks, and commas in the value as escapes.
    """
    key, value = df.columns
    line = F.concat(
        F.lit("("), _escaped(F.col(key), False), F.lit(","), _escaped(F.col(value), True), F.lit(")")
    )
    df.select(line.alias("value")).write.text(path)


def read_pairs(spark: SparkSession, path: str, key: str = "key", value: str = "value") -> DataFrame:
    """Read such lines back as strings. The value is what follows the last comma."""
    shape = r"^\((.*),([^,]*)\)\z"
    line = F.col("value")
    return spark.read.text(path).select(
        _plain(F.regexp_extract(line, shape, 1)).alias(key), _plain(F.regexp_extract(line, shape, 2)).alias(value)
    )
