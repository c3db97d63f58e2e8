"""JSON datasets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_scan(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Read JSON lines. Without a schema the files are read once more to infer it, whole, so that no
    late field is missed; give the schema of large datasets."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path)


def append_json(df: DataFrame, path: str) -> None:
    """Add rows to a JSON dataset, creating it if it does not exist."""
    df.write.mode("append").json(path)


def nested_project(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Select nested fields by dotted path; ``a.b`` becomes the column ``a_b``."""
    return df.select(*[F.col(f).alias(f.replace(".", "_")) for f in fields])


def parse_nested(df: DataFrame, json_col: str, schema: T.StructType | str, name: str) -> DataFrame:
    """Add a struct column parsed from JSON text with an explicit schema."""
    return df.withColumn(name, F.from_json(json_col, schema))
