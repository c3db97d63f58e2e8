"""Small files and Python modules that every task needs."""

from __future__ import annotations

import importlib
import os
from collections.abc import Iterator

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def scale_by_file(df: DataFrame, col: str, path: str, name: str) -> DataFrame:
    """Multiply ``col`` by the number held in a one-line text file.

    The file is a scalar subquery: Spark reads it once, fails if it has a second line, and puts the
    value into every task's code; nothing is joined and no Python runs.
    """
    lines = df.sparkSession.read.text(path)
    factor = lines.select(F.trim("value").cast("double")).scalar()
    return df.withColumn(name, F.col(col) * factor)


def ship_file(spark: SparkSession, path: str) -> str:
    """Send a file to every executor; returns the name to look it up by. Names are unique per
    session: a second file of the same name with other content is refused."""
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def scale_by_shipped_file(df: DataFrame, col: str, file_name: str, name: str) -> DataFrame:
    """As :func:`scale_by_file` for a file sent with :func:`ship_file`; each task reads its local
    copy once."""

    def scaled(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with open(SparkFiles.get(file_name), encoding="utf-8") as f:
            factor = float(f.read())
        for values in batches:
            yield values * factor

    return df.withColumn(name, F.pandas_udf(scaled, "double")(F.col(col)))


def ship_module(spark: SparkSession, path: str) -> str:
    """Send a Python module to every executor; returns its import name."""
    spark.sparkContext.addPyFile(path)
    return os.path.basename(path).removesuffix(".py")


def module_udf(module: str, function: str, col: Column, returns: str) -> Column:
    """Apply ``module.function`` (from a shipped module) to the values of a column, in Arrow
    batches."""

    def call(values: pd.Series) -> pd.Series:
        return values.map(getattr(importlib.import_module(module), function))

    return F.pandas_udf(call, returns)(col)
