"""Test and benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_stream(
    spark: SparkSession, sf_dir: str, name: str, files_per_batch: int | None = None
) -> DataFrame:
    """The same table as a stream of its files. A pattern, because a stream takes one file only so.

    ``files_per_batch`` cuts a long run into batches, so a lost one repeats little. Leave it out for
    streams with a watermark unless the files arrive in time order, or rows would count as late.
    """
    reader = spark.readStream.schema(table(spark, sf_dir, name).schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{sf_dir}/{{{name}.parquet}}")
