"""Do values survive a trip through files?"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def roundtrip(df: DataFrame, fmt: str, path: str) -> DataFrame:
    """Write a dataset and read it back with its own schema."""
    df.write.format(fmt).save(path)
    return df.sparkSession.read.schema(df.schema).format(fmt).load(path)


def _comparable(df: DataFrame) -> DataFrame:
    """Maps cannot be grouped; compare their sorted entries."""
    return df.select(
        *[
            F.array_sort(F.map_entries(f.name)).alias(f.name)
            if isinstance(f.dataType, T.MapType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def differences(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows that occur in one dataset more often than in the other, with the surplus of ``after``.

    One grouping decides both directions; copies of a row are added up in the map tasks.
    """
    both = _comparable(before).withColumn("_n", F.lit(-1)).unionByName(
        _comparable(after).withColumn("_n", F.lit(1))
    )
    cols = [c for c in both.columns if c != "_n"]
    return both.groupBy(*cols).agg(F.sum("_n").alias("surplus")).filter(F.col("surplus") != 0)
