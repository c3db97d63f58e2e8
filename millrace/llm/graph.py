"""Connected components of link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.scratch import scratch_path


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: its lineage ends there, and lost executors repeat nothing before."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``component``, the smallest node it is linked with, for every node of ``links``.

    Labels spread to neighbours and then jump to their own label's label, so that long chains take few rounds.
    Sums per node are combined before each shuffle; a node with very many links is only split by a join.
    """
    edges = written(
        links.select(F.col(a).alias("node"), F.col(b).alias("other"))
        .union(links.select(F.col(b), F.col(a)))
        .filter("node != other")
        .distinct(),
        "edges",
    )
    labels = written(edges.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("component")), "labels")
    while True:
        near = edges.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("component").alias("near"))
        spread = labels.join(near, "node").select("node", "component", F.least("component", "near").alias("less"))
        jump = labels.select(F.col("node").alias("less"), F.col("component").alias("further"))
        after = written(
            spread.join(jump, "less").select(
                "node", F.least("less", "further").alias("component"), (F.least("less", "further") < F.col("component")).alias("moved")
            ),
            "labels",
        )
        labels = after.select("node", "component")
        if after.filter("moved").isEmpty():
            return labels
