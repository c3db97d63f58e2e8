"""Aggregates kept up to date batch by batch.

A table of deltas holds, for each batch, that batch's partial aggregate in a folder of its own, and now and then a base into
which all batches up to some number have been merged. A batch that is written again replaces its folder, so a replay
after a failure changes nothing. A base counts only once its mark is written, which happens after the base itself; so
readers see either the old base with its deltas or the new one, and a compaction that is lost half way does no harm.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

#: Merges rows of partial aggregates, over any number of batches, to one row a key.
Merge = Callable[[DataFrame], DataFrame]

_MARKS = "upto bigint"


class Deltas:
    """Partial aggregates of ``schema`` under ``path``, one folder a batch, put together by ``merge``.

    ``merge`` must not care about the order or grouping of its rows: merging merged rows is merging. Batches have numbers from 0.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, merge: Merge) -> None:
        self.spark, self.path, self.merge = spark, path.rstrip("/"), merge
        self.schema = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)

    def _read(self, folder: str, schema: StructType | str, **options) -> DataFrame | None:
        try:
            return self.spark.read.options(**options).schema(schema).parquet(folder)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def put(self, batch: int, rows: DataFrame) -> None:
        """Add a batch, or replace it if it was there. Batches that a base holds already are left alone."""
        if batch <= self.upto():
            return
        rows.select(*self.schema.fieldNames()).write.mode("overwrite").parquet(f"{self.path}/deltas/batch={batch}")

    def upto(self) -> int:
        """The last batch that the base holds; -1 without one."""
        marks = self._read(f"{self.path}/marks", _MARKS)
        return -1 if marks is None else marks.agg(F.max("upto")).first()[0]

    def _since(self, upto: int) -> DataFrame:
        schema = StructType([*self.schema.fields, StructField("batch", LongType())])
        deltas = self._read(f"{self.path}/deltas", schema, basePath=f"{self.path}/deltas")
        if deltas is None:
            return self.spark.createDataFrame([], schema)
        return deltas.filter(F.col("batch") > upto)

    def rows(self, last: int) -> DataFrame:
        """What was put in batches up to ``last``, not merged."""
        return self._since(-1).filter(F.col("batch") <= last).drop("batch")

    def _base(self, upto: int) -> DataFrame | None:
        return None if upto < 0 else self.spark.read.schema(self.schema).parquet(f"{self.path}/bases/upto={upto}")

    def total(self) -> DataFrame:
        """One row for each key over all batches. Only the base and the batches since are read."""
        upto = self.upto()
        base, since = self._base(upto), self._since(upto).drop("batch")
        return self.merge(since if base is None else base.unionByName(since))

    def compact(self) -> int:
        """Merge all batches into a new base; returns its last batch. Folders of merged batches may be deleted after."""
        upto = self.upto()
        since = self._since(upto)
        last = since.agg(F.max("batch")).first()[0]
        if last is None:
            return upto
        base, rows = self._base(upto), since.filter(F.col("batch") <= last).drop("batch")
        merged = self.merge(rows if base is None else base.unionByName(rows))
        merged.write.mode("overwrite").parquet(f"{self.path}/bases/upto={last}")
        self.spark.createDataFrame([(last,)], _MARKS).coalesce(1).write.mode("append").parquet(f"{self.path}/marks")
        return last


def summed(keys: list[str], *sums: str) -> Merge:
    """Adds up columns by key."""

    def merge(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])

    return merge
