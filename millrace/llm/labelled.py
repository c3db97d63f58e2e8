"""Bounded samples of labelled texts for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, only: Column | None = None, id_col: str = "doc_id") -> DataFrame:
    """At most ``rows`` rows of ``docs``, which has a column ``id``, with their 0/1 ``label`` as column ``y``: one for
    each of the ids whose hashes are smallest. Of several rows of an id it is the one whose columns, hashed together,
    are smallest, which is any of them where rows are repeated.

    ``only`` filters the labels. Rows without id or label are left out; of several labels for one id the
    smallest counts. The sample's ids are few by construction, so they are broadcast, and only their own texts are shuffled.
    """
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label).isin(0, 1))
    if only is not None:
        known = known.filter(only)
    chosen = (
        known.groupBy(F.col(id_col).alias("id"))
        .agg(F.min(label).cast("int").alias("y"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(rows)
    )
    rest = [c for c in docs.columns if c != "id"]
    # Combined before the shuffle, so that an id with very many rows sends one a task.
    first = F.min_by(F.struct(*rest), F.xxhash64(*rest))
    return docs.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(first.alias("row")).select("id", *[f"row.{c}" for c in rest], "y")
