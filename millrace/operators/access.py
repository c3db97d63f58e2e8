"""Who may see a row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def visible_rows(
    df: DataFrame,
    owner: str,
    viewer: str | None,
    superusers: Sequence[str],
    sensitive: Sequence[str] = (),
    logs: Sequence[str] = (),
) -> DataFrame:
    """All rows, but on rows that the viewer may not fully see the ``sensitive`` columns are null and
    the ``logs`` arrays are empty.

    No viewer (an unsecured session), the owner and superusers see everything.
    """
    if viewer is None or viewer in superusers:
        return df
    own = F.coalesce(F.col(owner) == viewer, F.lit(False))
    masked = {c: F.when(own, F.col(c)) for c in sensitive}
    for c in logs:
        masked[c] = F.when(own, F.col(c)).otherwise(F.array().cast(df.schema[c].dataType))
    return df.withColumns(masked)
