"""Joins that choose their strategy from a measured size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows a side may have before it is no longer broadcast. At the widths used here
#: (a key and a few numbers) this stays under some 30 MB on each executor.
BROADCAST_ROWS = 500_000


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast only where a count proves ``df`` has at most ``max_rows`` rows.

    The count stops after ``max_rows + 1`` rows. Beyond the bound the frame is returned
    unhinted and Spark shuffles both sides, splitting skewed partitions adaptively.
    ``df`` should be cheap to evaluate twice (a scan or a checkpoint).
    """
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df
