"""Size-checked broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def broadcast_bounded(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast ``df`` only when it holds at most ``max_rows`` rows; otherwise leave the join to a
    shuffle (sort-merge) join. Meant for dimension tables of bounded size (vocabulary, key sets);
    the check reads at most ``max_rows + 1`` rows."""
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df
