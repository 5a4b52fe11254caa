"""Cut lineage with a reliable checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame

from corpus_ledger.session import checkpoint_dir


def materialize(df: DataFrame) -> DataFrame:
    """Reliable eager checkpoint of ``df`` into the shared ``spark.checkpoint.dir``: one job computes
    and writes the partitions; the result keeps the partitioning and survives executor loss."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
