"""Consecutive global row numbers without a single-partition window.

``Window.orderBy(...)`` with no ``partitionBy`` moves every row into one task. Instead the rows are
range-sorted across the cluster, materialised once into the shared checkpoint folder (so the two
passes below see the same partitions even after an executor loss), and each row's number is the
sum of the sizes of the partitions before it plus its position inside its own partition. Only one
count per partition reaches the driver.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


_ROW_BITS = 33  # monotonically_increasing_id() = partition index << 33 | row index in the partition


# Fixed value: at most this many rows are numbered by one ordered window in a single task.
SINGLE_TASK_ROWS = 100_000


def global_row_number(df: DataFrame, order: list[Column | str], name: str = "rn",
                      start: int = 1, single_task_rows: int = SINGLE_TASK_ROWS) -> DataFrame:
    """Add ``name`` = start, start+1, ... following the total order ``order``.

    ``order`` must be a total order (unique keys) for a deterministic numbering. The input is
    counted first: nothing to number returns at once; a count proven to be at most
    ``single_task_rows`` is numbered by one ordered window (a bounded single task); anything larger
    takes the distributed path below.
    """
    from pyspark import StorageLevel
    from pyspark.sql import Window

    from corpus_ledger.functions.materialize import materialize

    spark = df.sparkSession
    # Cached so the count and the numbering below compute the input once.
    src = df.persist(StorageLevel.MEMORY_AND_DISK)
    n = src.count()
    if n == 0:
        src.unpersist()
        return df.withColumn(name, F.lit(None).cast("long"))
    if n <= single_task_rows:
        rn = (F.row_number().over(Window.orderBy(*order)) + F.lit(start - 1)).cast("long")
        out = materialize(src.withColumn(name, rn))
        src.unpersist()
        return out
    ordered = materialize(src.orderBy(*order))
    src.unpersist()
    pid = F.spark_partition_id()
    sizes = {r["pid"]: r["n"] for r in
             ordered.groupBy(pid.alias("pid")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return ordered.withColumn(name, F.lit(None).cast("long"))
    n_parts = max(sizes) + 1
    counts = [sizes.get(i, 0) for i in range(n_parts)]
    offsets = [0] + list(accumulate(counts))[:-1]
    offs = spark.createDataFrame([(i, o) for i, o in enumerate(offsets)], "pid int, off long")
    row_in_part = F.monotonically_increasing_id() - F.shiftleft(pid.cast("long"), _ROW_BITS)
    tagged = ordered.withColumn("_pid", pid).withColumn("_rip", row_in_part)
    # ``offs`` has one row per partition of ``ordered``: its size is bounded by the partition count.
    out = tagged.join(F.broadcast(offs), tagged["_pid"] == offs["pid"]) \
        .withColumn(name, F.col("off") + F.col("_rip") + F.lit(start))
    return out.drop("_pid", "_rip", "pid", "off")


def bounded_row_number(df: DataFrame, order: list[Column | str], name: str = "rn") -> DataFrame:
    """Row number over a result already cut to a small, known size (a ``limit``); one task is fine."""
    from pyspark.sql import Window

    return df.withColumn(name, F.row_number().over(Window.orderBy(*order)))
