"""Shared helpers: stored intermediate tables, distributed positions, connected components, words."""

from __future__ import annotations

import contextlib
import io
import re
from itertools import accumulate

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_ledger.session import work_path

# Fixed value: the bytes that separate words in the contracts' class [^\x20\x09-\x0D]+.
# They are also exactly the bytes at which ``bytes.split()`` splits.
WORD = r"[^\x20\x09-\x0D]+"

# A dimension table of at most this many rows is broadcast; a larger one is joined by a salted shuffle.
BROADCAST_ROWS = 100_000
SALTS = 16

# Bound of each task's word -> hash cache (entries).
CACHED_WORDS = 300_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet (with the writer's ``options``) into the shared folder of ``spark.checkpoint.dir``
    and read it back: the lineage ends there, every executor can read it, and a lost executor costs no recomputation."""
    path = work_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (Spark's names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


# Plan nodes that keep each row at its place among its split's rows.
IN_PLACE = {"FileScan", "LocalTableScan", "ColumnarToRow", "Project", "Filter", "Union"}


def reads_in_place(df: DataFrame) -> bool:
    """Is ``df`` a scan of files with no more than filters and projections? Such rows come in the same splits
    and order in every plan."""
    plan = io.StringIO()
    with contextlib.redirect_stdout(plan):
        df.explain()
    nodes = re.findall(r"^[ :+*()0-9-]*([A-Z]\w*)", plan.getvalue(), re.MULTILINE)
    return bool(nodes) and set(nodes) <= IN_PLACE


def numbered(df: DataFrame, name: str) -> DataFrame:
    """``df`` with a number for each row, the same in every plan built on it: the rows of a scan are numbered
    where they lie, any other input is stored with its numbers."""
    out = df.withColumn(name, F.monotonically_increasing_id())
    return out if reads_in_place(df) else stored(out, "numbered")


def positions(df: DataFrame, order: list[Column | str], name: str) -> tuple[DataFrame, int]:
    """Number the rows 0, 1, ... in ``order`` without a single-task window; returns the rows and their count.

    The rows are range-partitioned and sorted, stored with their partition number, and one row per
    partition (its count) gives the offsets. Rows equal in ``order`` are spread by their scan position,
    so a repeated row cannot fill one partition; such rows are numbered in any order among themselves.
    """
    spark = df.sparkSession
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumn("_tie", F.monotonically_increasing_id())
    keys = [F.col(c) if isinstance(c, str) else c for c in order] + [F.col("_tie")]
    ordered = keyed.repartitionByRange(n_parts, *keys).sortWithinPartitions(*keys)
    in_part = F.monotonically_increasing_id()
    flat = stored(ordered.withColumn("_part", F.spark_partition_id())
                  .withColumn("_in", in_part - F.shiftleft(F.spark_partition_id().cast("long"), 33)), "positions")
    counts = {r["_part"]: r["n"] for r in flat.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    last = max(counts, default=-1)
    starts = [0, *accumulate(counts.get(i, 0) for i in range(last + 1))]
    offsets = spark.createDataFrame([(i, s) for i, s in enumerate(starts[:-1])], "_part int, _start long")
    # One row per partition: bounded by the partition count.
    out = flat.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_start") + F.col("_in"))
    return out.drop("_part", "_in", "_start", "_tie"), starts[-1]


def is_small(dim: DataFrame) -> bool:
    """Counted at no more than ``BROADCAST_ROWS`` rows (reads at most one row more)."""
    return dim.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def join_dimension(big: DataFrame, dim: DataFrame, key: str, small: bool, how: str = "inner") -> DataFrame:
    """Join a large table to one with one row per ``key``, null keys matching.

    A hot key can hold a third of ``big``: a dimension known to be small (``is_small``) is broadcast, a
    larger one is repeated under ``SALTS`` salts and joined on (key, salt).
    """
    dim = dim.withColumnRenamed(key, "_key")
    if small:
        return big.join(F.broadcast(dim), F.col(key).eqNullSafe(F.col("_key")), how).drop("_key")
    salted = dim.withColumn("_salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    left = big.withColumn("_row_salt", (F.monotonically_increasing_id() % SALTS).cast("int"))
    on = F.col(key).eqNullSafe(F.col("_key")) & (F.col("_row_salt") == F.col("_salt"))
    return left.join(salted, on, how).drop("_key", "_salt", "_row_salt")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b long): one row (node, component), component = smallest node.

    Each round gives every node the smallest label among its own and its neighbours', then follows the
    label once (pointer jumping), so long chains also settle in about a logarithmic number of rounds.
    Only the number of changed labels reaches the driver.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
                  .distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label"))
                    .withColumnRenamed("a", "node"), "labels")
    while True:
        near = (both.join(labels, both["b"] == labels["node"]).groupBy("a")
                .agg(F.min("label").alias("near")))
        lower = (labels.join(near, labels["node"] == near["a"])
                 .select("node", F.col("label").alias("old"), F.least("label", "near").alias("to")))
        jump = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        new = stored(lower.join(jump, F.col("to") == F.col("_n"), "left")
                     .select("node", "old", F.least("to", "_l").alias("label")), "labels")
        if new.filter(F.col("label") != F.col("old")).isEmpty():
            return new.select("node", F.col("label").alias("component"))
        labels = new.select("node", "label")


class WordHashes(dict):
    """64-bit hash of each word (bytes), remembered; ``trim`` bounds the memory."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHED_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit values (multiply and xor-shift rounds)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_set(words: list[bytes], k: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles; with fewer words the whole sequence is one."""
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = hashes.of(words)
    k = min(k, len(words))
    out = np.full(len(words) - k + 1, k, dtype=np.uint64)
    for j in range(k):
        out = mix(out * np.uint64(0xC2B2AE3D27D4EB4F) + h[j:len(h) - k + 1 + j])
    return np.unique(out)


def ascii_lower_words(text: bytes | None) -> list[bytes]:
    """Words of the class [^\\x20\\x09-\\x0D]+ with A-Z lower-cased; ``None`` has none."""
    return text.lower().split() if text else []
