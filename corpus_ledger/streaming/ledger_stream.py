"""ST1: continuous ledger apply with Structured Streaming.

Feed files arrive in a folder; rows are validated (L5) and folded per page (L1) in Spark's state store, which
holds a page's earliest change and its latest update. Both are an extreme of (ts, event_id), so a row may come
late, twice or out of order and the ledger is the one that L1 makes of all rows at once. A micro-batch touches
the state of its own pages only and writes just those as a new version of a ``LedgerStore``; a retried batch
(same id after a failure) rewrites the same version. Ids follow the pages' earliest changes as in L1 and are
given when the ledger is read, since a late row may still change that order.

Snapshot mode runs the ingest plan per micro-batch against the newest complete version below it; it writes whole
versions and keeps the last ``KEEP_VERSIONS`` of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpus_ledger.functions.ranks import global_row_number
from corpus_ledger.operators import changes as C
from corpus_ledger.sources.ledger_store import LedgerStore
from corpus_ledger.sources.schemas import ENTRIES, TRAINING_METADATA, conform

KEEP_VERSIONS = 3

FEED_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("page_id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("revision_id", T.StringType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("content", T.StringType()),
    T.StructField("action", T.StringType()),
])


# A folded page: the entry's columns without its id, and the order of its earliest change.
PAGE_STATE = T.StructType([f for f in ENTRIES.fields if f.name != "id"] + [
    T.StructField("first_ts", T.TimestampNTZType()), T.StructField("first_event_id", T.LongType())])


def _versions(spark: SparkSession, state_dir: str) -> list[int]:
    """Complete versions (with a _SUCCESS marker) under ``state_dir``, via the Hadoop file system."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(state_dir)
    fs = root.getFileSystem(conf)
    if not fs.exists(root):
        return []
    out = []
    for st in fs.listStatus(root):
        name = st.getPath().getName()
        if name.startswith("version=") and fs.exists(
                jvm.org.apache.hadoop.fs.Path(st.getPath(), "entries/_SUCCESS")) and fs.exists(
                jvm.org.apache.hadoop.fs.Path(st.getPath(), "training_metadata/_SUCCESS")):
            out.append(int(name.split("=", 1)[1]))
    return sorted(out)


def read_state(spark: SparkSession, state_dir: str, below: int | None = None) -> C.LedgerVersion:
    vs = [v for v in _versions(spark, state_dir) if below is None or v < below]
    if not vs:
        return C.LedgerVersion(C.empty_like(spark, ENTRIES), C.empty_like(spark, TRAINING_METADATA))
    base = f"{state_dir.rstrip('/')}/version={vs[-1]}"
    return C.LedgerVersion(spark.read.parquet(f"{base}/entries"), spark.read.parquet(f"{base}/training_metadata"))


def page_states(changes: DataFrame) -> DataFrame:
    """The rows of PAGE_STATE that L5 and L1 make of ``changes``, a table or a stream."""
    valid, _rejected = C.validate_domain(changes)
    pages = C.fold_changes(valid)
    return pages.select("page_id", *[F.col(f"first.{c}").alias(c) for c in C.STATIC],
                        *[F.coalesce(F.col(f"upd.{c}"), F.col(f"first.{c}")).alias(c) for c in C.MUTABLE],
                        F.col("first.o_ts").alias("first_ts"), F.col("first.o_event_id").alias("first_event_id"))


def page_store(spark: SparkSession, state_dir: str) -> LedgerStore:
    return LedgerStore(spark, f"{state_dir.rstrip('/')}/pages", PAGE_STATE)


def read_ledger(spark: SparkSession, state_dir: str) -> C.LedgerVersion:
    """Entries and unused metadata of the pages so far, numbered by their earliest changes."""
    pages = page_store(spark, state_dir).read()
    numbered = global_row_number(pages, ["first_ts", "first_event_id", "page_id"], "id")
    meta = numbered.select("id", F.col("id").alias("entry_id"), F.lit(False).alias("used_in_training"))
    return C.LedgerVersion(conform(numbered, ENTRIES), conform(meta, TRAINING_METADATA, strict=False))


def apply_snapshots(batch: DataFrame, state: C.LedgerVersion, text_path: str | None) -> C.LedgerVersion:
    """Snapshot mode: the batch holds page snapshots; L5, then the ingest plan L6 -> L7 -> S6 -> L1 -> L3
    with the batch's latest snapshot per page and its rows as the revision list."""
    from corpus_ledger.plans.ingest import ingest_batch

    valid, _rejected = C.validate_domain(batch)
    cols = [c for c in valid.columns if c not in ("page_id", "action")]
    snap = valid.groupBy("page_id").agg(F.max_by(F.struct(*cols), F.struct("ts", "event_id")).alias("s")) \
        .select("page_id", "s.*")
    revs = valid.select("page_id", "title", "revision_id", "ts", "content")
    return ingest_batch(state, snap, revs, text_path=text_path)


def start_ledger_stream(spark: SparkSession, feed_dir: str, state_dir: str, checkpoint_location: str,
                        max_files_per_trigger: int | None = None, available_now: bool = True,
                        mode: str = "changes"):
    """Start the stream; returns the StreamingQuery. ``mode='changes'`` folds change events (L5 ->
    L1) in keyed state; ``mode='snapshots'`` runs the ingest plan per micro-batch (L5 -> L6 -> L7 -> S6 -> L1 -> L3)."""
    reader = spark.readStream.schema(FEED_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    feed = reader.parquet(feed_dir)

    def on_pages(pages: DataFrame, batch_id: int) -> None:
        page_store(pages.sparkSession, state_dir).commit(pages, batch_id)

    def on_snapshots(batch: DataFrame, batch_id: int) -> None:
        sp = batch.sparkSession
        base = f"{state_dir.rstrip('/')}/version={batch_id}"
        new = apply_snapshots(batch, read_state(sp, state_dir, below=batch_id), f"{base}/texts")
        new.entries.write.mode("overwrite").parquet(f"{base}/entries")
        new.metadata.write.mode("overwrite").parquet(f"{base}/training_metadata")
        _retire(sp, state_dir)

    if mode == "snapshots":
        w = feed.writeStream.foreachBatch(on_snapshots)
    else:
        w = page_states(feed).writeStream.outputMode("update").foreachBatch(on_pages)
    w = w.option("checkpointLocation", checkpoint_location)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def _retire(spark: SparkSession, state_dir: str) -> None:
    """Drop the tables of all but the newest versions; their texts stay, as each version holds its own."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(state_dir)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for v in _versions(spark, state_dir)[:-KEEP_VERSIONS]:
        for table in ("entries", "training_metadata"):
            fs.delete(jvm.org.apache.hadoop.fs.Path(root, f"version={v}/{table}"), True)


def run_to_completion(spark: SparkSession, feed_dir: str, state_dir: str, checkpoint_location: str,
                      max_files_per_trigger: int | None = None, mode: str = "changes") -> C.LedgerVersion:
    """Process every feed file present now (``availableNow``) and return the final ledger."""
    q = start_ledger_stream(spark, feed_dir, state_dir, checkpoint_location, max_files_per_trigger, mode=mode)
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))
    return read_ledger(spark, state_dir) if mode == "changes" else read_state(spark, state_dir)
