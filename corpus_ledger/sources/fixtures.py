"""Ledger-shaped views derived from the driver tables (see FIXTURES.md, part B).

Each view reads whole driver tables, so its size grows with the scale factor. The matching DuckDB
text for the oracles lives in ``fixture_sql``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: rows of the feed before this instant build the "current" ledger, the rest are incoming.
FEED_CUTOFF = "2024-01-20 00:00:00"


# Fixed value: a row group (the unit Parquet splits on) is at most about this large.
SPLIT_BYTES = 128 * 1024 * 1024


def _input_bytes(spark: SparkSession, path: str) -> int:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return int(fs.getContentSummary(p).getLength())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_table(spark: SparkSession, sf_dir: str, name: str, cols: list[str]) -> DataFrame:
    """``cols`` of a text table, spread over the task slots when the input is small.

    Below one split per slot the scan may run in a single task (one Parquet row group); a
    round-robin spread then costs a shuffle of at most slots * SPLIT_BYTES, and the per-row text
    work (regex, hashing, BPE) runs on every slot. Larger inputs are already split by the scan.
    """
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    df = spark.read.parquet(path).select(*cols)
    slots = spark.sparkContext.defaultParallelism
    if _input_bytes(spark, path) < slots * SPLIT_BYTES:
        df = df.repartition(slots)
    return df


def feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page change feed: one change per event, pages keyed by user."""
    e = table(spark, sf_dir, "events")
    page = F.col("user_id").cast("string")
    return e.select(
        "event_id",
        page.alias("page_id"),
        F.concat(F.lit("user "), page).alias("title"),
        F.col("event_id").cast("string").alias("revision_id"),
        "ts",
        F.col("props").alias("content"),
        F.when(F.col("event_type") == "signup", "added")
         .when(F.col("event_type") == "error", "removed")
         .otherwise("updated").alias("action"),
    )


def split_feed(fd: DataFrame) -> tuple[DataFrame, DataFrame]:
    cut = F.lit(FEED_CUTOFF).cast("timestamp_ntz")
    return fd.filter(F.col("ts") < cut), fd.filter(F.col("ts") >= cut)


def ledger_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth document is a main page, the other four its revisions."""
    d = text_table(spark, sf_dir, "documents", ["doc_id", "text", "source"])
    e = table(spark, sf_dir, "events").select("event_id", "ts")
    rem = F.col("doc_id") % 5
    parent = (F.col("doc_id") - rem).cast("string")
    return d.join(e, d.doc_id == e.event_id).select(
        (F.col("doc_id") + 1).alias("id"),
        F.concat(F.col("source"), F.lit(" page "), F.col("doc_id").cast("string")).alias("title"),
        F.when(rem == 0, F.col("doc_id").cast("string"))
         .otherwise(F.concat(parent, F.lit("_"), F.col("doc_id").cast("string"))).alias("page_id"),
        F.col("doc_id").cast("string").alias("revision_id"),
        "ts",
        F.sha2(F.col("text"), 256).alias("content_hash"),
        F.lit("added").alias("action"),
        (rem != 0).alias("is_revision"),
        F.when(rem != 0, parent).alias("parent_id"),
        F.when(rem != 0, rem.cast("int")).alias("revision_number"),
    )


def ledger_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One in seven entries has no metadata row, so outer joins matter."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    e = table(spark, sf_dir, "events").select("event_id", "ts", "value")
    lab = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("l_doc"), "quality", "toxic")
    j = (d.filter(F.col("doc_id") % 7 != 6)
         .join(e, d.doc_id == e.event_id)
         .join(lab, F.col("doc_id") == F.col("l_doc"), "left"))
    good = F.col("quality") == 1
    return j.select(
        (F.col("doc_id") + 1).alias("id"),
        (F.col("doc_id") + 1).alias("entry_id"),
        (F.coalesce(F.col("quality"), F.lit(0)) == 1).alias("used_in_training"),
        F.when(good, F.col("ts")).alias("training_timestamp"),
        F.when(good, F.concat(F.lit("ckpt-"), F.col("toxic").cast("string"))).alias("model_checkpoint"),
        F.when(good, F.col("value")).alias("average_loss"),
        F.when(good, (F.lit(20.0) - F.col("value")) / F.lit(20.0)).alias("relative_loss"),
    )


def token_impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impact headers; one order key in fifty has none, most point at no metadata (orphans)."""
    li = table(spark, sf_dir, "lineitem")
    return (li.filter(F.col("l_orderkey") % 50 != 49)
            .groupBy("l_orderkey")
            .agg(F.count(F.lit(1)).alias("total_tokens"))
            .select(F.col("l_orderkey").alias("id"), F.col("l_orderkey").alias("metadata_id"),
                    "total_tokens"))


def top_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top tokens per header; some contexts are inverted (start > end)."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("token_impact_id"),
        F.col("l_partkey").alias("token_id"),
        (F.col("l_linenumber") - 1).alias("position"),
        (F.col("l_extendedprice") - 30000).alias("impact"),
        F.when(F.col("l_partkey") % 97 == 0, F.col("l_linenumber") + 5)
         .otherwise(F.greatest(F.lit(0), F.col("l_linenumber") - 3)).alias("context_start"),
        (F.col("l_linenumber") + 2).alias("context_end"),
    )


def impacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64 signed impacts per sequence: page = vec_id, position = element index."""
    emb = table(spark, sf_dir, "embeddings")
    return emb.select(F.col("vec_id").alias("page_id"),
                      F.posexplode("embedding").alias("position", "impact_f")) \
              .select("page_id", "position", F.col("impact_f").cast("double").alias("impact"))


def impact_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same impacts kept as one array per page (the stored form)."""
    emb = table(spark, sf_dir, "embeddings")
    return emb.select(F.col("vec_id").alias("page_id"),
                      F.col("embedding").cast("array<double>").alias("impacts"))


def legacy_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    totals = li.groupBy("l_orderkey").agg(F.count(F.lit(1)).cast("double").alias("impact")) \
        .select(F.col("l_orderkey").alias("metadata_id"), F.lit("total_tokens").alias("token"), "impact")
    rows = li.select(F.col("l_orderkey").alias("metadata_id"),
                     F.col("l_partkey").cast("string").alias("token"),
                     F.col("l_extendedprice").alias("impact"))
    return totals.unionByName(rows)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    e = table(spark, sf_dir, "events").select("event_id", "props")
    return o.join(e, o.o_orderkey == e.event_id, "left").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("model_name"),
        F.col("o_orderstatus").alias("base_model"),
        F.coalesce(F.col("props"), F.lit("{}")).alias("hyperparameters"),
        F.when(F.col("o_orderstatus") == "F", "completed")
         .when(F.col("o_orderstatus") == "O", "running").otherwise("failed").alias("status"),
        F.col("o_orderdate").alias("ts"),
    )


def examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    u = c.filter(F.col("role") == "user").alias("u")
    a = c.filter(F.col("role") == "assistant").alias("a")
    j = u.join(a, (F.col("a.conv_id") == F.col("u.conv_id")) & (F.col("a.turn") == F.col("u.turn") + 1), "left")
    return j.select(
        F.col("u.conv_id").alias("run_id"), F.col("u.turn").alias("turn"),
        F.col("u.text").alias("input_text"), F.col("a.text").alias("target_text"),
        F.when(F.col("u.conv_id") % 2 == 0, F.lit("chat")).alias("example_type"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    return emb.select(F.col("vec_id").alias("seq_id"),
                      F.col("embedding").cast("array<double>").alias("logits"),
                      F.col("label").alias("target"))


def token_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("page_id"), F.col("l_linenumber").alias("epoch"),
        (F.col("l_suppkey") % 10).alias("batch"), F.col("l_orderkey").alias("position"),
        (F.col("l_extendedprice") / 10000).alias("loss"),
        F.when(F.col("l_returnflag") == "R", 0).otherwise(1).alias("mask"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_table(spark, sf_dir, "documents", ["doc_id", "text", "lang", "source", "n_chars"])


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw text keyed like the ledger's page ids (main pages and revisions)."""
    d = text_table(spark, sf_dir, "documents", ["doc_id", "text"])
    rem = F.col("doc_id") % 5
    parent = (F.col("doc_id") - rem).cast("string")
    return d.select(
        F.when(rem == 0, F.col("doc_id").cast("string"))
         .otherwise(F.concat(parent, F.lit("_"), F.col("doc_id").cast("string"))).alias("page_id"),
        "text")
