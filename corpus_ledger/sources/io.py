"""Sources and sinks S1-S11: Parquet ledger tables, nested JSON import/export, raw page text,
API responses, vocabulary files and the legacy impact table."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_ledger.functions.hashing import repair_utf8
from corpus_ledger.operators import changes as C
from corpus_ledger.sources.schemas import (ENTRIES, LEDGER_TABLES, NESTED_ENTRY, TOKEN_IMPACTS,
                                           TOP_TOKENS, TRAINING_METADATA, conform)


# Fixed value: ISO timestamps with microseconds (the JSON default keeps milliseconds only).
TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"


# --------------------------------------------------------------------------- S1
def load_ledger(spark: SparkSession, base: str) -> dict[str, DataFrame]:
    """The four ledger tables from ``base/<table>`` Parquet, each conformed to its fixed schema."""
    return {name: conform(spark.read.parquet(f"{base.rstrip('/')}/{name}"), schema)
            for name, schema in LEDGER_TABLES.items()}


def save_ledger(tables: dict[str, DataFrame], base: str) -> None:
    """Write a ledger version; callers use a fresh versioned folder per version."""
    for name, df in tables.items():
        conform(df, LEDGER_TABLES[name]).write.mode("overwrite").parquet(f"{base.rstrip('/')}/{name}")


# --------------------------------------------------------------------------- S3, S2
def nest_ledger(entries: DataFrame, metadata: DataFrame, headers: DataFrame, tokens: DataFrame) -> DataFrame:
    """S3: one nested row per entry: entry fields + training_metadata struct whose token_impact holds
    the top tokens (context as a 2-array) and total_tokens. Of several headers per metadata row the
    one with the lowest id is used (D10). Replaces the reference's query-per-entry loop by joins."""
    first_h = headers.groupBy("metadata_id").agg(F.min_by(F.struct("id", "total_tokens"), F.col("id")).alias("h")) \
        .select("metadata_id", F.col("h.id").alias("token_impact_id"), F.col("h.total_tokens").alias("total_tokens"))
    toks = tokens.join(first_h.select("token_impact_id"), "token_impact_id", "left_semi") \
        .groupBy("token_impact_id").agg(F.array_sort(F.collect_list(F.struct(
            "position", "token_id", "impact", F.array("context_start", "context_end").alias("context")))).alias("t"))
    imp = first_h.join(toks, "token_impact_id", "left").select(
        "metadata_id", F.struct(
            F.coalesce(F.transform("t", lambda x: F.struct(
                x["token_id"].alias("token_id"), x["position"].alias("position"), x["impact"].alias("impact"),
                x["context"].alias("context"))), F.array()).alias("top_tokens"),
            F.col("total_tokens")).alias("token_impact"))
    first_m = metadata.groupBy("entry_id").agg(F.min_by(F.struct(*[c for c in TRAINING_METADATA.fieldNames()]),
                                                        F.col("id")).alias("m")).select("m.*")
    meta = first_m.join(imp, first_m["id"] == imp["metadata_id"], "left")
    tm = F.struct("used_in_training", "training_timestamp", "model_checkpoint", "average_loss", "relative_loss",
                  "token_impact")
    meta = meta.select(F.col("entry_id").alias("_eid"), tm.alias("training_metadata"))
    out = entries.join(meta, entries["id"] == meta["_eid"], "left").drop("_eid")
    return out.select(*ENTRIES.fieldNames(), "training_metadata")


def export_json(nested: DataFrame, path: str) -> None:
    """S3 sink: JSON Lines, one entry per line (a single JSON document does not scale)."""
    nested.write.mode("overwrite").option("timestampNTZFormat", TS_FORMAT).json(path)


def write_documents(rows: DataFrame, path: str, key: str | None = None) -> None:
    """The rows as JSON documents, one a task: ``{"<key>": [...]}``, or a plain array. No task holds another's rows."""
    head, end = (f'{{"{key}": [', "]}") if key else ("[", "]")

    def document(batches):
        lead = head
        for batch in batches:
            lines = batch.column("json").to_pylist()
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array([lead + lines[0], *["," + x for x in lines[1:]]])], ["value"])
                lead = ","
        yield pa.RecordBatch.from_arrays([pa.array([end if lead == "," else head + end])], ["value"])

    json = F.to_json(F.struct(*rows.columns), {"timestampNTZFormat": TS_FORMAT})
    rows.select(json.alias("json")).mapInArrow(document, "value string").write.mode("overwrite").text(path)


def read_nested(spark: SparkSession, path: str, multi_line_document: bool = False) -> DataFrame:
    """Read nested entries: JSON Lines, or a single ``{"entries": [...]}`` document, which many tasks read."""
    if multi_line_document:
        from corpus_ledger.sources.json_document import document_objects

        entry = F.from_json("object", NESTED_ENTRY, {"timestampNTZFormat": TS_FORMAT})
        return document_objects(spark, path, "entries").select(entry.alias("e")).select("e.*")
    return spark.read.schema(NESTED_ENTRY).option("timestampNTZFormat", TS_FORMAT).json(path)


def import_nested(nested: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Nested entries -> (entries, metadata, headers, tokens).

    Pass 1 upserts the entries in file order (the ``id`` field; action defaults to added,
    is_revision to false) and gives each new entry an unused metadata row; pass 2 marks used the
    entries whose metadata says used with a non-empty checkpoint, keeping their own timestamp (D20).
    """
    spark = nested.sparkSession
    feed = nested.select(
        F.col("id").alias("event_id"), "title", "page_id", "revision_id", "ts", "content_hash",
        F.coalesce("action", F.lit("added")).alias("action"),
        F.coalesce("is_revision", F.lit(False)).alias("is_revision"), "parent_id",
        F.col("revision_number").cast("int").alias("revision_number"))
    v = C.upsert_pages(C.empty_like(spark, ENTRIES), C.empty_like(spark, TRAINING_METADATA), feed,
                       order=("event_id",))
    tm = F.col("training_metadata")
    used = nested.filter(tm["used_in_training"] & (F.length(tm["model_checkpoint"]) > 0))
    metrics = used.select(
        "page_id", F.lit(True).alias("has_loss"), tm["average_loss"].alias("average_loss"),
        tm["relative_loss"].alias("relative_loss"), tm["token_impact"].alias("token_impact"),
        tm["model_checkpoint"].alias("model_checkpoint"), tm["training_timestamp"].alias("training_timestamp"))
    out = C.mark_used(v.entries, v.metadata, C.empty_like(spark, TOKEN_IMPACTS), C.empty_like(spark, TOP_TOKENS),
                      used.select("page_id"), "", "1970-01-01 00:00:00", metrics)
    return v.entries, out.metadata, out.headers, out.tokens


def impact_pages(entries: DataFrame, metadata: DataFrame, headers: DataFrame, tokens: DataFrame) -> DataFrame:
    """Pages having token impact, with their header and token arrays (inner joins, tokens left)."""
    em = entries.select(F.col("id").alias("entry_id"), "page_id", "title") \
        .join(metadata.select(F.col("id").alias("metadata_id"), "entry_id", "average_loss", "relative_loss"), "entry_id")
    eh = em.join(headers.select(F.col("id").alias("token_impact_id"), "metadata_id", "total_tokens"), "metadata_id")
    toks = tokens.groupBy("token_impact_id").agg(F.array_sort(F.collect_list(F.struct(
        "position", "token_id", "impact", "context_start", "context_end"))).alias("top_tokens"))
    return eh.join(toks, "token_impact_id", "left").withColumn(
        "top_tokens", F.coalesce("top_tokens", F.array().cast(toks.schema["top_tokens"].dataType)))


# --------------------------------------------------------------------------- S5, S6, S9
def page_key(page_id, revision_id=None):
    """``<page_id>`` or ``<page_id>_<revision_id>``, the raw text key."""
    if revision_id is None:
        return page_id
    return F.when(revision_id.isNull(), page_id).otherwise(F.concat_ws("_", page_id, revision_id))


def write_page_texts(df: DataFrame, path: str, page_col: str = "page_id", revision_col: str | None = None,
                     text_col: str = "text") -> None:
    """Raw text per page (or revision) keyed ``page[_rev]``, written as Parquet (one file per page
    does not scale; the key column replaces the file name)."""
    rev = F.col(revision_col) if revision_col else None
    df.select(page_key(F.col(page_col), rev).alias("page_key"), F.col(text_col).alias("text")) \
        .write.mode("overwrite").parquet(path)


def read_page_texts(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """(page_key, text). ``fmt='text'`` reads a folder of ``<key>.txt`` files whole."""
    if fmt == "text":
        raw = spark.read.text(path, wholetext=True)
        name = F.element_at(F.split(F.col("_metadata.file_name"), "/"), -1)
        return raw.select(F.regexp_replace(name, r"\.txt$", "").alias("page_key"), F.col("value").alias("text"))
    return spark.read.parquet(path).select("page_key", "text")


def attach_texts(pages: DataFrame, texts: DataFrame, missing: str = "skip") -> DataFrame:
    """S5 join: ``skip`` drops pages without text (tokenizer), ``keep`` keeps them with null text
    (the dataset then falls back to [0])."""
    t = texts.withColumnRenamed("page_key", "page_id")
    return pages.join(t, "page_id", "inner" if missing == "skip" else "left")


def repair_text(df: DataFrame, raw_col: str, out: str = "text") -> DataFrame:
    """Bytes decoded as UTF-8 with invalid sequences replaced by U+FFFD."""
    return df.withColumn(out, repair_utf8(F.col(raw_col)))


# --------------------------------------------------------------------------- S7, S8
def write_titles(df: DataFrame, path: str, with_mapping: bool = True, arrays: bool = False) -> None:
    """Title list (and page_id -> title mapping) as JSON Lines, or the list as JSON ``arrays`` of strings."""
    if arrays:
        def titles(batches):
            lead = "["
            for batch in batches:
                for line in batch.column("json").to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array([lead + line[1:-1]])], ["value"])
                    lead = ","
            yield pa.RecordBatch.from_arrays([pa.array(["]" if lead == "," else "[]"])], ["value"])

        quoted = F.to_json(F.array("title"))  # ["title"]: the brackets go, the escaped string stays
        df.filter(F.col("title").isNotNull()).select(quoted.alias("json")).mapInArrow(titles, "value string") \
            .write.mode("overwrite").text(f"{path.rstrip('/')}/titles")
    else:
        df.select("title").write.mode("overwrite").json(f"{path.rstrip('/')}/titles")
    if with_mapping:
        df.select("page_id", "title").write.mode("overwrite").json(f"{path.rstrip('/')}/mapping")


def read_title_arrays(spark: SparkSession, path: str) -> DataFrame:
    """The titles of all JSON arrays of strings at ``path``."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.explode(F.from_json("value", "array<string>")).alias("title"))


def flatten_api_pages(responses: DataFrame, json_col: str = "body") -> DataFrame:
    """API JSON -> one row per (page, revision); missing pages skipped; revisions numbered from 1
    in response order (newest first)."""
    from corpus_ledger.sources.schemas import API_RESPONSE

    parsed = responses.select(F.from_json(F.col(json_col), API_RESPONSE).alias("r"))
    pages = parsed.select(F.explode(F.map_values("r.query.pages")).alias("p")).filter(F.col("p.missing").isNull())
    revs = pages.select(F.col("p.pageid").cast("string").alias("page_id"), F.col("p.title").alias("title"),
                        F.posexplode("p.revisions").alias("pos", "rev"))
    return revs.select("page_id", "title", F.col("rev.revid").cast("string").alias("revision_id"),
                       (F.col("pos") + 1).cast("int").alias("revision_number"),
                       F.col("rev.slots")["main"]["*"].alias("content"))


def flatten_category_members(responses: DataFrame, json_col: str = "body") -> DataFrame:
    """Category member titles in response order."""
    from corpus_ledger.sources.schemas import API_RESPONSE

    parsed = responses.select(F.from_json(F.col(json_col), API_RESPONSE).alias("r"))
    return parsed.select(F.posexplode("r.query.categorymembers").alias("pos", "m")) \
        .select("pos", F.col("m.pageid").alias("pageid"), F.col("m.title").alias("title"))


# --------------------------------------------------------------------------- S10, S11
def save_tokenizer(vocab: DataFrame, merges: DataFrame, path: str) -> None:
    """Vocabulary (token, id) and merges (rank, left, right) as Parquet; a merge containing a
    space survives (D8)."""
    vocab.write.mode("overwrite").parquet(f"{path.rstrip('/')}/vocab")
    merges.write.mode("overwrite").parquet(f"{path.rstrip('/')}/merges")


def load_tokenizer(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return (spark.read.parquet(f"{path.rstrip('/')}/vocab"), spark.read.parquet(f"{path.rstrip('/')}/merges"))


def merges_from_text(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """``left right`` lines (merges.txt); lines not splitting into exactly two parts are dropped.

    The line number is the merge rank; text files are read with one task per file, so the number
    comes from ``monotonically_increasing_id`` order inside the file (merge files are small,
    bounded by the merge budget)."""
    parts = F.split(F.trim(F.col(line_col)), r"\s+")
    numbered = lines.withColumn("_n", F.monotonically_increasing_id())
    ok = numbered.filter(F.size(parts) == 2)
    from corpus_ledger.functions.ranks import bounded_row_number

    return bounded_row_number(ok.select("_n", parts[0].alias("left"), parts[1].alias("right")), ["_n"], "rank") \
        .select(F.col("rank").cast("int"), "left", "right")


def migrate_legacy_impact(legacy: DataFrame) -> DataFrame:
    """Keep the ``total_tokens`` rows of the long impact table as headers (impact -> total_tokens)."""
    t = legacy.filter(F.col("token") == "total_tokens")
    idc = F.col("id") if "id" in legacy.columns else F.col("metadata_id")
    return t.select(idc.cast("long").alias("id"), F.col("metadata_id").cast("long"),
                    F.col("impact").cast("long").alias("total_tokens"))
