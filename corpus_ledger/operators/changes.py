"""Ledger change application L1-L16: every change yields new table versions (DataFrames).

Surrogate ids continue from the current maximum, numbered by a natural key through
``global_row_number`` (no single-partition window). Per-page folds are aggregations with map-side
partial aggregation, so a page holding a third of the feed is reduced before the shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_ledger.functions.hashing import content_hash
from corpus_ledger.functions.materialize import materialize
from corpus_ledger.functions.ranks import global_row_number
from corpus_ledger.sources.schemas import (ACTIONS, ENTRIES, TOKEN_IMPACTS, TOP_TOKENS, TRAINING_METADATA,
                                           conform)

MUTABLE = ["revision_id", "ts", "content_hash", "action"]
STATIC = ["title", "is_revision", "parent_id", "revision_number"]


def _max_id(df: DataFrame, col: str = "id") -> int:
    """Current maximum surrogate id (one scalar to the driver)."""
    v = df.agg(F.max(col)).first()[0]
    return int(v) if v is not None else 0


def empty_like(spark, schema) -> DataFrame:
    return spark.createDataFrame([], schema)


def normalise_feed(feed: DataFrame) -> DataFrame:
    """Fill the optional feed columns: hash from content, non-revision defaults."""
    f = feed
    if "content_hash" not in f.columns:
        f = f.withColumn("content_hash", content_hash(F.col("content")))
    defaults = {"is_revision": F.lit(False), "parent_id": F.lit(None).cast("string"),
                "revision_number": F.lit(None).cast("int")}
    for c, v in defaults.items():
        if c not in f.columns:
            f = f.withColumn(c, v)
    return f


# --------------------------------------------------------------------------- L4, L5
def fingerprint(df: DataFrame, text_col: str = "text", out: str = "content_hash") -> DataFrame:
    """L4: SHA-256 hex of the UTF-8 text."""
    return df.withColumn(out, content_hash(F.col(text_col)))


def validate_domain(df: DataFrame, col: str = "action", domain=ACTIONS) -> tuple[DataFrame, DataFrame]:
    """Split rows into (valid, rejected); rejected rows carry a reason."""
    ok = F.col(col).isin(*domain) & F.col(col).isNotNull()
    rejected = df.filter(~ok | F.col(col).isNull()).withColumn(
        "reject_reason", F.concat(F.lit(f"{col} not in {'/'.join(domain)}: "),
                                  F.coalesce(F.col(col), F.lit("null"))))
    return df.filter(ok), rejected


def assert_domain(df: DataFrame, col: str = "action", domain=ACTIONS) -> DataFrame:
    """L5 strict mode: the query fails at run time on the first out-of-domain value."""
    ok = F.col(col).isin(*domain)
    return df.withColumn(col, F.when(ok, F.col(col)).otherwise(
        F.raise_error(F.concat(F.lit(f"{col} must be one of {', '.join(domain)}: "),
                               F.coalesce(F.col(col), F.lit("null"))))))


# --------------------------------------------------------------------------- L1, L2, L3
@dataclass
class LedgerVersion:
    entries: DataFrame
    metadata: DataFrame


def fold_changes(feed: DataFrame, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """L1's fold of the changes of each page: ``first``, the earliest change with its order, and ``upd``, the
    latest ``updated`` one. Neither depends on the order of arrival, and both can be kept up row by row."""
    f = normalise_feed(feed)
    o = F.struct(*[F.col(c) for c in order])
    return f.groupBy("page_id").agg(
        F.min_by(F.struct(*STATIC, *MUTABLE, *[F.col(c).alias(f"o_{c}") for c in order]), o).alias("first"),
        F.max_by(F.struct(*MUTABLE), F.when(F.col("action") == "updated", o)).alias("upd"),
    )


def upsert_pages(entries: DataFrame, metadata: DataFrame, feed: DataFrame,
                 order: tuple[str, ...] = ("ts", "event_id"), base: int | None = None) -> LedgerVersion:
    """L1: apply a batch of page changes to the ledger.

    Per page, in (ts, event id) order: an unknown page is inserted from its first change (whatever
    its action); afterwards only ``updated`` changes overwrite revision_id, ts, content_hash and
    action; title, id and the revision fields stay. Each new entry gets an unused metadata row.
    Ids go on after ``base``, by default the largest of ``entries``.
    """
    per_page = fold_changes(feed, order)
    cur = entries.alias("c")
    j = per_page.alias("p").join(cur, F.col("p.page_id") == F.col("c.page_id"), "full_outer")
    known = F.col("c.id").isNotNull()
    page = F.coalesce(F.col("c.page_id"), F.col("p.page_id"))

    def mut(c):
        return F.coalesce(F.col(f"p.upd.{c}"), F.when(known, F.col(f"c.{c}")).otherwise(F.col(f"p.first.{c}")))

    merged = j.select(
        F.col("c.id").alias("id"),
        *[F.when(known, F.col(f"c.{c}")).otherwise(F.col(f"p.first.{c}")).alias(c) for c in STATIC],
        page.alias("page_id"),
        *[mut(c).alias(c) for c in MUTABLE],
        *[F.col(f"p.first.o_{c}").alias(f"_o_{c}") for c in order],
    )
    old = merged.filter(F.col("id").isNotNull())
    new = merged.filter(F.col("id").isNull())
    base = _max_id(entries) if base is None else base
    new = global_row_number(new, [f"_o_{c}" for c in order] + ["page_id"], "_rn")
    new = new.withColumn("id", F.col("_rn") + F.lit(base)).drop("_rn")
    out = conform(old.unionByName(new.select(old.columns)), ENTRIES)
    meta_base = _max_id(metadata)
    new_meta = new.select(
        (F.col("id") - F.lit(base) + F.lit(meta_base)).alias("id"), F.col("id").alias("entry_id"),
        F.lit(False).alias("used_in_training"))
    meta = metadata.unionByName(conform(new_meta, TRAINING_METADATA, strict=False))
    return LedgerVersion(out, meta)


def upsert_stored(store, feed: DataFrame, version: int, order: tuple[str, ...] = ("ts", "event_id")) -> None:
    """L1 against a ``LedgerStore`` of entries: only the pages of ``feed`` are looked up, and only those that
    change are written. New pages are numbered after the largest id so far."""
    pages = feed.select("page_id").distinct()
    held = materialize(store.lookup(pages, below=version))
    known = store.read(below=version)
    none = empty_like(feed.sparkSession, TRAINING_METADATA)
    after = upsert_pages(held, none, feed, order, base=_max_id(known)).entries
    same = F.lit(True)
    for c in MUTABLE:
        same = same & F.col(f"n.{c}").eqNullSafe(F.col(f"h.{c}"))
    changed = after.alias("n").join(held.alias("h"), (F.col("n.page_id") == F.col("h.page_id")) & same, "left_anti")
    store.commit(changed, version)


def append_log(log: DataFrame | None, changes: DataFrame) -> DataFrame:
    """L2: append-only change log; every call adds its rows, so a page has several rows."""
    rows = normalise_feed(changes).select("event_id", "title", "page_id", "revision_id", "ts",
                                         "content_hash", "action")
    return rows if log is None else log.unionByName(rows)


def log_revisions(revisions: DataFrame, keep: int = 5) -> DataFrame:
    """L3: revision entries keyed ``<page>_<rev>``, numbered 1 = most recent, at most ``keep`` per page.

    ``row_number() <= keep`` is planned as a window group limit: each map task keeps only ``keep``
    rows per page before the shuffle, so a hot page cannot swamp one task.
    """
    from pyspark.sql import Window

    r = normalise_feed(revisions)
    w = Window.partitionBy("page_id").orderBy(F.desc("ts"), F.desc("revision_id"))
    top = r.withColumn("revision_number", F.row_number().over(w)).filter(F.col("revision_number") <= keep)
    return top.select(
        F.concat_ws("_", "page_id", "revision_id").alias("page_id"),
        "title", "revision_id", "ts", "content_hash", F.lit("added").alias("action"),
        F.lit(True).alias("is_revision"), F.col("page_id").alias("parent_id"),
        F.col("revision_number").cast("int").alias("revision_number"),
    )


# --------------------------------------------------------------------------- L6, L7, L8
def needs_update(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming (page_id, revision_id) rows flagged when the page is unknown or its latest stored
    revision (by ts, then id) differs."""
    latest = stored.groupBy("page_id").agg(
        F.max_by("revision_id", F.struct("ts", "id")).alias("stored_revision_id"))
    j = incoming.join(latest, "page_id", "left")
    return j.withColumn("needs_update", F.col("stored_revision_id").isNull()
                        | (F.col("stored_revision_id") != F.col("revision_id")))


def label_changes(history: DataFrame, changes: DataFrame) -> DataFrame:
    """A needed change is ``updated`` when the page has history, else ``added``."""
    known = history.select("page_id").distinct().withColumn("_known", F.lit(True))
    return changes.join(known, "page_id", "left").withColumn(
        "action", F.when(F.col("_known"), F.lit("updated")).otherwise(F.lit("added"))).drop("_known")


def incremental_apply(version: LedgerVersion, snapshot: DataFrame) -> LedgerVersion:
    """Check -> label -> upsert for a batch of page snapshots (page_id, title, revision_id, ts,
    content, event_id)."""
    flagged = needs_update(version.entries, snapshot)
    todo = flagged.filter("needs_update").drop("needs_update", "stored_revision_id")
    labelled = label_changes(version.entries, todo)
    return upsert_pages(version.entries, version.metadata, labelled)


# --------------------------------------------------------------------------- L9
@dataclass
class ImpactTables:
    metadata: DataFrame
    headers: DataFrame
    tokens: DataFrame


def mark_used(entries: DataFrame, metadata: DataFrame, headers: DataFrame, tokens: DataFrame,
              page_ids: DataFrame, checkpoint: str, at: str, metrics: DataFrame | None = None) -> ImpactTables:
    """Mark pages used in training.

    ``page_ids``: (page_id). ``metrics``: (page_id, has_loss, average_loss, relative_loss,
    token_impact struct<top_tokens array<struct<token_id, position, impact, context array<int>>>,
    total_tokens>). Unknown pages are ignored; the entry's first metadata row is updated (or one is
    created); losses are written only when ``has_loss`` (null -> 0.0); an impact header and its
    tokens are appended; a context that is not a 2+-element array becomes [position, position].
    """
    ts = F.lit(at).cast("timestamp_ntz")
    hit = entries.select(F.col("id").alias("entry_id"), "page_id") \
        .join(page_ids.select("page_id").distinct(), "page_id", "left_semi")
    if metrics is not None:
        hit = hit.join(metrics, "page_id", "left")
    else:
        hit = hit.withColumn("has_loss", F.lit(False)).withColumn("average_loss", F.lit(None).cast("double")) \
            .withColumn("relative_loss", F.lit(None).cast("double")) \
            .withColumn("token_impact", F.lit(None).cast(
                "struct<top_tokens:array<struct<token_id:bigint,position:int,impact:double,"
                "context:array<int>>>,total_tokens:bigint>"))
    first_meta = metadata.groupBy("entry_id").agg(F.min("id").alias("meta_id"))
    # ``hit`` (marked pages, their metrics and metadata row) feeds every step below: store it once.
    hit = materialize(hit.join(first_meta, "entry_id", "left"))
    # New metadata rows for hit entries without one.
    meta_base = _max_id(metadata)
    missing = global_row_number(hit.filter(F.col("meta_id").isNull()).select("entry_id"), ["entry_id"], "_rn")
    missing = missing.select("entry_id", (F.col("_rn") + F.lit(meta_base)).alias("new_meta_id"))
    hit = hit.join(missing, "entry_id", "left").withColumn("meta_id", F.coalesce("meta_id", "new_meta_id"))
    # Per-page checkpoint / timestamp columns in ``metrics`` override the call's constants (S2 import).
    if "model_checkpoint" not in hit.columns:
        hit = hit.withColumn("model_checkpoint", F.lit(checkpoint))
    if "training_timestamp" not in hit.columns:
        hit = hit.withColumn("training_timestamp", ts)
    hit = hit.withColumn("_ckpt", F.coalesce(F.col("model_checkpoint"), F.lit(checkpoint))) \
             .withColumn("_ts", F.coalesce(F.col("training_timestamp").cast("timestamp_ntz"), ts)) \
             .drop("model_checkpoint", "training_timestamp")
    upd = hit.select(
        F.col("meta_id").alias("id"), F.lit(True).alias("_marked"), "has_loss", "_ckpt", "_ts",
        F.coalesce(F.col("average_loss"), F.lit(0.0)).alias("new_avg"),
        F.coalesce(F.col("relative_loss"), F.lit(0.0)).alias("new_rel"))
    m = metadata.join(upd, "id", "left")
    touched = F.col("_marked").isNotNull()  # every listed page, with or without metrics
    loss = F.coalesce(F.col("has_loss"), F.lit(False))
    new_meta = m.select(
        "id", "entry_id",
        F.when(touched, F.lit(True)).otherwise(F.col("used_in_training")).alias("used_in_training"),
        F.when(touched, F.col("_ts")).otherwise(F.col("training_timestamp")).alias("training_timestamp"),
        F.when(touched, F.col("_ckpt")).otherwise(F.col("model_checkpoint")).alias("model_checkpoint"),
        F.when(loss, F.col("new_avg")).otherwise(F.col("average_loss")).alias("average_loss"),
        F.when(loss, F.col("new_rel")).otherwise(F.col("relative_loss")).alias("relative_loss"),
    )
    created = hit.filter(F.col("new_meta_id").isNotNull()).select(
        F.col("new_meta_id").alias("id"), "entry_id", F.lit(True).alias("used_in_training"),
        F.col("_ts").alias("training_timestamp"), F.col("_ckpt").alias("model_checkpoint"),
        F.when(F.col("has_loss"), F.coalesce("average_loss", F.lit(0.0))).alias("average_loss"),
        F.when(F.col("has_loss"), F.coalesce("relative_loss", F.lit(0.0))).alias("relative_loss"))
    metadata2 = conform(new_meta.unionByName(created), TRAINING_METADATA)

    # Impact headers, numbered after the current maximum in metadata-id order.
    with_imp = hit.filter(F.col("token_impact").isNotNull())
    h_base = _max_id(headers)
    new_h = global_row_number(
        with_imp.select(F.col("meta_id").alias("metadata_id"),
                        F.coalesce(F.col("token_impact.total_tokens"), F.lit(0)).alias("total_tokens"),
                        F.col("token_impact.top_tokens").alias("top_tokens")),
        ["metadata_id"], "_rn").withColumn("id", F.col("_rn") + F.lit(h_base))
    headers2 = headers.unionByName(conform(new_h, TOKEN_IMPACTS))
    t_base = _max_id(tokens)
    exploded = new_h.select(F.col("id").alias("token_impact_id"),
                            F.posexplode("top_tokens").alias("k", "t"))
    ctx_ok = F.col("t.context").isNotNull() & (F.size("t.context") >= 2)
    tok = exploded.select(
        "token_impact_id", "k",
        F.col("t.token_id").cast("long").alias("token_id"), F.col("t.position").alias("position"),
        F.col("t.impact").cast("double").alias("impact"),
        F.when(ctx_ok, F.col("t.context")[0]).otherwise(F.col("t.position")).alias("context_start"),
        F.when(ctx_ok, F.col("t.context")[1]).otherwise(F.col("t.position")).alias("context_end"))
    tok = global_row_number(tok, ["token_impact_id", "k"], "_rn").withColumn("id", F.col("_rn") + F.lit(t_base))
    tokens2 = tokens.unionByName(conform(tok, TOP_TOKENS))
    return ImpactTables(metadata2, headers2, tokens2)


# --------------------------------------------------------------------------- L10-L15
def set_used_flags(metadata: DataFrame, top_entry_ids: DataFrame) -> DataFrame:
    """Used flag true for entries in the key set, false for every other metadata row."""
    keys = top_entry_ids.select("entry_id").distinct().withColumn("_top", F.lit(True))
    return metadata.join(keys, "entry_id", "left").withColumn(
        "used_in_training", F.col("_top").isNotNull()).select(*TRAINING_METADATA.fieldNames())


def remove_unused(entries: DataFrame, metadata: DataFrame, headers: DataFrame, tokens: DataFrame):
    """L11 (stated intent, D3): keep only entries used in training, and their children.

    Returns (entries, metadata, headers, tokens, removed_entry_count DataFrame).
    """
    used_ids = metadata.filter(F.col("used_in_training")).select(F.col("entry_id").alias("id")).distinct()
    kept = entries.join(used_ids, "id", "left_semi")
    meta = metadata.join(kept.select(F.col("id").alias("entry_id")), "entry_id", "left_semi")
    hdr = headers.join(meta.select(F.col("id").alias("metadata_id")), "metadata_id", "left_semi")
    tok = tokens.join(hdr.select(F.col("id").alias("token_impact_id")), "token_impact_id", "left_semi")
    removed = entries.join(used_ids, "id", "left_anti").agg(F.count(F.lit(1)).alias("removed_entries"))
    return kept, meta, hdr, tok, removed


def reset_metadata(entries: DataFrame, metadata: DataFrame, recreate: bool = True) -> DataFrame:
    """Drop all training state; with ``recreate`` one fresh unused row per entry (ids continue
    after the old maximum, in entry-id order), else an empty table (D12)."""
    spark = entries.sparkSession
    if not recreate:
        return empty_like(spark, TRAINING_METADATA)
    base = _max_id(metadata)
    fresh = global_row_number(entries.select(F.col("id").alias("entry_id")), ["entry_id"], "_rn")
    fresh = fresh.select((F.col("_rn") + F.lit(base)).alias("id"), "entry_id",
                         F.lit(False).alias("used_in_training"))
    return conform(fresh, TRAINING_METADATA, strict=False)


def trim_to_top(metadata: DataFrame, headers: DataFrame, tokens: DataFrame, top_entry_ids: DataFrame):
    """For used metadata of entries outside the top set: state nulled, flag false, impact headers
    and their tokens removed. Returns (metadata, headers, tokens, trimmed_count DataFrame)."""
    top = top_entry_ids.select("entry_id").distinct().withColumn("_top", F.lit(True))
    m = metadata.join(top, "entry_id", "left")
    drop = F.col("used_in_training") & F.col("_top").isNull()
    trimmed_ids = m.filter(drop).select(F.col("id").alias("metadata_id"))
    meta = m.select(
        "id", "entry_id",
        F.when(drop, F.lit(False)).otherwise(F.col("used_in_training")).alias("used_in_training"),
        *[F.when(drop, F.lit(None)).otherwise(F.col(c)).alias(c)
          for c in ["training_timestamp", "model_checkpoint", "average_loss", "relative_loss"]])
    meta = conform(meta, TRAINING_METADATA)
    gone_h = headers.join(trimmed_ids, "metadata_id", "left_semi").select(F.col("id").alias("token_impact_id"))
    hdr = headers.join(trimmed_ids, "metadata_id", "left_anti")
    tok = tokens.join(gone_h, "token_impact_id", "left_anti")
    count = trimmed_ids.agg(F.count(F.lit(1)).alias("trimmed_metadata"))
    return meta, hdr, tok, count


def clean_orphans(metadata: DataFrame, headers: DataFrame, tokens: DataFrame):
    """Drop headers without metadata, then tokens without a (remaining) header.

    Returns (headers, tokens, counts DataFrame with headers_deleted, tokens_deleted).
    """
    meta_ids = metadata.select(F.col("id").alias("metadata_id"))
    hdr = headers.join(meta_ids, "metadata_id", "left_semi")
    tok = tokens.join(hdr.select(F.col("id").alias("token_impact_id")), "token_impact_id", "left_semi")
    h_del = headers.join(meta_ids, "metadata_id", "left_anti").agg(F.count(F.lit(1)).alias("headers_deleted"))
    t_del = tokens.join(hdr.select(F.col("id").alias("token_impact_id")), "token_impact_id", "left_anti") \
        .agg(F.count(F.lit(1)).alias("tokens_deleted"))
    counts = _side_by_side(h_del, t_del)
    return hdr, tok, counts


def _side_by_side(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two one-row aggregates as one row (joined on a constant key, no cartesian product)."""
    return a.withColumn("_k", F.lit(1)).join(b.withColumn("_k", F.lit(1)), "_k").drop("_k")
