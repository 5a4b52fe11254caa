"""Ledger queries Q1-Q17: projections, filters, joins, sorts and bounded limits.

Point lookups of the reference (one page id per call) are set-based here: callers pass a DataFrame
of keys, which Spark semi-joins (broadcast when AQE sees it is small, sort-merge otherwise).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_ledger.sources.schemas import ACTIONS

STATE_COLS = ["used_in_training", "training_timestamp", "model_checkpoint", "average_loss", "relative_loss"]
ENTRY_COLS = ["id", "title", "page_id", "revision_id", "ts", "content_hash", "action", "is_revision",
              "parent_id", "revision_number"]


def _state(metadata: DataFrame) -> DataFrame:
    return metadata.select(F.col("entry_id"), *STATE_COLS)


def with_state(entries: DataFrame, metadata: DataFrame, how: str = "left") -> DataFrame:
    """Entries with their training state (equi join on entry id)."""
    return entries.join(_state(metadata), entries["id"] == F.col("entry_id"), how).drop("entry_id")


def pages_by_id(entries: DataFrame, metadata: DataFrame, keys: DataFrame) -> DataFrame:
    """Q1: entries whose page_id is in ``keys`` (column page_id), with training state; unknown keys vanish."""
    picked = entries.join(keys.select("page_id").distinct(), "page_id", "left_semi")
    return with_state(picked, metadata).select(*ENTRY_COLS, *STATE_COLS)


def page_history(log: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Q2: change history of pages, newest first (sorted by page, then ts descending).

    A global range sort: a page holding a third of all rows is split across ranges by its ts.
    """
    h = log if keys is None else log.join(keys.select("page_id").distinct(), "page_id", "left_semi")
    return h.orderBy("page_id", F.desc("ts"), F.desc("event_id"))


def unused_pages(entries: DataFrame, metadata: DataFrame) -> DataFrame:
    """Q3: entries (revisions included) whose metadata says unused; entries without metadata are absent."""
    unused = metadata.filter(~F.col("used_in_training")).select("entry_id")
    return entries.join(unused, entries["id"] == unused["entry_id"], "inner").drop("entry_id")


def page_revisions(entries: DataFrame, metadata: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Q4: revision entries of the given parent pages with training state, by parent and revision number."""
    revs = entries.filter(F.col("is_revision"))
    if keys is not None:
        revs = revs.join(keys.select(F.col("page_id").alias("parent_id")).distinct(), "parent_id", "left_semi")
    return with_state(revs, metadata).select(*ENTRY_COLS, *STATE_COLS) \
        .orderBy("parent_id", "revision_number", "id")


def main_pages(entries: DataFrame, metadata: DataFrame) -> DataFrame:
    """Q5: main pages with training state; a missing metadata row counts as unused."""
    main = entries.filter(~F.col("is_revision"))
    out = with_state(main, metadata)
    return out.withColumn("used_in_training", F.coalesce(F.col("used_in_training"), F.lit(False))) \
        .select(*ENTRY_COLS, *STATE_COLS)


def filter_by_date(df: DataFrame, start: str | None = None, end: str | None = None,
                   ts_col: str = "ts") -> DataFrame:
    """Q6: rows whose date part lies in [start, end]; either end optional.

    Written as a half-open range on the timestamp itself so it reaches the Parquet scan as a pushed
    filter (``to_date(ts) <= end`` would not).
    """
    ts = F.col(ts_col)
    cond = F.lit(True)
    if start is not None:
        cond = cond & (ts >= F.to_date(F.lit(start)).cast("timestamp_ntz"))
    if end is not None:
        cond = cond & (ts < F.date_add(F.to_date(F.lit(end)), 1).cast("timestamp_ntz"))
    return df.filter(cond)


def group_by_action(df: DataFrame) -> DataFrame:
    """Q7: entry count per action: exactly the three domain actions, empty groups kept, unknown dropped."""
    spark = df.sparkSession
    domain = spark.createDataFrame([(a,) for a in ACTIONS], "action string")
    counts = df.groupBy("action").agg(F.count(F.lit(1)).alias("n_entries"))
    # The domain has three rows: the join is a broadcast of a fixed-size table.
    return F.broadcast(domain).join(counts, "action", "left") \
        .select("action", F.coalesce(F.col("n_entries"), F.lit(0)).cast("long").alias("n_entries"))


def usage_statistics(entries: DataFrame, metadata: DataFrame) -> DataFrame:
    """Q8: total, used, unused entries and used percentage (0 when there are none)."""
    used = F.coalesce(F.col("used_in_training"), F.lit(False))
    s = with_state(entries, metadata).agg(
        F.count(F.lit(1)).alias("total_entries"),
        F.count_if(used).alias("used_entries"),
    )
    return s.select(
        "total_entries", "used_entries",
        (F.col("total_entries") - F.col("used_entries")).alias("unused_entries"),
        F.when(F.col("total_entries") > 0,
               F.round(F.col("used_entries") * 100.0 / F.col("total_entries"), 6))
         .otherwise(F.lit(0.0)).alias("used_percentage"),
    )


def training_status(entries: DataFrame, metadata: DataFrame) -> DataFrame:
    """Q9: status report counted on main pages only (D13), plus unused revisions."""
    used = F.coalesce(F.col("used_in_training"), F.lit(False))
    main = ~F.col("is_revision")
    has_meta = F.col("entry_id").isNotNull()
    j = entries.join(_state(metadata), entries["id"] == F.col("entry_id"), "left")
    return j.agg(
        F.count_if(main).alias("main_pages"),
        F.count_if(main & used).alias("used_main_pages"),
        F.count_if(main & ~used).alias("unused_main_pages"),
        F.count_if(F.col("is_revision") & has_meta & ~used).alias("unused_revisions"),
    )


def latest_training(entries: DataFrame, metadata: DataFrame) -> DataFrame:
    """Q10: training state of the most recently trained main page (one row; none if nothing trained)."""
    j = with_state(entries.filter(~F.col("is_revision")), metadata) \
        .filter(F.col("used_in_training") & F.col("training_timestamp").isNotNull())
    best = F.max_by(F.struct("page_id", "title", *STATE_COLS[1:]),
                    F.struct("training_timestamp", "id"))
    return j.agg(best.alias("b")).filter(F.col("b").isNotNull()).select("b.*")


def latest_revision(log: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Q11: latest revision id per page (by ts, then event id); partial aggregation, skew-safe."""
    order = order or ["ts", "event_id"]
    return log.groupBy("page_id").agg(
        F.max_by("revision_id", F.struct(*order)).alias("latest_revision_id"),
        F.max("ts").alias("latest_ts"),
    )


def main_titles(entries: DataFrame, metadata: DataFrame) -> DataFrame:
    """Q12: titles of all main pages."""
    return main_pages(entries, metadata).select("page_id", "title")


def training_titles(entries: DataFrame, metadata: DataFrame, candidates: DataFrame,
                    target_count: int = 1000) -> DataFrame:
    """Q13: titles for the next training run.

    Unused pages, first entry per page id, main pages before revisions, cut at ``target_count``
    *before* the title filter (length >= 3, no leading quote); the shortfall is filled from
    ``candidates`` (column ``title``, ordered by ``cand_order``): the first ``2 * shortfall``
    candidates, minus titles of main pages already in the ledger, cut at the shortfall.
    """
    unused = unused_pages(entries, metadata)
    first = unused.groupBy("page_id").agg(F.min_by(F.struct("id", "title"), F.col("id")).alias("f")) \
        .select("page_id", F.col("f.id").alias("entry_id"), F.col("f.title").alias("title"))
    is_rev = F.col("page_id").contains("_")
    picked = first.withColumn("is_rev", is_rev).orderBy("is_rev", "entry_id").limit(target_count)
    ok = (F.length("title") >= 3) & ~F.col("title").startswith('"') & ~F.col("title").startswith("'")
    db_titles = picked.filter(ok).select(
        F.lit("ledger").alias("origin"), "page_id", "title",
        F.when(F.col("is_rev"), 1).otherwise(0).alias("_k1"), F.col("entry_id").alias("_k2"))
    n_db = db_titles.count()  # bounded by target_count
    need = target_count - n_db
    if need <= 0:
        out = db_titles
    else:
        cand = candidates.orderBy("cand_order").limit(2 * need)
        # ``cand`` holds at most 2 * target_count rows: broadcast it to pick the few ledger titles that
        # collide, instead of shuffling every main-page title for the anti join.
        existing = entries.filter(~F.col("is_revision")).select("title") \
            .join(F.broadcast(cand.select("title").distinct()), "title", "left_semi").distinct()
        fresh = cand.join(existing, "title", "left_anti").orderBy("cand_order").limit(need)
        out = db_titles.unionByName(fresh.select(
            F.lit("candidate").alias("origin"), F.lit(None).cast("string").alias("page_id"), "title",
            F.lit(2).alias("_k1"), F.col("cand_order").cast("long").alias("_k2")))
    from corpus_ledger.functions.ranks import bounded_row_number

    # ``out`` has at most target_count rows.
    return bounded_row_number(out, ["_k1", "_k2"], "rank").select("rank", "origin", "page_id", "title")


def crawl_list(members: DataFrame, limit: int | None = None, recursive: bool = True,
               batch_size: int = 10, max_subcats: int = 10, default_limit: int = 50) -> DataFrame:
    """Q14: crawl list per category.

    ``members``: (category, subcategory, title, member_order). Per category: the first
    ``limit or 50`` pages, then (recursive) from each of at most ``max_subcats`` subcategories
    (by name) the first ``(limit or 50) // n_subcats`` pages (0 falls back to 50); de-duplicated by
    title keeping the first occurrence, cut at ``limit``, numbered and batched.
    """
    from pyspark.sql import Window

    cap = limit or default_limit
    w_cat = Window.partitionBy("category").orderBy("member_order")
    direct = members.withColumn("r", F.row_number().over(w_cat)).filter(F.col("r") <= cap) \
        .select("category", "title", F.lit(0).alias("sub_rank"), F.col("r").alias("r"))
    parts = [direct]
    if recursive:
        subs = members.select("category", "subcategory").distinct()
        w_sub = Window.partitionBy("category").orderBy("subcategory")
        subs = subs.withColumn("sub_rank", F.row_number().over(w_sub)).filter(F.col("sub_rank") <= max_subcats)
        n_subs = subs.groupBy("category").agg(F.count(F.lit(1)).alias("n_subs"))
        quota = F.floor(F.lit(cap) / F.col("n_subs"))
        quota = F.when(quota == 0, F.lit(default_limit)).otherwise(quota)
        subs = subs.join(n_subs, "category").withColumn("quota", quota)
        # quota <= max(cap, default_limit): a literal bound lets Spark cut each group before the shuffle.
        bound = max(cap, default_limit)
        w_mem = Window.partitionBy("category", "subcategory").orderBy("member_order")
        sub_pages = members.withColumn("r", F.row_number().over(w_mem)).filter(F.col("r") <= bound) \
            .join(subs, ["category", "subcategory"]).filter(F.col("r") <= F.col("quota")) \
            .select("category", "title", "sub_rank", "r")
        parts.append(sub_pages)
    seq = parts[0]
    for p in parts[1:]:
        seq = seq.unionByName(p)
    first = seq.groupBy("category", "title").agg(F.min(F.struct("sub_rank", "r")).alias("k")) \
        .select("category", "title", F.col("k.sub_rank").alias("sub_rank"), F.col("k.r").alias("r"))
    w_all = Window.partitionBy("category").orderBy("sub_rank", "r")
    ranked = first.withColumn("rank", F.row_number().over(w_all))
    if limit:
        ranked = ranked.filter(F.col("rank") <= limit)
    return ranked.select("category", "rank", "title",
                         (F.floor((F.col("rank") - 1) / batch_size) + 1).cast("long").alias("batch"))


def top_nodes(entries: DataFrame, metadata: DataFrame, impacts: DataFrame, top_n: int = 10,
              order: str = "entry_id") -> DataFrame:
    """Q15: the first ``top_n`` entries having impact data.

    ``impacts`` has a ``metadata_id`` column (current headers or the legacy long table). ``order`` is
    ``entry_id`` (default, the reference's effective order) or ``relative_loss`` (descending, then
    entry id). With no entry having impact data, the first ``top_n`` entries by id.
    """
    meta = metadata.join(impacts.select(F.col("metadata_id").alias("id")).distinct(), "id", "left_semi")
    cand = entries.join(meta.select("entry_id", "relative_loss"), entries["id"] == F.col("entry_id")) \
        .groupBy(F.col("id").alias("entry_id")).agg(F.max("relative_loss").alias("relative_loss"))
    if order == "relative_loss":
        keys = [F.desc_nulls_last("relative_loss"), F.col("entry_id")]
    else:
        keys = [F.col("entry_id")]
    top = cand.orderBy(*keys).limit(top_n).select("entry_id", F.lit("impact").alias("basis"))
    if top.limit(1).count() == 0:
        top = entries.orderBy("id").limit(top_n).select(F.col("id").alias("entry_id"),
                                                          F.lit("fallback").alias("basis"))
    return top


def table_profile(entries: DataFrame, metadata: DataFrame, headers: DataFrame,
                  tokens: DataFrame) -> DataFrame:
    """Q16: row counts per table, used entries, distinct entries having impact headers."""
    spark = entries.sparkSession

    def one(name: str, df: DataFrame, expr: Column) -> DataFrame:
        return df.agg(expr.cast("long").alias("value")).select(F.lit(name).alias("metric"), "value")

    with_impact = metadata.join(headers.select(F.col("metadata_id").alias("id")), "id") \
        .select("entry_id")
    rows = [
        one("entries", entries, F.count(F.lit(1))),
        one("training_metadata", metadata, F.count(F.lit(1))),
        one("token_impacts", headers, F.count(F.lit(1))),
        one("top_tokens", tokens, F.count(F.lit(1))),
        one("used_in_training", metadata, F.count_if(F.col("used_in_training"))),
        one("entries_with_impact", with_impact, F.count_distinct("entry_id")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def impact_profile(legacy: DataFrame, top_n: int = 10) -> tuple[DataFrame, DataFrame]:
    """Q17: distinct tokens of the long impact table, and its ``top_n`` metadata ids by row count."""
    distinct_tokens = legacy.agg(F.count_distinct("token").alias("distinct_tokens"),
                                 F.count(F.lit(1)).alias("rows"))
    per_meta = legacy.groupBy("metadata_id").agg(F.count(F.lit(1)).alias("n_rows")) \
        .orderBy(F.desc("n_rows"), "metadata_id").limit(top_n)
    return distinct_tokens, per_meta


def rows_per_key(df: DataFrame, key: str, top_n: int = 10) -> DataFrame:
    """Q17 (second half): the ``top_n`` keys with most rows (e.g. tokens per header)."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows")).orderBy(F.desc("n_rows"), key).limit(top_n)
