"""Registered queries: one Spark callable per operator of the inventory, run on the driver tables.

Each callable takes ``(spark, sf_dir)`` and returns a DataFrame whose columns match the oracle SQL
of the same name in ``oracles``. Doubles are rounded to 6 digits where engines may differ in the
last bits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_ledger.operators import queries as Q
from corpus_ledger.sources import fixtures as fx

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


def r6(c):
    return F.round(F.col(c), 6).alias(c)


def _ledger(spark, sf):
    return fx.ledger_entries(spark, sf), fx.ledger_metadata(spark, sf)


def _keys(spark, sf) -> DataFrame:
    """Page ids picked by a data rule: documents labelled toxic (main-page form of the id)."""
    return fx.table(spark, sf, "labels").filter(F.col("toxic") == 1) \
        .select(F.col("doc_id").cast("string").alias("page_id"))


def _round_state(df: DataFrame) -> DataFrame:
    return df.withColumn("average_loss", F.round("average_loss", 6)) \
             .withColumn("relative_loss", F.round("relative_loss", 6))


# --------------------------------------------------------------------------- Q: ledger queries
@register("q01_pages_by_id")
def q01(spark, sf):
    e, m = _ledger(spark, sf)
    return _round_state(Q.pages_by_id(e, m, _keys(spark, sf)))


@register("q02_page_history")
def q02(spark, sf):
    log = fx.feed(spark, sf).withColumn("content_hash", F.sha2("content", 256)).drop("content")
    return Q.page_history(log)


@register("q03_unused_pages")
def q03(spark, sf):
    return Q.unused_pages(*_ledger(spark, sf))


@register("q04_page_revisions")
def q04(spark, sf):
    e, m = _ledger(spark, sf)
    return _round_state(Q.page_revisions(e, m, _keys(spark, sf)))


@register("q05_main_pages")
def q05(spark, sf):
    return _round_state(Q.main_pages(*_ledger(spark, sf)))


@register("q06_filter_by_date")
def q06(spark, sf):
    return Q.filter_by_date(fx.feed(spark, sf), "2024-01-05", "2024-01-12")


@register("q07_group_by_action")
def q07(spark, sf):
    return Q.group_by_action(fx.feed(spark, sf))


@register("q08_usage_statistics")
def q08(spark, sf):
    return Q.usage_statistics(*_ledger(spark, sf))


@register("q09_training_status")
def q09(spark, sf):
    return Q.training_status(*_ledger(spark, sf))


@register("q10_latest_training")
def q10(spark, sf):
    return _round_state(Q.latest_training(*_ledger(spark, sf)))


@register("q11_latest_revision")
def q11(spark, sf):
    return Q.latest_revision(fx.feed(spark, sf))


@register("q12_main_titles")
def q12(spark, sf):
    return Q.main_titles(*_ledger(spark, sf))


@register("q13_training_titles")
def q13(spark, sf):
    e, m = _ledger(spark, sf)
    cand = fx.table(spark, sf, "part").select(F.col("p_name").alias("title"),
                                              F.col("p_partkey").alias("cand_order"))
    return Q.training_titles(e, m, cand, target_count=1000)


@register("q14_crawl_list")
def q14(spark, sf):
    members = fx.table(spark, sf, "part").select(
        F.col("p_type").alias("category"), F.col("p_brand").alias("subcategory"),
        F.col("p_name").alias("title"), F.col("p_partkey").alias("member_order"))
    return Q.crawl_list(members, limit=40, recursive=True, batch_size=10)


@register("q15_top_nodes")
def q15(spark, sf):
    e, m = _ledger(spark, sf)
    return Q.top_nodes(e, m, fx.token_impacts(spark, sf), top_n=10)


@register("q15_top_nodes_by_loss")
def q15b(spark, sf):
    e, m = _ledger(spark, sf)
    return Q.top_nodes(e, m, fx.token_impacts(spark, sf), top_n=10, order="relative_loss")


@register("q16_table_profile")
def q16(spark, sf):
    e, m = _ledger(spark, sf)
    return Q.table_profile(e, m, fx.token_impacts(spark, sf), fx.top_tokens(spark, sf))


@register("q17_distinct_tokens")
def q17a(spark, sf):
    return Q.impact_profile(fx.legacy_impact(spark, sf))[0]


@register("q17_rows_per_metadata")
def q17b(spark, sf):
    return Q.impact_profile(fx.legacy_impact(spark, sf))[1]


@register("q17_rows_per_header")
def q17c(spark, sf):
    return Q.rows_per_key(fx.top_tokens(spark, sf), "token_impact_id")


# --------------------------------------------------------------------------- L: ledger changes
from corpus_ledger.operators import changes as C  # noqa: E402
from corpus_ledger.sources.schemas import ENTRIES, TRAINING_METADATA  # noqa: E402


def _versions(spark, sf):
    """Ledger built from the feed before the cutoff (v1, stored like any ledger version), and the
    rest of the feed still to apply."""
    from corpus_ledger.functions.materialize import materialize

    old, new = fx.split_feed(fx.feed(spark, sf))
    v1 = C.upsert_pages(C.empty_like(spark, ENTRIES), C.empty_like(spark, TRAINING_METADATA), old)
    return C.LedgerVersion(materialize(v1.entries), materialize(v1.metadata)), new


def latest_per_page(feed: DataFrame) -> DataFrame:
    """One snapshot row per page: its latest change (partial aggregation, skew-safe)."""
    cols = [c for c in feed.columns if c != "page_id"]
    return feed.groupBy("page_id").agg(F.max_by(F.struct(*cols), F.struct("ts", "event_id")).alias("s")) \
        .select("page_id", "s.*")


@register("l01_upsert_entries")
def l01(spark, sf):
    v1, new = _versions(spark, sf)
    return C.upsert_pages(v1.entries, v1.metadata, new).entries


@register("l01_upsert_metadata")
def l01m(spark, sf):
    v1, new = _versions(spark, sf)
    return C.upsert_pages(v1.entries, v1.metadata, new).metadata


@register("l02_append_log")
def l02(spark, sf):
    old, new = fx.split_feed(fx.feed(spark, sf))
    return C.append_log(C.append_log(None, old), new)


@register("l03_log_revisions")
def l03(spark, sf):
    return C.log_revisions(fx.feed(spark, sf), keep=5)


@register("l04_fingerprint")
def l04(spark, sf):
    return C.fingerprint(fx.documents(spark, sf).select("doc_id", "text")).drop("text")


@register("l05_rejected")
def l05(spark, sf):
    e = fx.table(spark, sf, "events")
    raw = e.select("event_id", F.col("user_id").cast("string").alias("page_id"),
                   F.when(F.col("event_type") == "signup", "added").when(F.col("event_type") == "error", "removed")
                    .when(F.col("event_type") == "click", "updated").otherwise(F.col("event_type")).alias("action"))
    return C.validate_domain(raw)[1]


@register("l06_needs_update")
def l06(spark, sf):
    v1, new = _versions(spark, sf)
    snap = latest_per_page(new).select("page_id", "revision_id")
    return C.needs_update(v1.entries, snap).select("page_id", "revision_id", "needs_update")


@register("l07_label_changes")
def l07(spark, sf):
    v1, new = _versions(spark, sf)
    snap = latest_per_page(new).select("page_id", "revision_id")
    todo = C.needs_update(v1.entries, snap).filter("needs_update").select("page_id", "revision_id")
    return C.label_changes(v1.entries, todo)


@register("l08_incremental_apply")
def l08(spark, sf):
    v1, new = _versions(spark, sf)
    snap = latest_per_page(new).drop("action")
    return C.incremental_apply(v1, snap).entries


def _l09(spark, sf):
    e, m = _ledger(spark, sf)
    hdr = fx.token_impacts(spark, sf)
    tok = fx.top_tokens(spark, sf).withColumn("id", F.col("token_impact_id") * 10 + F.col("position"))
    docs = fx.documents(spark, sf).select("doc_id", "n_chars")
    lab = fx.table(spark, sf, "labels").filter(F.col("quality") == 0).select("doc_id")
    pages = fx.page_texts(spark, sf).select("page_id", F.regexp_extract("page_id", r"(\d+)$", 1)
                                            .cast("long").alias("doc_id"))
    picked = pages.join(lab, "doc_id", "left_semi")
    unknown = lab.select(F.concat(F.lit("missing-"), F.col("doc_id").cast("string")).alias("page_id"))
    page_ids = picked.select("page_id").unionByName(unknown)
    tt = fx.top_tokens(spark, sf)
    ctx = F.when(F.col("position") == 0, F.array("context_start")) \
        .otherwise(F.array("context_start", "context_end"))
    imp = tt.groupBy("token_impact_id").agg(
        F.array_sort(F.collect_list(F.struct("position", "token_id", "impact", ctx.alias("context")))).alias("a"),
        F.count(F.lit(1)).alias("total_tokens"))
    imp = imp.select(F.col("token_impact_id").alias("doc_id"), F.struct(
        F.transform("a", lambda x: F.struct(x["token_id"].alias("token_id"), x["position"].alias("position"),
                                            x["impact"].alias("impact"), x["context"].alias("context")))
        .alias("top_tokens"), F.col("total_tokens").alias("total_tokens")).alias("token_impact"))
    metrics = picked.join(docs, "doc_id").join(imp, "doc_id", "left").select(
        "page_id", (F.col("doc_id") % 3 != 0).alias("has_loss"),
        (F.col("n_chars") / 1000.0).alias("average_loss"),
        F.when(F.col("doc_id") % 4 != 0, F.col("n_chars") / 10000.0).alias("relative_loss"),
        "token_impact")
    out = C.mark_used(e, m, hdr, tok, page_ids, "ckpt-new", "2024-02-01 00:00:00", metrics)
    return out, C._max_id(hdr), C._max_id(tok)


@register("l09_mark_used_metadata")
def l09a(spark, sf):
    out, _, _ = _l09(spark, sf)
    return _round_state(out.metadata)


@register("l09_mark_used_headers")
def l09b(spark, sf):
    out, hb, _ = _l09(spark, sf)
    return out.headers.filter(F.col("id") > hb)


@register("l09_mark_used_tokens")
def l09c(spark, sf):
    out, _, tb = _l09(spark, sf)
    return out.tokens.filter(F.col("id") > tb).withColumn("impact", F.round("impact", 6))


def _top10(spark, sf):
    e, m = _ledger(spark, sf)
    return Q.top_nodes(e, m, fx.token_impacts(spark, sf), top_n=10).select("entry_id")


@register("l10_set_used_flags")
def l10(spark, sf):
    _, m = _ledger(spark, sf)
    return _round_state(C.set_used_flags(m, _top10(spark, sf)))


@register("l11_kept_entries")
def l11a(spark, sf):
    e, m = _ledger(spark, sf)
    return C.remove_unused(e, m, fx.token_impacts(spark, sf), fx.top_tokens(spark, sf))[0]


@register("l11_kept_counts")
def l11b(spark, sf):
    e, m = _ledger(spark, sf)
    _, meta, hdr, tok, removed = C.remove_unused(e, m, fx.token_impacts(spark, sf), fx.top_tokens(spark, sf))
    return C._side_by_side(C._side_by_side(removed, meta.agg(F.count(F.lit(1)).alias("kept_metadata"))),
                           C._side_by_side(hdr.agg(F.count(F.lit(1)).alias("kept_headers")),
                                           tok.agg(F.count(F.lit(1)).alias("kept_tokens"))))


@register("l12_reset_metadata")
def l12(spark, sf):
    e, m = _ledger(spark, sf)
    return C.reset_metadata(e, m, recreate=True)


@register("l13_reset_no_recreate")
def l13(spark, sf):
    """Rows deleted from the metadata table and rows left after a reset without recreation."""
    e, m = _ledger(spark, sf)
    after = C.reset_metadata(e, m, recreate=False)
    return C._side_by_side(m.agg(F.count(F.lit(1)).alias("deleted_rows")),
                           after.agg(F.count(F.lit(1)).alias("remaining_rows")))


@register("l14_trim_metadata")
def l14a(spark, sf):
    _, m = _ledger(spark, sf)
    meta, _, _, _ = C.trim_to_top(m, fx.token_impacts(spark, sf), fx.top_tokens(spark, sf), _top10(spark, sf))
    return _round_state(meta)


@register("l14_trim_counts")
def l14b(spark, sf):
    _, m = _ledger(spark, sf)
    _, hdr, tok, cnt = C.trim_to_top(m, fx.token_impacts(spark, sf), fx.top_tokens(spark, sf), _top10(spark, sf))
    return C._side_by_side(cnt, C._side_by_side(hdr.agg(F.count(F.lit(1)).alias("kept_headers")),
                                                tok.agg(F.count(F.lit(1)).alias("kept_tokens"))))


@register("l15_clean_orphans")
def l15(spark, sf):
    _, m = _ledger(spark, sf)
    hdr, tok, counts = C.clean_orphans(m, fx.token_impacts(spark, sf), fx.top_tokens(spark, sf))
    return counts


@register("l15_remaining_headers")
def l15b(spark, sf):
    _, m = _ledger(spark, sf)
    return C.clean_orphans(m, fx.token_impacts(spark, sf), fx.top_tokens(spark, sf))[0]


@register("l16_clean_and_limit")
def l16(spark, sf):
    from corpus_ledger.plans.maintenance import clean_and_limit

    e, m = _ledger(spark, sf)
    res = clean_and_limit(e, m, fx.token_impacts(spark, sf), fx.top_tokens(spark, sf), top_n=10)
    return res.after


@register("l16_limit_to_top")
def l16l(spark, sf):
    from corpus_ledger.plans.maintenance import limit_to_top

    return limit_to_top(*_ledger(spark, sf), fx.token_impacts(spark, sf), fx.top_tokens(spark, sf)).after


@register("l16_mark_top")
def l16m(spark, sf):
    from corpus_ledger.plans.maintenance import mark_top

    return mark_top(*_ledger(spark, sf), fx.token_impacts(spark, sf), fx.top_tokens(spark, sf)).after


# --------------------------------------------------------------------------- R: runs, examples, outputs
from corpus_ledger.operators import runs as R  # noqa: E402
from corpus_ledger.sources.schemas import MODEL_OUTPUTS, TRAINING_EXAMPLES, TRAINING_RUNS  # noqa: E402

AT = "2024-02-01 00:00:00"


@register("r01_create_runs")
def r01(spark, sf):
    o = fx.table(spark, sf, "orders")
    req = o.select("o_orderkey", F.col("o_orderpriority").alias("model_name"),
                   F.col("o_orderstatus").alias("base_model"),
                   F.struct(F.col("o_custkey").alias("customer"), F.col("o_orderpriority").alias("priority"))
                   .alias("hyperparameters"))
    return R.create_runs(C.empty_like(spark, TRAINING_RUNS), req, AT, ["o_orderkey"])


def _runs_with_metrics(spark, sf):
    return fx.runs(spark, sf).withColumn("metrics", F.col("hyperparameters"))


@register("r02_update_status")
def r02(spark, sf):
    runs = _runs_with_metrics(spark, sf)
    o = fx.table(spark, sf, "orders").filter(F.col("o_orderstatus") == "O")
    upd = o.select(F.col("o_orderkey").alias("id"), F.lit("completed").alias("status"),
                   F.to_json(F.struct(F.col("o_custkey").alias("k"), F.lit(1.5).alias("final"),
                                      F.struct(F.col("o_custkey").alias("x")).alias("n"))).alias("metrics"), F.lit(2).alias("at"))
    # An earlier update of every one of these runs must leave no trace.
    earlier = upd.select("id", F.lit("failed").alias("status"), F.lit('{"k": "early"}').alias("metrics"), F.lit(1).alias("at"))
    out = R.update_run_status(runs, upd.unionByName(earlier), order=["at"])
    return out.select("id", "status", F.get_json_object("metrics", "$.k").alias("metrics_k"),
                      F.get_json_object("metrics", "$.final").alias("metrics_final"),
                      F.get_json_object("metrics", "$.n.x").alias("metrics_nested"),
                      F.coalesce(F.schema_of_variant(F.variant_get(F.parse_json("metrics"), "$.k", "variant")) == "BIGINT",
                                 F.lit(False)).alias("k_is_number"),
                      F.size(F.from_json("metrics", R.METRICS_MAP)).alias("n_metric_keys"))


def _examples(spark, sf):
    return R.add_examples(C.empty_like(spark, TRAINING_EXAMPLES), fx.examples(spark, sf), ["run_id", "turn"])


@register("r03_add_examples")
def r03(spark, sf):
    return _examples(spark, sf)


@register("r04_add_outputs")
def r04(spark, sf):
    ex = fx.examples(spark, sf).filter(F.col("target_text").isNotNull())
    new = ex.select("run_id", "turn", "input_text", F.col("target_text").alias("output_text"),
                    F.to_json(F.struct("turn")).alias("metadata"))
    return R.add_model_outputs(C.empty_like(spark, MODEL_OUTPUTS), new, AT, ["run_id", "turn"])


@register("r05_run_details")
def r05(spark, sf):
    ids = fx.table(spark, sf, "labels").filter(F.col("toxic") == 1).select(F.col("doc_id").alias("id"))
    d = R.run_details(_runs_with_metrics(spark, sf), ids)
    return d.select("id", "model_name", "status", F.element_at("hyperparameters_map", F.lit("k")).cast("bigint").alias("hp_k"),
                    F.size("metrics_map").alias("n_metric_keys"))


@register("r06_run_summaries")
def r06(spark, sf):
    return R.run_summaries(fx.runs(spark, sf))


@register("r07_list_examples")
def r07(spark, sf):
    return R.list_examples(_examples(spark, sf), example_type="chat", limit=100)


# --------------------------------------------------------------------------- I: audits
from corpus_ledger.operators import audit as I  # noqa: E402
from corpus_ledger.sources.schemas import LEDGER_TABLES  # noqa: E402


def _impact_tables(spark, sf):
    e, m = _ledger(spark, sf)
    return e, m, fx.token_impacts(spark, sf), fx.top_tokens(spark, sf)


@register("i01_orphans")
def i01(spark, sf):
    _, m, h, t = _impact_tables(spark, sf)
    return I.orphan_counts(m, h, t)


@register("i02_foreign_keys")
def i02(spark, sf):
    e, m, h, t = _impact_tables(spark, sf)
    return I.foreign_key_check({"entries": e, "training_metadata": m, "token_impacts": h, "top_tokens": t})


@register("i03_coverage")
def i03(spark, sf):
    return I.impact_coverage(*_impact_tables(spark, sf))


@register("i04_token_validity")
def i04(spark, sf):
    return I.token_validity(fx.top_tokens(spark, sf))


@register("i04_token_violations")
def i04v(spark, sf):
    return I.token_violations(fx.top_tokens(spark, sf)).select("token_impact_id", "token_id", "position", "rule")


@register("i05_schema_check")
def i05(spark, sf):
    e, m, h, t = _impact_tables(spark, sf)
    return I.schema_check({"entries": e, "training_metadata": m, "token_impacts": h, "top_tokens": t},
                          LEDGER_TABLES)


@register("i06_size_statistics")
def i06(spark, sf):
    return I.size_statistics(*_impact_tables(spark, sf))


@register("i07_readiness")
def i07(spark, sf):
    return I.readiness(*_impact_tables(spark, sf))


@register("i08_table_samples")
def i08(spark, sf):
    e, m, h, t = _impact_tables(spark, sf)
    return I.table_samples({"entries": e, "training_metadata": m, "token_impacts": h, "top_tokens": t},
                           {"entries": ["id"], "training_metadata": ["id"], "token_impacts": ["id"],
                            "top_tokens": ["token_impact_id", "position", "token_id", "context_start"]})


@register("i08_table_schemas")
def i08s(spark, sf):
    e, m, h, t = _impact_tables(spark, sf)
    return I.table_schemas({"entries": e, "training_metadata": m, "token_impacts": h, "top_tokens": t})


# --------------------------------------------------------------------------- M: dataset and metrics
from corpus_ledger.operators import metrics as M  # noqa: E402


def _eligible(spark, sf):
    e, m = _ledger(spark, sf)
    return M.eligible_pages(e, m, fx.page_texts(spark, sf), min_pages=100)


@register("m01_eligible_pages")
def m01(spark, sf):
    return _eligible(spark, sf)


@register("m02_split")
def m02(spark, sf):
    return M.split_train_val(_eligible(spark, sf).select("page_id"), 0.1, 42)


@register("m02_split_select")
def m02s(spark, sf):
    return M.split_select(_eligible(spark, sf).select("page_id"), 0.1, 42)


@register("m04_batches")
def m04(spark, sf):
    return M.number_batches(M.split_train_val(_eligible(spark, sf).select("page_id"), 0.1, 42), 4)


@register("m05_token_cross_entropy")
def m05(spark, sf):
    return M.token_cross_entropy(fx.scores(spark, sf)).select("seq_id", "target", r6("token_loss"))


def _seq_loss(spark, sf):
    return M.sequence_losses(fx.token_loss(spark, sf), ["page_id", "epoch", "batch"])


@register("m06_sequence_loss")
def m06(spark, sf):
    return _seq_loss(spark, sf).select("page_id", "epoch", "batch", r6("seq_loss"))


@register("m06_batch_loss")
def m06b(spark, sf):
    return M.batch_losses(_seq_loss(spark, sf), ["epoch", "batch"]).select("epoch", "batch", r6("batch_loss"))


@register("m07_epoch_loss")
def m07(spark, sf):
    b = M.batch_losses(_seq_loss(spark, sf), ["epoch", "batch"])
    return M.epoch_losses(b).select("epoch", r6("epoch_loss"), "n_batches")


@register("m08_page_loss")
def m08(spark, sf):
    return M.page_losses(_seq_loss(spark, sf)).select("page_id", r6("average_loss"), r6("initial_loss"),
                                                      r6("relative_loss"))


@register("m09_l2_norm")
def m09(spark, sf):
    return M.l2_norm(fx.impact_vectors(spark, sf), "impacts").select("page_id", r6("impact"))


@register("m10_threshold")
def m10(spark, sf):
    return M.significance_threshold(fx.impact_vectors(spark, sf)).select("page_id", r6("threshold"))


@register("m11_critical_tokens")
def m11(spark, sf):
    c = M.critical_tokens(fx.impact_vectors(spark, sf))
    return c.select("page_id", r6("threshold"), "total_tokens", "position", r6("impact"), "context_start",
                    "context_end")


@register("m12_top_impacts")
def m12(spark, sf):
    imp = fx.impacts(spark, sf).withColumn("total_tokens", F.lit(64))
    t = M.top_impacts(imp, k=10)
    return t.select("page_id", "rank", "position", r6("impact"), "context_start", "context_end")


@register("m13_last_epoch")
def m13(spark, sf):
    v = fx.impact_vectors(spark, sf)
    v = M.significance_threshold(v).select(
        F.floor(F.col("page_id") / 5).alias("page_id"), (F.col("page_id") % 5).alias("epoch"),
        F.col("page_id").alias("vec_id"), "threshold", F.size("impacts").alias("total_tokens"))
    return M.last_epoch(v).select("page_id", "epoch", "vec_id", r6("threshold"), "total_tokens")


@register("m14_nan_audit")
def m14(spark, sf):
    s = M.token_cross_entropy(fx.scores(spark, sf))
    return M.nan_audit(s, ["logits"], ["token_loss"])


@register("m15_top_k")
def m15(spark, sf):
    return M.top_k_filter(M.explode_scores(fx.scores(spark, sf)), k=5) \
        .select("seq_id", "token_id", r6("score"), "rank")


@register("m16_nucleus")
def m16(spark, sf):
    top = M.top_k_filter(M.explode_scores(fx.scores(spark, sf)), k=10)
    n = M.nucleus_filter(top, top_p=0.9, temperature=0.8)
    return n.select("seq_id", "token_id", r6("prob"), r6("cum_before"))


@register("m17_impactful_tokens")
def m17(spark, sf):
    return M.most_impactful_tokens(fx.top_tokens(spark, sf), 10).select("token_id", r6("total_abs_impact"),
                                                                         "n_pages")


# --------------------------------------------------------------------------- T: tokenizer
from corpus_ledger.functions.materialize import materialize  # noqa: E402
from corpus_ledger.functions.text import pretokenize  # noqa: E402
from corpus_ledger.operators import tokens as TK  # noqa: E402


def _hash_ids(c: str) -> F.Column:
    return F.sha2(F.array_join(F.transform(c, lambda x: x.cast("string")), ","), 256)


def _freqs(spark, sf):
    """Word counts, stored: the texts are split and counted once for the vocabulary and the merges."""
    return materialize(TK.word_frequencies(fx.documents(spark, sf)))


def _vocab(spark, sf, freqs=None):
    """The initial vocabulary, stored (some thousand rows), as encoding and decoding read it several times."""
    return materialize(TK.initial_vocab(TK.word_frequencies(fx.documents(spark, sf)) if freqs is None else freqs, 10000, 2))


def _word_level(spark, sf, max_length=None, add_eos=True, method="lookup", vocab=None):
    docs = TK.pre_tokens(fx.documents(spark, sf).select("doc_id", "text"))
    return TK.encode(docs, "doc_id", "tokens", _vocab(spark, sf) if vocab is None else vocab, max_length=max_length, add_eos=add_eos,
                     method=method)


@register("t01_pretokenize")
def t01(spark, sf):
    d = fx.documents(spark, sf).select("doc_id", pretokenize(F.col("text"), True).alias("s"),
                                       pretokenize(F.col("text"), False).alias("u"))
    return d.select("doc_id", F.size("s").alias("n_tokens"), F.sha2(F.array_join("s", "\u0001"), 256).alias("tokens_hash"),
                    F.size("u").alias("n_raw"), F.sha2(F.array_join("u", "\u0001"), 256).alias("raw_hash"))


@register("t02_word_frequencies")
def t02(spark, sf):
    return TK.word_frequencies(fx.documents(spark, sf))


@register("t03_initial_vocab")
def t03(spark, sf):
    return _vocab(spark, sf)


@register("t04_pair_counts")
def t04(spark, sf):
    return TK.pair_counts(TK.word_table(TK.word_frequencies(fx.documents(spark, sf)), 2))


def _merges(spark, sf, freqs=None):
    return TK.train_from_counts(_freqs(spark, sf) if freqs is None else freqs)[1]


@register("t05_learn_merges")
def t05(spark, sf):
    return _merges(spark, sf)


def _first_merges(spark, sf, freqs=None):
    """The first 20 merges, which SQL can learn too; the learner takes them in several rounds."""
    freqs = TK.word_frequencies(fx.documents(spark, sf)) if freqs is None else freqs
    return TK.learn_merges(TK.word_table(freqs, 2), 20, first_pairs=4)


@register("t05_first_merges")
def t05f(spark, sf):
    return _first_merges(spark, sf)


@register("t07_apply_first_merges")
def t07f(spark, sf):
    docs = TK.pre_tokens(fx.documents(spark, sf).select("doc_id", "text"))
    p = TK.apply_merges(docs, _first_merges(spark, sf))
    return p.select("doc_id", F.size("pieces").alias("n_pieces"), F.sha2(F.array_join("pieces", "\u0001"), 256)
                    .alias("pieces_hash"))


@register("t10_encode_first_merges")
def t10f(spark, sf):
    freqs = _freqs(spark, sf)
    merges = _first_merges(spark, sf, freqs)
    docs = TK.pre_tokens(fx.documents(spark, sf).select("doc_id", "text"))
    e = TK.encode(docs, "doc_id", "tokens", TK.extend_vocab(_vocab(spark, sf, freqs), merges), merges=merges)
    return e.select("doc_id", F.size("input_ids").alias("n_ids"), _hash_ids("input_ids").alias("ids_hash"))


@register("t06_extend_vocab")
def t06(spark, sf):
    freqs = _freqs(spark, sf)
    return TK.extend_vocab(_vocab(spark, sf, freqs), _merges(spark, sf, freqs))


@register("t07_apply_merges")
def t07(spark, sf):
    docs = TK.pre_tokens(fx.documents(spark, sf).select("doc_id", "text"))
    p = TK.apply_merges(docs, _merges(spark, sf))
    return p.select("doc_id", F.size("pieces").alias("n_pieces"), F.sha2(F.array_join("pieces", "\u0001"), 256)
                    .alias("pieces_hash"))


@register("t08_bpe_dropout")
def t08(spark, sf):
    docs = TK.pre_tokens(fx.documents(spark, sf).select("doc_id", "text"))
    p = TK.apply_merges_dropout(docs, _merges(spark, sf), "doc_id", p=0.1, seed=7)
    return p.select("doc_id", F.size("pieces").alias("n_pieces"), F.sha2(F.array_join("pieces", "\u0001"), 256)
                    .alias("pieces_hash"))


@register("t09_token_ids")
def t09(spark, sf):
    e = _word_level(spark, sf, add_eos=False, method="join")
    return e.select("doc_id", F.size("input_ids").alias("n_ids"),
                    F.size(F.filter("input_ids", lambda x: x == 3)).alias("n_unk"), _hash_ids("input_ids").alias("ids_hash"))


@register("t10_encode")
def t10(spark, sf):
    e = _word_level(spark, sf, max_length=1024)
    return e.select("doc_id", F.size("input_ids").alias("n_ids"), F.element_at("input_ids", -1).alias("last_id"),
                    _hash_ids("input_ids").alias("ids_hash"))


@register("t10_encode_bpe")
def t10b(spark, sf):
    freqs = _freqs(spark, sf)
    merges = _merges(spark, sf, freqs)
    docs = TK.pre_tokens(fx.documents(spark, sf).select("doc_id", "text"))
    e = TK.encode(docs, "doc_id", "tokens", TK.extend_vocab(_vocab(spark, sf, freqs), merges), merges=merges)
    return e.select("doc_id", F.size("input_ids").alias("n_ids"), _hash_ids("input_ids").alias("ids_hash"))


@register("t11_decode")
def t11(spark, sf):
    vocab = _vocab(spark, sf)
    e = _word_level(spark, sf, vocab=vocab)
    d = TK.decode(e.select("doc_id", "input_ids"), "doc_id", "input_ids", vocab)
    return d.select("doc_id", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text_hash"))


@register("t12_special_mask")
def t12(spark, sf):
    e = _word_level(spark, sf)
    m = TK.special_tokens_mask(F.col("input_ids"))
    m2 = TK.special_tokens_mask(F.col("input_ids"), already_has_special_tokens=False)
    pair = TK.special_tokens_mask(F.col("input_ids"), already_has_special_tokens=False, pair=F.array(F.lit(5), F.lit(6)))
    return e.select("doc_id", F.aggregate(m, F.lit(0), lambda a, x: a + x).alias("n_special"),
                    F.size(m2).alias("mask_len"), F.array_join(F.slice(pair, -4, 4), "").alias("pair_mask_end"))


@register("t13_pack_pair")
def t13(spark, sf):
    ex = fx.examples(spark, sf).filter(F.col("target_text").isNotNull()) \
        .withColumn("key", F.col("run_id") * 1000 + F.col("turn"))
    v = _vocab(spark, sf)
    a = TK.encode(TK.pre_tokens(ex, "input_text", out="ta"), "key", "ta", v, add_eos=False, out="a")
    b = TK.encode(TK.pre_tokens(a, "target_text", out="tb"), "key", "tb", v, add_eos=False, out="b")
    ids, types = TK.pack_pair(F.col("a"), F.col("b"))
    return b.select("run_id", "turn", F.size(ids).alias("n_ids"),
                    F.aggregate(types, F.lit(0), lambda s, x: s + x).alias("n_second"),
                    F.sha2(F.array_join(F.transform(ids, lambda x: x.cast("string")), ","), 256).alias("ids_hash"))


@register("t14_pad_batches")
def t14(spark, sf):
    e = _word_level(spark, sf, max_length=1024).withColumn("batch", F.floor(F.col("doc_id") / 4))
    p = TK.pad_batches(e, "batch")
    return p.select("doc_id", "batch", F.size("input_ids").alias("padded_len"),
                    F.size(F.filter("input_ids", lambda x: x == 0)).alias("n_pad"),
                    F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("mask_sum"))


@register("t15_added_vocab")
def t15(spark, sf):
    return TK.added_vocab(_vocab(spark, sf))


@register("t16_train_tokenizer")
def t16(spark, sf):
    from corpus_ledger.plans.tokenizer_job import corpus_tokenizer

    e, m = _ledger(spark, sf)
    vocab, merges = corpus_tokenizer(e, m, fx.page_texts(spark, sf), vocab_size=10000, min_frequency=2)
    return vocab


@register("m03_sequences")
def m03(spark, sf):
    from corpus_ledger.plans.dataset import page_sequences

    s = page_sequences(Q.main_pages(*_ledger(spark, sf)).select("page_id"), fx.page_texts(spark, sf), _vocab(spark, sf), max_length=1024)
    return s.select("page_id", F.size("input_ids").alias("n_ids"), _hash_ids("input_ids").alias("ids_hash"))


def _padded(batches: DataFrame) -> DataFrame:
    return batches.select("page_id", "split_rank", "batch", F.size("input_ids").alias("padded_len"),
                          F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("n_ids"), _hash_ids("input_ids").alias("ids_hash"))


@register("m04_training_batches")
def m04t(spark, sf):
    from corpus_ledger.plans.dataset import training_batches

    return _padded(training_batches(*_ledger(spark, sf), fx.page_texts(spark, sf), _vocab(spark, sf)))


@register("m04_training_batches_dropout")
def m04d(spark, sf):
    """The whole dataset job with BPE-dropout over the whole merge budget."""
    from corpus_ledger.plans.dataset import training_batches

    freqs = _freqs(spark, sf)
    merges = _merges(spark, sf, freqs)
    vocab = TK.extend_vocab(_vocab(spark, sf, freqs), merges)
    return _padded(training_batches(*_ledger(spark, sf), fx.page_texts(spark, sf), vocab, merges, dropout=0.1))


@register("m10_threshold_rows")
def m10r(spark, sf):
    """Row form: few pages with very many impacts each."""
    rows = fx.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("page_id"), (F.col("l_extendedprice") - 30000).alias("impact"))
    return M.threshold_rows(rows, "page_id", "impact").select("page_id", "n", r6("threshold"))


@register("m17_remove_tokens")
def m17r(spark, sf):
    e = _word_level(spark, sf, add_eos=False)
    top = M.most_impactful_tokens(fx.top_tokens(spark, sf), 10)
    r = M.remove_tokens(e, "input_ids", top)
    return r.select("doc_id", F.size("input_ids").alias("n_ids"), _hash_ids("input_ids").alias("ids_hash"))


# --------------------------------------------------------------------------- S: sources and sinks
from corpus_ledger.session import work_path  # noqa: E402
from corpus_ledger.sources import io as IO  # noqa: E402


def _ledger4(spark, sf):
    e, m = _ledger(spark, sf)
    return {"entries": e, "training_metadata": m, "token_impacts": fx.token_impacts(spark, sf),
            "top_tokens": fx.top_tokens(spark, sf).withColumn("id", F.lit(None).cast("long"))}


@register("s01_load_ledger")
def s01(spark, sf):
    base = work_path(spark, "ledger")
    IO.save_ledger(_ledger4(spark, sf), base)
    return IO.load_ledger(spark, base)["entries"]


def _roundtrip(spark, sf):
    t = _ledger4(spark, sf)
    path = work_path(spark, "nested")
    IO.export_json(IO.nest_ledger(t["entries"], t["training_metadata"], t["token_impacts"], t["top_tokens"]), path)
    return IO.import_nested(IO.read_nested(spark, path))


@register("s02_import_entries")
def s02a(spark, sf):
    return _roundtrip(spark, sf)[0]


@register("s02_import_metadata")
def s02b(spark, sf):
    return _round_state(_roundtrip(spark, sf)[1])


@register("s02_import_headers")
def s02c(spark, sf):
    _, _, h, t = _roundtrip(spark, sf)
    n = t.groupBy("token_impact_id").agg(F.count(F.lit(1)).alias("n_tokens"))
    return h.join(n, h["id"] == n["token_impact_id"], "left").select(
        "metadata_id", "total_tokens", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"))


@register("s02_import_document")
def s02d(spark, sf):
    """The ledger as JSON documents, one per task, read block by block and imported."""
    t = _ledger4(spark, sf)
    n = IO.nest_ledger(t["entries"], t["training_metadata"], t["token_impacts"], t["top_tokens"])
    path = work_path(spark, "documents")
    IO.write_documents(n, path, "entries")
    return IO.import_nested(IO.read_nested(spark, path, multi_line_document=True))[0]


@register("s03_export_nested")
def s03(spark, sf):
    t = _ledger4(spark, sf)
    n = IO.nest_ledger(t["entries"], t["training_metadata"], t["token_impacts"], t["top_tokens"])
    ti = F.col("training_metadata.token_impact")
    return n.select("id", "page_id", F.col("training_metadata.used_in_training").alias("used_in_training"),
                    ti["total_tokens"].alias("total_tokens"), F.size(ti["top_tokens"]).alias("n_top_tokens"),
                    F.element_at(ti["top_tokens"], 1)["position"].alias("first_position"))


@register("s04_impact_pages")
def s04(spark, sf):
    t = _ledger4(spark, sf)
    p = IO.impact_pages(t["entries"], t["training_metadata"], t["token_impacts"], t["top_tokens"])
    return p.select("entry_id", "page_id", "token_impact_id", "total_tokens", F.size("top_tokens").alias("n_top_tokens"),
                    F.round(F.aggregate("top_tokens", F.lit(0.0), lambda a, x: a + x["impact"]), 6).alias("impact_sum"))


@register("s05_read_texts")
def s05(spark, sf):
    path = work_path(spark, "texts")
    pages = fx.table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("page_id"),
                                                 F.col("html").alias("text"))
    IO.write_page_texts(pages, path)
    t = IO.read_page_texts(spark, path)
    return t.select("page_key", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text_hash"))


@register("s06_write_revision_texts")
def s06(spark, sf):
    path = work_path(spark, "revtexts")
    IO.write_page_texts(fx.feed(spark, sf), path, "page_id", "revision_id", "content")
    t = IO.read_page_texts(spark, path)
    return t.select("page_key", F.sha2("text", 256).alias("text_hash"))


@register("s07_write_titles")
def s07(spark, sf):
    path = work_path(spark, "titles")
    IO.write_titles(Q.main_titles(*_ledger(spark, sf)), path)
    return spark.read.schema("page_id string, title string").json(f"{path}/mapping")


@register("s07_title_arrays")
def s07a(spark, sf):
    path = work_path(spark, "titles")
    IO.write_titles(Q.main_titles(*_ledger(spark, sf)), path, with_mapping=False, arrays=True)
    return IO.read_title_arrays(spark, f"{path}/titles")


@register("s08_category_members")
def s08c(spark, sf):
    """One response per part type that lists its parts, flattened to titles in the order of the response."""
    p = fx.table(spark, sf, "part")
    members = F.array_sort(F.collect_list(F.struct(F.col("p_partkey").cast("long").alias("pageid"), F.col("p_name").alias("title"))))
    body = F.to_json(F.struct(F.struct(members.alias("categorymembers")).alias("query")))
    return IO.flatten_category_members(p.groupBy("p_type").agg(body.alias("body")).select("body"))


def api_responses(feed: DataFrame) -> DataFrame:
    """Re-nest the feed as API responses: one document per page with its 5 latest revisions (newest
    first); a page without a signup ('added') change is answered as missing."""
    from pyspark.sql import Window

    w = Window.partitionBy("page_id").orderBy(F.desc("ts"), F.desc("event_id"))
    top = feed.withColumn("rn", F.row_number().over(w)).filter("rn <= 5")
    revs = top.groupBy("page_id", "title").agg(F.array_sort(F.collect_list(F.struct(
        "rn", F.col("event_id").alias("revid"), F.col("content")))).alias("r"))
    known = feed.filter(F.col("action") == "added").select("page_id").distinct().withColumn("ok", F.lit(True))
    j = revs.join(known, "page_id", "left")
    page = F.struct(F.col("page_id").cast("long").alias("pageid"), F.col("title").alias("title"),
                    F.when(F.col("ok").isNull(), F.lit("")).alias("missing"),
                    F.transform("r", lambda x: F.struct(
                        x["revid"].alias("revid"),
                        F.create_map(F.lit("main"), F.create_map(F.lit("*"), x["content"])).alias("slots"))
                    ).alias("revisions"))
    body = F.to_json(F.struct(F.struct(F.create_map(F.col("page_id"), page).alias("pages")).alias("query")))
    return j.select(body.alias("body"))


@register("s08_flatten_api")
def s08(spark, sf):
    return IO.flatten_api_pages(api_responses(fx.feed(spark, sf)))


@register("s09_repair_utf8")
def s09(spark, sf):
    p = fx.table(spark, sf, "pages").select("page_id", F.concat(F.col("html").cast("binary"),
                                                                F.unhex(F.lit("FF"))).alias("raw"))
    r = IO.repair_text(p, "raw")
    return r.select("page_id", F.length("text").alias("n_chars"), F.col("text").endswith("�").alias("repaired"))


@register("s10_tokenizer_files")
def s10(spark, sf):
    path = work_path(spark, "tokenizer")
    freqs = _freqs(spark, sf)
    IO.save_tokenizer(_vocab(spark, sf, freqs), _first_merges(spark, sf, freqs), path)
    vocab, merges = IO.load_tokenizer(spark, path)
    return vocab.select(F.lit("vocab").alias("part"), F.col("id").cast("long").alias("n"), F.col("token").alias("left"),
                        F.lit(None).cast("string").alias("right")).unionByName(
        merges.select(F.lit("merges").alias("part"), F.col("rank").cast("long").alias("n"), "left", "right"))


@register("s10_merges_text")
def s10t(spark, sf):
    """Merge lines as text, one ``left right`` line each; lines of a piece that holds white space are malformed."""
    lines = _first_merges(spark, sf).orderBy("rank").coalesce(1).select(F.concat_ws(" ", "left", "right").alias("value"))
    return IO.merges_from_text(lines)


@register("s11_migrate_legacy")
def s11(spark, sf):
    return IO.migrate_legacy_impact(fx.legacy_impact(spark, sf))


# --------------------------------------------------------------------------- ST1: streaming ledger apply
@register("st01_stream_ledger")
def st01(spark, sf):
    """The feed written as files per day, then applied by the stream a few files per micro-batch."""
    from corpus_ledger.streaming.ledger_stream import FEED_SCHEMA, run_to_completion

    base = work_path(spark, "stream")
    feed = fx.feed(spark, sf).select(*FEED_SCHEMA.fieldNames()).withColumn("day", F.to_date("ts"))
    # A range of days and events per task: a day with many events is spread over several files.
    tasks = max(8, spark.sparkContext.defaultParallelism)
    feed.repartitionByRange(tasks, "day", "event_id").write.partitionBy("day").parquet(f"{base}/feed")
    return run_to_completion(spark, f"{base}/feed/*", f"{base}/state", f"{base}/checkpoint",
                             max_files_per_trigger=16).entries


@register("l01_upsert_stored")
def l01s(spark, sf):
    """L1 against a stored ledger: the old feed as the first version, the new feed as the second."""
    from corpus_ledger.sources.ledger_store import LedgerStore

    store = LedgerStore(spark, work_path(spark, "ledger"), ENTRIES)
    for version, part in enumerate(fx.split_feed(fx.feed(spark, sf)), 1):
        C.upsert_stored(store, part, version)
    return store.read()


@register("l08_ingest_with_revisions")
def l08b(spark, sf):
    """L8 end to end: latest snapshot per page, text stored, upsert, then the 5 latest revisions."""
    from corpus_ledger.plans.ingest import ingest_batch

    v1, new = _versions(spark, sf)
    snap = latest_per_page(new).drop("action")
    revs = new.select("page_id", "title", "revision_id", "ts", "content")
    return ingest_batch(v1, snap, revs, text_path=work_path(spark, "ingest-texts")).entries
