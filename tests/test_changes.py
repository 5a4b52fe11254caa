"""Ledger changes: the L1 fold against a sequential Python fold (D1), L9 with the one-metric input,
orphan cleanup invariants and surrogate ids."""

import datetime as dt
import random

from pyspark.sql import functions as F

from corpus_ledger.functions.ranks import global_row_number
from corpus_ledger.operators import audit as I
from corpus_ledger.operators import changes as C
from corpus_ledger.sources.schemas import ENTRIES, TOKEN_IMPACTS, TOP_TOKENS, TRAINING_METADATA

T0 = dt.datetime(2024, 1, 1)


def python_fold(rows):
    """The reference's log_page applied row by row in (ts, event_id) order."""
    led = {}
    for r in sorted(rows, key=lambda r: (r["ts"], r["event_id"])):
        p = r["page_id"]
        if p not in led:
            led[p] = dict(id=len(led) + 1, title=r["title"], page_id=p, revision_id=r["revision_id"], ts=r["ts"],
                          action=r["action"])
        elif r["action"] == "updated":
            led[p].update(revision_id=r["revision_id"], ts=r["ts"], action="updated")
    return led


def feed_rows(n=300, pages=12, seed=3):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        rows.append(dict(event_id=i, page_id=f"p{rnd.randrange(pages)}", title=f"t{i}", revision_id=f"r{i}",
                         ts=T0 + dt.timedelta(minutes=rnd.randrange(10000)), content=f"c{i}",
                         action=rnd.choice(["added", "updated", "removed"])))
    return rows


def to_df(spark, rows):
    return spark.createDataFrame(rows, "event_id long, page_id string, title string, revision_id string, "
                                       "ts timestamp_ntz, content string, action string")


def test_upsert_equals_sequential_fold(spark):
    rows = feed_rows()
    v = C.upsert_pages(C.empty_like(spark, ENTRIES), C.empty_like(spark, TRAINING_METADATA), to_df(spark, rows))
    got = {r.page_id: r.asDict() for r in v.entries.collect()}
    want = python_fold(rows)
    assert set(got) == set(want)
    for p, w in want.items():
        g = got[p]
        assert (g["id"], g["title"], g["revision_id"], g["ts"], g["action"]) == \
            (w["id"], w["title"], w["revision_id"], w["ts"], w["action"])
    meta = v.metadata.collect()
    assert len(meta) == len(want) and not any(m.used_in_training for m in meta)


def test_upsert_in_two_batches_equals_one(spark):
    rows = feed_rows(seed=5)
    cut = T0 + dt.timedelta(minutes=5000)
    e0, m0 = C.empty_like(spark, ENTRIES), C.empty_like(spark, TRAINING_METADATA)
    one = C.upsert_pages(e0, m0, to_df(spark, rows)).entries
    v1 = C.upsert_pages(e0, m0, to_df(spark, [r for r in rows if r["ts"] < cut]))
    two = C.upsert_pages(v1.entries, v1.metadata, to_df(spark, [r for r in rows if r["ts"] >= cut])).entries
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))


def test_first_change_inserts_whatever_its_action(spark):
    rows = [dict(event_id=1, page_id="x", title="X", revision_id="r1", ts=T0, content="a", action="removed"),
            dict(event_id=2, page_id="x", title="Y", revision_id="r2", ts=T0 + dt.timedelta(1), content="b",
                 action="added")]
    v = C.upsert_pages(C.empty_like(spark, ENTRIES), C.empty_like(spark, TRAINING_METADATA), to_df(spark, rows))
    (e,) = v.entries.collect()
    assert (e.title, e.revision_id, e.action) == ("X", "r1", "removed")


def test_validate_domain_and_strict_mode(spark):
    df = spark.createDataFrame([("added",), ("bogus",), (None,)], "action string")
    ok, bad = C.validate_domain(df)
    assert ok.count() == 1 and bad.count() == 2
    import pytest

    with pytest.raises(Exception):
        C.assert_domain(df).collect()


def test_mark_used_with_one_metric(spark):
    """The reference's behavioural test: one page, one metric with a one-token impact."""
    entries = spark.createDataFrame(
        [(1, "Test Page", "test123", "rev1", T0, "h", "added", False, None, None)], ENTRIES)
    meta = spark.createDataFrame([(1, 1, False, None, None, None, None)], TRAINING_METADATA)
    metrics = spark.createDataFrame(
        [("test123", True, 1.234, 0.567, ([(42, 10, 3.14, [8, 12])], 100))],
        "page_id string, has_loss boolean, average_loss double, relative_loss double, "
        "token_impact struct<top_tokens:array<struct<token_id:bigint,position:int,impact:double,"
        "context:array<int>>>,total_tokens:bigint>")
    keys = spark.createDataFrame([("test123",), ("unknown",)], "page_id string")
    out = C.mark_used(entries, meta, C.empty_like(spark, TOKEN_IMPACTS), C.empty_like(spark, TOP_TOKENS), keys,
                      "test_checkpoint", "2024-02-01 00:00:00", metrics)
    (m,) = out.metadata.collect()
    assert m.used_in_training and m.model_checkpoint == "test_checkpoint"
    assert (m.average_loss, m.relative_loss) == (1.234, 0.567)
    (h,) = out.headers.collect()
    assert (h.id, h.metadata_id, h.total_tokens) == (1, 1, 100)
    (t,) = out.tokens.collect()
    assert (t.token_id, t.position, t.impact, t.context_start, t.context_end) == (42, 10, 3.14, 8, 12)


def test_mark_used_bad_context_and_null_losses(spark):
    entries = spark.createDataFrame([(5, "T", "p", "r", T0, "h", "added", False, None, None)], ENTRIES)
    metrics = spark.createDataFrame(
        [("p", True, None, None, ([(7, 3, 1.0, [1])], None))],
        "page_id string, has_loss boolean, average_loss double, relative_loss double, "
        "token_impact struct<top_tokens:array<struct<token_id:bigint,position:int,impact:double,"
        "context:array<int>>>,total_tokens:bigint>")
    out = C.mark_used(entries, C.empty_like(spark, TRAINING_METADATA), C.empty_like(spark, TOKEN_IMPACTS),
                      C.empty_like(spark, TOP_TOKENS), spark.createDataFrame([("p",)], "page_id string"),
                      "c", "2024-02-01 00:00:00", metrics)
    (m,) = out.metadata.collect()  # created, since the entry had no metadata row
    assert (m.id, m.entry_id, m.average_loss, m.relative_loss) == (1, 5, 0.0, 0.0)
    (h,) = out.headers.collect()
    assert h.total_tokens == 0
    (t,) = out.tokens.collect()
    assert (t.context_start, t.context_end) == (3, 3)


def test_no_orphans_after_clean(spark):
    meta = spark.createDataFrame([(1, 1, True, None, None, None, None)], TRAINING_METADATA)
    hdr = spark.createDataFrame([(1, 1, 3), (2, 99, 3)], TOKEN_IMPACTS)
    tok = spark.createDataFrame([(1, 1, 5, 0, 1.0, 0, 2), (2, 2, 6, 0, 1.0, 0, 2), (3, 77, 6, 0, 1.0, 0, 2)],
                                TOP_TOKENS)
    h2, t2, counts = C.clean_orphans(meta, hdr, tok)
    assert counts.first().asDict() == {"headers_deleted": 1, "tokens_deleted": 2}
    o = I.orphan_counts(meta, h2, t2).first()
    assert (o.orphan_headers, o.orphan_tokens) == (0, 0)


def test_global_row_number_matches_window(spark):
    df = spark.range(0, 5000).withColumn("k", (F.col("id") * 7919) % 5003)
    want = sorted(((r.k, r.id) for r in df.collect()))
    for limit in (0, 10 ** 6):  # distributed path, then the bounded single-task path
        got = global_row_number(df, ["k", "id"], "rn", single_task_rows=limit).select("k", "id", "rn").collect()
        assert sorted((r.rn, r.k, r.id) for r in got) == [(i + 1, k, j) for i, (k, j) in enumerate(want)]


def test_mark_used_without_metrics(spark):
    """Every listed page is marked, also one that has no metrics."""
    from corpus_ledger.operators import changes as C
    from corpus_ledger.sources.schemas import ENTRIES, TOKEN_IMPACTS, TOP_TOKENS, TRAINING_METADATA

    entries = C.empty_like(spark, ENTRIES).select("id", "page_id").union(
        spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, page_id string"))
    meta = C.empty_like(spark, TRAINING_METADATA).union(spark.createDataFrame(
        [(i, i, False, None, None, None, None) for i in (1, 2, 3)], C.empty_like(spark, TRAINING_METADATA).schema))
    pages = spark.createDataFrame([("a",), ("b",)], "page_id string")
    metrics = spark.createDataFrame([("a", True, 1.5, 0.5, None)], "page_id string, has_loss boolean, average_loss double, "
                                    "relative_loss double, token_impact struct<top_tokens:array<struct<token_id:bigint,"
                                    "position:int,impact:double,context:array<int>>>,total_tokens:bigint>")
    out = C.mark_used(entries, meta, C.empty_like(spark, TOKEN_IMPACTS), C.empty_like(spark, TOP_TOKENS), pages, "ck",
                      "2024-02-01 00:00:00", metrics).metadata
    got = {r.id: (r.used_in_training, r.model_checkpoint, r.average_loss) for r in out.collect()}
    assert got == {1: (True, "ck", 1.5), 2: (True, "ck", None), 3: (False, None, None)}


def test_run_metrics_keep_types_and_fold(spark):
    from pyspark.sql import functions as F

    from corpus_ledger.operators import runs as R

    runs = spark.createDataFrame([(1, "running", '{"loss": 0.5, "n": {"x": 1}, "s": "1"}'), (2, "running", "{}")],
                                 "id long, status string, metrics string")
    updates = spark.createDataFrame([(1, "running", '{"loss": 0.25}', 1), (1, "completed", '{"ok": true}', 2), (2, "failed", None, 1)],
                                    "id long, status string, metrics string, at int")
    out = {r.id: r for r in R.update_run_status(runs, updates, order=["at"]).collect()}
    import json
    assert len(out) == 2 and out[1].status == "completed" and out[2].status == "failed"
    assert json.loads(out[1].metrics) == {"loss": 0.25, "n": {"x": 1}, "s": "1", "ok": True} and out[2].metrics == "{}"


def test_loss_keeps_nan_and_samples_keep_empty_tables(spark):
    import math

    from corpus_ledger.operators import audit as I
    from corpus_ledger.operators import metrics as M

    scores = spark.createDataFrame([(1, [1.0, float("nan"), 2.0], 2), (2, [1.0, 1.0], 1)], "k long, logits array<double>, target int")
    loss = {r.k: r.token_loss for r in M.token_cross_entropy(scores).collect()}
    assert math.isnan(loss[1]) and abs(loss[2] - math.log(2)) < 1e-12
    t = spark.createDataFrame([(1,)], "id long")
    got = {r.table: r.rows for r in I.table_samples({"full": t, "none": t.limit(0)}, {"full": ["id"], "none": ["id"]}).collect()}
    assert got == {"full": 1, "none": 0}
