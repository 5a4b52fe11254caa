"""Physical-plan properties the scale design relies on, and correctness with one very hot key."""

import datetime as dt
import random

from pyspark.sql import functions as F

from corpus_ledger.operators import changes as C
from corpus_ledger.operators import queries as Q
from corpus_ledger.sources.schemas import ENTRIES, TRAINING_METADATA
from test_changes import python_fold, to_df

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_upsert_fold_aggregates_before_the_shuffle(spark):
    from corpus_ledger.sources import fixtures as fx

    f = C.normalise_feed(fx.feed(spark, SF))
    o = F.struct("ts", "event_id")
    agg = f.groupBy("page_id").agg(F.min_by(F.struct("title", "revision_id"), o).alias("first"),
                                   F.max_by("revision_id", F.when(F.col("action") == "updated", o)).alias("upd"))
    p = plan(agg)
    # A partial aggregate runs below the exchange: a hot page leaves each task as one row.
    assert p.index("Exchange hashpartitioning(page_id") < p.rindex("partial_")


def test_top_k_per_page_is_limited_before_the_shuffle(spark):
    from corpus_ledger.sources import fixtures as fx

    p = plan(C.log_revisions(fx.feed(spark, SF), keep=5))
    assert "WindowGroupLimit" in p and "Partial" in p
    assert p.index("Exchange") < p.rindex("Partial")


def test_date_filter_reaches_the_scan(spark):
    from corpus_ledger.sources import fixtures as fx

    p = plan(Q.filter_by_date(fx.feed(spark, SF), "2024-01-05", "2024-01-12"))
    scan = [line for line in p.splitlines() if "FileScan parquet" in line][0]
    assert "PushedFilters: [" in scan and "GreaterThanOrEqual(ts" in scan and "LessThan(ts" in scan


def test_projection_prunes_the_scan(spark):
    from corpus_ledger.sources import fixtures as fx

    p = plan(Q.group_by_action(fx.feed(spark, SF)))
    scan = [line for line in p.splitlines() if "FileScan parquet" in line][0]
    assert "ReadSchema: struct<event_type:string>" in scan


def test_upsert_with_a_page_holding_a_third_of_the_feed(spark):
    rnd = random.Random(11)
    t0 = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(900):
        page = "hot" if i % 3 == 0 else f"p{rnd.randrange(40)}"
        rows.append(dict(event_id=i, page_id=page, title=f"t{i}", revision_id=f"r{i}",
                         ts=t0 + dt.timedelta(seconds=rnd.randrange(10 ** 6)), content=f"c{i}",
                         action=rnd.choice(["added", "updated", "removed"])))
    v = C.upsert_pages(C.empty_like(spark, ENTRIES), C.empty_like(spark, TRAINING_METADATA), to_df(spark, rows))
    got = {r.page_id: (r.id, r.revision_id, r.ts, r.action) for r in v.entries.collect()}
    want = {p: (w["id"], w["revision_id"], w["ts"], w["action"]) for p, w in python_fold(rows).items()}
    assert got == want
    revs = C.log_revisions(to_df(spark, rows), keep=5).filter(F.col("parent_id") == "hot").collect()
    hot = sorted((r for r in rows if r["page_id"] == "hot"), key=lambda r: (r["ts"], r["revision_id"]), reverse=True)
    assert [r.revision_id for r in sorted(revs, key=lambda r: r.revision_number)] == [h["revision_id"] for h in hot[:5]]
