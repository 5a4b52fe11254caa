"""Incremental ingest of page snapshots: check -> label -> store text -> upsert -> log revisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_ledger.operators import changes as C
from corpus_ledger.sources import io as IO


def ingest_batch(version: C.LedgerVersion, snapshot: DataFrame, revisions: DataFrame | None = None,
                 text_path: str | None = None, keep_revisions: int = 5) -> C.LedgerVersion:
    """Apply one batch of page snapshots (page_id, title, revision_id, ts, content, event_id).

    Pages that are new or whose latest stored revision differs are labelled added/updated (L6, L7),
    their text is stored under ``text_path`` (S6), they are upserted (L1), and the latest
    ``keep_revisions`` rows of ``revisions`` (page_id, title, revision_id, ts, content) of those pages
    become revision entries ``<page>_<rev>`` (L3), upserted like any page (existing ones stay).
    """
    flagged = C.needs_update(version.entries, snapshot)
    todo = flagged.filter("needs_update").drop("needs_update", "stored_revision_id")
    labelled = C.label_changes(version.entries, todo)
    if text_path is not None:
        IO.write_page_texts(labelled, text_path, "page_id", None, "content")
    v = C.upsert_pages(version.entries, version.metadata, labelled)
    if revisions is None:
        return v
    changed = revisions.join(todo.select("page_id"), "page_id", "left_semi")
    rev_entries = C.log_revisions(changed, keep_revisions).withColumn("event_id", F.lit(0).cast("long"))
    return C.upsert_pages(v.entries, v.metadata, rev_entries)
