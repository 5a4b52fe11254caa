"""Clean-and-limit job composed from the change and query operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_ledger.operators import changes as C
from corpus_ledger.operators import queries as Q


@dataclass
class CleanResult:
    before: DataFrame
    after: DataFrame
    metadata: DataFrame
    headers: DataFrame
    tokens: DataFrame
    top: DataFrame


def clean_and_limit(entries: DataFrame, metadata: DataFrame, headers: DataFrame, tokens: DataFrame,
                    top_n: int = 10, order: str = "entry_id") -> CleanResult:
    """Profile -> drop orphans (L15) -> pick top nodes (Q15) -> set used flags (L10) -> profile."""
    before = Q.table_profile(entries, metadata, headers, tokens).withColumn("stage", F.lit("before"))
    hdr, tok, _ = C.clean_orphans(metadata, headers, tokens)
    top = Q.top_nodes(entries, metadata, hdr, top_n=top_n, order=order).select("entry_id")
    meta = C.set_used_flags(metadata, top)
    after = Q.table_profile(entries, meta, hdr, tok).withColumn("stage", F.lit("after"))
    return CleanResult(before, after, meta, hdr, tok, top)


def limit_to_top(entries: DataFrame, metadata: DataFrame, headers: DataFrame, tokens: DataFrame,
                 top_n: int = 10, order: str = "entry_id") -> CleanResult:
    """L16, limiting job: profile -> top nodes (Q15) -> drop all others' training data (L14) -> profile."""
    before = Q.table_profile(entries, metadata, headers, tokens).withColumn("stage", F.lit("before"))
    top = Q.top_nodes(entries, metadata, headers, top_n=top_n, order=order).select("entry_id")
    meta, hdr, tok, _ = C.trim_to_top(metadata, headers, tokens, top)
    after = Q.table_profile(entries, meta, hdr, tok).withColumn("stage", F.lit("after"))
    return CleanResult(before, after, meta, hdr, tok, top)


def mark_top(entries: DataFrame, metadata: DataFrame, headers: DataFrame, tokens: DataFrame,
             top_n: int = 10, order: str = "entry_id") -> CleanResult:
    """L16, marking job: profile -> top nodes (Q15) -> used flags for them alone (L10) -> profile."""
    before = Q.table_profile(entries, metadata, headers, tokens).withColumn("stage", F.lit("before"))
    top = Q.top_nodes(entries, metadata, headers, top_n=top_n, order=order).select("entry_id")
    meta = C.set_used_flags(metadata, top)
    after = Q.table_profile(entries, meta, headers, tokens).withColumn("stage", F.lit("after"))
    return CleanResult(before, after, meta, headers, tokens, top)
