"""Corpus tokenizer job: main pages -> their text -> vocabulary and merges."""

from __future__ import annotations

from pyspark.sql import DataFrame

from corpus_ledger.operators import queries as Q
from corpus_ledger.operators import tokens as TK


def corpus_tokenizer(entries: DataFrame, metadata: DataFrame, texts: DataFrame, vocab_size: int = 10000,
                     min_frequency: int = 2, num_merges: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Train on the text of the ledger's main pages; pages without text are skipped."""
    pages = Q.main_pages(entries, metadata).select("page_id")
    corpus = texts.join(pages, "page_id", "left_semi")
    return TK.train_tokenizer(corpus, vocab_size, min_frequency, num_merges)
