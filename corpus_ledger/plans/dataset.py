"""Dataset assembly (M1-M4 with T10): eligible pages -> split -> token sequences -> batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_ledger.operators import metrics as M
from corpus_ledger.operators import tokens as TK


def page_sequences(pages: DataFrame, texts: DataFrame, vocab: DataFrame, merges: DataFrame | None = None,
                   max_length: int = 1024, dropout: float = 0.0, seed: int = 0) -> DataFrame:
    """M3: token ids of each page's text truncated to ``max_length``; a page without text gets [0]. With
    ``dropout`` merges are skipped by chance (T8); the draws hang on ``seed`` and the page, not on the task."""
    j = pages.select("page_id").join(texts.select("page_id", "text"), "page_id", "left")
    t = TK.pre_tokens(j)
    key = "page_id"
    if merges is not None and dropout > 0:
        t = TK.apply_merges_dropout(t, merges, key, dropout, seed, "tokens", "tokens")
    elif merges is not None:
        t = TK.apply_merges(t, merges, "tokens", "tokens")
    enc = TK.encode(t, key, "tokens", vocab, max_length=max_length + 1, add_eos=False)
    return enc.withColumn("input_ids", F.when(F.col("text").isNull(), F.array(F.lit(0).cast("long")))
                          .otherwise(F.col("input_ids"))).select("page_id", "input_ids")


def training_batches(entries: DataFrame, metadata: DataFrame, texts: DataFrame, vocab: DataFrame,
                     merges: DataFrame | None = None, val_split: float = 0.1, batch_size: int = 4,
                     max_length: int = 1024, min_pages: int = 100, seed: int = 42, dropout: float = 0.0,
                     epoch: int = 0) -> DataFrame:
    """M1 -> M2 -> M3 -> M4 -> T14: padded training batches with attention masks. The batch of a page follows from
    its place in the split; with ``dropout`` each ``epoch`` draws other pieces of the same texts."""
    pages = M.eligible_pages(entries, metadata, texts, min_pages)
    split = M.split_train_val(pages.select("page_id"), val_split, seed)
    batches = M.number_batches(split, batch_size)
    seqs = page_sequences(batches.select("page_id"), texts, vocab, merges, max_length, dropout, seed + epoch)
    return TK.pad_batches(batches.join(seqs, "page_id"), "batch")
