"""Token counts of a unigram tokenizer by dynamic programming shared along a trie.

A text is cut into pre-tokens (its words, each behind the space mark); the token count of a pre-token is
that of its best-scored split into vocabulary pieces. The distinct pre-tokens of a batch form a trie: sorted,
each one follows the path it shares with the one before, so the forward scores of a shared prefix are
computed once, and only the counts at terminal nodes are stored. A character in no piece costs one token
per UTF-8 byte. Batches are independent: nothing is shuffled, and a task holds one batch's pre-tokens and a
bounded cache.

Scores: the vocabulary file lists pieces by merge rank without unigram probabilities, so the piece of rank i
gets ln(1 / (i + 1)), Zipf's law. Equal scores are settled by fewer tokens.

Defined results: null, empty and blank texts have no tokens; null and repeated doc_ids are counted row by
row; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_ledger.llm.common import documents

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
CACHED = 400_000
BYTE_SCORE = -20.0  # each byte of an unknown character; below every piece's score


def read_vocabulary(path: str = VOCABULARY) -> dict[str, float]:
    """Piece -> score from a sentencepiece model file; control, unknown and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [model.id_to_piece(i) for i in range(model.vocab_size())
              if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    return {piece: -math.log(rank + 1) for rank, piece in enumerate(pieces)}


class PrefixScores:
    """Best (score, tokens) of every prefix on the current trie path; a new word keeps the shared part."""

    def __init__(self, vocabulary: dict[str, float]):
        self.vocabulary = vocabulary
        self.longest = max(map(len, vocabulary), default=1)
        self.word = ""
        self.best: list[tuple[float, int]] = [(0.0, 0)]
        self.steps = 0  # prefixes computed, for measuring how much is shared

    def count(self, word: str) -> int:
        shared, limit = 0, min(len(word), len(self.word))
        while shared < limit and word[shared] == self.word[shared]:
            shared += 1
        best, get = self.best, self.vocabulary.get
        del best[shared + 1:]
        for end in range(shared + 1, len(word) + 1):
            score, tokens = best[end - 1]
            letter = get(word[end - 1])
            if letter is None:
                size = len(word[end - 1].encode("utf-8", "surrogatepass"))
                top, fewest = score + size * BYTE_SCORE, tokens + size
            else:
                top, fewest = score + letter, tokens + 1
            for start in range(max(0, end - self.longest), end - 1):
                piece = get(word[start:end])
                if piece is not None:
                    score = best[start][0] + piece
                    if score > top or score == top and best[start][1] + 1 < fewest:
                        top, fewest = score, best[start][1] + 1
            best.append((top, fewest))
        self.steps += len(word) - shared
        self.word = word
        return best[-1][1]


def count_batch(texts: list[bytes | None], scores: PrefixScores, cache: dict[bytes, int]) -> list[tuple[int, int, int]]:
    """(tokens, pre-tokens, most tokens of one pre-token) of each text."""
    split = [text.split() if text else [] for text in texts]
    if len(cache) > CACHED:
        cache.clear()
    new = {w for words in split for w in words if w not in cache}
    # Sorted: every prefix is entered once, as when walking the trie depth first.
    for mark, word in sorted((SPACE + w.decode("utf-8", "replace"), w) for w in new):
        cache[word] = scores.count(mark)
    out = []
    for words in split:
        counts = [cache[w] for w in words]
        out.append((sum(counts), len(counts), max(counts, default=0)))
    return out


def token_counts(docs: DataFrame, vocabulary: dict[str, float], id_col: str = "doc_id", text_col: str = "text",
                 chunk_bytes: int = 4_000_000) -> DataFrame:
    """One row per document row: id, n_tokens, n_words, most_tokens (of one pre-token)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # one fixed vocabulary file

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, cache = PrefixScores(shared.value), {}
        for batch in batches:
            rows, part, size = [], [], 0
            for text in batch.column("text").to_pylist():
                part.append(text)
                size += len(text or b"")
                if size >= chunk_bytes:
                    rows += count_batch(part, scores, cache)
                    part, size = [], 0
            rows += count_batch(part, scores, cache)
            columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *columns], ["id", "n_tokens", "n_words", "most_tokens"])

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return slim.mapInArrow(count, "id long, n_tokens long, n_words long, most_tokens long")


def op10_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), read_vocabulary()).withColumnRenamed("id", "doc_id")
