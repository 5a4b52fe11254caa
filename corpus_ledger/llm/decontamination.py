"""Benchmark decontamination through a distributed positional inverted index.

The index is a table partitioned by documents: a segment is a run of documents of about
``SEGMENT_WORDS`` words, and a row (segment, term, postings) lists the positions of one benchmark term in
it. A position counts words through the segment, with a gap between documents, so one integer names the
document and the place, and no match crosses two documents. The rows of a segment meet in one task, where
each benchmark window is found by intersecting the lists of its terms, each shifted by its offset in the
window, from the segment's rarest term on. ``slop`` widens the intersection to a proximity match: every
term may lie up to ``slop`` words from its place.

The benchmark is taken in blocks of about ``BLOCK_WORDS`` words, so what is sent to the tasks is bounded
however large it grows; the documents are then read once per block. A segment is bounded by its words or
by a single text, whichever is larger.

Defined results: null or empty text has no words and no hits; an item without words has no window; rows
that repeat a doc_id or an item_id are searched each for itself, and an item counts once per document;
items without an id count together as one, which no list of ids names; an empty table on either side gives no hits; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_ledger.llm.common import documents, free_name, numbered, stored

WINDOW = 10
SEGMENT_WORDS = 200_000
BLOCK_WORDS = 200_000
HEADER = -1  # the ``term`` of the row that lists a segment's documents

# The separators of the class [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after A-Z are lower-cased.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def fold_words(text: bytes | None) -> list[bytes]:
    """Lower-cased words of ASCII letters, digits and non-ASCII characters."""
    return text.translate(_FOLD).split() if text else []


def item_windows(words: list[bytes], size: int) -> list[tuple[bytes, ...]]:
    """The runs of ``size`` consecutive words; fewer words, but not none, are one window."""
    if not words:
        return []
    return [tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))]


# What tasks need of a block of items, as plain values: the number of each term, the windows as term numbers, and
# the ids of each window's items (null for items without one).
Queries = tuple[dict[bytes, int], list[tuple[int, ...]], list[list[str | None]]]


def _sorted_ids(ids) -> list[str | None]:
    return sorted(ids, key=lambda i: (i is None, i or ""))


def windows_of(items: list[tuple[str | None, bytes]], size: int) -> Queries:
    vocabulary: dict[bytes, int] = {}
    owners: dict[tuple[int, ...], set[str | None]] = {}
    for item, text in items:
        for window in item_windows(fold_words(text), size):
            key = tuple(vocabulary.setdefault(w, len(vocabulary)) for w in window)
            owners.setdefault(key, set()).add(item)
    return vocabulary, list(owners), [_sorted_ids(o) for o in owners.values()]


def _segments(batches: Iterator[pa.RecordBatch], vocabulary: dict[bytes, int], gap: int) -> Iterator[pa.RecordBatch]:
    """Index rows of the documents of one partition, segment by segment."""
    rows: list[int] = []
    ids: list[int | None] = []
    sizes: list[int] = []
    terms: list[np.ndarray] = []
    places: list[np.ndarray] = []
    at = 0
    unknown = -1

    def flush():
        term, place = np.concatenate(terms), np.concatenate(places)
        order = np.argsort(term, kind="stable")
        term, place = term[order], place[order]
        starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.empty(0, np.int64)
        distinct = term[starts]
        n = len(distinct) + 1
        header = [rows, ids, sizes]
        postings = pa.ListArray.from_arrays(pa.array(np.r_[0, 0, starts[1:], len(term)] if len(term) else [0, 0], pa.int32()),
                                            pa.array(place, pa.int64()))
        lists = [pa.array([h] + [None] * (n - 1), pa.list_(pa.int64())) for h in header]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, rows[0]), pa.int64()), pa.array(np.r_[HEADER, distinct], pa.int64()), *lists, postings],
            ["segment", "term", "rows", "ids", "sizes", "postings"])

    for batch in batches:
        for row, doc, text in zip(batch.column("row").to_pylist(), batch.column("id").to_pylist(), batch.column("text").to_pylist()):
            words = fold_words(text)
            known = np.fromiter((vocabulary.get(w, unknown) for w in words), dtype=np.int64, count=len(words))
            place = np.flatnonzero(known >= 0)
            rows.append(row), ids.append(doc), sizes.append(len(words))
            terms.append(known[place]), places.append(place + at)
            at += len(words) + gap
            if at >= SEGMENT_WORDS:
                yield flush()
                rows, ids, sizes, terms, places, at = [], [], [], [], [], 0
    if rows:
        yield flush()


def build_index(docs: DataFrame, vocabulary: dict[bytes, int], gap: int) -> DataFrame:
    """Positional index of the terms of ``vocabulary`` in ``docs`` (row, id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def segments(batches):
        return _segments(batches, shared.value, gap)

    return docs.mapInArrow(segments, "segment long, term long, rows array<long>, ids array<long>, "
                                     "sizes array<long>, postings array<long>")


def _near(places: np.ndarray, wanted: np.ndarray, slop: int) -> np.ndarray:
    """For each wanted position: does ``places`` hold one within ``slop`` of it?"""
    i = np.searchsorted(places, wanted - slop)
    return (i < len(places)) & (places[np.minimum(i, len(places) - 1)] <= wanted + slop)


def window_starts(terms: list[int], lists: dict[int, np.ndarray], slop: int) -> np.ndarray:
    """Positions at which the window starts: shifted lists intersected from the rarest term on."""
    by_rarity = sorted(range(len(terms)), key=lambda j: len(lists[terms[j]]))
    starts = lists[terms[by_rarity[0]]] - by_rarity[0]
    for j in by_rarity[1:]:
        starts = starts[_near(lists[terms[j]], starts + j, slop)]
        if not len(starts):
            break
    return starts


def _matches(segment: pd.DataFrame, queries: Queries, size: int, slop: int) -> pd.DataFrame:
    """One row per document of the segment: its size, the spans hit and the items found."""
    vocabulary, windows, owners = queries
    head = segment[segment["term"] == HEADER].iloc[0]
    sizes = np.asarray(head["sizes"], dtype=np.int64)
    base = np.r_[0, np.cumsum(sizes + size + slop)[:-1]]
    lists = {t: np.asarray(p, dtype=np.int64) for t, p in zip(segment["term"], segment["postings"]) if t != HEADER}
    terms = np.full((len(windows), size), -1, dtype=np.int64)
    lengths = np.fromiter(map(len, windows), dtype=np.int64, count=len(windows))
    terms[np.arange(size) < lengths[:, None]] = np.fromiter((t for w in windows for t in w), dtype=np.int64, count=lengths.sum())
    present = np.zeros(len(vocabulary) + 1, dtype=bool)  # the last one stands for the padding
    present[list(lists)] = True
    present[-1] = True
    spans: dict[int, list[tuple[int, int]]] = {}
    items: dict[int, set[str | None]] = {}
    for w in np.flatnonzero(present[terms].all(axis=1)) if len(windows) else []:
        window = windows[w]
        starts = window_starts(list(window), lists, slop)
        for doc, start in zip(np.searchsorted(base, starts, side="right") - 1, starts):
            doc = max(int(doc), 0)
            first = int(start - base[doc])
            spans.setdefault(doc, []).append((max(first, 0), min(first + len(window), int(sizes[doc]))))
            items.setdefault(doc, set()).update(owners[w])
    n = len(sizes)
    return pd.DataFrame({
        "row": np.asarray(head["rows"], dtype=np.int64),
        "id": pd.array(list(head["ids"]), dtype="Int64"), "n_words": sizes,
        "starts": [[s for s, _ in sorted(spans.get(i, []))] for i in range(n)],
        "ends": [[e for _, e in sorted(spans.get(i, []))] for i in range(n)],
        "items": [_sorted_ids(items.get(i, ())) for i in range(n)]})


MATCHES = "row long, id long, n_words long, starts array<long>, ends array<long>, items array<string>"


def benchmark_blocks(benchmark: DataFrame, item_col: str, text_col: str) -> tuple[DataFrame, int]:
    """The items with a block number, in blocks of about ``BLOCK_WORDS`` words."""
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("binary").alias("text"))
    volume = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_blocks = 1 + volume // (6 * BLOCK_WORDS)  # about six bytes a word
    return items.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(n_blocks))), n_blocks


def block_matches(rows: DataFrame, items: DataFrame, window: int, slop: int) -> DataFrame:
    """Matches of one block of items in all ``rows``: build the index of the block's terms, then search it."""
    context = rows.sparkSession.sparkContext
    texts = [(r["item"], bytes(r["text"] or b"")) for r in items.select("item", "text").collect()]
    queries = windows_of(texts, window)
    shared = context.broadcast(queries)
    index = stored(build_index(rows, queries[0], window + slop), "index")

    def match(segment: pd.DataFrame) -> pd.DataFrame:
        return _matches(segment, shared.value, window, slop)

    return index.groupBy("segment").applyInPandas(match, MATCHES)


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                      item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                      slop: int = 0) -> DataFrame:
    """One row per document row: id, n_words, starts and ends (word spans hit), items (ids found).

    ``slop`` 0 gives exact phrase matches, a larger one proximity matches.
    """
    items, n_blocks = benchmark_blocks(benchmark, item_col, item_text_col)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"),
                       F.col(text_col).cast("binary").alias("text"))
    if n_blocks == 1:
        return block_matches(rows, items, window, slop).drop("row")
    rows, items = stored(rows, "numbered"), stored(items, "items")  # every block sees the same row numbers
    parts = None
    for block in range(n_blocks):
        found = stored(block_matches(rows, items.filter(F.col("block") == block), window, slop), "matches")
        parts = found if parts is None else parts.union(found)
    # A document has one row per block here.
    return (parts.groupBy("row").agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"),
                                     F.flatten(F.collect_list(F.arrays_zip("starts", "ends"))).alias("spans"),
                                     F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
            .select("id", "n_words", F.col("spans.starts").alias("starts"), F.col("spans.ends").alias("ends"), "items"))


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words covered by the spans, and the hash of the item list."""
    for batch in batches:
        hit, sha = [], []
        for n, starts, ends, items in zip(*(batch.column(c).to_pylist() for c in ("n_words", "starts", "ends", "items"))):
            covered = np.zeros(n + 1 if starts else 1, dtype=np.int64)
            if starts:
                np.add.at(covered, starts, 1)
                np.add.at(covered, ends, -1)
            hit.append(int((np.cumsum(covered) > 0).sum()))
            sha.append(hashlib.sha256(",".join(i for i in items if i is not None).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_words"), pa.array(hit, pa.int64()),
                                          pa.array([len(x) for x in batch.column("items").to_pylist()], pa.int64()),
                                          pa.array(sha, pa.string())], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs; each row is judged by its own text, whatever its id."""
    row = free_name(docs, "_row")
    rows = numbered(docs, row)
    hit = benchmark_matches(rows, benchmark, row, text_col).filter(F.size("items") > 0)
    gone = stored(hit.select(F.col("id").alias(row)), "contaminated")
    return rows.join(gone, row, "left_anti").select(*docs.columns)


def op8_decontamination(spark, sf_dir: str) -> DataFrame:
    found = benchmark_matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    out = found.mapInArrow(_digest, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string")
    return out.withColumn("contaminated", F.col("n_hit") > 0)
