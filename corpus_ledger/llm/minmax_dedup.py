"""Near-duplicate detection by min-max hashing.

Each hash function is evaluated once per shingle and gives two signature values, its minimum and its
maximum, so a signature of 2K values costs K evaluations. Bands of ``rows`` values put documents into
buckets; every bucket's candidates are confirmed on the full shingle sets.

Work stays linear in a bucket's size: documents with equal shingle sets are merged first; in a bucket all
members are compared with its smallest id and its hub; then, only in buckets that still hold more than one
component, the members outside the largest component are compared with those of other components that an
exact prefix filter leaves. Pairs inside one component cannot change the result.

Miss rate: a pair of similarity 0.8 shares none of 40 bands of 5 values with probability 1.2e-7.

Defined results: null, empty or blank text has an empty set and is linked with nothing; rows that repeat
an id are judged each by its own text; a null id stays unlinked and kept, while ``deduplicate`` judges every row by
its text, whatever its id; an empty table gives an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpus_ledger.llm.common import WordHashes, ascii_lower_words, components, documents, free_name, mix, numbered, shingle_set, stored

BANDS, ROWS, SEED = 40, 5, 17
SIGN_CHUNK = 16_384  # shingles hashed at a time: bounds memory for very long texts


def _signatures(batches: Iterator[pa.RecordBatch], k: int, bands: int, rows: int, seed: int) -> Iterator[pa.RecordBatch]:
    rng = np.random.default_rng(seed)
    n_hash = bands // 2 * rows
    mult = (rng.integers(0, 2**63, n_hash, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[:, None]
    add = rng.integers(0, 2**64 - 1, n_hash, dtype=np.uint64)[:, None]
    band_no = np.arange(bands, dtype=np.uint64)
    hashes = WordHashes()
    for batch in batches:
        n, h1, h2, flat, ends = [], [], [], [], [0]
        for text in batch.column("text").to_pylist():
            shingles = shingle_set(ascii_lower_words(text), k, hashes)
            n.append(len(shingles))
            if not len(shingles):
                h1.append(None), h2.append(None), ends.append(ends[-1])
                continue
            digest = xxhash.xxh3_128_intdigest(shingles.tobytes())
            h1.append((digest >> 64) - 2**63), h2.append((digest & (2**64 - 1)) - 2**63)
            low, high = np.full(n_hash, 2**64 - 1, dtype=np.uint64), np.zeros(n_hash, dtype=np.uint64)
            for at in range(0, len(shingles), SIGN_CHUNK):
                values = shingles[at:at + SIGN_CHUNK][None, :] * mult + add
                low, high = np.minimum(low, values.min(axis=1)), np.maximum(high, values.max(axis=1))
            signature = np.concatenate([low, high]).reshape(bands, rows)
            keys = band_no
            for r in range(rows):
                keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + signature[:, r])
            flat.append(keys.view(np.int64)), ends.append(ends[-1] + bands)
        keys = pa.ListArray.from_arrays(pa.array(ends, pa.int32()),
                                        pa.array(np.concatenate(flat) if flat else np.empty(0, np.int64)))
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n, pa.int64()), pa.array(h1, pa.int64()),
                                          pa.array(h2, pa.int64()), keys], ["id", "n", "h1", "h2", "keys"])


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle_words: int,
               bands: int = BANDS, rows: int = ROWS, seed: int = SEED) -> DataFrame:
    """One row per document: id, n (size of its shingle set), h1, h2 (128-bit hash of the set), keys (band keys)."""
    def sign(batches):
        return _signatures(batches, shingle_words, bands, rows, seed)

    return (docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
            .mapInArrow(sign, "id long, n long, h1 long, h2 long, keys array<long>"))


def _compare(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    last, left = None, None
    for batch in batches:
        shared, either = [], []
        for a, ta, tb in zip(batch.column("a").to_pylist(), batch.column("ta").to_pylist(), batch.column("tb").to_pylist()):
            if a != last:
                last, left = a, shingle_set(ascii_lower_words(ta), k, hashes)
            right = shingle_set(ascii_lower_words(tb), k, hashes)
            both = len(np.intersect1d(left, right, assume_unique=True))
            shared.append(both), either.append(len(left) + len(right) - both)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(shared, pa.int64()),
                                          pa.array(either, pa.int64())], ["a", "b", "shared", "either"])


def compare(pairs: DataFrame, texts: DataFrame, shingle_words: int) -> DataFrame:
    """a, b, shared, either: the sizes of the intersection and the union of the pairs' full shingle sets."""
    def check(batches):
        return _compare(batches, shingle_words)

    joined = (pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
              .join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
              .select("a", "b", "ta", "tb"))
    return joined.mapInArrow(check, "a long, b long, shared long, either long")


def _ordered_pairs(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.filter(F.col(x) != F.col(y)).select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()


def _shingle_rows(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        for rep, text in zip(batch.column("rep").to_pylist(), batch.column("text").to_pylist()):
            shingles = shingle_set(ascii_lower_words(text), k, hashes)
            n = np.full(len(shingles), len(shingles))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(shingles), rep), pa.int64()), pa.array(n, pa.int64()),
                                              pa.array(shingles.view(np.int64))], ["rep", "n", "shingle"])


def outside_pairs(pool: DataFrame, texts: DataFrame, shingle_words: int, percent: int) -> DataFrame:
    """Pairs (a, b) of ``pool`` (rep, component, outside) that may be linked, one of them outside its buckets'
    largest component, and in different components.

    Exact prefix and positional filter: shingles are ordered by rarity in the pool; two linked sets share one
    among the first n - ceil(percent n) + 1 of each, and where the first shared one stands bounds their overlap.
    """
    def rows(batches):
        return _shingle_rows(batches, shingle_words)

    shingles = stored(texts.join(pool.select(F.col("rep").alias("id")), "id", "left_semi").dropDuplicates(["id"])
                      .select(F.col("id").alias("rep"), "text").mapInArrow(rows, "rep long, n long, shingle long"), "shingles")
    rarity = shingles.groupBy("shingle").agg(F.count(F.lit(1)).alias("df"))
    order = Window.partitionBy("rep").orderBy("df", "shingle")  # one text's shingles
    ranked = shingles.join(rarity, "shingle").withColumn("at", F.row_number().over(order))
    prefix = (ranked.filter(F.col("at") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).filter("df > 1")
              .join(pool, "rep").select("rep", "n", "shingle", "at", "component", "outside"))
    prefix = stored(prefix, "prefix")
    x = prefix.filter("outside").select(*[F.col(c).alias(f"x_{c}") for c in prefix.columns])
    overlap = F.least(F.col("n") - F.col("at"), F.col("x_n") - F.col("x_at")) + 1
    may = (100 + percent) * overlap >= percent * (F.col("n") + F.col("x_n"))
    pairs = x.join(prefix, (F.col("x_shingle") == F.col("shingle")) & (F.col("x_component") != F.col("component")) & may)
    return _ordered_pairs(pairs, "rep", "x_rep")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5,
                    percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per input row: id, n_shingles, component_id (smallest linked id), kept."""
    signed = stored(signatures(docs, id_col, text_col, shingle_words, bands, rows), "signatures")
    # One representative per distinct set: exact copies (a third of all rows, say) leave here.
    reps = stored(signed.filter((F.col("n") > 0) & F.col("id").isNotNull()).groupBy("h1", "h2")
                  .agg(F.min("id").alias("rep"), F.any_value("keys").alias("keys")), "reps")
    buckets = reps.select("rep", F.explode("keys").alias("key"))
    sizes = buckets.groupBy("key").agg(F.min("rep").alias("lo"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    members = stored(buckets.join(sizes, "key"), "members")
    # The hub of a bucket is the member that meets the most documents over all its buckets: the original of
    # a family of edited copies, to which copies are linked that are not linked with each other.
    meets = members.groupBy("rep").agg(F.sum("size").alias("meets"))
    met = members.join(meets, "rep")
    hubs = met.groupBy("key").agg(F.max_by("rep", F.struct("meets", "rep")).alias("hub"))
    members = stored(met.join(hubs, "key").select("key", "rep", "lo", "hub", "size"), "members")
    first = stored(_ordered_pairs(members.select("rep", F.explode(F.array("lo", "hub")).alias("end")), "rep", "end"),
                   "pairs")
    # All candidate pairs lie within ``members``, so their texts are fetched once.
    wanted = members.select(F.col("rep").alias("id")).distinct()
    texts = stored(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
                   .join(wanted, "id", "left_semi"), "texts")
    compared = stored(compare(first, texts, shingle_words), "compared")
    linked_by = (F.col("shared") * 100 >= percent * F.col("either"))
    links = compared.filter(linked_by).select("a", "b")

    # Buckets of two have had their pair compared. In one of three whose hub is the smallest id, the other two
    # have not been compared with each other.
    found = components(links)
    large = members.filter("size > 2").select("key", "rep")
    placed = stored(large.join(found, F.col("rep") == F.col("node"), "left")
                    .select("key", "rep", F.coalesce("component", "rep").alias("component")), "placed")
    main = (placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("size"))
            .groupBy("key").agg(F.max_by("component", F.struct("size", "component")).alias("main"),
                                F.count(F.lit(1)).alias("parts")).filter("parts > 1").drop("parts"))
    pool = stored(placed.join(main, "key").groupBy("rep").agg(
        F.min("component").alias("component"), F.max(F.col("component") != F.col("main")).alias("outside")), "pool")
    rest = outside_pairs(pool, texts, shingle_words, percent)
    rest = stored(rest.join(first, ["a", "b"], "left_anti"), "pairs")
    if not rest.isEmpty():
        links = links.union(stored(compare(rest, texts, shingle_words).filter(linked_by).select("a", "b"), "links"))
        found = components(links)

    linked = (reps.select("h1", "h2", "rep").join(found, F.col("rep") == F.col("node"), "left")
              .select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"),
                      F.coalesce("component", "rep").alias("component")))
    rows_ = signed.select("id", "n", "h1", "h2")
    out = rows_.join(linked, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"),
                      F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, text_col: str = "text", shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` of which no earlier row, in the order they are stored, is linked with them."""
    row = free_name(docs, "_row")
    rows = numbered(docs, row)
    gone = (near_duplicates(rows, row, text_col, shingle_words, percent).filter(~F.col("kept"))
            .select(F.col("id").alias(row)))
    return rows.join(stored(gone, "removed"), row, "left_anti").select(*docs.columns)


def op6_minmax_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(documents(spark, sf_dir), shingle_words=2, percent=80)
    return found.withColumnRenamed("id", "doc_id")
