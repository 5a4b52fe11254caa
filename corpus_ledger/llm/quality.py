"""Quality classifier: random Fourier features over document statistics, ridge scores, isotonic calibration.

Each text becomes ``len(STATISTICS)`` numbers (lengths, character classes, repetition of words and lines).
They are standardised by their mean and spread over the sample, and mapped to ``FEATURES`` random cosines whose inner
products approximate a Gaussian kernel. Ridge regression on the labels needs only Z'Z and Z'y: every task
sums its own, and Spark adds the sums row by row. Raw scores are then calibrated: the fold's scores are
counted into bins, and pooling adjacent violators over the bins gives a rising step function. The ridge
is fitted on one part of the sample and calibrated on the other.

Defined results: null and empty text have all statistics 0 and are scored like any other; null and repeated
doc_ids are scored row by row; without labelled rows, or with one class only, every score is that class's
share (0 without any); an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_ledger.llm.common import documents, stored
from corpus_ledger.llm.toxicity import held_out, labelled_sample

SAMPLE_ROWS = 20_000  # documented bound: labelled documents used to learn
FEATURES = 256
RIDGE = 1e-3
BINS = 200
SEED = 5

STATISTICS = ("chars", "words", "lines", "word_length", "line_words", "upper", "digits", "spaces", "symbols", "stops",
              "distinct_words", "top_word", "repeated_pairs", "repeated_lines", "short_lines", "symbol_words",
              "upper_words", "marked_ends", "longest_word", "entropy")
_DIGIT_OR_SYMBOL = re.compile(rb"[!#$%&*+/<=>@\\^_`{|}~]")


def statistics(text: bytes | None) -> list[float]:
    """The numbers of ``STATISTICS`` for a UTF-8 text."""
    if not text:
        return [0.0] * len(STATISTICS)
    size = len(text)
    codes = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    upper, digits, spaces = codes[65:91].sum(), codes[48:58].sum(), codes[[9, 10, 11, 12, 13, 32]].sum()
    symbols = codes[list(b"!#$%&*+/<=>@\\^_`{|}~")].sum()
    stops = codes[list(b".,;:?'\"-()")].sum()
    share = codes[codes > 0] / size
    words, lines = text.split(), text.split(b"\n")
    n = max(1, len(words))
    counts = Counter(words)
    pairs = len(set(zip(words, words[1:])))
    line_counts = Counter(lines)
    marked = sum(bool(_DIGIT_OR_SYMBOL.search(w)) for w in counts)
    return [np.log1p(size), np.log1p(len(words)), np.log1p(len(lines)), size / n, np.log1p(len(words) / len(lines)),
            upper / size, digits / size, spaces / size, symbols / size, stops / size, len(counts) / n,
            max(counts.values(), default=0) / n, 1 - pairs / max(1, len(words) - 1), 1 - len(line_counts) / len(lines),
            sum(len(line) < 20 for line in lines) / len(lines), marked / max(1, len(counts)),
            sum(w.isupper() for w in words) / n, sum(line.rstrip().endswith((b".", b"!", b"?")) for line in lines) / len(lines),
            np.log1p(max(map(len, words), default=0)), float(-(share * np.log2(share)).sum())]


def random_features(x: np.ndarray, mean: np.ndarray, spread: np.ndarray, n: int = FEATURES, seed: int = SEED) -> np.ndarray:
    """cos(w x + b) with Gaussian w: inner products approximate exp(-|x - y|^2 / (2 d)); the last column is 1."""
    rng = np.random.default_rng(seed)
    w, b = rng.normal(size=(len(mean), n)) / np.sqrt(len(mean)), rng.uniform(0, 2 * np.pi, n)
    z = np.sqrt(2 / n) * np.cos(np.clip((x - mean) / spread, -8, 8) @ w + b)
    return np.c_[z, np.ones(len(x))]


def measured(sample: DataFrame) -> DataFrame:
    """x (statistics), label, half of the sampled documents."""
    def measure(batches):
        for batch in batches:
            x = [statistics(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column("label"), batch.column("half")],
                                             ["x", "label", "half"])

    return (sample.select(F.col("text").cast("binary").alias("text"), "label", "half")
            .mapInArrow(measure, "x array<double>, label int, half int"))


def normal_equations(rows: DataFrame, mean: np.ndarray, spread: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Z'Z and Z'y summed per task, then per matrix row; their size does not depend on the data."""
    def partial(batches):
        total = np.zeros((FEATURES + 1, FEATURES + 2))
        for batch in batches:
            if batch.num_rows:
                z = random_features(np.array(batch.column("x").to_pylist()), mean, spread)
                y = np.array(batch.column("label").to_pylist(), dtype=float)
                total += z.T @ np.c_[z, y]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))],
                                         ["i", "sums"])

    added = [F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(FEATURES + 2)]
    sums = rows.select("x", "label").mapInArrow(partial, "i int, sums array<double>").groupBy("i").agg(F.array(*added).alias("sums"))
    total = np.array([r["sums"] for r in sums.orderBy("i").collect()])
    return total[:, :-1], total[:, -1]


def isotonic(positions: np.ndarray, weights: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the rising step values closest to the bins' means."""
    blocks: list[list[float]] = []  # weight, sum, bins
    for w, s in zip(weights, sums):
        blocks.append([w, s, 1])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][0] >= blocks[-1][1] * blocks[-2][0]:
            w2, s2, n2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + w2, blocks[-1][1] + s2, blocks[-1][2] + n2]
    return np.concatenate([np.full(int(n), s / w) for w, s, n in blocks]) if blocks else np.empty(0)


class Model:
    """Standardisation, ridge weights and calibration of a fitted classifier."""

    def __init__(self, mean, spread, weights, edges, levels):
        self.mean, self.spread, self.weights, self.edges, self.levels = mean, spread, weights, edges, levels

    def raw(self, x: np.ndarray) -> np.ndarray:
        return random_features(x, self.mean, self.spread) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """The calibrated level at the raw score, linear between bins, with a trace of the raw order kept."""
        raw = self.raw(x)
        level = np.interp(raw, self.edges, self.levels)
        return np.clip(0.999 * level + 0.001 * np.clip(raw, 0, 1), 0, 1)


def fit(sample: DataFrame) -> tuple[Model | None, float]:
    """(model, share of label 1) from a sample (text, label, half)."""
    rows = stored(measured(sample), "statistics")
    n, positive = rows.agg(F.count(F.lit(1)), F.sum(F.when(F.col("label") == 1, 1).otherwise(0))).first()
    share = (positive or 0) / max(1, n)
    if not n or share in (0.0, 1.0):
        return None, share
    moments = rows.agg(*[f(F.col("x")[i]) for i in range(len(STATISTICS)) for f in (F.avg, F.stddev_pop)]).first()
    mean, spread = np.array(moments[0::2], dtype=float), np.maximum(np.array(moments[1::2], dtype=float), 1e-9)
    fitted_on = rows.filter("half = 0") if rows.filter("half = 0").agg(F.countDistinct("label")).first()[0] == 2 else rows
    zz, zy = normal_equations(fitted_on, mean, spread)
    weights = np.linalg.solve(zz + RIDGE * max(1.0, zz[-1, -1] / 1000) * np.eye(len(zz)), zy)
    model = Model(mean, spread, weights, None, None)

    def raw(batches):
        for batch in batches:
            x = np.array(batch.column("x").to_pylist()).reshape(-1, len(STATISTICS))
            yield pa.RecordBatch.from_arrays([pa.array(model.raw(x)), batch.column("label")], ["raw", "label"])

    held = rows.filter("half = 1") if rows.filter("half = 1").limit(1).count() else rows
    binned = (held.select("x", "label").mapInArrow(raw, "raw double, label int")
              .groupBy(F.floor(F.least(F.greatest(F.col("raw"), F.lit(-0.5)), F.lit(1.5)) * BINS).alias("bin"))
              .agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("ones")).orderBy("bin").collect())
    at = np.array([(r["bin"] + 0.5) / BINS for r in binned])
    model.edges = at
    model.levels = isotonic(at, np.array([float(r["n"]) for r in binned]), np.array([float(r["ones"]) for r in binned]))
    return model, share


def score(docs: DataFrame, model: Model | None, share: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: id, score."""
    def scored(batches):
        for batch in batches:
            texts = batch.column("text").to_pylist()
            x = np.array([statistics(t) for t in texts]).reshape(-1, len(STATISTICS))
            values = np.full(len(texts), share) if model is None else model.score(x)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(values, pa.float64())], ["id", "score"])

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    return slim.mapInArrow(scored, "id long, score double")


def op2_rff_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    sample = labelled_sample(docs, labels, "quality", ~held_out(F.col("doc_id"), 3, 1), SAMPLE_ROWS)
    found = score(docs, *fit(sample))
    return found.select(F.col("id").alias("doc_id"), held_out(F.col("id"), 3, 1).alias("held_out"), "score",
                        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
