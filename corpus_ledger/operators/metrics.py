"""Dataset assembly, losses and token impact.

Per-sequence math stays inside one row with higher-order array functions (a sequence is bounded by
the model's max length); per-page and per-batch statistics are partial aggregations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpus_ledger.operators.queries import unused_pages

from corpus_ledger.functions.text import PAD_ID  # noqa: E402

# The reference's logit clamp, context window and significance quantile.
LOGIT_CLAMP = 10.0
CONTEXT_WINDOW = 2
SIGNIFICANCE_QUANTILE = 0.95
# Pages whose state (six numbers each) is broadcast in ``threshold_rows``.
STATE_PAGES = 100_000


# --------------------------------------------------------------------------- M1, M2, M4
def eligible_pages(entries: DataFrame, metadata: DataFrame, texts: DataFrame, min_pages: int | None = None) -> DataFrame:
    """M1: unused pages whose text is available; fails when fewer than ``min_pages``."""
    pages = unused_pages(entries, metadata).join(texts.select("page_id"), "page_id", "left_semi")
    if min_pages is not None:
        n = pages.count()
        if n < min_pages:
            raise ValueError(f"only {n} eligible pages, at least {min_pages} needed")
    return pages


# Leading hex digits of the hash that make a bucket: 65,536 buckets of equal expectation.
BUCKET_DIGITS = 4


def _hashed(pages: DataFrame, seed: int, key: str) -> tuple[DataFrame, dict[str, int]]:
    """``pages`` with the hash that orders them (_h) and its bucket (_b), and the rows of each bucket."""
    h = pages.withColumn("_h", F.sha2(F.concat(F.col(key).cast("string"), F.lit(str(seed))), 256)) \
        .withColumn("_b", F.substring("_h", 1, BUCKET_DIGITS))
    return h, {r["_b"]: r["n"] for r in h.groupBy("_b").agg(F.count(F.lit(1)).alias("n")).collect()}


def split_train_val(pages: DataFrame, val_split: float = 0.1, seed: int = 42, key: str = "page_id") -> DataFrame:
    """M2: random split with exact sizes: rank by sha2(key || seed), the first int(n * (1 - v)) train.

    The hash is uniform, so its leading digits cut the pages into even buckets without a sort: the rank is the
    rows of the buckets before plus the place in the bucket. One count per bucket (at most 65,536) reaches the
    driver and goes back as offsets.
    """
    h, counts = _hashed(pages, seed, key)
    offsets, total = [], 0
    for bucket in sorted(counts):
        offsets.append((bucket, total))
        total += counts[bucket]
    n_train = int(total * (1 - val_split))
    starts = F.broadcast(pages.sparkSession.createDataFrame(offsets, "_b string, _start long"))
    place = F.row_number().over(Window.partitionBy("_b").orderBy("_h", key))
    return (h.join(starts, "_b").withColumn("split_rank", (F.col("_start") + place).cast("long"))
            .withColumn("split", F.when(F.col("split_rank") <= n_train, "train").otherwise("val"))
            .drop("_h", "_b", "_start"))


def split_select(pages: DataFrame, val_split: float = 0.1, seed: int = 42, key: str = "page_id") -> DataFrame:
    """M2 without ranks, and without moving a page: the hash at which training ends is found by counting, first
    over all buckets, then inside the one that holds it; each row is then compared with it."""
    h, counts = _hashed(pages, seed, key)
    wanted = int(sum(counts.values()) * (1 - val_split))
    digits = BUCKET_DIGITS
    inside = h
    while True:
        bucket = None
        for b in sorted(counts):
            if wanted <= counts[b]:
                bucket = b
                break
            wanted -= counts[b]
        if bucket is None or wanted == 0 or counts[bucket] <= 1000 or digits == 64:
            break
        inside = inside.filter(F.col("_h").startswith(bucket))
        digits += BUCKET_DIGITS
        counts = {r["b"]: r["n"] for r in inside.groupBy(F.substring("_h", 1, digits).alias("b"))
                  .agg(F.count(F.lit(1)).alias("n")).collect()}
    if wanted == 0:  # training ends where this bucket, or the first one, begins
        last = None if bucket is None else (bucket, "")
        train = F.lit(False) if last is None else F.col("_h") < F.lit(bucket)
    elif bucket is None:
        train = F.lit(True)
    else:  # at most 1000 rows, or equal hashes, which only equal keys have
        rows = inside.filter(F.col("_h").startswith(bucket)).select("_h", key).orderBy("_h", key).limit(wanted).tail(1)
        at, name = rows[0]["_h"], rows[0][key]
        train = (F.col("_h") < at) | ((F.col("_h") == at) & (F.col(key) <= F.lit(name)))
    return h.withColumn("split", F.when(train, "train").otherwise("val")).drop("_h", "_b")


def split_by_hash(pages: DataFrame, val_split: float = 0.1, seed: int = 42, key: str = "page_id",
                  buckets: int = 10000) -> DataFrame:
    """M2, scalable variant: a page is in validation when its hash bucket falls below ``val_split``
    (no global rank, sizes only approximately exact)."""
    b = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(seed)), F.lit(buckets))
    return pages.withColumn("split", F.when(b < int(buckets * val_split), "val").otherwise("train"))


def number_batches(split: DataFrame, batch_size: int = 4) -> DataFrame:
    """M4: batch number of each training page: floor((rank - 1) / B) in split order."""
    train = split.filter(F.col("split") == "train")
    return train.withColumn("batch", F.floor((F.col("split_rank") - 1) / batch_size).cast("long"))


# --------------------------------------------------------------------------- M5 - M8
def token_cross_entropy(scores: DataFrame, logits: str = "logits", target: str = "target",
                        pad_id: int = PAD_ID, clamp: float = LOGIT_CLAMP) -> DataFrame:
    """M5: cross-entropy of one position from stored logits: subtract the max, clamp to
    [-clamp, clamp], pad target gives 0. A NaN among the logits gives NaN (Spark's ``greatest`` and
    ``least`` order NaN above every number and would clamp it away)."""
    m = F.array_max(logits)
    z = F.transform(logits, lambda x: F.greatest(F.least(x - m, F.lit(clamp)), F.lit(-clamp)))
    lse = F.log(F.aggregate(z, F.lit(0.0), lambda acc, x: acc + F.exp(x)))
    nan = F.exists(logits, lambda x: F.isnan(x))
    ce = F.when(nan, F.lit(float("nan"))).otherwise(lse - F.element_at(z, F.col(target) + 1))
    return scores.withColumn("token_loss", F.when(F.col(target) == pad_id, F.lit(0.0)).otherwise(ce))


def sequence_losses(token_loss: DataFrame, seq: list[str]) -> DataFrame:
    """M6 (first half): sequence loss = sum of token losses / max(sum of mask, 1)."""
    return token_loss.groupBy(*seq).agg(
        (F.sum("loss") / F.greatest(F.sum("mask"), F.lit(1))).alias("seq_loss"))


def batch_losses(seq_loss: DataFrame, batch: list[str]) -> DataFrame:
    """M6 (second half): batch loss = mean of its sequence losses."""
    return seq_loss.groupBy(*batch).agg(F.avg("seq_loss").alias("batch_loss"))


def epoch_losses(batch_loss: DataFrame, epoch: str = "epoch") -> DataFrame:
    """M7: epoch loss = mean of its batch losses."""
    return batch_loss.groupBy(epoch).agg(F.avg("batch_loss").alias("epoch_loss"),
                                         F.count(F.lit(1)).alias("n_batches"))


def page_losses(seq_loss: DataFrame, page: str = "page_id", epoch: str = "epoch") -> DataFrame:
    """M8: average loss over epochs, initial loss (first epoch) and relative loss
    (initial - avg) / initial; null when the initial loss is 0."""
    g = seq_loss.groupBy(page).agg(F.avg("seq_loss").alias("average_loss"),
                                   F.min_by("seq_loss", epoch).alias("initial_loss"))
    return g.withColumn("relative_loss", F.when(F.col("initial_loss") != 0,
                                                (F.col("initial_loss") - F.col("average_loss")) / F.col("initial_loss")))


# --------------------------------------------------------------------------- M9 - M13
def l2_norm(df: DataFrame, vec: str, out: str = "impact") -> DataFrame:
    """M9: token impact = L2 norm of the stored vector."""
    return df.withColumn(out, F.sqrt(F.aggregate(vec, F.lit(0.0), lambda acc, x: acc + x * x)))


def significance_threshold(df: DataFrame, impacts: str = "impacts", q: float = SIGNIFICANCE_QUANTILE) -> DataFrame:
    """sorted(|impact|)[int(n * q)] per sequence (an index pick, not an interpolated percentile)."""
    sorted_abs = F.array_sort(F.transform(impacts, lambda x: F.abs(x)))
    idx = F.floor(F.size(impacts).cast("double") * F.lit(q)).cast("int") + 1
    return df.withColumn("threshold", F.element_at(sorted_abs, idx))


def threshold_rows(rows: DataFrame, key: str, value: str, quantile: float = SIGNIFICANCE_QUANTILE,
                   buckets: int = 1024, few: int = 4096) -> DataFrame:
    """M10 for impacts in row form: (key, n, threshold), the absolute impact at place int(n * quantile).

    A page may hold any share of the rows: they are counted into ``buckets`` between its least and greatest value,
    the bucket that holds the wanted place is cut again, and only when at most ``few`` rows, or equal ones, are left
    are they sorted. Rows are held against the state of up to ``STATE_PAGES`` pages where they lie; a round aggregates in
    each task before the shuffle. Null and NaN impacts are left out.
    """
    from corpus_ledger.functions.joins import broadcast_bounded
    from corpus_ledger.functions.materialize import materialize

    v = rows.select(F.col(key).alias("k"), F.abs(F.col(value).cast("double")).alias("v")).filter("v IS NOT NULL AND NOT isnan(v)")
    counted = v.groupBy("k").agg(F.count(F.lit(1)).alias("total"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    # ``at``: the wanted place among the ``n`` rows between lo and hi.
    state = materialize(counted.withColumn("n", F.col("total")).withColumn("at", F.floor(F.col("total") * F.lit(quantile)).cast("long")))
    large = (F.col("n") > few) & (F.col("lo") < F.col("hi"))
    while not state.filter(large).isEmpty():
        inside = v.join(broadcast_bounded(state.filter(large), STATE_PAGES), "k").filter(F.col("v").between(F.col("lo"), F.col("hi")))
        # Half of both, as the range of very large values would not fit a double.
        share = (F.col("v") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
        cells = inside.withColumn("b", F.least(F.floor(share * buckets), F.lit(buckets - 1))).groupBy("k", "b").agg(
            F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"),
            F.first("total").alias("total"), F.first("at").alias("at"))
        upto = F.sum("n").over(Window.partitionBy("k").orderBy("b"))  # at most ``buckets`` rows a page
        chosen = cells.withColumn("upto", upto).filter((F.col("upto") > F.col("at")) & (F.col("upto") - F.col("n") <= F.col("at")))
        cut = chosen.withColumn("at", F.col("at") - (F.col("upto") - F.col("n"))).select(state.columns)
        state = materialize(state.filter(~large).unionByName(cut))
    # Pages whose remaining rows are all equal need no row; the others sort at most ``few``.
    last = v.join(broadcast_bounded(state.filter("lo < hi"), STATE_PAGES), "k").filter(F.col("v").between(F.col("lo"), F.col("hi")))
    place = F.row_number().over(Window.partitionBy("k").orderBy("v"))
    found = last.withColumn("place", place).filter(F.col("place") == F.col("at") + 1).select("k", "total", F.col("v").alias("threshold"))
    equal = state.filter("lo = hi").select("k", "total", F.col("lo").alias("threshold"))
    return found.unionByName(equal).select(F.col("k").alias(key), F.col("total").alias("n"), "threshold")


def critical_tokens(df: DataFrame, impacts: str = "impacts", window: int = CONTEXT_WINDOW) -> DataFrame:
    """Positions with |impact| >= threshold and their context [max(0, i-w), min(n, i+w+1))."""
    t = significance_threshold(df, impacts)
    keep = [c for c in t.columns if c != impacts]
    ex = t.select(*keep, F.size(impacts).alias("total_tokens"), F.posexplode(impacts).alias("position", "impact"))
    return ex.filter(F.abs("impact") >= F.col("threshold")).select(
        *keep, "total_tokens", "position", "impact",
        F.greatest(F.lit(0), F.col("position") - window).alias("context_start"),
        F.least(F.col("total_tokens"), F.col("position") + window + 1).alias("context_end"))


def top_impacts(impacts: DataFrame, page: str = "page_id", k: int = 10, window: int = CONTEXT_WINDOW,
                total: str | None = "total_tokens") -> DataFrame:
    """The ``k`` largest |impact| per page (ties by position) with the same context rule.

    ``row_number() <= k`` is planned as a window group limit (partial top-k before the shuffle).
    """
    w = Window.partitionBy(page).orderBy(F.desc(F.abs("impact")), "position")
    top = impacts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    end = F.col("position") + window + 1
    if total:
        end = F.least(F.col(total), end)
    return top.withColumn("context_start", F.greatest(F.lit(0), F.col("position") - window)) \
              .withColumn("context_end", end)


def last_epoch(df: DataFrame, page: str = "page_id", epoch: str = "epoch") -> DataFrame:
    """Keep each page's row of its last epoch (partial aggregation)."""
    cols = [c for c in df.columns if c != page]
    return df.groupBy(page).agg(F.max_by(F.struct(*cols), F.col(epoch)).alias("_l")).select(page, "_l.*")


# --------------------------------------------------------------------------- M14 - M17
def nan_audit(scores: DataFrame, arrays: list[str], scalars: list[str]) -> DataFrame:
    """Rows holding a NaN per array column, NaN count per scalar column."""
    aggs = [F.count_if(F.exists(a, lambda x: F.isnan(x))).alias(f"{a}_rows_with_nan") for a in arrays]
    aggs += [F.count_if(F.isnan(c)).alias(f"{c}_nan") for c in scalars]
    return scores.agg(F.count(F.lit(1)).alias("rows"), *aggs)


def explode_scores(scores: DataFrame, key: str = "seq_id", logits: str = "logits") -> DataFrame:
    return scores.select(key, F.posexplode(logits).alias("token_id", "score"))


def top_k_filter(scores: DataFrame, key: str = "seq_id", k: int = 50) -> DataFrame:
    """Per key the scores >= the k-th largest (ties at the k-th value kept): ``rank() <= k``."""
    w = Window.partitionBy(key).orderBy(F.desc("score"))
    return scores.withColumn("rank", F.rank().over(w)).filter(F.col("rank") <= k)


def nucleus_filter(scores: DataFrame, key: str = "seq_id", top_p: float = 0.9, temperature: float = 1.0) -> DataFrame:
    """Softmax over the (already top-k filtered) scores / temperature, ordered by probability;
    keep the smallest prefix reaching mass ``top_p`` (the crossing item kept)."""
    s = scores.withColumn("_z", F.col("score") / F.lit(temperature))
    g = Window.partitionBy(key)
    s = s.withColumn("_e", F.exp(F.col("_z") - F.max("_z").over(g)))
    s = s.withColumn("prob", F.col("_e") / F.sum("_e").over(g))
    o = Window.partitionBy(key).orderBy(F.desc("prob"), "token_id")
    prev = F.sum("prob").over(o.rowsBetween(Window.unboundedPreceding, -1))
    return s.withColumn("cum_before", F.coalesce(prev, F.lit(0.0))) \
            .filter(F.col("cum_before") <= top_p).drop("_z", "_e")


def most_impactful_tokens(tokens: DataFrame, n: int = 10) -> DataFrame:
    """M17 (first half): tokens with the largest total |impact| across pages."""
    return tokens.groupBy("token_id").agg(
        F.sum(F.abs("impact")).alias("total_abs_impact"),
        F.count_distinct("token_impact_id").alias("n_pages"),
    ).orderBy(F.desc("total_abs_impact"), "token_id").limit(n)


def remove_tokens(sequences: DataFrame, ids_col: str, drop: DataFrame, max_ids: int = 100_000) -> DataFrame:
    """M17 (second half): remove the given token ids from every sequence.

    ``drop`` is a bounded report (a top-N result, at most ``max_ids`` ids, checked), so it is gathered
    into one array literal applied inside each row.
    """
    banned = [r[0] for r in drop.select("token_id").limit(max_ids + 1).collect()]
    if len(banned) > max_ids:
        raise ValueError(f"more than {max_ids} token ids to remove")
    arr = F.array(*[F.lit(int(b)) for b in banned]) if banned else F.array().cast("array<long>")
    return sequences.withColumn(ids_col, F.filter(ids_col, lambda x: ~F.array_contains(arr, x.cast("long"))))
