"""Mixing sources to target token shares by entropy balancing.

Among all document rates r >= 0 that meet the token constraints sum(size * r) = target of each source, the
ones closest in relative entropy to rate 1 are r = exp(lambda * size / mean size), one multiplier lambda
per source, limited to ``CAP``. The multipliers solve the convex dual. Newton's method finds them: each
iteration is one Spark aggregation over (source, size) groups that gives every source its gradient and
curvature, kept in a bracket so that the limit's kink and heavy tails cannot make it diverge. A long
document is thus raised, or lowered, more than a short one.

Rates are rounded into whole copies: the floor first, then one copy more in the order of u / fraction,
u a hash of the id (sequential Poisson sampling), until the source's target would be passed; further
rounds fill what is left with documents that still fit, in hash order, and one larger document is added where
that comes closer. The cut is found from sums over hash bins, so no task holds a source's documents.

Defined results: null or empty text has size 0 and takes no words; null is a source of its own, last in
order; a null doc_id hashes as the text "null" does; rows that repeat an id are taken alike; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from corpus_ledger.llm.common import WORD, documents, free_name, is_small, join_dimension, numbered, positions, stored

CAP = 3.0
WEIGHTS = (1, 2, 3)
ITERATIONS = 60
TOLERANCE = 1e-6  # of the target; the rounding that follows is coarser
BINS = 1024
FILL_ROUNDS = 4


def source_targets(sizes: DataFrame, cap: float = CAP, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, mean, target: weights repeat over the sources by code point (null last); a
    target stops at ``cap`` times its source's size and the excess is shared again by weight."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.avg("size").alias("mean"))
    ranked, _ = positions(totals, [F.col("source").asc_nulls_last()], "rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    table = stored(ranked.withColumn("weight", weight).withColumn("limit", cap * F.col("source_size")), "sources")
    total = float(table.agg(F.sum("source_size")).first()[0] or 0)
    share = 0.0
    capped = F.lit(False)
    while True:
        held, free = table.agg(F.sum(F.when(capped, F.col("limit"))), F.sum(F.when(~capped, F.col("weight")))).first()
        if not free:
            break
        new = (total - float(held or 0)) / free
        if new <= share:
            break
        share = new
        capped = F.col("limit") <= F.lit(share) * F.col("weight")
    return stored(table.select("source", "source_size", "mean",
                               F.least("limit", F.lit(share) * F.col("weight")).alias("target")), "targets")


def rate(size: Column, mean: Column, multiplier: Column, cap: float) -> Column:
    """min(cap, exp(multiplier * size / mean)), the exponent limited first so that it cannot overflow."""
    tilt = F.when(mean > 0, multiplier * size / mean).otherwise(F.lit(0.0))
    return F.when(tilt >= math.log(cap), F.lit(cap)).otherwise(F.exp(F.greatest(tilt, F.lit(-700.0))))


def multipliers(sizes: DataFrame, targets: DataFrame, small: bool, cap: float = CAP) -> DataFrame:
    """targets with one dual multiplier per source, by safeguarded Newton steps for all sources at once."""
    groups = stored(sizes.filter("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "groups")
    full = F.col("target") >= cap * F.col("source_size") * (1 - 1e-12)
    # A full source takes every rate at the cap: its multiplier lies beyond every size's limit.
    state = stored(targets.withColumns({
        "low": F.lit(-1e9), "high": F.lit(1e9), "done": full | (F.col("source_size") == 0),
        "multiplier": F.when(full, F.lit(1e9)).otherwise(F.lit(0.0))}), "multipliers")
    for _ in range(ITERATIONS):
        if state.filter(~F.col("done")).isEmpty():
            break
        joined = join_dimension(groups, state.filter(~F.col("done")).select("source", "mean", "multiplier"),
                                "source", small)
        r = rate(F.col("size"), F.col("mean"), F.col("multiplier"), cap)
        words = F.col("n") * F.col("size")
        slope = F.when(r < cap, words * r * F.col("size") / F.col("mean")).otherwise(0.0)
        sums = joined.groupBy("source").agg(F.sum(words * r).alias("_words"), F.sum(slope).alias("_slope"))
        # ``state`` and ``sums`` have one row per source.
        s, o = state.alias("s"), sums.withColumnRenamed("source", "_source")
        both = s.join(F.broadcast(o) if small else o, F.col("source").eqNullSafe(F.col("_source")), "left")
        gap = F.col("_words") - F.col("target")
        low = F.when(gap < 0, F.col("multiplier")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("multiplier")).otherwise(F.col("high"))
        step = F.col("multiplier") - F.when(F.col("_slope") > 0, gap / F.col("_slope"))
        inside = step.isNotNull() & (step > low) & (step < high) & (F.abs(step - F.col("multiplier")) < 1e6)
        middle = F.when((low > -1e9) & (high < 1e9), (low + high) / 2) \
            .when(gap < 0, F.greatest(F.col("multiplier") * 2, F.lit(1.0))) \
            .otherwise(F.least(F.col("multiplier") * 2, F.lit(-1.0)))
        settled = F.col("done") | (F.abs(gap) <= TOLERANCE * F.greatest("target", F.lit(1.0)))
        state = stored(both.select(
            "source", "source_size", "mean", "target",
            F.when(settled, F.col("low")).otherwise(low).alias("low"),
            F.when(settled, F.col("high")).otherwise(high).alias("high"), settled.alias("done"),
            F.when(settled, F.col("multiplier")).when(inside, step).otherwise(middle).alias("multiplier")), "multipliers")
    return state


def _unit(key: Column, seed: int) -> Column:
    """A repeatable number in [0, 1) from a key."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 40)) / float(1 << 40)


def entropy_mix(docs: DataFrame, id_col: str, source_col: str, size: Column, cap: float = CAP,
                weights: tuple[int, ...] = WEIGHTS, seed: int = 3) -> DataFrame:
    """One row per document: id, size, source, source_size, target, rate, copies."""
    base = stored(docs.select(F.col(id_col).alias("id"), size.cast("long").alias("size"),
                              F.col(source_col).cast("string").alias("source")), "sizes")
    targets = source_targets(base, cap, weights)
    small = is_small(targets)
    solved = multipliers(base, targets, small, cap).select("source", "source_size", "mean", "target", "multiplier")
    r = F.when(F.col("multiplier") >= 1e9, F.lit(cap)).otherwise(
        rate(F.col("size"), F.col("mean"), F.col("multiplier"), cap))
    key = F.coalesce(F.col("id").cast("string"), F.lit("null"))
    rated = join_dimension(base, solved, "source", small).withColumn("rate", r) \
        .withColumn("copies", F.floor("rate").cast("long")).drop("mean", "multiplier")
    fraction = F.col("rate") - F.floor("rate")
    rank = F.when(fraction > 0, _unit(key, seed) / fraction)
    rated = rated.withColumn("_at", F.when(rank.isNotNull(), rank / (1 + rank)))
    rounds = stored(rated, "rates")
    for i in range(FILL_ROUNDS):
        taken = rounds.groupBy("source").agg(F.first("target").alias("_target"),
                                             F.sum(F.col("size") * F.col("copies")).alias("_taken"))
        left = taken.select("source", (F.col("_target") - F.col("_taken")).alias("_left"))
        at = F.col("_at") if i == 0 else F.when(F.col("copies") < cap, _unit(key, seed + i))
        open_ = at.isNotNull() & (F.col("size") > 0) & (F.col("size") <= F.col("_left"))
        tried = join_dimension(rounds, left, "source", small).withColumn("_bin", F.when(open_, F.floor(at * BINS).cast("int")))
        # At most BINS rows per source reach the window.
        sums = tried.filter(F.col("_bin").isNotNull()).groupBy("source", "_bin").agg(
            F.sum("size").alias("_size"), F.first("_left").alias("_l"))
        upto = F.sum("_size").over(Window.partitionBy("source").orderBy("_bin"))
        cut = (sums.withColumn("_upto", upto).filter(F.col("_upto") <= F.col("_l"))
               .groupBy("source").agg(F.max("_bin").alias("_cut")))
        more = (F.col("_bin") <= F.col("_cut")).cast("long")
        rounds = stored(join_dimension(tried, cut, "source", small, "left").withColumn(
            "copies", F.col("copies") + F.coalesce(more, F.lit(0))).drop("_left", "_bin", "_cut"), "rates")
    # What is left may be closer to one more, larger document than to nothing: at most one per source.
    gap = rounds.groupBy("source").agg((F.first("target") - F.sum(F.col("size") * F.col("copies"))).alias("_left"))
    tried = join_dimension(rounds, gap, "source", small).withColumn("_best", F.when(
        (F.col("copies") < cap) & (F.col("size") > 0) & (F.col("size") < 2 * F.col("_left")),
        F.struct(F.abs(F.col("_left") - F.col("size")).alias("off"), _unit(key, seed).alias("u"), key.alias("key"))))
    best = tried.groupBy("source").agg(F.min("_best").alias("_one"))
    done = join_dimension(tried, best, "source", small, "left")
    done = done.withColumn("copies", F.col("copies") + F.coalesce((F.col("_best") == F.col("_one")).cast("long"), F.lit(0)))
    return done.select("id", "size", "source", "source_size", "target", "rate", "copies")


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def mix_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it (rows of no words stay once)."""
    row = free_name(docs, "_row")
    rows = numbered(docs, row)
    mixed = entropy_mix(rows, row, "source", word_count())
    times = free_name(docs, "_copies")
    copies = stored(mixed.select(F.col("id").alias(row), F.when(F.col("size") > 0, F.col("copies")).otherwise(1).cast("int")
                                 .alias(times)), "copies")
    joined = rows.join(copies, row).filter(F.col(times) > 0)
    return joined.withColumn(times, F.explode(F.array_repeat(F.lit(1), F.col(times)))).select(*docs.columns)


def op3_entropy_mixing(spark, sf_dir: str) -> DataFrame:
    mixed = entropy_mix(documents(spark, sf_dir), "doc_id", "source", word_count())
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target",
                        (F.col("size") * F.col("copies")).alias("taken"))
