"""Sharding along a Hilbert curve.

Several metadata dimensions are quantised to ``2**BITS`` levels, the cell's index on the Hilbert curve is
computed with column expressions, the rows are sorted by it, and the order is cut into runs. Neighbours
on the curve are neighbours in every dimension, so each shard covers a small box of all dimensions and a
filter on any of them skips whole shards (``shard_bounds`` gives the box).

Law ``rows``: the row counts of two shards differ by at most one. Ties on the curve are cut by the order
columns, so a cell that holds a third of all rows spreads over several shards.

Defined results: a null takes the lowest level of its dimension; a null text has size 1; an empty table
gives an empty result; repeated rows take neighbouring slots; further columns pass through unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpus_ledger.llm.common import documents, positions, stored

BITS = 5
SHARDS = 16


def text_level(c: str) -> Column:
    """A number that orders strings by their first seven bytes."""
    return F.conv(F.rpad(F.hex(F.substring(F.col(c).cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("double")


def quantise(df: DataFrame, dims: dict[str, Column], bits: int = BITS) -> DataFrame:
    """Add an array column ``_cell`` with one level 0 .. 2**bits - 1 per dimension, linear between the
    dimension's smallest and largest value (one aggregate; two numbers per dimension reach the driver)."""
    values = df.withColumns({f"_v{i}": c.cast("double") for i, c in enumerate(dims.values())})
    ends = values.agg(*[f(f"_v{i}").alias(f"{f.__name__}{i}") for i in range(len(dims)) for f in (F.min, F.max)]).first()
    levels = []
    for i in range(len(dims)):
        low, high = ends[f"min{i}"], ends[f"max{i}"]
        if low is None or high == low:
            levels.append(F.lit(0).cast("long"))
            continue
        level = F.floor((F.col(f"_v{i}") - low) / (high - low) * (2**bits - 1) + 0.5).cast("long")
        levels.append(F.coalesce(level, F.lit(0).cast("long")))
    return values.withColumn("_cell", F.array(*levels)).drop(*[f"_v{i}" for i in range(len(dims))])


def hilbert_index(cell: str, n_dims: int, bits: int = BITS) -> Column:
    """Index on the Hilbert curve of an array column of ``n_dims`` levels.

    From the highest bit down, each axis either inverts the lower bits of the first axis or swaps them with
    its own; the axes are then Gray-coded and their bits interleaved.
    """
    turned = cell
    for bit in range(bits - 1, 0, -1):
        for axis in range(n_dims):
            flag, low = 1 << bit, (1 << bit) - 1
            # One lambda per step: the array is bound once and not repeated in the plan.
            first = f"(CASE WHEN x[{axis}] & {flag}L <> 0 THEN x[0] ^ {low}L ELSE x[0] ^ ((x[0] ^ x[{axis}]) & {low}L) END)"
            own = f"(CASE WHEN x[{axis}] & {flag}L <> 0 THEN x[{axis}] ELSE x[{axis}] ^ ((x[0] ^ x[{axis}]) & {low}L) END)"
            parts = [first if i == 0 else own if i == axis else f"x[{i}]" for i in range(n_dims)]
            turned = f"transform(array({turned}), x -> array({', '.join(parts)}))[0]"
    gray = [" ^ ".join(f"x[{j}]" for j in range(i + 1)) for i in range(n_dims)]
    turned = f"transform(array({turned}), x -> array({', '.join(gray)}))[0]"
    fix = " ^ ".join(f"(CASE WHEN x[{n_dims - 1}] & {1 << b}L <> 0 THEN {(1 << b) - 1}L ELSE 0L END)" for b in range(bits - 1, 0, -1))
    turned = f"transform(array({turned}), x -> array({', '.join(f'x[{i}] ^ {fix}' for i in range(n_dims))}))[0]"
    woven = " | ".join(f"shiftleft(shiftright(x[{i}], {b}) & 1L, {b * n_dims + n_dims - 1 - i})"
                       for b in range(bits) for i in range(n_dims))
    return F.expr(f"transform(array({turned}), x -> {woven})[0]")


def hilbert_shards(df: DataFrame, dims: dict[str, Column], order: list[str], shards: int = SHARDS,
                   bits: int = BITS) -> DataFrame:
    """Add hilbert, shard (0 .. shards-1) and slot (gapless from 0 within the shard)."""
    indexed = quantise(df, dims, bits).withColumn("hilbert", hilbert_index("_cell", len(dims), bits)).drop("_cell")
    ranked, n = positions(indexed, ["hilbert", *order], "_rank")
    # Shard s holds the ranks r with floor(r * shards / n) = s; its first rank is ceil(s * n / shards).
    ranked = ranked.withColumn("shard", F.expr(f"CAST((_rank * {shards}) DIV {max(n, 1)} AS INT)"))
    first = F.expr(f"(CAST(shard AS BIGINT) * {n} + {shards - 1}) DIV {shards}")
    return ranked.withColumn("slot", F.col("_rank") - first).drop("_rank")


def shard_bounds(sharded: DataFrame, columns: list[str]) -> DataFrame:
    """Per shard the smallest and largest value of each column: what file pruning reads."""
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in columns for f in (F.min, F.max)]
    return sharded.groupBy("shard").agg(F.count(F.lit(1)).alias("n_rows"), *ends)


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write one folder per shard, rows in curve order."""
    sharded.repartition("shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def document_dims() -> dict[str, Column]:
    return {"source": text_level("source"), "lang": text_level("lang"), "size": F.log2("size"),
            "doc_id": F.col("doc_id")}


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Shard assignment of each document: doc_id, size, text_crc32, law, shard, slot, grown_shard, source, lang, hilbert."""
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = stored(docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
                              F.crc32(text.cast("binary")).alias("text_crc32"), "source", "lang"), "slim")
    out = hilbert_shards(slim, document_dims(), ["doc_id", "text_crc32", "size"], shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), "hilbert", "source", "lang")


def op1_hilbert_sharding(spark, sf_dir: str) -> DataFrame:
    return shard_documents(documents(spark, sf_dir))
