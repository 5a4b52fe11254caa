"""Near-duplicate vectors by cross-polytope hashing with verified candidates.

A rotation is three rounds of random signs and a fast Hadamard transform; its hash is the axis, with sign, to
which the rotated vector is nearest. ``HASHES`` of them make the key of a table. A vector lies in its own
bucket of each of ``TABLES`` tables and probes ``PROBES`` more: those whose axes it misses by the least.
Candidates are the pairs of a bucket of which at least one lies in it. Their cosine is computed in double
precision, in blocks of ``BLOCK`` vectors a side: a large bucket is cut into blocks, every pair of blocks is a
group of its own, and a group returns one row per vector (its number of links) and a spanning forest of its
links, never the pairs themselves. A pair that meets in several buckets is counted in the first of them only,
which each group tells from the two vectors' keys.

Equal vectors are merged first and counted by their number, so copies are never compared with each other.
Of pairs at a cosine of exactly 0.9 in 64 dimensions 2.7e-4 meet in no bucket (simulated), fewer above.

Defined results: a vector that is null or zero, or holds a null, NaN or infinite component, is linked with
nothing and kept; vectors of different lengths are not linked; rows that repeat an id are compared as any
others; a null id is compared too, and names a component only if all of its ids are null; an empty table gives
an empty result; further columns of the input are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_ledger.llm.common import components, stored

TABLES, HASHES, PROBES, SEED = 20, 3, 3, 13
CHOICES = 3  # nearest axes of each rotation that probes may take
BLOCK = 512  # vectors a side of a verified group
CHUNK = 2048  # vectors hashed at a time
PAIRS = 1 << 16  # linked pairs whose keys are compared at a time
BUCKET_BITS = 48  # of a bucket's number
GROUP = ["dim", "t", "bucket", "x", "y"]  # a pair of blocks of a bucket of a table


def hadamard(x: np.ndarray) -> np.ndarray:
    """Normalised fast Hadamard transform of the rows; their length is a power of two.

    The transform of length a * b is one of length a and one of length b over the row as an a x b matrix."""
    n, d = x.shape
    if d <= 8:
        m = np.ones((1, 1))
        while len(m) < d:
            m = np.block([[m, m], [m, -m]])
        return x @ (m / np.sqrt(d)).astype(x.dtype)
    grid = x.reshape(n, d // 8, 8)
    inner = hadamard(grid.reshape(-1, 8)).reshape(n, d // 8, 8)
    return hadamard(inner.transpose(0, 2, 1).reshape(-1, d // 8)).reshape(n, 8, d // 8).transpose(0, 2, 1).reshape(n, d)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; scaled by a power of two first, so that no square over- or underflows."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0.0))[1][:, None])
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def bucket_keys(u: np.ndarray, tables: int, hashes: int, probes: int, seed: int) -> np.ndarray:
    """(rows, tables, 1 + probes) bucket numbers: own bucket first, then the probed ones by their distance."""
    n, d = u.shape
    size = max(4, 1 << (d - 1).bit_length())
    if (2 * size) ** hashes > 2 ** BUCKET_BITS:
        raise ValueError(f"{hashes} hashes of {size} dimensions do not fit {BUCKET_BITS} bits")
    x = np.zeros((n, size))
    x[:, :d] = u
    rng = np.random.default_rng(seed)
    choices = CHOICES
    combos = np.array(list(itertools.product(range(choices), repeat=hashes)))
    probes = min(probes, len(combos) - 1)
    out = np.empty((n, tables, 1 + probes), dtype=np.int64)
    for t in range(tables):
        codes, lost = np.zeros((n, len(combos)), dtype=np.int64), np.zeros((n, len(combos)))
        for h in range(hashes):
            y = x
            for signs in rng.choice([-1.0, 1.0], size=(3, size)):
                y = hadamard(y * signs)
            length = np.abs(y)
            near = np.argpartition(-length, choices - 1, axis=1)[:, :choices]
            order = np.argsort(-np.take_along_axis(length, near, 1), axis=1, kind="stable")
            near = np.take_along_axis(near, order, 1)
            axis = 2 * near + (np.take_along_axis(y, near, 1) < 0)
            miss = np.take_along_axis(length, near, 1)
            miss = (miss[:, :1] - miss) ** 2
            codes = codes * (2 * size) + axis[:, combos[:, h]]
            lost += miss[:, combos[:, h]]
        lost[:, 0] = -1.0  # the own bucket
        best = np.argsort(lost, axis=1, kind="stable")[:, :1 + probes]
        out[:, t] = np.take_along_axis(codes, best, 1)
    return out


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two 64-bit hashes of each usable vector; -0.0 counts as 0.0."""
    for batch in batches:
        high, low = [], []
        for v in batch.column("vector"):
            digest = xxhash.xxh3_128_intdigest((np.array(v.as_py(), dtype=np.float64) + 0.0).tobytes())
            high.append((digest >> 64) - 2 ** 63), low.append((digest & (2 ** 64 - 1)) - 2 ** 63)
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(high, pa.int64()), pa.array(low, pa.int64())],
                                         ["row", "h1", "h2"])


def _hashed(batches: Iterator[pa.RecordBatch], tables: int, hashes: int, probes: int, seed: int
            ) -> Iterator[pa.RecordBatch]:
    """rep, vector and keys; the vectors of a batch may have several lengths."""
    for batch in batches:
        lengths = np.array(batch.column("dim").to_numpy(zero_copy_only=False))
        for d in np.unique(lengths):
            part = batch.take(pa.array(np.flatnonzero(lengths == d)))
            for at in range(0, part.num_rows, CHUNK):
                some = part.slice(at, CHUNK)
                vectors = _matrix(some.column("vector"))
                keys = bucket_keys(unit(vectors), tables, hashes, probes, seed).reshape(some.num_rows, -1)
                ends = np.arange(some.num_rows + 1) * keys.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [some.column("rep"), some.column("dim"), some.column("n"), some.column("vector"),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys.ravel()))],
                    ["rep", "dim", "n", "vector", "keys"])


def _first_meeting(keys: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The first bucket, as table and number in one value, in which the vectors i and j of each pair meet; of two
    in one table the smaller. ``keys`` is (vectors, tables, 1 + probes)."""
    first = np.full(len(i), np.iinfo(np.int64).max)
    for t in range(keys.shape[1] - 1, -1, -1):
        own_i, own_j = keys[i, t, 0], keys[j, t, 0]
        in_i = (keys[j, t] == own_i[:, None]).any(axis=1)  # j lies in, or probes, the bucket of i
        in_j = (keys[i, t] == own_j[:, None]).any(axis=1)
        bucket = np.where(in_i & in_j, np.minimum(own_i, own_j), np.where(in_i, own_i, own_j))
        first = np.where(in_i | in_j, t << BUCKET_BITS | bucket, first)
    return first


def _forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a symmetric adjacency matrix."""
    left, edges = np.ones(len(linked), dtype=bool), []
    for start in range(len(linked)):
        if not left[start]:
            continue
        left[start], border = False, [start]
        while border:
            at = border.pop()
            new = np.flatnonzero(linked[at] & left)
            left[new] = False
            edges += [(at, b) for b in new.tolist()]
            border += new.tolist()
    return edges


def _links(group: pa.RecordBatch, least: float, tables: int) -> pa.RecordBatch:
    """Of a group's vectors: a row (a, null, n) says that ``a`` has ``n`` more links, a row (a, b, null) that the
    two are linked."""
    rep, many = group.column("rep").to_numpy(), group.column("n").to_numpy()
    own = group.column("own").to_numpy(zero_copy_only=False)
    t, bucket, x, y = (group.column(c)[0].as_py() for c in ("t", "bucket", "x", "y"))
    vectors = unit(_matrix(group.column("vector")))
    linked = vectors @ vectors.T >= least
    linked &= own[:, None] | own[None, :]
    if x != y:  # pairs within a block belong to that block's own group
        side = group.column("block").to_numpy()
        linked &= side[:, None] != side[None, :]
    linked |= linked.T
    np.fill_diagonal(linked, False)
    i, j = np.nonzero(np.triu(linked))
    if not len(i):
        return _found([], [], [])
    keys = group.column("keys").flatten().to_numpy().reshape(len(rep), tables, -1)
    mine = np.concatenate([_first_meeting(keys, i[at:at + PAIRS], j[at:at + PAIRS]) for at in range(0, len(i), PAIRS)])
    mine = mine == (t << BUCKET_BITS | bucket)
    links = np.zeros(len(rep), dtype=np.int64)
    np.add.at(links, i[mine], many[j[mine]])
    np.add.at(links, j[mine], many[i[mine]])
    counted = np.flatnonzero(links)
    edges = _forest(linked)
    return _found(rep[counted].tolist() + [int(rep[p]) for p, _ in edges],
                  [None] * len(counted) + [int(rep[q]) for _, q in edges],
                  links[counted].tolist() + [None] * len(edges))


def _found(a: list, b: list, n: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, n)], ["a", "b", "n"])


def _verified(batches: Iterator[pa.RecordBatch], least: float, tables: int) -> Iterator[pa.RecordBatch]:
    """The rows of a partition lie group by group; only the group at hand is kept across batches."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        rows = pa.concat_batches([*rest, batch])
        key = np.stack([rows.column(c).to_numpy() for c in GROUP], axis=1)
        starts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist()]
        for at, end in zip(starts, starts[1:]):
            if end - at > 1:
                yield _links(rows.slice(at, end - at), least, tables)
        rest = [rows.slice(starts[-1])] if rows.num_rows else []
    if rest and rest[0].num_rows > 1:
        yield _links(rest[0], least, tables)


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9,
                 tables: int = TABLES, hashes: int = HASHES, probes: int = PROBES, seed: int = SEED,
                 block: int = BLOCK) -> DataFrame:
    """One row per input row: id, n_links, component_id (smallest id reachable by links), kept."""
    whole = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    rows = stored(vectors.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"),
                                 F.col(vector_col).alias("vector"))
                  .withColumn("usable", F.coalesce(whole & F.exists("vector", lambda x: x != 0), F.lit(False))), "rows")
    usable = rows.filter("usable")
    hashed = stored(usable.select("row", "vector").mapInArrow(_copies, "row long, h1 long, h2 long"), "hashed")
    classes = hashed.groupBy("h1", "h2").agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("n"))
    member = stored(hashed.join(classes, ["h1", "h2"]).select("row", "rep", "n"), "membership")

    def keyed(batches):
        return _hashed(batches, tables, hashes, probes, seed)

    vector_type = dict(rows.dtypes)["vector"]
    reps = (usable.select(F.col("row").alias("rep"), "vector", F.size("vector").alias("dim"))
            .join(member.filter(F.col("row") == F.col("rep")).select("rep", "n"), "rep"))
    reps = stored(reps.select("rep", "dim", "n", "vector")
                  .mapInArrow(keyed, f"rep long, dim int, n long, vector {vector_type}, keys array<long>"), "keyed")
    # A place is a table and a bucket of it; keys are laid out as tables x (own, probes).
    width = 1 + probes_of(probes, hashes)
    entries = (reps.select("rep", "dim", F.posexplode("keys").alias("at", "bucket"))
               .select("rep", "dim", "bucket", F.floor(F.col("at") / width).cast("int").alias("t"),
                       (F.col("at") % width == 0).alias("own")))
    place = ["dim", "t", "bucket"]
    sizes = entries.groupBy(*place).agg(F.count(F.lit(1)).alias("size"), F.count_if("own").alias("owners"))
    crowded = sizes.filter((F.col("size") > 1) & (F.col("owners") > 0)).select(
        *place, F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    met = entries.join(crowded, place).withColumn("block", F.pmod(F.xxhash64("rep", F.lit(seed)), "blocks").cast("int"))
    # A block meets every other block of its bucket and itself.
    paired = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "rep", *place, "own", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    groups = (paired.join(reps.drop("dim"), "rep").repartition(*GROUP).sortWithinPartitions(*GROUP)
              .select("rep", "n", "own", "block", "vector", "keys", *GROUP))

    def check(batches):
        return _verified(batches, least, tables)

    found = stored(groups.mapInArrow(check, "a long, b long, n long"), "found")
    return _result(rows, member, found)


def probes_of(probes: int, hashes: int) -> int:
    return min(probes, CHOICES ** hashes - 1)


def _result(rows: DataFrame, member: DataFrame, found: DataFrame) -> DataFrame:
    links = found.filter("n is not null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    near = components(found.filter("n is null").select("a", "b"))
    placed = (member.join(links, "rep", "left").join(near, F.col("rep") == F.col("node"), "left")
              .select("row", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                      F.coalesce("component", "rep").alias("component")))
    placed = stored(rows.select("row", "id").join(placed, "row", "left")
                    .select("id", F.coalesce("n_links", F.lit(0)).alias("n_links"),
                            F.coalesce("component", "row").alias("component")), "placed")
    least_id = placed.groupBy("component").agg(F.min("id").alias("component_id"))
    out = placed.join(least_id, "component")
    return out.select("id", F.col("n_links").cast("long").alias("n_links"), "component_id",
                      F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op13_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.withColumnRenamed("id", "vec_id")
