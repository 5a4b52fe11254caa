"""Centroid clustering (Lloyd's rounds) with a vantage-point tree over the centroids.

Components become integers, so distances, sums and means are exact and no result depends on the order in
which partitions are added up. In each round the driver builds a tree over the centroids (as many as the
parameter says, whatever the data) and broadcasts it; each task walks it best first for every vector, adds up
its vectors per cluster, and only those sums are shuffled.

Defined results: a vector that is null, has another number of components, or holds a null, NaN or infinite
component is left out; repeated rows count each; of equal hashes the smaller vector comes first; with fewer
vectors than clusters each becomes a centroid; a null id is hashed as the empty text; an empty table gives an
empty result; further columns of the input are ignored. Distances and inertia above the largest long are
given as the largest long, while the comparisons behind them stay exact.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_ledger.llm.common import stored

LEAF = 4  # centroids in a leaf of the tree
SAFE = 2 ** 27  # up to this size of component the squared distance of 64 fits a long
LARGEST = 2 ** 63 - 1
LIMB = 40  # bits of a partial sum that are added up as one long
SLACK = 2.0 ** -50  # bounds give way by more than the rounding of the square roots
CHUNK = 8192  # vectors compared at a time

Tree = tuple[list[list[int]], list[tuple]]


def _squared(a: list[int], b: list[int]) -> int:
    return sum((x - y) ** 2 for x, y in zip(a, b))


def vantage_point_tree(centroids: list[list[int]]) -> Tree:
    """Centroids and nodes. A node is (centroids measured on a visit, children), a child is (node number,
    smallest distance, largest distance) of its centroids to the node's first one, the vantage point."""
    nodes: list[tuple] = []

    def build(members: list[int]) -> int:
        at = len(nodes)
        nodes.append((members, ()))
        if len(members) > LEAF:
            point, rest = members[0], members[1:]
            away = sorted((_squared(centroids[point], centroids[c]), c) for c in rest)
            half = (len(away) + 1) // 2
            children = tuple((build(sorted(c for _, c in part)), math.sqrt(part[0][0]), math.sqrt(part[-1][0]))
                             for part in (away[:half], away[half:]) if part)
            nodes[at] = ([point], children)
        return at

    if centroids:
        build(list(range(len(centroids))))
    return centroids, nodes


def nearest(x: np.ndarray, tree: Tree) -> tuple[np.ndarray, np.ndarray]:
    """Number and squared distance of each row's nearest centroid, of equally near ones the smallest number.

    Each row visits the open node with the least lower bound until that bound exceeds its best distance; a node
    whose bound equals it is still visited, so no tie is lost.
    """
    centroids, nodes = tree
    centers = np.array(centroids, dtype=x.dtype)
    far = LARGEST if x.dtype != object else None
    best = np.full(len(x), far, dtype=x.dtype)
    who = np.full(len(x), len(centroids))
    radius = np.full(len(x), np.inf)
    waiting = np.full((len(x), len(nodes)), np.inf)
    waiting[:, 0] = 0.0
    rows = np.arange(len(x))
    while len(rows):
        node = waiting[rows].argmin(axis=1)
        bound = waiting[rows, node]
        open_ = (bound <= radius[rows]) & (bound < np.inf)
        rows, node = rows[open_], node[open_]
        waiting[rows, node] = np.inf
        for at in np.unique(node):
            here = rows[node == at]
            members, children = nodes[at]
            for c in members:
                away = ((x[here] - centers[c]) ** 2).sum(axis=1)
                first = radius[here] == np.inf
                if far is None:
                    better = np.array([f or d < b or (d == b and c < w) for f, d, b, w
                                       in zip(first, away, best[here], who[here])], dtype=bool)
                else:
                    better = first | (away < best[here]) | ((away == best[here]) & (c < who[here]))
                won = here[better]
                best[won], who[won] = away[better], c
                radius[won] = np.sqrt(away[better].astype(np.float64)) * (1 + SLACK)
            if children:  # ``away`` holds the distances to the vantage point
                root = np.sqrt(away.astype(np.float64))
                for child, low, high in children:
                    waiting[here, child] = np.maximum(np.maximum(low - root, root - high) - (root + high) * SLACK, 0.0)
    return who, best


def _integers(vectors: pa.Array, dim: int, scale: int) -> Iterator[np.ndarray]:
    """floor(scale * x) of the vectors, in chunks: int64, or Python's integers where those could overflow."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    for at in range(0, len(flat), CHUNK):
        x = flat[at:at + CHUNK]
        if np.abs(x).max(initial=0.0) * scale <= SAFE:
            yield np.floor(x * scale).astype(np.int64)
        else:
            # From 2 ** 53 on a double is whole already, and its product could leave the doubles.
            yield np.array([[math.floor(v * scale) if abs(v) < 2.0 ** 53 else int(v) * scale for v in row]
                            for row in x.tolist()], dtype=object)


def _fitting(x: np.ndarray, tree: Tree) -> np.ndarray:
    wide = max((abs(v) for c in tree[0] for v in c), default=0) > SAFE
    return x.astype(object) if wide and x.dtype != object else x


def _partial_sums(batches: Iterator[pa.RecordBatch], tree: Tree, dim: int, scale: int) -> Iterator[pa.RecordBatch]:
    """Per cluster of the task: its number of vectors (place -1) and, per component, its sum in limbs."""
    counts: dict[int, int] = {}
    sums: dict[int, list[int]] = {}
    for batch in batches:
        for x in _integers(batch.column("vector"), dim, scale):
            x = _fitting(x, tree)
            who, _ = nearest(x, tree)
            for c in np.unique(who).tolist():
                own = x[who == c]
                counts[c] = counts.get(c, 0) + len(own)
                sums[c] = [a + int(b) for a, b in zip(sums.get(c, [0] * dim), own.sum(axis=0))]
    rows = [(c, -1, 0, n) for c, n in counts.items()]
    for c, total in sums.items():
        for place, value in enumerate(total):
            sign, rest, limb = (-1 if value < 0 else 1), abs(value), 0
            while rest:
                rows.append((c, place, limb, sign * (rest % 2 ** LIMB)))
                rest, limb = rest >> LIMB, limb + 1
    columns = list(zip(*rows)) or [(), (), (), ()]
    yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()),
                                      pa.array(columns[2], pa.int32()), pa.array(columns[3], pa.int64())],
                                     ["cluster", "place", "limb", "part"])


def _assigned(batches: Iterator[pa.RecordBatch], tree: Tree, dim: int, scale: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        who, away = [], []
        for x in _integers(batch.column("vector"), dim, scale):
            c, d = nearest(_fitting(x, tree), tree)
            who += c.tolist()
            away += [min(int(v), LARGEST) for v in d]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(who, pa.int32()), pa.array(away, pa.int64())],
                                         ["id", "cluster", "distance"])


def first_centroids(kept: DataFrame, clusters: int, seed: int, scale: int) -> list[list[int]]:
    """The vectors whose ids have the smallest hashes, in the order of the hashes."""
    name = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = kept.withColumn("_h", name).orderBy("_h", "vector").limit(clusters).collect()
    dim = len(rows[0]["vector"]) if rows else 0
    return [[int(v) for v in x] for r in rows for x in next(_integers(pa.array([r["vector"]]), dim, scale))]


def cluster_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dim: int = 64,
                    clusters: int = 8, rounds: int = 10, seed: int = 3, scale: int = 1024
                    ) -> tuple[DataFrame, list[list[int]]]:
    """(id, cluster, distance) of every usable vector, and the final centroids."""
    spark = vectors.sparkSession
    whole = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    kept = stored(vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector"))
                  .filter((F.size("vector") == dim) & whole), "vectors")
    centroids = first_centroids(kept, clusters, seed, scale)
    if not centroids:
        return spark.createDataFrame([], kept.select("id").schema.add("cluster", "integer").add("distance", "long")), []
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast(vantage_point_tree(centroids))

        def add_up(batches, sent=sent):
            return _partial_sums(batches, sent.value, dim, scale)

        # One row per cluster, component and limb reaches the driver.
        parts = (kept.select("vector").mapInArrow(add_up, "cluster int, place int, limb int, part long")
                 .groupBy("cluster", "place", "limb").agg(F.sum("part").alias("part")).collect())
        counts = {r["cluster"]: r["part"] for r in parts if r["place"] < 0}
        sums = {c: [0] * dim for c in counts}
        for r in parts:
            if r["place"] >= 0:
                sums[r["cluster"]][r["place"]] += r["part"] << (LIMB * r["limb"])
        moved = [[s // counts[c] for s in sums[c]] if c in counts else old for c, old in enumerate(centroids)]
        if moved == centroids:
            break  # every further round would repeat this one
        centroids = moved
    sent = spark.sparkContext.broadcast(vantage_point_tree(centroids))

    def assign(batches):
        return _assigned(batches, sent.value, dim, scale)

    id_type = dict(kept.dtypes)["id"]
    return kept.mapInArrow(assign, f"id {id_type}, cluster int, distance long"), centroids


def op12_vector_clusters(spark, sf_dir: str) -> DataFrame:
    assigned, centroids = cluster_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    assigned = stored(assigned, "assigned")
    inertia = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster")
               .agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    total = min(sum(inertia.values()), LARGEST)
    rows = [(c, min(inertia.get(c, 0), LARGEST), total, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest())
            for c, v in enumerate(centroids)]
    # One row per cluster, a number set by the parameter.
    named = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(named), "cluster").select(
        F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
