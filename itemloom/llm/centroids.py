"""Clusters of integer vectors around centroids, searched by a vantage-point tree.

The centroids, a parameter in number, are held by the driver. Each round it builds a
vantage-point tree over them and broadcasts it: a node has one centroid and splits the
others by their distance to it, so that each side knows the least and greatest of these distances. A vector is
searched best first: of the nodes that it hasn't opened it opens that of the least bound,
which by the triangle inequality no centroid below it undercuts, until the least bound is
above the best distance found. Bounds are floats, so nodes are opened up to a radius that is
widened by more than rounding can take away, the radius itself included; distances that decide are sums
of squares of integers, and of equal ones the smaller number counts. The vectors of a batch
take these steps together, each with a queue of its own.

Rounds add up each cluster's vectors within tasks, then by cluster and component, so a
cluster that holds most rows is no more work than any other, and the driver gets as many rows
as there are components of centroids. Vectors are written once as integers to the shared
folder, so a lost executor costs a part of one round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemloom.session import discard, materialize

DIMENSIONS = 64
SCALE = 256
CLUSTERS = 40
ROUNDS = 5
#: Vectors that are searched together.
BATCH = 2048
#: Centroids below which a node isn't split.
LEAF = 4
#: Scaled components must be smaller, so that squared distances fit in a long.
MOST = 1 << 27
#: Share of a bound by which float roots may be off, and more.
SLACK = 1e-12


def quantized(vectors: DataFrame, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id and v, the components as little-endian 32-bit integers floor(scale * x).

    Vectors of another length, and those with a null or non-finite component, are left
    out; so are those with a component of ``MOST`` or more when scaled, whose squared distances don't fit in a long.
    """
    x = F.col("embedding").cast("array<double>")
    good = (F.size("embedding") == dimensions) & F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) * scale < MOST), F.lit(False)))
    kept = vectors.filter(F.coalesce(good, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(1).flatten().to_numpy()
            scaled = np.floor(values * scale).astype("<i4")
            width = 4 * dimensions
            ends = pa.py_buffer((np.arange(batch.num_rows + 1) * width).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, ends, pa.py_buffer(scaled)])], names=["vec_id", "v"])

    return kept.mapInArrow(run, "vec_id long, v binary")


def first_centroids(vectors: DataFrame, n: int = CLUSTERS, salt: str = "2:") -> np.ndarray:
    """The ``n`` vectors of the least SHA-256 of salt and id, in that order; equal ids by their components."""
    key: Column = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.select(key.alias("key"), "v").orderBy(F.asc_nulls_last("key"), "v").limit(n).collect()
    return np.array([np.frombuffer(r.v, "<i4") for r in rows], np.int64)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of pairs of integer rows."""
    d = x - c
    return np.einsum("...k,...k->...", d, d)


@dataclass
class Tree:
    """A vantage-point tree over centroids; node 0 is the root.

    A node has its vantage centroid, children with the range of distances between its vantage and all
    that is below them, and, where it isn't split, further centroids.
    """

    centroids: np.ndarray
    vantage: list[int] = field(default_factory=list)
    children: list[list[tuple[int, float, float]]] = field(default_factory=list)
    others: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self) -> None:
        if len(self.centroids):
            self._add(np.arange(len(self.centroids)))

    def _add(self, members: np.ndarray) -> int:
        # The farthest from the first one sees the others at the most different distances.
        at = int(members[squared(self.centroids[members], self.centroids[members[0]]).argmax()])
        rest = members[members != at]
        node = len(self.vantage)
        self.vantage.append(at)
        self.children.append([])
        self.others.append(rest if len(rest) < LEAF else rest[:0])
        if len(rest) >= LEAF:
            away = np.sqrt(squared(self.centroids[rest], self.centroids[at]).astype(float))
            order = np.argsort(away, kind="stable")
            for half in np.array_split(order, 2):
                self.children[node].append((self._add(rest[half]), float(away[half].min()), float(away[half].max())))
        return node

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of the nearest centroid of each row of integers, and its squared distance."""
        best = np.full(len(x), np.iinfo(np.int64).max)
        number = np.full(len(x), len(self.centroids), np.int64)
        bound = np.full((len(x), len(self.vantage)), np.inf)
        bound[:, 0] = 0
        active = np.arange(len(x))
        while len(active):
            node = bound[active].argmin(1)
            least = bound[active, node]
            inside = least <= np.sqrt(best[active].astype(float)) * (1 + SLACK)
            active, node = active[inside], node[inside]
            bound[active, node] = np.inf
            for k in np.unique(node):
                rows = active[node == k]
                away = self._try(x, rows, self.vantage[k], best, number)
                for c in self.others[k]:
                    self._try(x, rows, int(c), best, number)
                root = np.sqrt(away.astype(float))
                for child, low, high in self.children[k]:
                    gap = np.maximum(np.maximum(root - high, low - root), 0)
                    bound[rows, child] = np.maximum(gap - SLACK * (root + high), 0)
        return number, best

    def _try(self, x: np.ndarray, rows: np.ndarray, c: int, best: np.ndarray, number: np.ndarray) -> np.ndarray:
        away = squared(x[rows], self.centroids[c])
        better = (away < best[rows]) | ((away == best[rows]) & (c < number[rows]))
        best[rows[better]], number[rows[better]] = away[better], c
        return away


def _rows(column: pa.Array, dimensions: int) -> np.ndarray:
    _, _, body = column.buffers()
    width = 4 * dimensions
    start = column.offset * width
    return np.frombuffer(body, np.uint8, len(column) * width, start).view("<i4").reshape(-1, dimensions).astype(np.int64) if len(column) else np.zeros((0, dimensions), np.int64)


def _searched(batches: Iterator[pa.RecordBatch], tree: Tree) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    dimensions = tree.centroids.shape[1]
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            cut = batch.slice(at, BATCH)
            x = _rows(cut.column(1), dimensions)
            yield cut, x, *tree.nearest(x)


def totals(vectors: DataFrame, tree: Tree) -> DataFrame:
    """Per cluster and component the sum over its vectors; component -1 is their number."""
    shared = vectors.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dimensions = shared.value.centroids.shape
        total, count = np.zeros((k, dimensions), np.int64), np.zeros(k, np.int64)
        for _, x, number, _ in _searched(batches, shared.value):
            np.add.at(total, number, x)
            count += np.bincount(number, minlength=k)
        filled = np.flatnonzero(count)
        cluster = np.repeat(filled, dimensions + 1)
        component = np.tile(np.arange(-1, dimensions), len(filled))
        value = np.concatenate([count[filled, None], total[filled]], 1).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(cluster, pa.int32()), pa.array(component, pa.int32()), pa.array(value, pa.int64())], names=["cluster", "component", "total"])

    return vectors.mapInArrow(run, "cluster int, component int, total long").groupBy("cluster", "component").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))


def moved(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: the floored means of their vectors; those without any stay."""
    sums: dict[int, dict[int, int]] = {}
    for r in totals(vectors, Tree(centroids)).collect():
        sums.setdefault(r.cluster, {})[r.component] = int(r.total)
    out = centroids.copy()
    for cluster, by in sums.items():
        out[cluster] = [by[c] // by[-1] for c in range(centroids.shape[1])]
    return out


def assigned(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster and squared distance of every vector."""
    shared = vectors.sparkSession.sparkContext.broadcast(Tree(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cut, _, number, away in _searched(batches, shared.value):
            yield pa.RecordBatch.from_arrays([cut.column(0), pa.array(number, pa.int32()), pa.array(away, pa.int64())], names=["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(embeddings: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """Per kept row of ``embeddings`` (vec_id, embedding): cluster, distance, both inertias, and the centroid's digest.

    Fewer vectors than ``clusters`` give as many centroids. Of an empty table, or one without a good vector, nothing is left.
    Repeated rows count each; rows of one vec_id but other components are vectors of their own; a row without a vec_id is
    a centroid at first only where the others don't suffice. Other columns aren't read.
    """
    spark = embeddings.sparkSession
    vectors = materialize(quantized(embeddings, dimensions, scale), "vectors")
    centroids = first_centroids(vectors, clusters).reshape(-1, dimensions)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(vectors, centroids)
    placed = materialize(assigned(vectors, centroids), "clusters")
    discard(vectors)
    sums = {r.cluster: int(r.total) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    rows = [(k, n, sum(sums.values()), digest[k]) for k, n in sums.items()]
    known = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # One row for each centroid, so it may be broadcast.
    return placed.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def oracle_sql(clusters: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    """The same in SQL: all distances, round by round."""
    steps = [
        "kept AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS k, v FROM kept ORDER BY sha256('2:' || vec_id) LIMIT {clusters})",
    ]
    away = "list_sum(list_transform(list_zip(x.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    for t in range(rounds + 1):
        steps.append(f"a{t} AS MATERIALIZED (SELECT r, arg_min(k, (d, k)) AS k, CAST(min(d) AS BIGINT) AS d FROM (SELECT x.r, c.k, {away} AS d FROM kept x, c{t} c) GROUP BY r)")
        if t < rounds:
            steps.append(f"s{t} AS MATERIALIZED (SELECT k, i, sum(y) AS s, count(*) AS n FROM (SELECT a.k, unnest(x.v) AS y, unnest(range(64)) AS i FROM kept x JOIN a{t} a ON a.r = x.r) GROUP BY k, i)")
            steps.append(f"m{t} AS MATERIALIZED (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v FROM s{t} GROUP BY k)")
            steps.append(f"c{t + 1} AS MATERIALIZED (SELECT c.k, coalesce(m.v, c.v) AS v FROM c{t} c LEFT JOIN m{t} m ON m.k = c.k)")
    last = rounds
    return f"WITH {', '.join(steps)} SELECT x.vec_id, CAST(a.k AS INTEGER) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM kept x JOIN a{last} a ON a.r = x.r JOIN c{last} c ON c.k = a.k"


ORACLE_SQL = oracle_sql()
