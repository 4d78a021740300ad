"""Operator 12: centroid clustering with kd-tree filtering.

Components become whole numbers, so sums, means and distances are exact whatever the order of rows.  Each task builds kd-trees
over blocks of its vectors once; a node holds its vectors' count, sum and bounding box.  In a round all centroids, a bounded
number, go to the workers; from the root down, a node keeps the centroids that may be nearest to some point of its box: one is
dropped where another is strictly nearer to the whole box.  A node with one centroid left is assigned whole by its count
and sum; a leaf with several is resolved vector by vector, ties to the smaller number.  Spark adds up what the tasks return.

Cases: vectors that are null, of another length, or with a component that is null, NaN or infinite are left out; repeated
rows and ids stay rows of their own; a null id hashes as the empty text; fewer vectors than centroids give as many
centroids as vectors; centroids may be equal, then the smaller number takes all; an empty table gives no rows; only
the id and the vector are read, so other columns may have any name.  A distance has to fit the long of the result: a kept
component beyond 2^26 after scaling (65,536 for a scale of 1024) is refused with an error, never rounded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, tidied

#: Vectors of a block, which has a kd-tree of its own, and of a leaf.
BLOCK, LEAF = 2048, 32
#: Largest component, so that squared distances of doubled boxes fit 64 bits.
LIMIT = 1 << 26


def whole(vectors: DataFrame, id_col: str, vector_col: str, dims: int, scale: int) -> DataFrame:
    """(id, v): the kept vectors as whole numbers."""
    x = F.col(vector_col)
    number = lambda c: c.cast("double")
    good = (F.size(x) == dims) & ~F.coalesce(F.exists(x, lambda c: c.isNull() | F.isnan(number(c)) | (F.abs(number(c)) == F.lit(float("inf")))), F.lit(True))
    scaled = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * number(c)))
    return vectors.where(good).select(F.col(id_col).cast("bigint").alias("id"), scaled.alias("v"))


class Tree:
    """A kd-tree as a heap of nodes: node k has the children 2k+1 and 2k+2, and the vectors from start[k] to start[k] + count[k]."""

    def __init__(self, v: np.ndarray):
        n, d = v.shape
        levels = 0
        while n >> levels > LEAF:
            levels += 1
        m = (1 << (levels + 1)) - 1
        self.inner = (1 << levels) - 1
        self.order = np.arange(n)
        self.start, self.count = np.zeros(m, np.int64), np.zeros(m, np.int64)
        self.count[0] = n
        self.low, self.high, self.sum = (np.zeros((m, d), np.int64) for _ in range(3))
        for k in range(m):
            a, c = self.start[k], self.count[k]
            own = v[self.order[a : a + c]]
            if c:
                self.low[k], self.high[k], self.sum[k] = own.min(axis=0), own.max(axis=0), own.sum(axis=0)
            if k < self.inner:
                half = c // 2
                if c > 1:
                    widest = int((self.high[k] - self.low[k]).argmax())
                    self.order[a : a + c] = self.order[a : a + c][np.argpartition(own[:, widest], half)]
                self.start[2 * k + 1], self.count[2 * k + 1] = a, half
                self.start[2 * k + 2], self.count[2 * k + 2] = a + half, c - half


def possible(low: np.ndarray, high: np.ndarray, centroids: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Which of the centroids `left` may be nearest to some point of each box; low, high: (boxes, dims); left: (boxes, centroids)."""
    far = np.iinfo(np.int64).max
    middle = ((2 * centroids[None] - (low + high)[:, None]) ** 2).sum(axis=2)
    best = np.where(left, middle, far).argmin(axis=1)
    z = centroids[best]
    # The corner of the box that lies furthest towards the other centroid: if even that is nearer to z, so is the whole box.
    corner = np.where(centroids[None] > z[:, None], high[:, None], low[:, None])
    other = ((corner - centroids[None]) ** 2).sum(axis=2)
    return left & ~(other > ((corner - z[:, None]) ** 2).sum(axis=2))


def filtered(tree: Tree, centroids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Nodes that need no further split, with the centroids that are left; together they hold every vector once."""
    nodes, left = np.array([0]), np.ones((1, len(centroids)), bool)
    while len(nodes):
        left = possible(tree.low[nodes], tree.high[nodes], centroids, left)
        done = (left.sum(axis=1) == 1) | (nodes >= tree.inner)
        yield from zip(nodes[done].tolist(), left[done], strict=True)
        nodes, left = np.repeat(nodes[~done], 2), np.repeat(left[~done], 2, axis=0)
        nodes = 2 * nodes + np.tile([1, 2], len(nodes) // 2)
        some = tree.count[nodes] > 0
        nodes, left = nodes[some], left[some]


def distances(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((v[:, None] - centroids[None]) ** 2).sum(axis=2)


def assigned(tree: Tree, v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts and sums by centroid, and each vector's centroid."""
    count, total, label = np.zeros(len(centroids), np.int64), np.zeros_like(centroids), np.empty(len(v), np.int64)
    for k, left in filtered(tree, centroids):
        rows = tree.order[tree.start[k] : tree.start[k] + tree.count[k]]
        own = np.flatnonzero(left)
        if len(own) == 1:
            count[own[0]] += tree.count[k]
            total[own[0]] += tree.sum[k]
            label[rows] = own[0]
            continue
        label[rows] = own[distances(v[rows], centroids[own]).argmin(axis=1)]
        count += np.bincount(label[rows], minlength=len(centroids))
        np.add.at(total, label[rows], v[rows])
    return count, total, label


FIELDS = ("order", "start", "count", "low", "high", "sum")


def blocks(vectors: DataFrame, dims: int) -> DataFrame:
    """(ids, v and the tree's arrays as bytes) of every block of vectors."""

    def packed(ids: list[pa.Array], own: list[np.ndarray]) -> pa.RecordBatch:
        v = np.concatenate(own)
        if ((v > LIMIT) | (v < -LIMIT)).any():
            raise ValueError(f"a scaled component is beyond {LIMIT}: its distances do not fit a long")
        t = Tree(v)
        names = ["ids", "v", *FIELDS]
        both = pa.concat_arrays(ids)
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(both)], pa.int32()), both), *(pa.array([x.tobytes()], pa.binary()) for x in (v, *(getattr(t, f) for f in FIELDS)))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, own, n = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                b = batch.slice(at, BLOCK)
                if n and n + b.num_rows > BLOCK:
                    yield packed(ids, own)
                    ids, own, n = [], [], 0
                ids.append(b.column(0).cast(pa.int64()))
                own.append(b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims))
                n += b.num_rows
        if n:
            yield packed(ids, own)

    return vectors.mapInArrow(tidied(run), "ids array<bigint>, v binary, " + ", ".join(f"`{f}` binary" for f in FIELDS))


def opened(row: dict, dims: int) -> tuple[Tree, np.ndarray]:
    t = Tree.__new__(Tree)
    for f in FIELDS:
        setattr(t, f, np.frombuffer(row[f], np.int64))
    t.low, t.high, t.sum = (x.reshape(-1, dims) for x in (t.low, t.high, t.sum))
    t.inner = len(t.count) // 2
    return t, np.frombuffer(row["v"], np.int64).reshape(-1, dims)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for k in range(b.num_rows):
            yield {n: b.column(i)[k].as_py() if n != "ids" else b.column(i)[k].values for i, n in enumerate(b.schema.names)}


def sums(trees: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, list[int]]]:
    """Count and sum of each centroid that has vectors: a row a centroid and place, added up by Spark."""
    k, dims = centroids.shape
    sent = trees.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        total = np.zeros((k, dims + 1), np.int64)  # of one task: under 2^37 vectors
        for row in rows_of(batches):
            n, s, _ = assigned(*opened(row, dims), c)
            total[:, 0] += n
            total[:, 1:] += s
        at, place = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(place.astype(np.int64)), pa.array(total[at, place])], ["cluster", "place", "n"])

    got = trees.mapInArrow(tidied(run), "cluster bigint, place bigint, n bigint").groupBy("cluster", "place").agg(F.sum(F.col("n").cast("decimal(20,0)")).alias("n")).collect()  # centroids times places
    sent.unpersist()
    by = {(r["cluster"], r["place"]): int(r["n"]) for r in got}
    return {c: (by[c, 0], [by.get((c, p + 1), 0) for p in range(dims)]) for c in range(k) if by.get((c, 0))}


def fit(kept: DataFrame, trees: DataFrame, k: int, rounds: int, salt: str, dims: int) -> np.ndarray:
    """The centroids after `rounds` rounds, from the k vectors whose ids hash lowest."""
    key = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    first = kept.select(key.alias("h"), "v").orderBy("h", "v").limit(k).collect()
    c = np.array([r["v"] for r in first], np.int64).reshape(len(first), dims)
    if ((c > LIMIT) | (c < -LIMIT)).any():
        raise ValueError(f"a scaled component is beyond {LIMIT}: its distances do not fit a long")
    for _ in range(rounds if len(c) else 0):
        new = c.copy()
        for j, (n, total) in sums(trees, c).items():
            new[j] = [s // n for s in total]
        if (new == c).all():  # the rounds left would change nothing
            break
        c = new
    return c


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = 64, k: int = 8, rounds: int = 10, scale: int = 1024, salt: str = "3:") -> DataFrame:
    """Every kept vector's cluster and squared distance, the distances summed by cluster and over all, and its centroid's digest."""
    kept = whole(vectors, id_col, vector_col, dims, scale)
    trees = settle(blocks(kept, dims), "kdtrees")
    c = fit(kept, trees, k, rounds, salt, dims)
    spark = vectors.sparkSession
    digest = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c.tolist()]
    sent = spark.sparkContext.broadcast(c)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for row in rows_of(batches):
            t, v = opened(row, dims)
            label = assigned(t, v, c)[2]
            yield pa.RecordBatch.from_arrays([row["ids"], pa.array(label.astype(np.int32)), pa.array(((v - c[label]) ** 2).sum(axis=1))], [id_col, "cluster", "distance"])

    near = trees.mapInArrow(tidied(run), f"{id_col} bigint, cluster int, distance bigint") if len(c) else spark.createDataFrame([], f"{id_col} bigint, cluster int, distance bigint")
    near = settle(near, "clusters")
    by = near.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()  # k rows
    inertia = {r["cluster"]: int(r["s"]) for r in by}
    own = spark.createDataFrame([(j, inertia[j], sum(inertia.values()), digest[j]) for j in inertia], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return near.join(F.broadcast(own), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
