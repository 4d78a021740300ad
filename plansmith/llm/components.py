"""Connected components of a link table.

Each partition first reduces its links to a forest.  A forest of at most SMALL links, which is counted, is finished by one
task; a larger one by alternating large and small stars, entirely as joins and aggregations.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, settle


#: Links that one task may finish: some 100 MB of keys.
SMALL = 1 << 20


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) to (node, smallest node that these links join it to); a root has no row."""
    parent: dict = {}
    kind = pa.int64()

    def find(x):
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while (up := parent.get(x, x)) != root:
            parent[x], x = root, up
        return root

    for b in batches:
        kind = b.column(0).type
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
    own = list(parent)
    for k in range(0, len(own), 10_000):
        yield pa.RecordBatch.from_arrays([pa.array(own[k : k + 10_000], kind), pa.array([find(x) for x in own[k : k + 10_000]], kind)], ["a", "b"])


def components(links: DataFrame, small: int = SMALL) -> DataFrame:
    """links (a, b) of keys of one type, to (node, root): root is the smallest node of the component; nodes without links have no row."""
    kind = links.schema["a"].dataType.simpleString()
    trees = settle(links.select("a", "b").mapInArrow(forest, f"a {kind}, b {kind}"), "forest")
    if trees.count() > small:
        return stars(trees)
    done = trees.coalesce(1).mapInArrow(forest, f"a {kind}, b {kind}")
    return done.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("root")), F.struct(F.col("b").alias("node"), F.col("b").alias("root")))).alias("x")).select("x.*").distinct()


def stars(links: DataFrame, most: int = 60) -> DataFrame:
    """The same by stars.

    Each round hangs every larger neighbour of a node on the node's smallest one, then every smaller.  A node with very many
    links is a group only for a minimum, which is taken before the shuffle; the joins back on it can be split.
    """
    edges = settle(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    for _ in range(most):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.greatest("v", "m").alias("a"), F.least("v", "m").alias("b"), "u", "m")
        out = settle(small.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("a").alias("u"), F.col("b").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct(), "edges")
        now = out.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        forget(edges.sparkSession, edges)
        edges = out
        if tuple(now) == state:
            break
        state = tuple(now)
    else:
        raise RuntimeError("the components did not settle")
    return edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root").union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()).groupBy("node").agg(F.min("root").alias("root"))
