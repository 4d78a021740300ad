"""Connected pieces of every plan at once, and their repair: joins and aggregations over (plan, node), no graph on the driver.

Nodes are cut into chunks of CHUNK consecutive ids.  The edges of a plan inside a chunk, a bounded group, are contracted to
one label a piece; what crosses chunks is a small graph of labels, which large and small stars contract round by round
until a count and a checksum of the edges stay as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import drop, settle

#: Consecutive node ids whose edges one task contracts.
CHUNK = 1 << 16


def inner_edges(parts: DataFrame, edges: DataFrame) -> DataFrame:
    """(plan_id, u, v): the edges with both ends in one part; parts: (plan_id, node, part)."""
    at = lambda x: parts.select("plan_id", F.col("node").alias(x), F.col("part").alias(f"part_{x}"))
    return edges.select("u", "v").join(at("u"), "u").join(at("v"), ["plan_id", "v"]).where("part_u = part_v").select("plan_id", "u", "v")


def labelled(t: pa.Table) -> pa.Table:
    """The smallest node of each node's piece, by edges of one plan and chunk."""
    u, v = t["u"].to_numpy(), t["v"].to_numpy()
    node, both = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = both[: len(u)], both[len(u) :]
    low = np.arange(len(node))
    while True:
        new = low.copy()
        least = np.minimum(low[a], low[b])
        for x in (a, b):
            np.minimum.at(new, low[x], least)  # hook the roots,
            np.minimum.at(new, x, least)
        while (new[new] != new).any():  # and jump to them
            new = new[new]
        if (new == low).all():
            break
        low = new
    plan = t["plan_id"].combine_chunks().take(pa.array(np.zeros(len(node), np.int64)))
    return pa.table({"plan_id": plan, "node": pa.array(node), "low": pa.array(node[low])})


def contracted(links: DataFrame, most: int = 60) -> DataFrame:
    """links (plan_id, u, v) to (plan_id, node, root): root is the smallest node that links reach."""
    edges = settle(links.select("plan_id", F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    before = None
    for _ in range(most):
        both = edges.unionAll(edges.select("plan_id", F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("plan_id", "u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, ["plan_id", "u"]).select("plan_id", F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("plan_id", "u").agg(F.min("v").alias("m"))
        pair = F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))))
        new = settle(large.join(low, ["plan_id", "u"]).select("plan_id", pair.alias("e")).select("plan_id", "e.*").where("u <> v").distinct(), "links")
        now = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("plan_id", "u", "v").cast("decimal(38,0)"))).first())
        drop(edges)
        edges = new
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"the pieces did not settle in {most} rounds")
    return edges.select("plan_id", F.col("u").alias("node"), F.col("v").alias("root")).unionAll(edges.select("plan_id", F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def components(parts: DataFrame, edges: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """parts (plan_id, node, part, ...) with root, the smallest node that edges within the part reach."""
    kind, ids = parts.schema["plan_id"].dataType.simpleString(), parts.schema["node"].dataType.simpleString()
    links = settle(inner_edges(parts, edges), "inner")
    at = lambda c: F.floor(F.col(c) / chunk)
    low = links.where(at("u") == at("v")).groupBy("plan_id", at("u").alias("chunk")).applyInArrow(labelled, f"plan_id {kind}, node {ids}, low {ids}")
    far = links.where(at("u") != at("v"))
    out = parts.join(low, ["plan_id", "node"], "left").withColumn("low", F.coalesce("low", "node"))
    if far.isEmpty():
        return out.withColumnRenamed("low", "root")
    low = settle(low, "low")
    end = lambda c: low.select("plan_id", F.col("node").alias(c), F.col("low").alias(f"low_{c}"))
    far = far.join(end("u"), ["plan_id", "u"], "left").join(end("v"), ["plan_id", "v"], "left")
    root = contracted(far.select("plan_id", F.coalesce("low_u", "u").alias("u"), F.coalesce("low_v", "v").alias("v")))
    out = parts.join(low, ["plan_id", "node"], "left").withColumn("low", F.coalesce("low", "node"))
    return out.join(root.withColumnRenamed("node", "low"), ["plan_id", "low"], "left").withColumn("root", F.coalesce("root", "low")).drop("low")


def pieces(assignment: DataFrame, edges: DataFrame, units: DataFrame | None = None, locality: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """(plan_id, district, n_components): the pieces of each district, or with a locality of units (plan_id, district, locality, n_components) of its part in it; units without a district are left out, a missing locality is one of its own."""
    own, by = assignment.where("district IS NOT NULL").select("plan_id", "node", "district"), ["plan_id", "district"]
    if locality:
        own, by = own.join(units.select("node", F.col(locality).cast("string").alias("locality")), "node"), [*by, "locality"]
    part = F.to_json(F.struct(*by[1:]))  # a null field is left out, so it differs from every text
    found = components(own.withColumn("part", part), edges, chunk)
    return found.groupBy(*by).agg(F.count_if(F.col("node") == F.col("root")).alias("n_components"))


def torn(assignment: DataFrame, edges: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(plan_id): the plans with a district of several pieces."""
    return pieces(assignment, edges, chunk=chunk).where("n_components > 1").select("plan_id").distinct()


def filled(assignment: DataFrame, edges: DataFrame) -> DataFrame:
    """Units without a district take the one that most of their neighbours are in, the smallest on a tie, round after round; units that no district reaches take the smallest of their plan."""
    from .ensemble import modal_neighbour

    own = settle(assignment.select("plan_id", "node", "district"), "filled")
    while not own.where("district IS NULL").isEmpty():
        near = modal_neighbour(edges, own).withColumnRenamed("district", "near")
        if near.isEmpty():
            least = own.groupBy("plan_id").agg(F.min("district").alias("least"))
            return own.join(least, "plan_id").select("plan_id", "node", F.coalesce("district", "least").alias("district"))
        new = settle(own.join(near, ["plan_id", "node"], "left").select("plan_id", "node", F.coalesce("district", "near").alias("district")), "filled")
        drop(own)
        own = new
    return own


def repaired(assignment: DataFrame, edges: DataFrame, passes: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """(plan_id, node, district) with contiguous districts, all plans at once.

    First units without a district get one.  Then each plan goes through its districts in order, as often as it has
    districts, twice that at most (or `passes` times): of a torn district all pieces but the largest (on a tie the one
    with the smallest node) go to the district most of their neighbours are in, the smallest on a tie; a piece without neighbours
    outside goes to the smallest other district.  A step does each plan's next torn district, so there are
    as many steps as the worst plan has repairs; each step is written and the one before dropped."""
    own = settle(filled(assignment, edges), "repaired")
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    order = Window.partitionBy("plan_id").orderBy("district")  # a plan's districts are few
    names = own.where("district IS NOT NULL").select("plan_id", "district").distinct()
    names = names.withColumns({"rank": F.row_number().over(order) - 1, "k": F.count("*").over(Window.partitionBy("plan_id"))})
    names = settle(names.select("plan_id", "district", "rank", "k"), "districts")
    cursor = settle(names.groupBy("plan_id").agg(F.lit(-1).cast("bigint").alias("cursor"), F.min("district").alias("first"), F.min_by("district", F.when(F.col("rank") > 0, F.col("rank"))).alias("second")), "cursor")
    limit = F.lit(passes) if passes is not None else 2 * F.col("k")
    while True:
        found = settle(components(own.where("district IS NOT NULL").withColumn("part", F.col("district")), edges, chunk).drop("part"), "pieces")
        size = found.groupBy("plan_id", "district", "root").agg(F.count("*").alias("n"))
        broken = size.groupBy("plan_id", "district").agg(F.count("*").alias("pieces"), F.max_by("root", F.struct(F.col("n"), -F.col("root"))).alias("keep")).where("pieces > 1")
        place = F.col("cursor") + 1 + F.pmod(F.col("rank") - F.col("cursor") - 1, F.col("k"))
        due = broken.join(names, ["plan_id", "district"]).join(cursor, "plan_id").withColumn("place", place).where(F.col("place") < limit * F.col("k"))
        due = settle(due.groupBy("plan_id").agg(F.min(F.struct("place", "district", "keep", "first", "second")).alias("x")).select("plan_id", "x.*"), "due")
        if due.isEmpty():
            drop(found, due)
            break
        moving = found.join(due, ["plan_id", "district"]).where("root <> keep").select("plan_id", "node", "root", "district", "first", "second")
        around = own.where("district IS NOT NULL").select("plan_id", F.col("node").alias("v"), F.col("district").alias("other"))
        near = moving.join(both, moving.node == both.u).join(around, ["plan_id", "v"]).where("other <> district").groupBy("plan_id", "root", "other").agg(F.count("*").alias("n"))
        to = near.groupBy("plan_id", "root").agg(F.min_by("other", F.struct(-F.col("n"), F.col("other"))).alias("to"))
        away = F.coalesce("to", F.when(F.col("district") == F.col("first"), F.col("second")).otherwise(F.col("first")), "district")
        moves = moving.join(to, ["plan_id", "root"], "left").select("plan_id", "node", away.alias("to"))
        new = settle(own.join(moves, ["plan_id", "node"], "left").select("plan_id", "node", F.coalesce("to", "district").alias("district")), "repaired")
        later = settle(cursor.join(due.select("plan_id", "place"), "plan_id", "left").select("plan_id", F.coalesce("place", "cursor").alias("cursor"), "first", "second"), "cursor")
        drop(own, found, due, cursor)
        own, cursor = new, later
    drop(cursor, names)
    return own
