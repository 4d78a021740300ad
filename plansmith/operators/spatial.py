"""Spatial joins without theta joins: segments, vertices and cells make them equi-joins, and no row carries more than a piece."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..shared import drop, large, settle

SEGMENT = ["x0", "y0", "x1", "y1"]
#: How far a vertex may lie off a segment that it splits.
TOLERANCE = 1e-6
#: Unit pieces of a cell that is not cut further, and outline segments of a cell whose chains one task joins, on average.
DENSE, CHAINED = 64, 20_000


def with_area(units: DataFrame) -> DataFrame:
    """`area` of each geometry where the column is missing."""
    if "area" in units.columns:
        return units

    @F.pandas_udf("double")
    def area(x: pd.Series) -> pd.Series:
        return x.map(lambda b: None if b is None else g.area(bytes(b)))

    return units.withColumn("area", area("geom"))


def boundary_segments(units: DataFrame, key: str = "node") -> DataFrame:
    """(key, x0, y0, x1, y1, forward) of every boundary segment, from its smaller end; forward: the inside is on its left."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, xy = g.segments(b.column(1).to_pylist())
            back = (xy[:, 0] > xy[:, 2]) | ((xy[:, 0] == xy[:, 2]) & (xy[:, 1] > xy[:, 3]))
            xy[back] = xy[back][:, [2, 3, 0, 1]]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), *(pa.array(np.ascontiguousarray(c)) for c in xy.T), pa.array(~back)], [key, *SEGMENT, "forward"])

    return units.select(key, "geom").mapInArrow(run, f"{key} {units.schema[key].dataType.simpleString()}, x0 double, y0 double, x1 double, y1 double, forward boolean")


def length() -> Column:
    return F.sqrt(F.pow(F.col("x1") - F.col("x0"), 2) + F.pow(F.col("y1") - F.col("y0"), 2))


def matched(units: DataFrame) -> DataFrame:
    """(x0, y0, x1, y1, who): the segments with the units (node, forward) that have them."""
    return boundary_segments(units).groupBy(*SEGMENT).agg(F.collect_list(F.struct("node", "forward")).alias("who"))  # two units in a coverage


def ends_of(segments: DataFrame) -> DataFrame:
    return segments.select(F.explode(F.array(F.struct(F.col("x0").alias("px"), F.col("y0").alias("py")), F.struct(F.col("x1").alias("px"), F.col("y1").alias("py")))).alias("p")).select("p.*").distinct()


def strays(open_: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(px, py, to): ends of segments that lie within the tolerance of a smaller end, as two sources may round one corner in two ways."""
    ends = ends_of(open_)
    cell = lambda c: F.floor(F.col(c) / (4 * tolerance))
    around = lambda c: F.explode(F.array(*(cell(c) + k for k in (-1, 0, 1))))
    here = ends.withColumn("cx", around("px")).withColumn("cy", around("py"))
    there = ends.select(cell("px").alias("cx"), cell("py").alias("cy"), F.col("px").alias("qx"), F.col("py").alias("qy"))
    close = (F.abs(F.col("px") - F.col("qx")) <= tolerance) & (F.abs(F.col("py") - F.col("qy")) <= tolerance)
    return here.join(there, ["cx", "cy"]).where(close).groupBy("px", "py").agg(F.min(F.struct("qx", "qy")).alias("to")).where("to.qx <> px OR to.qy <> py")


def gathered(segments: DataFrame, strays: DataFrame) -> DataFrame:
    """The segments with their stray ends moved; those that shrink to a point go."""
    columns = segments.columns
    for k in "01":
        segments = segments.join(strays.withColumnsRenamed({"px": f"x{k}", "py": f"y{k}"}), [f"x{k}", f"y{k}"], "left")
        segments = segments.withColumns({f"x{k}": F.coalesce("to.qx", f"x{k}"), f"y{k}": F.coalesce("to.qy", f"y{k}")}).drop("to")
    back = F.expr("x0 > x1 OR x0 = x1 AND y0 > y1")
    turned = {a: F.when(back, F.col(b)).otherwise(F.col(a)) for a, b in zip(SEGMENT, ["x1", "y1", "x0", "y0"], strict=True)}
    return segments.where("x0 <> x1 OR y0 <> y1").withColumns(turned | {"forward": F.col("forward") != back}).select(*columns)


def split(open_: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Segments (x0, y0, x1, y1, node, forward) cut at the ends of others that lie on them, so that parts of a boundary match; the parts of a segment come from a window over the places on it."""
    cuts = meetings(open_, tolerance).where((F.col("t") > tolerance) & (F.col("t") < length() - tolerance)).distinct()
    first = open_.select("*", F.col("x0").alias("px"), F.col("y0").alias("py"), F.lit(0.0).alias("t"))
    last = open_.select("*", F.col("x1").alias("px"), F.col("y1").alias("py"), length().alias("t"))
    by = Window.partitionBy(*open_.columns).orderBy("t", "px", "py")
    to = F.lead(F.struct("px", "py")).over(by)
    parts = cuts.unionByName(first).unionByName(last).withColumn("to", to).where("to IS NOT NULL")
    x0, y0, x1, y1 = F.col("px"), F.col("py"), F.col("to.px"), F.col("to.py")
    back = (x0 > x1) | ((x0 == x1) & (y0 > y1))
    ends = [F.when(back, b).otherwise(a) for a, b in ((x0, x1), (y0, y1), (x1, x0), (y1, y0))]
    return parts.select("node", (F.col("forward") != back).alias("forward"), *(c.alias(n) for c, n in zip(ends, SEGMENT, strict=True)))


def alone(by: DataFrame) -> DataFrame:
    return by.where(F.size("who") == 1).select(*SEGMENT, F.col("who")[0]["node"].alias("node"), F.col("who")[0]["forward"].alias("forward"))


def meetings(open_: DataFrame, tolerance: float) -> DataFrame:
    """(x0, y0, x1, y1, node, forward, px, py, t): ends within the tolerance of a segment other than its own, and how far along they are.

    Segments and ends meet in cells of about two segments' length; a long segment is in the cells along its way."""
    extent = F.greatest(F.abs(F.col("x1") - F.col("x0")), F.abs(F.col("y1") - F.col("y0")))
    cell = F.broadcast(open_.agg((2 * F.avg(extent)).alias("cell")))  # one row
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    lines = open_.crossJoin(cell).withColumn("n", F.greatest(F.ceil(extent / F.col("cell")), F.lit(1)))
    lines = lines.withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))

    def along(axis: str, d: Column) -> Column:
        a, b = (F.col(axis + "0") + d * (F.col("k") + j) / F.col("n") for j in (0, 1))
        at = lambda x: F.floor(x / F.col("cell"))
        return F.explode(F.sequence(at(F.least(a, b) - tolerance), at(F.greatest(a, b) + tolerance)))

    lines = lines.withColumn("cx", along("x", dx)).withColumn("cy", along("y", dy)).select(*open_.columns, "cx", "cy")
    ends = ends_of(open_).crossJoin(cell).select("px", "py", F.floor(F.col("px") / F.col("cell")).alias("cx"), F.floor(F.col("py") / F.col("cell")).alias("cy"))
    t = ((F.col("px") - F.col("x0")) * dx + (F.col("py") - F.col("y0")) * dy) / length()
    off = F.abs((F.col("px") - F.col("x0")) * dy - (F.col("py") - F.col("y0")) * dx) / length()
    own = F.expr("px = x0 AND py = y0 OR px = x1 AND py = y1")
    near = lines.join(ends, ["cx", "cy"]).where(~own).withColumn("t", t)
    return near.where((off <= tolerance) & (F.col("t") >= -tolerance) & (F.col("t") <= length() + tolerance)).select(*open_.columns, "px", "py", "t")


def tidied(by: DataFrame, tolerance: float) -> tuple[DataFrame, DataFrame | None]:
    """The segments of `by` that match none, cut where ends of others lie on them, and stray ends; in a clean coverage, where a join has shown that nothing meets them, they stay as they are."""
    open_ = alone(by)
    if meetings(open_, tolerance).isEmpty():
        return open_, None
    moved = strays(open_, tolerance)
    return split(gathered(open_, moved), tolerance), moved


def coverage(units: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(node, forward, x0, y0, x1, y1): boundary segments, cut so that what two units share are equal segments.  Only segments that match none are cut, and only corners of these are looked at for stray ones."""
    by = settle(matched(units), "segments")
    parts, moved = tidied(by, tolerance)
    whole = by.where(F.size("who") > 1).select(F.explode("who").alias("w"), *SEGMENT).select("w.*", *SEGMENT)
    return (whole if moved is None else gathered(whole, moved)).unionByName(parts.select(*whole.columns))


def adjacency(units: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(u, v, shared_perim) of units that share a part of their boundaries, whether their segments match or not: aggregations by segment, no self-join."""
    by = settle(matched(units), "segments")
    node = F.transform("who", lambda w: w["node"])
    pairs = by.where(F.size("who") == 2).select(F.array_min(node).alias("u"), F.array_max(node).alias("v"), *SEGMENT)
    parts, moved = tidied(by, tolerance)
    if moved is not None:
        cut = parts.groupBy(*SEGMENT).agg(F.min("node").alias("u"), F.max("node").alias("v"), F.count("*").alias("n")).where("n = 2").drop("n")
        pairs = pairs.unionByName(cut)
    return pairs.where("u <> v").groupBy("u", "v").agg(F.sum(length()).alias("shared_perim"))


def boundary_perimeter(units: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(node, boundary_perim): the length of boundary that no other unit has; 0 for inner units."""
    parts, _ = tidied(settle(matched(units), "segments"), tolerance)
    by = parts.groupBy(*SEGMENT).agg(F.min("node").alias("node"), F.count("*").alias("n")).where("n = 1")
    outer = by.groupBy("node").agg(F.sum(length()).alias("boundary_perim"))
    return units.select("node").join(outer, "node", "left").select("node", F.coalesce("boundary_perim", F.lit(0.0)).alias("boundary_perim"))


def vertices(units: DataFrame) -> DataFrame:
    """Distinct (node, x, y)."""
    return boundary_segments(units).select("node", F.explode(F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")))).alias("p")).select("node", "p.x", "p.y").distinct()


# Overlay

def tiled(df: DataFrame, keys: list[str], size: float | Column, geom: str = "geom") -> DataFrame:
    """(keys, cx, cy, piece): polygons cut to the cells of a grid of a size of their own each."""
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, (geom_, size_) in enumerate(zip(b.column(len(keys)).to_pylist(), b.column(len(keys) + 1).to_pylist(), strict=True)):
                rows = [(x, y, g.wkb(rings)) for p in (g.polygons(geom_) if geom_ is not None else ()) for x, y, rings in g.tiles(p, size_)]
                if rows:
                    own = b.slice(k, 1).to_pydict()
                    x, y, piece = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays([*(pa.array([own[c][0]] * len(rows), b.schema.field(c).type) for c in keys), pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(piece, pa.binary())], [*keys, "cx", "cy", "piece"])

    size = F.lit(float(size)) if isinstance(size, (int, float)) else size
    return df.select(*keys, geom, size.alias("size")).mapInArrow(run, f"{kinds}, cx bigint, cy bigint, piece binary")


def assign(units: DataFrame, plans: DataFrame, cell: float | None = None, dense: int = DENSE) -> DataFrame:
    """(plan_id, node, district): the plan polygon that shares most area with each unit, the smallest district on a tie; null where none does.

    plans: (plan_id, district, geom).  Both sides are cut to cells of about four units' size; a cell with over `dense` unit
    pieces is cut on, into as many as bring them to about that.  Pieces meet by cell, so no row carries a whole district, and the areas
    that pieces share are added up."""
    if cell is None:
        seg = boundary_segments(units)
        extent = seg.groupBy("node").agg((F.max(F.greatest("x0", "x1")) - F.min("x0")).alias("w"), (F.max(F.greatest("y0", "y1")) - F.min(F.least("y0", "y1"))).alias("h"))
        size = extent.agg(F.avg(F.greatest("w", "h"))).first()[0]
        cell = float(size or 1.0) * 4
    own = settle(tiled(units, ["node"], cell), "pieces")
    level = F.ceil(F.log2(F.col("n") / dense) / 2).cast("int")
    fine = settle(own.groupBy("cx", "cy").agg(F.count("*").alias("n")).select("cx", "cy", F.greatest(level, F.lit(0)).alias("level")), "cells")
    if fine.where("level > 0").isEmpty():
        a, b = own, tiled(plans, ["plan_id", "district"], cell).join(fine.select("cx", "cy"), ["cx", "cy"], "left_semi")
        on = ["cx", "cy"]
    else:
        on = ["level", "cx", "cy"]
        cut = lambda df, keys: tiled(df.join(fine, ["cx", "cy"]).withColumnsRenamed({"piece": "geom"}).drop("cx", "cy"), [*keys, "level"], F.lit(cell) / F.pow(F.lit(2.0), F.col("level")))
        a, b = cut(own, ["node"]), cut(tiled(plans, ["plan_id", "district"], cell), ["plan_id", "district"])
    pair = a.withColumnRenamed("piece", "pu").join(b.withColumnRenamed("piece", "pp"), on)

    @F.pandas_udf("double")
    def shared(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([g.overlap(bytes(p), bytes(q)) for p, q in zip(x, y, strict=True)], dtype="float64")

    area = pair.withColumn("shared", shared("pu", "pp")).groupBy("plan_id", "node", "district").agg(F.round(F.sum("shared"), 9).alias("shared")).where("shared > 0")
    best = area.groupBy("plan_id", "node").agg(F.min_by("district", F.struct(-F.col("shared"), F.col("district"))).alias("district"))
    every = units.select("node").join(F.broadcast(plans.select("plan_id").distinct()))  # a number a plan
    return every.join(best, ["plan_id", "node"], "left").select("plan_id", "node", "district")


# Dissolve

def outlines(assignment: DataFrame, units: DataFrame) -> DataFrame:
    """(plan_id, district, x0, y0, x1, y1): the directed segments around each district, the inside on the left: what its units share has gone."""
    inside = F.sum(F.when(F.col("forward"), 1).otherwise(-1))
    seg = large(assignment.where("district IS NOT NULL").select("plan_id", "node", "district")).join(coverage(units), "node").groupBy("plan_id", "district", *SEGMENT).agg(inside.alias("side")).where("side <> 0")
    turned = [F.when(F.col("side") > 0, F.col(a)).otherwise(F.col(b)).alias(a) for a, b in zip(SEGMENT, ["x1", "y1", "x0", "y0"], strict=True)]
    return seg.select("plan_id", "district", *turned)


def followed(seg: DataFrame) -> DataFrame:
    """seg (id, plan_id, district, ...) with the segment that follows each; where several go on from a vertex, the leftmost, so that rings touch and do not cross."""
    to = seg.select("plan_id", "district", F.col("x0").alias("x1"), F.col("y0").alias("y1"), F.col("x1").alias("x2"), F.col("y1").alias("y2"), F.col("id").alias("next"))
    ax, ay, bx, by = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    turn = F.atan2(ax * by - ay * bx, ax * bx + ay * by)
    both = seg.join(large(to), ["plan_id", "district", "x1", "y1"])
    return both.groupBy("id", "plan_id", "district", "x0", "y0").agg(F.max_by("next", turn).alias("next"))


def chained(t: pa.Table) -> pa.Table:
    """The segments of a cell joined to paths: a path's id is its first segment's, its next the segment after its last one; a ring has itself as next."""
    t = t.combine_chunks()
    ids, after = t["id"].to_numpy(), t["next"].to_numpy()
    xy = np.stack([t["x0"].to_numpy(), t["y0"].to_numpy()], axis=1)
    at = {int(i): k for k, i in enumerate(ids)}
    follows = np.array([at.get(int(i), -1) for i in after])
    first = np.ones(len(ids), bool)
    first[follows[follows >= 0]] = False
    seen = np.zeros(len(ids), bool)
    heads, nexts, points = [], [], []
    for start in [*np.flatnonzero(first).tolist(), *np.argsort(ids).tolist()]:
        if seen[start]:
            continue
        path, k = [], start
        while k >= 0 and not seen[k]:
            seen[k] = True
            path.append(k)
            k = follows[k]
        heads.append(int(ids[start]))
        nexts.append(int(after[path[-1]]))
        points.append(np.ascontiguousarray(xy[path]).tobytes())
    plan = t["plan_id"].chunk(0).take(pa.array([0] * len(heads)))
    return pa.table({"plan_id": plan, "district": pa.array([t["district"][0].as_py()] * len(heads), pa.string()), "id": pa.array(heads, pa.int64()), "next": pa.array(nexts, pa.int64()), "points": pa.array(points, pa.binary())})


def flat_points(x: pa.BinaryArray) -> np.ndarray:
    """The points of all paths of an array, without a copy."""
    offsets = np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1]
    return np.frombuffer(x.buffers()[2], float, (offsets[-1] - offsets[0]) // 8, offsets[0]).reshape(-1, 2) if len(x) else np.empty((0, 2))


def ringed(paths: DataFrame, most: int = 64) -> DataFrame:
    """paths (id, next, ...) with ring (the smallest id of its ring) and steps (to that one), by pointer jumping: each round doubles how far a path sees."""
    state = settle(paths.where("id <> next").select("id", F.col("next").alias("ahead"), F.col("id").alias("ring"), F.lit(0).cast("bigint").alias("steps")), "pointers")
    for k in range(most):
        there = state.select(F.col("id").alias("ahead"), F.col("ahead").alias("ahead_"), F.col("ring").alias("ring_"), F.col("steps").alias("steps_"))
        nearer = F.col("ring_") < F.col("ring")
        new = state.join(large(there), "ahead").select("id", F.col("ahead_").alias("ahead"), F.least("ring", "ring_").alias("ring"), F.when(nearer, F.col("steps_") + (1 << k)).otherwise(F.col("steps")).alias("steps"), nearer.alias("moved"))
        new = settle(new, "pointers")
        drop(state)
        state = new.drop("moved")
        if new.where("moved").isEmpty():
            break
    else:
        raise RuntimeError("the outlines do not close")
    return paths.join(large(state.select("id", "ring", "steps")), "id", "left").withColumns({"ring": F.coalesce("ring", "id"), "steps": F.coalesce("steps", F.lit(0))})


def dissolve(assignment: DataFrame, units: DataFrame, sums: list[str] | None = None, per_cell: int = CHAINED) -> DataFrame:
    """(plan_id, district, geom, sums): the union of each district's units.

    Segments that two units share cancel; those that are left are joined to paths cell by cell, and paths to rings by pointer
    jumping.  So no task holds more of a district than a cell's part of its outline, until the outline becomes the
    one value that it is."""
    kind = assignment.schema["plan_id"].dataType.simpleString()
    seg = settle(outlines(assignment, units), "outlines")
    seg = settle(seg.withColumn("id", F.monotonically_increasing_id()), "outlines")
    box = seg.agg(F.min("x0"), F.min("y0"), F.max("x0"), F.max("y0"), F.count("*")).first()
    cells = max(1, round((box[4] / per_cell) ** 0.5))
    wide = max(box[2] - box[0], box[3] - box[1]) / cells if box[4] else 1.0
    at = lambda c, low: F.floor((F.col(c) - F.lit(low)) / wide) if cells > 1 else F.lit(0)
    cell = [at("x0", box[0]).alias("cx"), at("y0", box[1]).alias("cy")]
    paths = followed(seg).groupBy("plan_id", "district", *cell).applyInArrow(chained, f"plan_id {kind}, district string, id bigint, next bigint, points binary")
    if cells > 1:
        paths = ringed(settle(paths, "paths"))
    else:
        paths = paths.withColumns({"ring": F.col("id"), "steps": F.lit(0).cast("bigint")})

    def run(t: pa.Table) -> pa.Table:
        keys = {c: t[c].combine_chunks().slice(0, 1) for c in ("plan_id", "district")}
        ring, steps = t["ring"].to_numpy(), t["steps"].to_numpy()
        sizes, points = pc.binary_length(t["points"]).to_numpy() // 16, [flat_points(x) for x in t["points"].chunks]
        del t
        xy = np.concatenate(points) if len(points) > 1 else points[0]
        del points
        order = np.lexsort((-steps, steps > 0, ring))  # the smallest id first, then from far to near
        begins = (np.cumsum(sizes) - sizes)[order]
        ring, sizes = ring[order], sizes[order].astype(np.int64)
        new = np.flatnonzero(np.diff(ring, prepend=ring[0] - 1))  # the first path of each ring
        length = np.add.reduceat(sizes, new)
        first = np.concatenate([[0], np.cumsum(length + 1)])  # a ring's first point comes again
        whose = np.cumsum(np.isin(np.arange(len(ring)), new)) - 1
        begin = np.cumsum(sizes) - sizes
        closed = np.empty((first[-1], 2))
        low = 0
        while low < len(ring):  # paths of about a million points at a time
            high = min(len(ring), max(low + 1, int(np.searchsorted(begin, begin[low] + (1 << 20)))))
            n, here = sizes[low:high], np.arange(begin[low], begin[high - 1] + sizes[high - 1])
            closed[here + np.repeat(whose[low:high], n)] = xy[here + np.repeat(begins[low:high] - begin[low:high], n)]
            low = high
        del xy, whose, begin
        closed[first[1:] - 1] = closed[first[:-1]]
        own = [closed]
        del closed, order, begins, ring, sizes, steps
        geom = g.assembled(own.pop, first)  # which lets go of the points
        return pa.table({**keys, "geom": pa.Array.from_buffers(pa.binary(), 1, [None, pa.array([0, len(geom)], pa.int32()).buffers()[1], pa.py_buffer(geom)])})

    paths = paths.select("plan_id", "district", "ring", "steps", "points")
    out = paths.groupBy("plan_id", "district").applyInArrow(run, f"plan_id {kind}, district string, geom binary")
    if sums:
        total = assignment.where("district IS NOT NULL").join(large(units.select("node", *sums)), "node").groupBy("plan_id", "district").agg(*(F.sum(c).alias(c) for c in sums))
        out = out.join(total, ["plan_id", "district"])
    return out
