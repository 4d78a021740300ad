"""Polygons in WKB on numpy: what the engine needs of geometry, without a geometry library.

Rings are closed; a polygon's first ring is its outside, the others are holes.  Both byte orders are read.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable, Iterable, Iterator

import numpy as np

Rings = list[np.ndarray]


def polygons(wkb: bytes) -> list[Rings]:
    """The polygons of a WKB Polygon or MultiPolygon."""
    return list(each_polygon(wkb))


def each_ring(wkb: bytes) -> Iterator[tuple[bool, np.ndarray]]:
    """Every ring, and whether a polygon begins with it."""
    at, left = 0, 1
    while left:  # geometries still to come
        left -= 1
        order = "<" if wkb[at] else ">"
        kind, n = struct.unpack_from(order + "II", wkb, at + 1)
        at += 9
        if kind == 3:
            for k in range(n):
                size, = struct.unpack_from(order + "I", wkb, at)
                yield k == 0, np.frombuffer(wkb, order + "f8", 2 * size, at + 4).reshape(-1, 2)
                at += 4 + 16 * size
        elif kind == 6:
            left += n
        else:
            raise ValueError(f"WKB kind {kind} is neither a polygon nor several")


def each_polygon(wkb: bytes) -> Iterator[Rings]:
    """The polygons one after another, so that none is held longer than it is needed."""
    rings: Rings = []
    for begins, r in each_ring(wkb):
        if begins and rings:
            yield rings
            rings = []
        rings.append(r.astype(float))
    if rings:
        yield rings


def flat(wkb: bytes, some: int = 10_000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The points of all rings, where each ring begins, with the end of the last, and whether it is a polygon's outside."""
    views, done, sizes, outer = [], [], [0], []
    for begins, r in each_ring(wkb):
        views.append(r)
        sizes.append(len(r))
        outer.append(begins)
        if len(views) == some:
            done.append(np.concatenate(views))
            views = []
    return np.concatenate([np.empty((0, 2)), *done, *views]), np.cumsum(sizes), np.array(outer, bool)


def wkb(rings: Rings) -> bytes:
    out = [struct.pack("<BII", 1, 3, len(rings))]
    for r in rings:
        out += [struct.pack("<I", len(r)), np.ascontiguousarray(r, "<f8").tobytes()]
    return b"".join(out)


def multipolygon(parts: list[Rings]) -> bytes:
    return struct.pack("<BII", 1, 6, len(parts)) + b"".join(wkb(p) for p in parts)


def areas(xy: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The signed area of each closed ring."""
    x, y = xy.T
    cross = np.zeros(len(xy))
    cross[:-1] = x[:-1] * y[1:] - x[1:] * y[:-1]
    cross[first[1:] - 1] = 0.0  # from a ring to the next
    n = np.diff(first)
    return np.bincount(np.repeat(np.arange(len(n)), n), cross, len(n)) / 2


def homes(xy: np.ndarray, first: np.ndarray, size: np.ndarray, holes: np.ndarray, outer: np.ndarray, most: int = 1 << 20) -> np.ndarray:
    """The smallest outer ring around each hole, as a place in outer, -1 without one; both are numbers of rings, size their areas.

    A hole is where a place just beside the middle of its first edge is.  Edges of outer rings lie in strips about as high as they are,
    so a place meets the edges of its own strips alone, `most` pairs at a time."""
    if not len(holes) or not len(outer):
        return np.full(len(holes), -1)
    outer_size = np.abs(size[outer])
    rank = np.argsort(outer_size, kind="stable")
    a, b = xy[first[holes]], xy[first[holes] + 1]
    px, py = (a[:, 0] + b[:, 0]) / 2 + (b[:, 1] - a[:, 1]) * 1e-9, (a[:, 1] + b[:, 1]) / 2 - (b[:, 0] - a[:, 0]) * 1e-9
    lengths = np.maximum(np.diff(first)[outer[rank]] - 1, 0)
    start = np.repeat(first[outer[rank]] - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())
    owner = np.repeat(np.arange(len(outer), dtype=np.int32), lengths)
    level = xy[start, 1] != xy[start + 1, 1]  # a level edge is crossed by none
    start, owner = start[level], owner[level]
    low, high = np.minimum(xy[start, 1], xy[start + 1, 1]), np.maximum(xy[start, 1], xy[start + 1, 1])
    height = np.ceil(np.log2(high - low)).astype(np.int16)
    met = [np.empty((2, 0), np.int64)]
    for h in np.unique(height).tolist():
        own = np.flatnonzero(height == h)
        strip, top = np.floor(low[own] / 2.0**h), np.floor(high[own] / 2.0**h)
        twice = top > strip
        strip, own = np.concatenate([strip, top[twice]]), np.concatenate([own, own[twice]])
        order = np.argsort(strip, kind="stable")
        strip, own = strip[order], own[order]
        here = np.floor(py / 2.0**h)
        begin, n = np.searchsorted(strip, here), np.searchsorted(strip, here, "right") - np.searchsorted(strip, here)
        total, k = np.concatenate([[0], np.cumsum(n)]), 0
        while k < len(n):
            to = max(k + 1, int(np.searchsorted(total, total[k] + most, "right")) - 1)
            hole = np.repeat(np.arange(k, to), n[k:to])
            edge = own[np.repeat(begin[k:to] - (total[k:to] - total[k]), n[k:to]) + np.arange(len(hole))]
            (x0, y0), (x1, y1), y = xy[start[edge]].T, xy[start[edge] + 1].T, py[hole]
            crossed = (y0 > y) != (y1 > y)
            with np.errstate(divide="ignore", invalid="ignore"):
                crossed &= px[hole] < (x1 - x0) * (y - y0) / (y1 - y0) + x0
            met.append(np.stack([hole[crossed], owner[edge[crossed]]]))
            k = to
    hole, ring = np.concatenate(met, axis=1)
    pair, times = np.unique(hole * len(outer) + ring, return_counts=True)
    pair = pair[times % 2 == 1]
    hole, ring = pair // len(outer), pair % len(outer)
    fits = outer_size[rank[ring]] > np.abs(size[holes[hole]])
    hole, ring = hole[fits], ring[fits]
    found = np.full(len(holes), -1)
    found[hole[::-1]] = rank[ring[::-1]]  # the smallest is written last
    return found


def packed(xy: np.ndarray, first: np.ndarray, outer: np.ndarray, holes: np.ndarray, home: np.ndarray) -> bytearray:
    """WKB of the polygons of outer rings and the holes whose home (a place in outer) they are; holes of none are left out."""
    order = np.argsort(home, kind="stable")
    begin, end = np.searchsorted(home[order], np.arange(len(outer))), np.searchsorted(home[order], np.arange(len(outer)), "right")
    size = lambda rings: 4 * len(rings) + 16 * int((first[rings + 1] - first[rings]).sum())
    at = 0 if len(outer) == 1 else 9
    out = bytearray(at + 9 * len(outer) + size(outer) + size(holes[(home >= 0) & (home < len(outer))]))
    if at:
        struct.pack_into("<BII", out, 0, 1, 6, len(outer))
    points = memoryview(np.ascontiguousarray(xy, "<f8")).cast("B") if len(xy) else b""
    for k, (a, b) in zip(outer.tolist(), zip(begin.tolist(), end.tolist(), strict=True), strict=True):
        struct.pack_into("<BII", out, at, 1, 3, 1 + b - a)
        at += 9
        for ring in (k, *holes[order[a:b]].tolist()):
            begins, ends = int(first[ring]), int(first[ring + 1])
            struct.pack_into("<I", out, at, ends - begins)
            out[at + 4 : at + 4 + 16 * (ends - begins)] = points[16 * begins : 16 * ends]
            at += 4 + 16 * (ends - begins)
    return out


def box(x0: float, y0: float, x1: float, y1: float) -> bytes:
    return wkb([np.array([(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)], float)])


def ring_area(r: np.ndarray) -> float:
    return float((r[:-1, 0] * r[1:, 1] - r[1:, 0] * r[:-1, 1]).sum() / 2)


def area(g: bytes) -> float:
    xy, first, outer = flat(g)
    size = np.abs(areas(xy, first))
    return float(size[outer].sum() - size[~outer].sum())


def segments(geoms: Iterable[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Boundary segments of many polygons: the place of each one's polygon, and (x0, y0, x1, y1) with the inside on the left."""
    at, out = [], []
    for k, geom in enumerate(geoms):
        for p in polygons(bytes(geom)) if geom is not None else ():
            for hole, r in enumerate(p):
                r = r if (ring_area(r) > 0) != bool(hole) else r[::-1]
                own = np.hstack([r[:-1], r[1:]])
                own = own[(own[:, :2] != own[:, 2:]).any(axis=1)]
                at.append(np.full(len(own), k))
                out.append(own)
    return (np.concatenate(at), np.concatenate(out)) if out else (np.empty(0, int), np.empty((0, 4)))


def clip(subject: np.ndarray, convex: np.ndarray) -> np.ndarray:
    """Sutherland-Hodgman: a simple ring cut by a convex one."""
    if ring_area(convex) < 0:
        convex = convex[::-1]
    out = subject[:-1]
    for a, b in zip(convex[:-1], convex[1:], strict=True):
        if not len(out):
            break
        side = (b[0] - a[0]) * (out[:, 1] - a[1]) - (b[1] - a[1]) * (out[:, 0] - a[0])
        kept = []
        for i in range(len(out)):
            j = i - 1
            if (side[i] >= 0) != (side[j] >= 0):
                t = side[j] / (side[j] - side[i])
                kept.append(out[j] + t * (out[i] - out[j]))
            if side[i] >= 0:
                kept.append(out[i])
        out = np.array(kept).reshape(-1, 2)
    return np.vstack([out, out[:1]]) if len(out) else np.empty((0, 2))


def fan(ring: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """Triangles that, counted with their signs, cover a simple ring once; a convex ring is one piece."""
    if ring_area(ring) < 0:
        ring = ring[::-1]
    step = np.diff(ring, axis=0)
    turn = step[:, 0] * np.roll(step[:, 1], -1) - step[:, 1] * np.roll(step[:, 0], -1)
    if (turn >= 0).all():
        yield ring, 1.0
        return
    for a, b in zip(ring[1:-2], ring[2:-1], strict=True):
        piece = np.array([ring[0], a, b, ring[0]])
        if (size := ring_area(piece)) != 0:
            yield piece, math.copysign(1.0, size)


def overlap(unit: bytes, plan: bytes) -> float:
    """The area that two polygons share, whatever their shape; holes of either are taken out."""
    total = 0.0
    for u in polygons(unit):
        pieces = [(piece, sign * (-1 if k else 1)) for k, r in enumerate(u) for piece, sign in fan(r)]
        for p in polygons(plan):
            for k, r in enumerate(p):
                for piece, sign in pieces:
                    cut = clip(r, piece)
                    if len(cut) > 3:
                        total += sign * abs(ring_area(cut)) * (-1 if k else 1)
    return total


def half(ring: np.ndarray, axis: int, at: float, above: bool) -> np.ndarray:
    """A closed ring cut by a line across an axis: the side from `at` on, or up to it."""
    side = ring[:, axis] - at if above else at - ring[:, axis]
    if (side >= 0).all():
        return ring
    if (side <= 0).all():
        return ring[:0]
    a, b = ring[:-1], ring[1:]
    here, there = side[:-1], side[1:]
    crossing = (here < 0) != (there < 0)
    with np.errstate(divide="ignore", invalid="ignore"):
        cut = a + (here / (here - there))[:, None] * (b - a)
    cut[:, axis] = at
    both = np.empty((2 * len(a), 2))
    both[::2], both[1::2] = a, cut
    keep = np.empty(2 * len(a), bool)
    keep[::2], keep[1::2] = here >= 0, crossing
    out = both[keep]
    return np.vstack([out, out[:1]]) if len(out) else out


def tiles(rings: Rings, size: float, x: tuple[int, int] | None = None, y: tuple[int, int] | None = None) -> Iterator[tuple[int, int, Rings]]:
    """A polygon cut to the cells of a grid: (column, row, rings).  The range of columns and rows is halved until one cell is left, so a long outline is not gone through for each cell."""
    if x is None:
        low, high = rings[0].min(axis=0), rings[0].max(axis=0)
        (x0, y0), (x1, y1) = np.floor(low / size).astype(int).tolist(), np.floor(high / size).astype(int).tolist()
        x, y = (x0, x1), (y0, y1)
    if x[0] == x[1] and y[0] == y[1]:
        yield x[0], y[0], rings
        return
    axis = 0 if x[1] - x[0] >= y[1] - y[0] else 1
    low, high = (x, y)[axis]
    middle = (low + high + 1) // 2
    for above, own in ((False, (low, middle - 1)), (True, (middle, high))):
        part = [r for r in (half(r, axis, middle * size, above) for r in rings) if len(r) > 3 and ring_area(r) != 0]
        if part:
            yield from tiles(part, size, own if axis == 0 else x, own if axis else y)


def simple(ring: np.ndarray) -> Iterator[np.ndarray]:
    """A closed ring cut where it touches itself."""
    if len(np.unique(ring[:-1], axis=0)) == len(ring) - 1:
        yield ring
        return
    path: list[tuple] = []
    at: dict[tuple, int] = {}
    for p in map(tuple, ring.tolist()):
        if p in at:
            k = at[p]
            yield np.array([*path[k:], p])
            for q in path[k + 1 :]:
                del at[q]
            del path[k + 1 :]
        else:
            at[p] = len(path)
            path.append(p)


def assembled(xy: np.ndarray | Callable[[], np.ndarray], first: np.ndarray, some: int = 1 << 20) -> bytearray:
    """One geometry of closed rings with the inside on the left (all points, and where each ring begins, with the end of the last): a hole goes to the smallest ring around it.  Points that come from a function are held by nothing else."""
    xy = xy() if callable(xy) else xy
    n = np.diff(first)
    touching = np.zeros(len(n), bool)
    low = 0
    while low < len(n):  # about `some` points at a time
        high = min(len(n), max(low + 1, int(np.searchsorted(first, first[low] + some))))
        part, ring = xy[first[low] : first[high]], np.repeat(np.arange(low, high), n[low:high])
        inner = np.ones(len(part), bool)
        inner[first[low + 1 : high + 1] - 1 - first[low]] = False  # a ring's last point is its first
        part, ring = part[inner], ring[inner]
        at = np.lexsort((part[:, 1], part[:, 0], ring))
        part, ring = part[at], ring[at]
        touching[ring[1:][(ring[1:] == ring[:-1]) & (part[1:] == part[:-1]).all(axis=1)]] = True
        low = high
    if touching.any():
        parts, sizes, k = [], [], 0
        for t in [*np.flatnonzero(touching).tolist(), len(n)]:
            if t > k:
                parts.append(xy[first[k] : first[t]])
                sizes += n[k:t].tolist()
            if t < len(n):
                own = list(simple(xy[first[t] : first[t + 1]]))
                parts += own
                sizes += map(len, own)
            k = t + 1
        xy, first = np.concatenate(parts), np.cumsum([0, *sizes])
        del parts, sizes
    size = areas(xy, first)
    outer = np.flatnonzero(size > 0)
    outer = outer[np.argsort(size[outer], kind="stable")][::-1]
    holes = np.flatnonzero(size < 0)
    return packed(xy, first, outer, holes, homes(xy, first, size, holes, outer))
