"""Graph kernels on flat arrays: what is sequential by nature runs here, one chain or plan a task.

Random numbers come from the seed and the chain alone, so results do not depend on how rows are partitioned.
"""

from __future__ import annotations

import math
import tempfile
from array import array
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow.parquet as pq
from pyarrow import fs

from ..shared import large, place


@dataclass
class Graph:
    """Units as positions 0..n-1: ids, populations, canonical edges, region codes (-1: none) and edge penalties."""

    ids: np.ndarray
    pop: np.ndarray
    u: np.ndarray
    v: np.ndarray
    regions: dict[str, np.ndarray] = field(default_factory=dict)
    penalty: np.ndarray | None = None

    def __post_init__(self) -> None:
        if self.penalty is None:
            self.penalty = np.zeros(len(self.u))


@dataclass
class StoredGraph:
    """A graph in the shared folder, nodes and edges in order: who needs it reads it there, and the driver holds none of it.

    A task maps its arrays from files, as two chains may run in one executor."""

    nodes: str
    edges: str
    regions: tuple[str, ...] = ()
    penalties: bool = False

    def load(self) -> Graph:
        n, read = rows_of(self.nodes)
        ids, pop, code = mapped(n, np.int64), mapped(n, np.float64), {c: [] for c in self.regions}
        for a, b, t in read(["node", "totpop", *self.regions]):
            ids[a:b], pop[a:b] = t["node"].to_numpy(), t["totpop"].to_numpy()
            for c in self.regions:
                code[c].append(t[c].combine_chunks().dictionary_encode())
        m, read = rows_of(self.edges)
        u, v, penalty = mapped(m, np.int32), mapped(m, np.int32), mapped(m, np.float64) if self.penalties else None
        for a, b, t in read(["u", "v", *["penalty"] * self.penalties]):
            u[a:b], v[a:b] = np.searchsorted(ids, t["u"].to_numpy()), np.searchsorted(ids, t["v"].to_numpy())
            if self.penalties:
                penalty[a:b] = t["penalty"].to_numpy()
        return Graph(ids, pop, u, v, {c: region_codes(x) for c, x in code.items()}, penalty)


def mapped(n: int, kind: type) -> np.ndarray:
    """An array in a file without a name, which goes with it: the system may drop its pages and read them again."""
    if not n:
        return np.empty(0, kind)
    with tempfile.TemporaryFile() as f:
        return np.asarray(np.memmap(f, kind, "w+", shape=(n,)))


def rows_of(path: str):
    """How many rows a stored table has, and a reader of its files in order: (first row, row after the last, table)."""
    store, root = fs.FileSystem.from_uri(path)
    files = sorted(x.path for x in store.get_file_info(fs.FileSelector(root)) if x.path.endswith(".parquet"))

    def read(columns: list[str]):
        at = 0
        for f in files:
            with store.open_input_file(f) as file:
                own = pq.ParquetFile(file)
                for k in range(own.num_row_groups):
                    t = own.read_row_group(k, columns)
                    yield at, at + len(t), t
                    at += len(t)

    def count(f: str) -> int:
        with store.open_input_file(f) as file:
            return pq.ParquetFile(file).metadata.num_rows

    return sum(map(count, files)), read


def stored_plan(plan: str, ids: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """District numbers in text order of a stored plan (node, district), -1 for none, and the districts' names."""
    n, read = rows_of(plan)
    node, own, names = np.empty(n, np.int64), np.empty(n, np.int32), {}
    for a, b, t in read(["node", "district"]):
        x = t["district"].combine_chunks().dictionary_encode()
        at = np.array([names.setdefault(d, len(names)) for d in x.dictionary.to_pylist()] + [-1], np.int32)
        node[a:b], own[a:b] = t["node"].to_numpy(), at[x.indices.fill_null(-1).to_numpy()]
    order = np.argsort(node, kind="stable")
    if (np.diff(node[order]) == 0).any():
        raise ValueError("a unit has several districts in one plan")
    rank = np.array([sorted(names).index(d) for d in names] + [-1], np.int32)  # a plan's districts are few
    label = np.full(len(ids), -1, np.int32)
    if n:
        at = np.minimum(np.searchsorted(node[order], ids), n - 1)
        label = np.where(node[order][at] == ids, rank[own[order][at]], np.int32(-1))
    return label, sorted(names)


def region_codes(parts: list) -> np.ndarray:
    """Numbers of values in text order, -1 for missing and blank ones; parts: dictionary arrays."""
    blank = lambda x: x is None or str(x).strip() in ("", "nan")
    values = {x: i for i, x in enumerate(sorted({x for p in parts for x in p.dictionary.to_pylist() if not blank(x)}, key=str))}
    own = [np.array([values.get(x, -1) for x in p.dictionary.to_pylist()] + [-1], np.int32)[p.indices.fill_null(-1).to_numpy()] for p in parts]
    return np.concatenate(own) if own else np.empty(0, np.int32)


def stored_graph(units, edges, regions: tuple[str, ...] = (), penalties=None, most: int = 50_000_000) -> StoredGraph:
    """The graph of unit and edge tables, written in order for the tasks that walk on it; a state has some 100,000 units, and `most` rows is checked."""
    n = units.count()
    if n > most:
        raise ValueError(f"{n} units are more than the {most} that a task's graph may have; run the state in parts")
    spark = units.sparkSession
    nodes, pairs = place(spark, "graph-nodes"), place(spark, "graph-edges")
    units.select("node", "totpop", *regions).orderBy("node").write.parquet(nodes)
    e = edges.select("u", "v") if penalties is None else edges.select("u", "v").join(large(penalties), ["u", "v"], "left").fillna(0.0, ["penalty"])
    e.orderBy("u", "v").write.parquet(pairs)
    return StoredGraph(nodes, pairs, tuple(regions), penalties is not None)


def rng_of(seed: int, chain: int) -> np.random.Generator:
    return np.random.default_rng([seed & 0x7FFFFFFF, chain & 0x7FFFFFFF])


def components(g: Graph, label: np.ndarray) -> np.ndarray:
    """A component number for each node: nodes that edges within one label join.  Labels spread by minima, with jumps; edges inside a component drop out."""
    root = np.arange(len(g.ids), dtype=g.u.dtype)
    inner = label[g.u] == label[g.v]
    a, b = g.u[inner], g.v[inner]
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))  # a and b are roots
        root = jumped(root)
        a = root[a]
        b = root[b]
        apart = a != b
        a, b = a[apart], b[apart]
    return root


def jumped(to: np.ndarray) -> np.ndarray:
    """Where pointers end that lead to ends which point to themselves."""
    while True:
        jump = to[to]
        if (jump == to).all():
            return jump
        to = jump


def contiguous(g: Graph, label: np.ndarray) -> bool:
    root = components(g, label)
    return np.count_nonzero(root == np.arange(len(root))) == len(np.unique(label))


def spanning_tree(g: Graph, nodes: np.ndarray, edges: np.ndarray, rng: np.random.Generator, surcharges: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """The lightest tree over uniform weights plus surcharges for crossed regions plus edge penalties, as ends of its edges, places in nodes.

    Each component takes its lightest edge outwards, all at once, round after round; ties go by the edges' order."""
    w = rng.random(len(edges))
    w += g.penalty[edges]
    for c, s in surcharges.items():
        a, b = g.regions[c][g.u[edges]], g.regions[c][g.v[edges]]
        w += s * ((a != b) | (a < 0) | (b < 0))
    own = edges[np.argsort(w, kind="stable")]
    del w
    where = np.empty(len(g.ids), np.int32)
    where[nodes] = np.arange(len(nodes), dtype=np.int32)
    ends = where[g.u[own]], where[g.v[own]]
    del where, own
    a, b, k = *ends, np.arange(len(edges), dtype=np.int32)  # live edges: their components and ranks
    taken = np.zeros(len(edges), bool)
    n = len(nodes)
    while len(k):
        lightest = np.full(n, -1, np.int32)  # a place in k: what is written last stays
        back = np.arange(len(k), dtype=np.int32)[::-1]
        lightest[a[::-1]] = back
        other = np.full(n, len(k), np.int32)
        other[b[::-1]] = back
        lightest = np.where(lightest < 0, other, np.minimum(lightest, other))
        live = np.flatnonzero(lightest < len(k))
        edge = lightest[live]
        taken[k[edge]] = True
        to = np.arange(n, dtype=np.int32)
        to[live] = np.where(a[edge] == live, b[edge], a[edge])
        both = (to[to[live]] == live) & (live < to[live])  # two that chose the same edge
        to[live[both]] = live[both]
        to = jumped(to)
        a, b = to[a], to[b]
        apart = a != b
        a, b, k = a[apart], b[apart], k[apart]
    return ends[0][taken], ends[1][taken]


def balanced_cut(g: Graph, nodes: np.ndarray, tree: tuple[np.ndarray, np.ndarray], target: float, epsilon: float, rng: np.random.Generator) -> np.ndarray | None:
    """One side of a tree edge whose removal leaves both sides within epsilon of the target; None without such an edge."""
    a, b = tree
    n = len(nodes)
    degree = np.bincount(a, minlength=n) + np.bincount(b, minlength=n)
    root = int(degree.argmax())
    degree[root] += n  # stays
    # Leaves go one after another; the sum of a leaf's neighbours, those gone taken off, is its parent.
    left, up = array("q", degree.astype("q").tobytes()), array("q", (np.bincount(a, b, n) + np.bincount(b, a, n)).astype("q").tobytes())
    below = array("d", g.pop[nodes].astype("d").tobytes())
    del degree
    for x in range(n):
        while left[x] == 1:
            y = up[x]
            left[x] = -1
            left[y] -= 1
            up[y] -= x
            below[y] += below[x]
            x = y
    alone = np.frombuffer(left, np.int64) != -1
    parent = np.where(alone, np.arange(n), np.frombuffer(up, np.int64)).astype(np.int32)
    size = np.frombuffer(below)
    slack = epsilon * target
    good = np.flatnonzero((np.abs(size - target) <= slack) & (np.abs(size[root] - size - target) <= slack) & ~alone)
    if len(a) < n - 1:  # no tree of all nodes
        good = good[jumped(parent)[good] == root]
    if not len(good):
        return None
    top = good[int(rng.integers(len(good)))]
    parent[top] = top
    return nodes[jumped(parent) == top]


@dataclass
class Recom:
    """Merge two neighbouring districts and split them anew along a random spanning tree."""

    target: float
    epsilon: float
    surcharges: dict[str, float] = field(default_factory=dict)
    attempts: int = 1000
    trees: int = 30
    #: u, v (node ids, u under v) and penalty of edges, instead of the graph's own penalties.
    weights: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def weighed(self, g: Graph) -> Graph:
        """g with this proposal's penalties; edges that it does not name have none."""
        if self.weights is None or not len(self.weights[0]):
            return g
        if getattr(self, "seen", (None, None))[0] is not g:
            pair = np.dtype([("u", np.int64), ("v", np.int64)])
            own, named = np.empty(len(g.u), pair), np.empty(len(self.weights[0]), pair)
            own["u"], own["v"] = np.minimum(g.ids[g.u], g.ids[g.v]), np.maximum(g.ids[g.u], g.ids[g.v])
            named["u"], named["v"] = self.weights[:2]
            order = np.argsort(named)
            at = np.minimum(np.searchsorted(named[order], own), len(named) - 1)
            self.seen = g, replace(g, penalty=np.where(named[order][at] == own, np.asarray(self.weights[2], float)[order][at], 0.0))
        return self.seen[1]

    def __call__(self, g: Graph, label: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        """The new labels; the old ones where no attempt finds a balanced cut."""
        g = self.weighed(g)
        cut = np.flatnonzero(label[g.u] != label[g.v])
        left = self.attempts
        while left > 0 and len(cut):
            k = int(cut[rng.integers(len(cut))])
            a, b = label[g.u[k]], label[g.v[k]]
            mine = (label == a) | (label == b)
            nodes, edges = np.flatnonzero(mine).astype(np.int32), np.flatnonzero(mine[g.u] & mine[g.v]).astype(np.int32)
            for _ in range(min(self.trees, left)):  # then another pair
                left -= 1
                side = balanced_cut(g, nodes, spanning_tree(g, nodes, edges, rng, self.surcharges), self.target, self.epsilon, rng)
                if side is not None:
                    new = label.copy()
                    new[nodes], new[side] = b, a
                    return new
        return label


@dataclass
class PopulationFlip:
    """One end of a random cut edge that touches a district a person or more off the ideal joins the other's district."""

    ideal: float

    def __call__(self, g: Graph, label: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        off = np.abs(np.bincount(label, g.pop) - self.ideal) >= 1
        a, b = label[g.u], label[g.v]
        cut = np.flatnonzero((a != b) & (off[a] | off[b]))
        return flipped(g, label, cut, rng)


@dataclass
class BoundaryFlip:
    """One end of any random cut edge joins the other's district."""

    def __call__(self, g: Graph, label: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        return flipped(g, label, np.flatnonzero(label[g.u] != label[g.v]), rng)


def flipped(g: Graph, label: np.ndarray, cut: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    if not len(cut):
        return label
    k = int(cut[rng.integers(len(cut))])
    x, y = (g.u[k], g.v[k]) if rng.integers(2) else (g.v[k], g.u[k])
    new = label.copy()
    new[x] = label[y]
    return new


Constraint = Callable[[Graph, np.ndarray, np.ndarray | None], bool]


def is_contiguous(g: Graph, label: np.ndarray, before: np.ndarray | None) -> bool:
    return contiguous(g, label)


def same_plan(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two plans are equal but for their districts' names."""
    pairs = np.unique(np.stack([a, b], 1), axis=0)
    return len(pairs) == len(np.unique(a)) == len(np.unique(b))


def not_equal(g: Graph, label: np.ndarray, before: np.ndarray | None) -> bool:
    return before is None or not same_plan(label, before)


def split_counts(g: Graph, label: np.ndarray, region: str) -> tuple[int, int]:
    """Split localities, and parts - split - localities."""
    pairs = np.unique(np.stack([g.regions[region], label], 1), axis=0)
    n = np.unique(pairs[:, 0], return_counts=True)[1]
    split = int((n > 1).sum())
    return split, len(pairs) - split - len(n)


@dataclass
class SplitBound:
    region: str
    most: int | None = None
    multi: int | None = None

    def __call__(self, g: Graph, label: np.ndarray, before: np.ndarray | None) -> bool:
        split, multi = split_counts(g, label, self.region)
        return (self.most is None or split <= self.most) and (self.multi is None or multi <= self.multi)


def max_deviation(g: Graph, label: np.ndarray, ideal: float) -> float:
    return float(np.abs(np.bincount(label, g.pop)[np.unique(label)] - ideal).max())


def log_sse(g: Graph, label: np.ndarray, ideal: float) -> float:
    sse = float(((np.bincount(label, g.pop)[np.unique(label)] - ideal) ** 2).sum())
    return math.log(sse) if sse > 0 else -1.0


@dataclass
class PreconditionObjective:
    """Squared excess of the relative deviation over the tolerance, of each split count over its ceiling and of each count of multiple splits over its own; and 1 for the plan that the result has to differ from."""

    ideal: float
    tolerance: float
    ceilings: dict[str, int] = field(default_factory=dict)
    multi: dict[str, int] = field(default_factory=dict)
    apart_from: np.ndarray | None = None

    def __call__(self, g: Graph, label: np.ndarray) -> float:
        over = lambda value, ceiling: max(0.0, value - ceiling) ** 2
        counts = sum(over(split_counts(g, label, r)[k], c) for k, own in enumerate((self.ceilings, self.multi)) for r, c in own.items())
        same = self.apart_from is not None and not not_equal(g, label, self.apart_from)
        return over(max_deviation(g, label, self.ideal) / self.ideal / self.tolerance, 1) + counts + float(same)
