"""Chains of plans and optimisers: sequential within a chain, parallel over chains.

A run is a table of chains; each is one task, which reads the graph from the shared folder.  Evaluation is not done
here: the assignments that come out are evaluated set-at-a-time by `ensemble`.
"""

from __future__ import annotations

import functools
import math
import warnings
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import place, settle
from .kernels import Constraint, Graph, StoredGraph, is_contiguous, max_deviation, rng_of, stored_plan

Proposal = Callable[[Graph, np.ndarray, np.random.Generator], np.ndarray]
Score = Callable[[Graph, np.ndarray], float]
#: Rows that a chain hands on at once.
ROWS = 1 << 16


@dataclass
class Scheme:
    """neutral, tilted (accept worse with probability p), short_bursts (of `burst` steps) or coupon_collector (micro steps for each yield)."""

    kind: str = "neutral"
    score: Score | None = None
    maximize: bool = False
    p: float = 0.0
    burst: int = 100
    micro: int = 1

    def __post_init__(self) -> None:
        if self.kind not in ("neutral", "tilted", "short_bursts", "coupon_collector"):
            raise ValueError(f"unknown scheme {self.kind!r}")
        if self.kind in ("tilted", "short_bursts") and self.score is None:
            raise ValueError(f"{self.kind} needs a score")
        if not isinstance(self.micro, int) or not isinstance(self.burst, int):
            raise TypeError("steps are whole numbers")


def proposed(g, state, propose: Callable, constraints: Sequence[Constraint], rng, tries: int = 1000):
    """The next proposal that meets all constraints; after too many that do not, the state itself, or ValueError where that breaks one too."""
    for _ in range(tries):
        new = propose(g, state, rng)
        if all(c(g, new, state) for c in constraints):
            return new
    if all(c(g, state, state) for c in constraints):
        return state
    raise ValueError(f"none of {tries} proposals meets the constraints, nor does the state they come from")


def walk(g, state, propose: Callable, constraints: Sequence[Constraint], scheme: Scheme, steps: int, rng) -> Iterator:
    """The states of a run; the first is the initial one.  A coupon collector yields the last of each `micro` states."""
    if scheme.kind == "coupon_collector":
        inner = Scheme("neutral")
        for k, s in enumerate(walk(g, state, propose, constraints, inner, steps * scheme.micro, rng)):
            if k % scheme.micro == scheme.micro - 1:
                yield s
        return
    better = lambda a, b: a >= b if scheme.maximize else a <= b
    own = scheme.score(g, state) if scheme.score else 0.0
    best, best_state = own, state
    for k in range(steps):
        if k:
            if scheme.kind == "short_bursts" and k % scheme.burst == 0:
                state, own = best_state, best
            new = proposed(g, state, propose, constraints, rng)
            if scheme.kind == "tilted":
                value = scheme.score(g, new)
                if better(value, own) or rng.random() < scheme.p:
                    state, own = new, value
            else:
                state = new
                if scheme.score:
                    own = scheme.score(g, state)
        if scheme.score and better(own, best):
            best, best_state = own, state
        yield state


def codes(districts: pd.Series) -> tuple[np.ndarray, list[str]]:
    """District numbers in text order; -1 for none."""
    names = sorted({str(d) for d in districts if d is not None and d == d})
    at = {d: i for i, d in enumerate(names)}
    return np.array([at[str(d)] if d is not None and d == d else -1 for d in districts], np.int64), names


def loader(spark: SparkSession, g: Graph | StoredGraph) -> Callable[[], Graph]:
    """What gives a task the graph: a stored one is read, one that is at hand is broadcast."""
    if isinstance(g, StoredGraph):
        return g.load
    sent = spark.sparkContext.broadcast(g)
    return lambda: sent.value


def run_chains(spark: SparkSession, g: Graph | StoredGraph, initial: DataFrame, chains: Sequence[int], propose: Proposal, constraints: Sequence[Constraint] = (is_contiguous,), scheme: Scheme | None = None, steps: int = 10, seed: int = 0, spacing: int = 1, polish: tuple[Sequence[Goal], Sequence[Callable], Sequence[dict]] | None = None) -> DataFrame:
    """(chain_id, step, node, district) of every spacing-th state of each chain, from one initial plan (node, district).

    polish: metrics, proposals and configurations of lexicographic(), which then optimises every state that is returned; the
    chain goes on from the state before, with random numbers of its own."""
    scheme = scheme or Scheme()
    load, start = loader(spark, g), place(spark, "start")
    initial.select(F.col("node").cast("bigint").alias("node"), F.col("district").cast("string").alias("district")).write.parquet(start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [c for b in batches for c in b.column(0).to_pylist()]
        if not own:
            return
        g = load()
        label, names = stored_plan(start, g.ids)
        named = pa.array([*names, None], pa.string())
        for chain in own:
            for k, s in enumerate(walk(g, label, propose, constraints, scheme, steps, rng_of(seed, chain))):
                if k % spacing:
                    continue
                if polish:
                    s = lexicographic(g, s, *polish, constraints, np.random.default_rng([seed & 0x7FFFFFFF, chain & 0x7FFFFFFF, k]))[0]
                for i in range(0, len(s), ROWS):
                    part = s[i : i + ROWS]
                    full = lambda x: pa.array(np.full(len(part), x, np.int64))  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([full(chain), full(k), pa.array(g.ids[i : i + ROWS], pa.int64()), named.take(pa.array(np.where(part < 0, len(names), part)))], ["chain_id", "step", "node", "district"])

    own = list(dict.fromkeys(int(c) for c in chains))
    ids = spark.createDataFrame(list(enumerate(own)), "at int, chain_id bigint")
    # A task each; a worker holds one state, however many steps there are.
    return ids.repartitionById(max(1, len(own)), "at").select("chain_id").mapInArrow(run, "chain_id bigint, step bigint, node bigint, district string")


def partition(units: DataFrame, plan: DataFrame, repair: bool = True, edges: DataFrame | None = None) -> DataFrame:
    """(plan_id, node, district) of plans given as polygons: units go to the district that covers most of them, torn districts are mended if asked, and what stays torn is warned of.

    Without `edges`, units that share a boundary are neighbours."""
    from .regions import repaired, torn
    from .spatial import adjacency, assign

    edges = settle(adjacency(units) if edges is None else edges.select("u", "v"), "edges")
    own = settle(assign(units, plan).select("plan_id", "node", "district"), "assigned")
    if not repair or (own.where("district IS NULL").isEmpty() and torn(own, edges).isEmpty()):
        return own
    mended = repaired(own, edges)
    if n := torn(mended, edges).count():
        warnings.warn(f"{n} plans have torn districts after repair: see the plan and the units for gaps", stacklevel=2)
    return mended


# Optimisers

class Goal:
    """A score that a phase of an optimisation makes small, or with `up` large; it is turned round once, here, and only losses are compared.

    Losses up to `slack` apart count as equal.  `enough` ends a phase when the score is beyond it, `closed` also when it is within slack of it."""

    def __init__(self, score: Score, up: bool = False, slack: float = 0.0, enough: float | None = None, closed: bool = False):
        sign = -1.0 if up else 1.0
        self.loss = lambda g, s: sign * score(g, s)
        self.slack = slack
        margin = slack + 1e-12 if closed else 0.0
        self.reached = (lambda loss: False) if enough is None else (lambda loss: loss - sign * enough < margin)


def order(goals: Sequence[Goal], new: Sequence[float], old: Sequence[float]) -> int:
    """1, 0 or -1: whether losses are better, as good, or worse; the first goal that tells them apart decides."""
    apart = (old_ - new_ for goal, new_, old_ in zip(goals, new, old, strict=False) if abs(old_ - new_) > goal.slack)
    return int(np.sign(next(apart, 0.0)))


def lexicographic(g, state, goals: Sequence[Goal], proposals: Sequence[Callable], configs: Sequence[dict], constraints: Sequence[Constraint], rng):
    """The state and its losses after a phase for each goal, in order; a phase may not lose what the goals before it have reached.  Of equally good states the latest is kept."""
    if len({len(goals), len(proposals), len(configs)}) > 1:
        raise ValueError("each goal needs a proposal and a configuration")
    losses = lambda s: [goal.loss(g, s) for goal in goals]

    def phase(start: tuple, k: int) -> tuple:
        best, at = start
        config = {"method": "short_bursts", "burst": 10, "steps": 50, **configs[k]}
        keeps = lambda g_, new, before: order(goals[:k], losses(new), start[1]) >= 0
        run = walk(g, best, proposals[k], [*constraints, keeps][: len(constraints) + bool(k)], Scheme(config["method"], goals[k].loss, burst=config["burst"]), config["steps"], rng)
        for s in run:
            if order(goals[: k + 1], own := losses(s), at) >= 0:
                best, at = s, own
                if goals[k].reached(own[k]):
                    break
        return best, at

    return functools.reduce(phase, range(len(goals)), (state, losses(state)))


def anneal(g, state, propose: Callable, constraints: Sequence[Constraint], score: Score, steps: int, rng, hot: int = 0, beta: float = 1.0, scale: float = 100.0, done: Callable[[object], bool] | None = None):
    """Accept a worse state with probability exp(-beta * scale * change); beta rises in a line from 0 after `hot` steps.  The first best state is kept."""
    own = score(g, state)
    best, best_state = own, state
    for k in range(steps):
        b = 0.0 if k < hot else beta * (k - hot + 1) / max(1, steps - hot)
        new = proposed(g, state, propose, constraints, rng, 100)
        value = score(g, new)
        power = b * scale * (value - own)
        if value <= own or rng.random() < math.exp(-min(power, 700.0)):
            state, own = new, value
        if own < best:
            best, best_state = own, state
            if done is not None and done(best_state):
                break
    return best_state, best


def precondition(g, state, propose: Callable, objective: Score, constraints: Sequence[Constraint], rng, steps: int = 50, attempts: int = 1):
    """Bursts of five on the objective, tried again from the best state until all constraints hold."""
    best, value = state, objective(g, state)
    for _ in range(attempts):
        for s in walk(g, best, propose, [is_contiguous], Scheme("short_bursts", objective, burst=5), 5 * math.ceil(steps / 5), rng):
            own = objective(g, s)
            if own <= value:
                best, value = s, own
        if all(c(g, best, None) for c in constraints):
            break
    return best


@dataclass
class Escalation:
    """Preconditioning that raises a region's surcharge by a factor while its split count is over the ceiling."""

    ceilings: dict[str, int] = field(default_factory=dict)
    factor: float = 1.25
    most: float = 10.0

    def __call__(self, g, state, recom, objective, rng, steps: int = 50, attempts: int = 5):
        from .kernels import split_counts

        for _ in range(attempts):
            state = precondition(g, state, recom, objective, [], rng, steps)
            over = [r for r, c in self.ceilings.items() if split_counts(g, state, r)[0] > c]
            if not over:
                break
            for r in over:
                recom.surcharges[r] = min(self.most, recom.surcharges.get(r, 1.0) * self.factor)
        return state


def equal_population(spark: SparkSession, g: Graph | StoredGraph, seeds: DataFrame, wanted: int, propose: Proposal, score: Score, ideal: float, steps: int, seed: int = 0, within: float = 1.0, runs: int = 5, at_once: int | None = None, **options) -> DataFrame:
    """(candidate_id, score, success, node, district): candidate plans annealed, in parallel; the first `wanted` of those whose districts are all less than `within` people off the ideal.

    seeds: (candidate_id, node, district).  Candidates go in waves, in order, of `at_once` (as many as are wanted); no wave starts once
    enough have come through.  A run that fails is replaced by another with random numbers of its own, up to `runs`."""
    load = loader(spark, g)

    def run(df: pd.DataFrame) -> pd.DataFrame:
        g = load()
        c = int(df["candidate_id"].iloc[0])
        label, names = codes(df.set_index("node")["district"].reindex(g.ids))
        for k in range(runs):
            rng = rng_of(seed, c) if not k else np.random.default_rng([seed & 0x7FFFFFFF, c & 0x7FFFFFFF, k])
            best, value = anneal(g, label, propose, [is_contiguous], score, steps, rng, done=lambda s: max_deviation(g, s, ideal) < within, **options)
            if max_deviation(g, best, ideal) < within:
                break
        return pd.DataFrame({"candidate_id": c, "score": value, "success": max_deviation(g, best, ideal) < within, "node": g.ids, "district": np.array(names, object)[best]})

    schema = "candidate_id bigint, score double, success boolean, node bigint, district string"
    every = [r[0] for r in seeds.select("candidate_id").distinct().orderBy("candidate_id").collect()]  # a number a candidate
    size = at_once or max(1, wanted)
    out, chosen = spark.createDataFrame([], schema), []
    for k in range(0, len(every), size):
        if len(chosen) >= wanted:
            break
        wave = settle(seeds.where(F.col("candidate_id").isin(every[k : k + size])).groupBy("candidate_id").applyInPandas(run, schema), "wave")
        chosen += sorted(r[0] for r in wave.where("success").select("candidate_id").distinct().collect())
        out = out.union(wave)
    return out.where(F.col("candidate_id").isin(chosen[:wanted]))
