"""Set-at-a-time evaluation of plans: populations, splits, elections and partisan metrics of every plan at once.

Inputs are long tables: units(node, totpop, ...), assignment(plan_id, node, district), votes(node, election, party, votes),
edges(u, v, shared_perim).  Districts are strings.  Every result is keyed by plan_id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import is_empty, ratio, region_mismatch
from ..shared import large

def by_plan():
    return Window.partitionBy("plan_id")


# Populations and areas

def tally(assignment: DataFrame, units: DataFrame, column: str, name: str | None = None) -> DataFrame:
    """The sum of a unit column in each district; partial sums leave the map side."""
    return assignment.join(units.select("node", column), "node").groupBy("plan_id", "district").agg(F.sum(column).alias(name or column))


def deviation(pops: DataFrame, pop: str = "totpop", ideal: float | None = None) -> DataFrame:
    """Signed difference from the ideal population (the plan's mean, unless given) and its share of that."""
    mean = F.lit(float(ideal)) if ideal is not None else F.avg(pop).over(by_plan())
    return pops.withColumn("ideal", mean).withColumn("pop_dev", F.col(pop) - F.col("ideal")).withColumn("rel_dev", ratio(F.abs("pop_dev"), "ideal"))


def deviation_summary(dev: DataFrame) -> DataFrame:
    """Of each plan: largest deviation, largest share, and log of the squared sum (-1 for a sum of 0)."""
    sse = F.sum(F.col("pop_dev") * F.col("pop_dev"))
    return dev.groupBy("plan_id").agg(F.max(F.abs("pop_dev")).alias("max_abs_dev"), F.max("rel_dev").alias("max_rel_dev"), F.when(sse <= 0, -1.0).otherwise(F.log(sse)).alias("log_sse"))


def ideal_population(units: DataFrame, districts: int, pop: str = "totpop") -> DataFrame:
    return units.agg(F.sum(pop).alias("total_pop"), (F.sum(pop) / F.lit(float(districts))).alias("ideal_pop"))


# Localities

def pieces_of(assignment: DataFrame, units: DataFrame, locality: str) -> DataFrame:
    """Distinct (plan, locality, district); a missing locality is one value of its own."""
    return assignment.join(units.select("node", locality), "node").select("plan_id", F.col(locality).cast("string").alias("locality"), "district").distinct()


def splits(assignment: DataFrame, units: DataFrame, locality: str) -> DataFrame:
    """num_parts, num_localities, split (in two districts or more), multi_split (in three or more), and multi_splits = parts - split - localities."""
    by = pieces_of(assignment, units, locality).groupBy("plan_id", "locality").agg(F.count("*").alias("n"))
    out = by.groupBy("plan_id").agg(F.sum("n").alias("num_parts"), F.count("*").alias("num_localities"), F.count_if(F.col("n") > 1).alias("split"), F.count_if(F.col("n") > 2).alias("multi_split"))
    return out.withColumn("multi_splits", F.col("num_parts") - F.col("split") - F.col("num_localities"))


def split_counts(assignment: DataFrame, units: DataFrame, localities: Sequence[str]) -> DataFrame:
    """split_<locality> of every plan, all from one pass; 0 for a locality that the units do not have."""
    there = [c for c in localities if c in units.columns]
    kinds = F.explode_outer(F.array(*(F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("locality")) for c in there)))
    own = assignment.join(units.select("node", *there), "node").select("plan_id", "district", kinds.alias("l")).select("plan_id", "district", "l.*") if there else assignment.select("plan_id", "district", F.lit("").alias("kind"), F.lit("").alias("locality"))
    many = own.distinct().groupBy("plan_id", "kind", "locality").agg(F.count("*").alias("n"))
    return many.groupBy("plan_id").agg(*(F.count_if((F.col("kind") == c) & (F.col("n") > 1)).alias(f"split_{c}") for c in localities))


def locality_names(units: DataFrame, locality: str, name: str) -> DataFrame:
    """The first name of each locality that is not empty, in node order; else its id."""
    named = units.where(~is_empty(locality)).groupBy(F.col(locality).cast("string").alias("locality")).agg(F.min_by(F.when(~is_empty(name), F.col(name)), F.when(~is_empty(name), F.col("node"))).alias("name"))
    return named.select("locality", F.coalesce("name", "locality").alias("name"))


def split_names(assignment: DataFrame, units: DataFrame, locality: str, name: str) -> DataFrame:
    """Names of the split localities of each plan, sorted."""
    many = pieces_of(assignment, units, locality).where(~is_empty("locality")).groupBy("plan_id", "locality").agg(F.count("*").alias("n")).where("n > 1")
    return many.join(locality_names(units, locality, name), "locality").groupBy("plan_id").agg(F.array_sort(F.collect_list("name")).alias("names"))


# Elections

def party_votes(assignment: DataFrame, votes: DataFrame) -> DataFrame:
    """Votes of each district, election and party, with statewide rows ('S'), in one pass of grouping sets.

    The label's first letter is the party."""
    joined = assignment.join(votes, "node").select("plan_id", "district", "election", F.substring("party", 1, 1).alias("party"), "votes")
    by = joined.groupBy("plan_id", "district", "election", "party").agg(F.sum("votes").alias("votes"))
    view = by.groupingSets([["plan_id", "district", "election", "party"], ["plan_id", "election", "party"]], "plan_id", "district", "election", "party")
    return view.agg(F.sum("votes").alias("votes"), F.grouping("district").alias("g")).select("plan_id", F.when(F.col("g") == 1, "S").otherwise(F.col("district")).alias("district"), "election", "party", "votes")


def label_votes(assignment: DataFrame, votes: DataFrame) -> DataFrame:
    """Votes of each district, election and label: candidates of one party stay apart."""
    return assignment.join(votes, "node").groupBy("plan_id", "district", "election", "label").agg(F.sum("votes").alias("votes"))


def wide_votes(long: DataFrame, total: str = "reference") -> DataFrame:
    """Parties side by side: d, r and total_votes, which is the third party's column, as the reference metrics have it, or with "all_votes" the sum of all."""
    wide = long.groupBy("plan_id", "district", "election").pivot("party", ["D", "R", "-"]).agg(F.avg("votes")).na.fill(0)
    if total not in ("reference", "all_votes"):
        raise ValueError("total has to be 'reference' or 'all_votes'")
    return wide.select("plan_id", "district", "election", F.col("D").alias("d"), F.col("R").alias("r"), (F.col("-") if total == "reference" else F.col("D") + F.col("R") + F.col("-")).alias("total_votes"))


def election_metrics(wide: DataFrame, zero: str = "null") -> DataFrame:
    """Vote shares, two-party indexes and share of the statewide vote, for each district and election."""
    state = F.max(F.when(F.col("district") == "S", F.col("total_votes"))).over(Window.partitionBy("plan_id", "election"))
    both = F.col("d") + F.col("r")
    return wide.select("plan_id", "district", "election", ratio("d", "total_votes", zero).alias("vote_share_d"), ratio("r", "total_votes", zero).alias("vote_share_r"), ratio("d", both, zero).alias("index_d"), ratio("r", both, zero).alias("index_r"), ratio("total_votes", state, zero).alias("statewide_prop"))


METRICS = ("vote_share_d", "vote_share_r", "index_d", "index_r", "statewide_prop")


def aggregate(metrics: DataFrame, method: str = "mean") -> DataFrame:
    """Each district's metrics over all elections, by mean or median."""
    if method not in ("mean", "median"):
        raise ValueError("the method has to be 'mean' or 'median'")
    f = F.avg if method == "mean" else F.median
    return metrics.groupBy("plan_id", "district").agg(*(f(c).alias(c) for c in METRICS))


def partisan(assignment: DataFrame, votes: DataFrame, method: str = "mean", total: str = "reference", zero: str = "null") -> DataFrame:
    """The aggregated table that all partisan metrics read: one row a district, and 'S'."""
    return aggregate(election_metrics(wide_votes(party_votes(assignment, votes), total), zero), method)


def by_majority(table: DataFrame) -> DataFrame:
    """Districts with the majority's and minority's index and the statewide index; the majority has the larger statewide vote share, D on a tie.

    One window over a plan carries the statewide row to its districts, so the table is shuffled once."""
    state = lambda c: F.max(F.when(F.col("district") == "S", F.col(c))).over(by_plan())
    d_leads = state("vote_share_d") >= state("vote_share_r")
    both = table.withColumn("majority", F.when(F.coalesce(d_leads, F.lit(True)), "D").otherwise("R")).withColumns({"s_index_d": state("index_d"), "s_index_r": state("index_r")})
    is_d = F.col("majority") == "D"
    return both.where("district <> 'S'").select("plan_id", "district", "majority", F.when(is_d, F.col("index_d")).otherwise(F.col("index_r")).alias("a"), F.when(is_d, F.col("index_r")).otherwise(F.col("index_d")).alias("b"), F.when(is_d, F.col("s_index_d")).otherwise(F.col("s_index_r")).alias("s_a"), "statewide_prop", "vote_share_d", "vote_share_r")


def partisan_summary(table: DataFrame) -> DataFrame:
    """All metrics of a plan in one aggregation: efficiency gap (majority less minority), both biases, mean less median, seats, and sample deviation."""
    rows = by_majority(table).withColumn("mean_a", F.avg("a").over(by_plan()))
    wasted = lambda c: F.when(F.col(c) > 0.5, F.col(c) - 0.5).otherwise(F.col(c)) * F.col("statewide_prop")
    swung = F.col("a") + (0.5 - F.col("s_a"))
    won = F.when(swung > 0.5, 1.0).when(swung < 0.5, 0.0).otherwise(0.5)
    return rows.groupBy("plan_id", "majority").agg(
        (F.sum(wasted("a")) - F.sum(wasted("b"))).alias("efficiency_gap"),
        (F.avg((F.col("a") > F.col("mean_a")).cast("double")) - 0.5).alias("partisan_bias"),
        (F.sum(won) - F.count("*") / 2.0).alias("partisan_bias_swing"),
        (F.avg("vote_share_d") - F.median("vote_share_d")).alias("mean_median_d"),
        (F.avg("vote_share_r") - F.median("vote_share_r")).alias("mean_median_r"),
        F.count_if(F.col("a") > 0.5).alias("majority_seats"),
        F.stddev_samp("a").alias("stdev_share"),
    )


def majority_shares(table: DataFrame) -> DataFrame:
    """Map of district to the majority's index, in key order."""
    from ..functions.columns import sorted_map

    return by_majority(table).groupBy("plan_id").agg(sorted_map(F.map_from_entries(F.collect_list(F.struct("district", "a")))).alias("shares"))


def election_results(long: DataFrame) -> DataFrame:
    """Of each plan, election and party: votes, share of all votes, districts won and seats (a tie wins for every party that shares it)."""
    rows = long.where("district <> 'S'").withColumn("top", F.max("votes").over(Window.partitionBy("plan_id", "district", "election")))
    out = rows.groupBy("plan_id", "election", "party").agg(F.sum("votes").alias("count"), F.count_if(F.col("votes") == F.col("top")).alias("wins"))
    return out.withColumn("percent", ratio("count", F.sum("count").over(Window.partitionBy("plan_id", "election"))))


# Edges and shapes

def edge_districts(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """Each edge with the districts of both ends in each plan: two equi-joins by sorting, never a theta join or a broadcast of plans or edges."""
    u, v = large(assignment.alias("au")), large(assignment.alias("av"))
    return edges.join(u, F.col("u") == F.col("au.node")).join(v, (F.col("v") == F.col("av.node")) & (F.col("au.plan_id") == F.col("av.plan_id"))).select(F.col("au.plan_id").alias("plan_id"), "u", "v", F.col("au.district").alias("district_u"), F.col("av.district").alias("district_v"), *(c for c in edges.columns if c not in ("u", "v")))


def cut_edges(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    return edge_districts(edges, assignment).where("district_u <> district_v")


def perimeter(edges: DataFrame, assignment: DataFrame, units: DataFrame) -> DataFrame:
    """Shared length of cut edges on both sides, and the outer boundary of the units."""
    cut = cut_edges(edges, assignment).select("plan_id", F.explode(F.array("district_u", "district_v")).alias("district"), F.col("shared_perim").alias("length"))
    outer = assignment.join(large(units.select("node", F.col("boundary_perim").alias("length"))), "node").select("plan_id", "district", "length")
    return cut.unionByName(outer).groupBy("plan_id", "district").agg(F.sum("length").alias("perimeter"))


def polsby_popper(areas: DataFrame, perimeters: DataFrame) -> DataFrame:
    return areas.join(perimeters, ["plan_id", "district"]).withColumn("polsby_popper", ratio(4 * F.pi() * F.col("area"), F.col("perimeter") * F.col("perimeter")))


def reock(assignment: DataFrame, units: DataFrame, vertices: DataFrame) -> DataFrame:
    """Area over the circle about the centre of the bounding box that holds every vertex; 0 without extent.

    vertices: (node, x, y).  Two aggregations, both with partial sums: extents, then the farthest vertex."""
    points = assignment.join(vertices, "node")
    box = points.groupBy("plan_id", "district").agg(((F.min("x") + F.max("x")) / 2).alias("cx"), ((F.min("y") + F.max("y")) / 2).alias("cy"))
    far = points.join(box, ["plan_id", "district"]).groupBy("plan_id", "district").agg(F.max(F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2)).alias("r2"))
    area = tally(assignment, units, "area")
    return area.join(far, ["plan_id", "district"]).withColumn("reock_score", F.coalesce(ratio("area", F.pi() * F.col("r2")), F.lit(0.0))).select("plan_id", "district", "reock_score")


# Identity of plans

def plan_hash(assignment: DataFrame, labelled: bool = False) -> DataFrame:
    """A hash of each plan, whatever its districts are called; with labels, of (node, district) pairs.

    Node hashes are summed (order does not matter and no list is gathered), then the few districts of a plan are sorted."""
    part = assignment.groupBy("plan_id", "district").agg(F.sum(F.xxhash64("node").cast("decimal(20,0)")).cast("decimal(38,0)").alias("s"), F.count("*").alias("n"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("x"))
    key = F.struct("s", "n", "x", "district") if labelled else F.struct("s", "n", "x")
    return part.groupBy("plan_id").agg(F.xxhash64(F.to_json(F.array_sort(F.collect_list(key)))).alias("assignment_hash"))


def distinct_fraction(hashes: DataFrame) -> DataFrame:
    if "assignment_hash" not in hashes.columns:
        raise KeyError("the share of distinct plans needs the column assignment_hash")
    return hashes.agg((F.count_distinct("assignment_hash") / F.count("*")).alias("distinct_fraction"))


# Predicates

def upper_bound(value: str | Column, limit: float) -> Column:
    """At most the limit; a missing value is not."""
    return F.coalesce((F.col(value) if isinstance(value, str) else value) <= limit, F.lit(False))


def all_of(predicates: list[Column]) -> Column:
    out = F.lit(True)
    for p in predicates:
        out = out & p
    return out


def differs_from_parent(hashes: DataFrame, chain: str = "chain_id", step: str = "step") -> DataFrame:
    """Whether each plan differs from the one a step before; the first of a chain does."""
    if "assignment_hash" not in hashes.columns:
        raise KeyError("the comparison with the parent needs the column assignment_hash")
    before = F.lag("assignment_hash").over(Window.partitionBy(chain).orderBy(step))
    return hashes.withColumn("differs", F.coalesce(F.col("assignment_hash") != before, F.lit(True)))


def flip_candidates(edges: DataFrame, assignment: DataFrame, pops: DataFrame, ideal: float, pop: str = "totpop") -> DataFrame:
    """Cut edges with a district that is a person or more off the ideal."""
    off = pops.select("plan_id", "district", (F.abs(F.col(pop) - F.lit(float(ideal))) >= 1).alias("off"))
    cut = cut_edges(edges, assignment)
    out = cut.join(off.select("plan_id", F.col("district").alias("district_u"), F.col("off").alias("off_u")), ["plan_id", "district_u"]).join(off.select("plan_id", F.col("district").alias("district_v"), F.col("off").alias("off_v")), ["plan_id", "district_v"])
    return out.where("off_u OR off_v").select("plan_id", "u", "v", "district_u", "district_v")


def edge_penalties(edges: DataFrame, units: DataFrame, weights: DataFrame | None, scale: float = 1.0, surcharges: dict[str, float] | None = None) -> DataFrame:
    """The penalty of each edge: scaled weight of its canonical key (0 without) and a surcharge for each region it crosses; surcharges of 0 or less do nothing."""
    out = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    penalty = F.lit(0.0)
    if weights is not None:
        out = out.join(weights.select("u", "v", "w"), ["u", "v"], "left")
        penalty = penalty + F.coalesce(F.col("w"), F.lit(0.0)) * scale
    own = {c: s for c, s in (surcharges or {}).items() if s > 0}
    for side in ("u", "v"):
        if own:
            out = out.join(units.select(F.col("node").alias(side), *(F.col(c).alias(f"{c}_{side}") for c in own)), side)
    for c, s in own.items():
        penalty = penalty + F.when(region_mismatch(f"{c}_u", f"{c}_v"), s).otherwise(0.0)
    return out.select("u", "v", penalty.alias("penalty"))


def modal_neighbour(edges: DataFrame, assignment: DataFrame) -> DataFrame:
    """For each unassigned node, the district most of its neighbours are in, the smallest on a tie."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    empty = assignment.where("district IS NULL").select("plan_id", F.col("node").alias("u"))
    near = empty.join(both, "u").join(assignment.where("district IS NOT NULL").select("plan_id", F.col("node").alias("v"), "district"), ["plan_id", "v"])
    n = near.groupBy("plan_id", "u", "district").agg(F.count("*").alias("n"))
    return n.groupBy("plan_id", F.col("u").alias("node")).agg(F.min_by("district", F.struct(-F.col("n"), F.col("district"))).alias("district"))


def transfer(coarse: DataFrame, nesting: DataFrame) -> DataFrame:
    """An assignment of coarse units moved to the fine units that nest in them; a fine unit without a coarse one has neither plan nor district."""
    return nesting.select("fine", F.col("coarse").alias("node")).join(coarse, "node", "left").select("plan_id", F.col("fine").alias("node"), "district")
