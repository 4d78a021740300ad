"""The registry of the engine's own queries over the projected tables, each with its DuckDB twin where SQL has one."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as fc
from ..operators import ensemble as e
from ..operators import regions as rg
from ..operators import results as r
from ..shared import large, place, settle
from ..streaming import steps as st
from . import projection as p

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
W = p.WIDTH


def query(sql: str | None = None, tables: str = p.SQL) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = (f"WITH {tables} " if tables else "") + sql
        return f

    return add


ALL = p.SQL + "," + p.PARTISAN
STEPS = ALL + "," + p.STEPS


def rounded(df: DataFrame, *names: str, to: int = 8) -> DataFrame:
    return df.withColumns({c: F.round(c, to) for c in names})


def plans(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return p.assignment(s, d), p.units(s, d)


# Populations

@query("SELECT plan_id, district, sum(totpop)::BIGINT AS totpop FROM assignment JOIN units USING (node) GROUP BY ALL")
def population_tally(s, d):
    return e.tally(*plans(s, d), "totpop")


@query("SELECT plan_id, district, sum(area) AS area FROM assignment JOIN units USING (node) GROUP BY ALL")
def area_tally(s, d):
    return e.tally(*plans(s, d), "area")


@query("SELECT plan_id, district, n::BIGINT AS totpop, round(n - avg(n) OVER w, 8) AS pop_dev, round(abs(n - avg(n) OVER w) / avg(n) OVER w, 8) AS rel_dev FROM (SELECT plan_id, district, sum(totpop) AS n FROM assignment JOIN units USING (node) GROUP BY ALL) WINDOW w AS (PARTITION BY plan_id)")
def population_deviation(s, d):
    return rounded(e.deviation(e.tally(*plans(s, d), "totpop")).drop("ideal"), "pop_dev", "rel_dev")


@query("SELECT plan_id, round(max(abs(dev)), 8) AS max_abs_dev, round(max(abs(dev) / ideal), 8) AS max_rel_dev, round(CASE WHEN sum(dev * dev) <= 0 THEN -1 ELSE ln(sum(dev * dev)) END, 8) AS log_sse FROM (SELECT plan_id, n - avg(n) OVER (PARTITION BY plan_id) AS dev, avg(n) OVER (PARTITION BY plan_id) AS ideal FROM (SELECT plan_id, district, sum(totpop) AS n FROM assignment JOIN units USING (node) GROUP BY ALL)) GROUP BY plan_id")
def deviation_summary(s, d):
    return rounded(e.deviation_summary(e.deviation(e.tally(*plans(s, d), "totpop"))), "max_abs_dev", "max_rel_dev", "log_sse")


@query(f"SELECT sum(totpop)::BIGINT AS total_pop, round(sum(totpop) / {p.DISTRICTS}.0, 8) AS ideal_pop FROM units")
def ideal_population(s, d):
    return rounded(e.ideal_population(p.units(s, d), p.DISTRICTS), "ideal_pop")


# Localities

SPLITS = "SELECT plan_id, sum(n)::BIGINT AS num_parts, count(*) AS num_localities, count(*) FILTER (n > 1) AS split, count(*) FILTER (n > 2) AS multi_split, (sum(n) - count(*) FILTER (n > 1) - count(*))::BIGINT AS multi_splits FROM (SELECT plan_id, {0}, count(DISTINCT district) AS n FROM assignment JOIN units USING (node) GROUP BY ALL) GROUP BY plan_id"


@query(SPLITS.format("county"))
def county_splits(s, d):
    return e.splits(*plans(s, d), "county")


@query(SPLITS.format("muni"))
def muni_splits(s, d):
    return e.splits(*plans(s, d), "muni")


@query("SELECT plan_id, array_to_string(list_sort(list(name)), ',') AS names FROM (SELECT plan_id, muni FROM assignment JOIN units USING (node) GROUP BY ALL HAVING count(DISTINCT district) > 1) JOIN (SELECT muni, min_by(name, node) AS name FROM units GROUP BY muni) USING (muni) GROUP BY plan_id")
def split_names(s, d):
    a, u = plans(s, d)
    return e.split_names(a, u, "muni", "name").select("plan_id", F.array_join("names", ",").alias("names"))


@query("SELECT muni AS locality, min_by(name, node) AS name FROM units GROUP BY ALL")
def locality_names(s, d):
    return e.locality_names(p.units(s, d), "muni", "name")


# Elections

@query("SELECT plan_id, district, election, party, votes::BIGINT AS votes FROM long", ALL)
def party_votes(s, d):
    return e.party_votes(p.assignment(s, d), p.votes(s, d))


@query("SELECT plan_id, district, election, round(vote_share_d, 8) AS vote_share_d, round(vote_share_r, 8) AS vote_share_r, round(index_d, 8) AS index_d, round(index_r, 8) AS index_r, round(statewide_prop, 8) AS statewide_prop FROM em", ALL)
def election_metrics(s, d):
    return rounded(e.election_metrics(e.wide_votes(e.party_votes(p.assignment(s, d), p.votes(s, d)))), *e.METRICS)


@query("SELECT plan_id, district, round(vote_share_d, 8) AS vote_share_d, round(vote_share_r, 8) AS vote_share_r, round(index_d, 8) AS index_d, round(index_r, 8) AS index_r, round(statewide_prop, 8) AS statewide_prop FROM agg", ALL)
def partisan_mean(s, d):
    return rounded(e.partisan(p.assignment(s, d), p.votes(s, d)), *e.METRICS)


@query("SELECT plan_id, district, round(median(vote_share_d), 8) AS vote_share_d, round(median(vote_share_r), 8) AS vote_share_r, round(median(index_d), 8) AS index_d, round(median(index_r), 8) AS index_r, round(median(statewide_prop), 8) AS statewide_prop FROM em GROUP BY ALL", ALL)
def partisan_median(s, d):
    return rounded(e.partisan(p.assignment(s, d), p.votes(s, d), "median"), *e.METRICS)


@query("SELECT plan_id, majority, round(sum((CASE WHEN a > 0.5 THEN a - 0.5 ELSE a END) * w) - sum((CASE WHEN b > 0.5 THEN b - 0.5 ELSE b END) * w), 8) AS efficiency_gap, count(*) FILTER (a > 0.5) AS majority_seats FROM seats GROUP BY ALL", ALL)
def efficiency_gap(s, d):
    return rounded(e.partisan_summary(e.partisan(p.assignment(s, d), p.votes(s, d))).select("plan_id", "majority", "efficiency_gap", "majority_seats"), "efficiency_gap")


@query("SELECT plan_id, majority, round(sum((CASE WHEN a > 0.5 THEN a - 0.5 ELSE a END) * w) - sum((CASE WHEN b > 0.5 THEN b - 0.5 ELSE b END) * w), 8) AS efficiency_gap, round(avg((a > m)::INT) - 0.5, 8) AS partisan_bias, round(sum(CASE WHEN a + 0.5 - s > 0.5 THEN 1 WHEN a + 0.5 - s < 0.5 THEN 0 ELSE 0.5 END) - count(*) / 2.0, 8) AS partisan_bias_swing, round(avg(vote_share_d) - median(vote_share_d), 8) AS mean_median_d, round(avg(vote_share_r) - median(vote_share_r), 8) AS mean_median_r, count(*) FILTER (a > 0.5) AS majority_seats, round(stddev_samp(a), 8) AS stdev_share FROM (SELECT *, avg(a) OVER (PARTITION BY plan_id) AS m FROM seats) GROUP BY ALL", ALL)
def partisan_summary(s, d):
    return rounded(e.partisan_summary(e.partisan(p.assignment(s, d), p.votes(s, d))), "efficiency_gap", "partisan_bias", "partisan_bias_swing", "mean_median_d", "mean_median_r", "stdev_share")


@query("SELECT plan_id, district, round(a, 8) AS share FROM seats", ALL)
def majority_shares(s, d):
    m = e.majority_shares(e.partisan(p.assignment(s, d), p.votes(s, d)))
    return rounded(m.select("plan_id", F.explode("shares").alias("district", "share")), "share")


@query("SELECT plan_id, election, party, n::BIGINT AS count, wins, round(n / sum(n) OVER (PARTITION BY plan_id, election), 8) AS percent FROM (SELECT plan_id, election, party, sum(votes) AS n, count(*) FILTER (votes = top) AS wins FROM (SELECT *, max(votes) OVER (PARTITION BY plan_id, district, election) AS top FROM by_party) GROUP BY ALL)", ALL)
def election_results(s, d):
    return rounded(e.election_results(e.party_votes(p.assignment(s, d), p.votes(s, d))), "percent")


# Edges and shapes

ED = ", ed AS (SELECT a.plan_id, e.u, e.v, a.district AS district_u, b.district AS district_v FROM edges e JOIN assignment a ON a.node = e.u JOIN assignment b ON b.node = e.v AND b.plan_id = a.plan_id)"
PER = ED + f", bounds AS (SELECT node, 4.0 - count(u) AS boundary_perim FROM units LEFT JOIN (SELECT u FROM edges UNION ALL SELECT v FROM edges) ON u = node GROUP BY node), per AS (SELECT plan_id, district, sum(l) AS perimeter FROM (SELECT plan_id, unnest([district_u, district_v]) AS district, 1.0 AS l FROM ed WHERE district_u <> district_v UNION ALL SELECT plan_id, district, boundary_perim FROM assignment JOIN bounds USING (node)) GROUP BY ALL)"


@query("SELECT plan_id, count(*) AS n FROM ed WHERE district_u <> district_v GROUP BY ALL", p.SQL + ED)
def cut_edges(s, d):
    return e.cut_edges(p.edges(s, d), p.assignment(s, d)).groupBy("plan_id").agg(F.count("*").alias("n"))


@query("SELECT plan_id, district, perimeter::DOUBLE AS perimeter FROM per", p.SQL + PER)
def perimeter(s, d):
    return e.perimeter(p.edges(s, d), p.assignment(s, d), p.with_boundary(s, d))


@query("SELECT plan_id, district, round(4 * pi() * count(*) / (perimeter * perimeter), 8) AS polsby_popper FROM assignment JOIN per USING (plan_id, district) GROUP BY plan_id, district, perimeter", p.SQL + PER)
def polsby_popper(s, d):
    a, u = p.assignment(s, d), p.with_boundary(s, d)
    return rounded(e.polsby_popper(e.tally(a, u, "area"), e.perimeter(p.edges(s, d), a, u)).select("plan_id", "district", "polsby_popper"), "polsby_popper")


@query("SELECT plan_id, district, round(area / (pi() * max(r2)), 8) AS reock_score FROM (SELECT b.plan_id, b.district, b.area, unnest([pow(x - cx, 2) + pow(y - cy, 2), pow(x + 1 - cx, 2) + pow(y - cy, 2), pow(x - cx, 2) + pow(y + 1 - cy, 2), pow(x + 1 - cx, 2) + pow(y + 1 - cy, 2)]) AS r2 FROM assignment a JOIN units USING (node) JOIN (SELECT plan_id, district, count(*) AS area, (min(x) + max(x) + 1) / 2.0 AS cx, (min(y) + max(y) + 1) / 2.0 AS cy FROM assignment JOIN units USING (node) GROUP BY ALL) b ON a.plan_id = b.plan_id AND a.district = b.district) GROUP BY plan_id, district, area")
def reock(s, d):
    from ..operators.spatial import vertices

    return rounded(e.reock(p.assignment(s, d), p.units(s, d), vertices(p.geometry(s, d))), "reock_score")


@query("SELECT u, v, shared_perim FROM edges")
def adjacency(s, d):
    from ..operators.spatial import adjacency as adj

    return adj(p.geometry(s, d))


@query("SELECT node, (4.0 - count(u))::DOUBLE AS boundary_perim FROM units LEFT JOIN (SELECT u FROM edges UNION ALL SELECT v FROM edges) ON u = node GROUP BY node")
def boundary_perimeter(s, d):
    from ..operators.spatial import boundary_perimeter as f

    return f(p.geometry(s, d))


@query(f"SELECT 0::BIGINT AS plan_id, node, CAST(x // {W // p.DISTRICTS} AS VARCHAR) AS district FROM units")
def spatial_assignment(s, d):
    from ..functions.geometry import box
    from ..operators.spatial import assign

    step = W // p.DISTRICTS
    top = float(p.units(s, d).agg(F.max("y")).first()[0] + 1)
    polygons = s.createDataFrame([(0, str(k), bytearray(box(k * step, 0, (k + 1) * step, top))) for k in range(p.DISTRICTS)], "plan_id bigint, district string, geom binary")
    return assign(p.geometry(s, d), polygons)


@query(f"SELECT CAST(x // {W // p.DISTRICTS} AS VARCHAR) AS district, sum(totpop)::BIGINT AS totpop, round(count(*), 6)::DOUBLE AS area FROM units GROUP BY ALL")
def dissolve(s, d):
    from ..operators.spatial import dissolve as f
    from ..operators.spatial import with_area

    return with_area(f(p.stripes(s, d), p.geometry(s, d), ["totpop"])).select("district", "totpop", F.round("area", 6).alias("area"))


@query("SELECT u, v, (CASE WHEN a.county <> b.county THEN 0.5 * 2 + 0.25 ELSE 0 END + CASE WHEN a.muni <> b.muni THEN 0.125 ELSE 0 END)::DOUBLE AS penalty FROM edges JOIN units a ON a.node = u JOIN units b ON b.node = v")
def edge_penalties(s, d):
    return e.edge_penalties(p.edges(s, d), p.units(s, d), p.weights(s, d), 2.0, {"county": 0.25, "muni": 0.125, "segment": 0})


@query("SELECT plan_id, u, v, district_u, district_v FROM ed JOIN pops x USING (plan_id) JOIN pops y USING (plan_id) WHERE district_u <> district_v AND x.district = district_u AND y.district = district_v AND (abs(x.n - 2500) >= 1 OR abs(y.n - 2500) >= 1)", p.SQL + ED + ", pops AS (SELECT plan_id, district, sum(totpop) AS n FROM assignment JOIN units USING (node) GROUP BY ALL)")
def flip_candidates(s, d):
    a, u = plans(s, d)
    return e.flip_candidates(p.edges(s, d), a, e.tally(a, u, "totpop"), 2500)


@query("SELECT plan_id, node, district FROM (SELECT *, row_number() OVER (PARTITION BY plan_id, node ORDER BY n DESC, district) AS k FROM (SELECT plan_id, u AS node, district, count(*) AS n FROM (SELECT u, v FROM edges UNION ALL SELECT v, u FROM edges) JOIN assignment a ON a.node = v WHERE u % 10 = 0 AND v % 10 <> 0 GROUP BY ALL)) WHERE k = 1")
def modal_neighbour(s, d):
    a = p.assignment(s, d).withColumn("district", F.when(F.col("node") % 10 != 0, F.col("district")))
    return e.modal_neighbour(p.edges(s, d), a)


@query("SELECT plan_id, c_custkey AS node, district FROM customer LEFT JOIN assignment a ON a.node = c_custkey // 2 * 2")
def transfer(s, d):
    nesting = p.units(s, d).select(F.col("node").alias("fine"), F.expr("node div 2 * 2").alias("coarse"))
    return e.transfer(p.assignment(s, d).where("node % 2 = 0"), nesting)


# Identity and predicates

@query("SELECT round(count(DISTINCT h) / count(*), 8) AS distinct_fraction FROM (SELECT plan_id, list_sort(list(part)) AS h FROM (SELECT plan_id, district, list_sort(list(node)) AS part FROM assignment GROUP BY ALL) GROUP BY ALL)")
def distinct_plans(s, d):
    return rounded(e.distinct_fraction(e.plan_hash(p.assignment(s, d))), "distinct_fraction")


@query("SELECT plan_id AS step, (plan_id = 0 OR h <> lag(h) OVER (ORDER BY plan_id)) AS differs FROM (SELECT plan_id, list_sort(list(part)) AS h FROM (SELECT plan_id, district, list_sort(list(node)) AS part FROM assignment GROUP BY ALL) GROUP BY ALL)")
def not_equal_to_parent(s, d):
    h = e.plan_hash(p.assignment(s, d)).select(F.lit(0).alias("chain_id"), F.col("plan_id").alias("step"), "assignment_hash")
    return e.differs_from_parent(h).select("step", "differs")


@query("SELECT plan_id FROM (SELECT plan_id, county, count(DISTINCT district) AS n FROM assignment JOIN units USING (node) GROUP BY ALL) GROUP BY plan_id HAVING count(*) FILTER (n > 1) <= 25 AND sum(n) - count(*) FILTER (n > 1) - count(*) <= 60")
def split_bounds(s, d):
    x = e.splits(*plans(s, d), "county")
    return x.where(e.all_of([e.upper_bound("split", 25), e.upper_bound("multi_splits", 60)])).select("plan_id")


# Columns

@query("SELECT node, CASE WHEN node % 7 = 0 THEN CAST(m + row_number() OVER (PARTITION BY node % 7 = 0 ORDER BY node) AS VARCHAR) ELSE county END AS county FROM units, (SELECT max(county::INT) FILTER (node % 7 <> 0) AS m FROM units)")
def fill_empty_ids(s, d):
    u = p.units(s, d).select("node", F.when(F.col("node") % 14 == 0, F.lit(" ")).when(F.col("node") % 7 == 0, None).otherwise(F.col("county")).alias("county"))
    return fc.fill_empty_ids(u, ["county"])


@query("SELECT node, coalesce(totpop, 0)::DOUBLE + CASE WHEN node % 3 = 0 THEN 0 ELSE acctbal END AS total FROM units")
def total_column(s, d):
    u = p.units(s, d).withColumn("text", F.when(F.col("node") % 3 == 0, "none").otherwise(F.col("acctbal").cast("string")))
    return fc.add_total(u, "total", ["totpop", "text", "missing"]).select("node", "total")


@query("SELECT c_custkey AS node, election, label, substr(label, 1, 1) AS party, votes::DOUBLE AS votes FROM customer, (VALUES ('2020PRE', 'D1', 1), ('2020PRE', 'R1', 2), ('2020PRE', 'R2', 3), ('2024GOV', '-1', 4)) t(election, label, k), LATERAL (SELECT (c_custkey * k) % 11 AS votes)", "")
def melted_votes(s, d):
    names = {"G20PREDAAA": 1, "G20PRERBBB": 2, "G20PRERCCC": 3, "G24GOVNDDD": 4, "G20USPX": 5, "OTHER": 6}
    u = p.read(s, d, "customer").select(F.col("c_custkey").alias("node"), *((F.col("c_custkey") * k % 11).alias(n) for n, k in names.items()))
    return fc.melt_votes(u, fc.election_labels(u.columns, [2020, 2024], ["PRE", "GOV"]))


# Results

@query("SELECT step, metric, rank, round(value, 8) AS value FROM ranked", STEPS)
def ranked_entries(s, d):
    return rounded(r.rank_entries(p.long_steps(s, d), "share").select("step", "metric", F.col("rank").cast("bigint").alias("rank"), "value"), "value")


WIDE = ", ".join(f"round(max(value) FILTER (rank = {k} AND metric = '{m}'), 8) AS {m}_{k}" for m in ("share", "population") for k in range(p.DISTRICTS))


@query(f"SELECT step, {WIDE} FROM ranked GROUP BY step", STEPS)
def ranked_wide(s, d):
    w = r.widen(r.rank_entries(p.long_steps(s, d), "share"), ["share", "population"], p.DISTRICTS)
    return rounded(w, *(c for c in w.columns if c != "step"))


@query("SELECT metric, rank, round(avg(value), 8) AS mean FROM ranked GROUP BY ALL", STEPS)
def ranked_means(s, d):
    return rounded(r.ranked_means(r.rank_entries(p.long_steps(s, d), "share")).withColumn("rank", F.col("rank").cast("bigint")), "mean")


@query("SELECT step, round(sqrt(avg(pow(value - m, 2))), 8) AS rmd FROM (SELECT *, avg(value) OVER (PARTITION BY rank) AS m FROM ranked WHERE metric = 'share') GROUP BY step", STEPS)
def ranked_deviation(s, d):
    return rounded(r.ranked_deviation(r.rank_entries(p.long_steps(s, d), "share"), "share"), "rmd")


@query("SELECT metric, rank, round(quantile_cont(value, 0.5), 8) AS median, round(quantile_cont(value, 0.025), 8) AS q0, round(quantile_cont(value, 0.975), 8) AS q1 FROM ranked GROUP BY ALL", STEPS)
def quantile_intervals(s, d):
    x = r.intervals(r.rank_entries(p.long_steps(s, d), "share"), ["metric", "rank"])
    return rounded(x.withColumn("rank", F.col("rank").cast("bigint")), "median", "q0", "q1")


@query("SELECT metric, step, key, round(value - median(value) OVER (PARTITION BY metric), 8) AS from_median FROM steps", STEPS)
def deviation_from_median(s, d):
    return rounded(r.from_median(p.long_steps(s, d), ["metric"]).select("metric", "step", "key", "from_median"), "from_median")


@query("SELECT seg, bin, count(*) AS n, round(count(*) / any_value(c * (hi - lo) / 30), 8) AS density FROM (SELECT *, least(floor((bal - lo) / ((hi - lo) / 30)), 29)::INT AS bin FROM (SELECT segment AS seg, acctbal AS bal, min(acctbal) OVER w AS lo, max(acctbal) OVER w AS hi, count(*) OVER w AS c FROM units WINDOW w AS (PARTITION BY segment))) GROUP BY seg, bin")
def histogram(s, d):
    x = r.histogram(p.units(s, d).select(F.col("segment").alias("seg"), F.col("acctbal").alias("value")), ["seg"])
    return rounded(x.select("seg", "bin", "n", "density"), "density")


@query("""SELECT seg, point, round(lo + 8 * point * step, 6) AS x, round(sum(w * exp(-pow((8 * point - bin) * step / h, 2) / 2)) / (any_value(m) * any_value(h) * sqrt(2 * pi())), 9) AS density
FROM (SELECT seg, bin, sum(w) AS w, any_value(lo) AS lo, any_value(step) AS step, any_value(h) AS h, any_value(m) AS m FROM (SELECT *, floor(pos) + side AS bin, CASE side WHEN 0 THEN 1 - (pos - floor(pos)) ELSE pos - floor(pos) END AS w FROM (SELECT *, (value - lo) / step AS pos FROM (SELECT *, (hi - lo + 3 * h) / (8 * 199) AS step FROM (SELECT segment AS seg, acctbal AS value, b.h, b.m, b.low - 3 * b.h AS lo, b.high AS hi FROM units JOIN (SELECT segment, stddev_samp(acctbal) * pow(count(*), -0.2) AS h, count(*) AS m, min(acctbal) AS low, max(acctbal) AS high FROM units GROUP BY segment) b USING (segment)))), (SELECT unnest([0, 1]) AS side)) GROUP BY seg, bin), (SELECT unnest(range(200)) AS point)
GROUP BY seg, point, lo, step""")
def density_curve(s, d):
    x = r.density(p.units(s, d).select(F.col("segment").alias("seg"), F.col("acctbal").alias("value")), ["seg"])
    return rounded(rounded(x, "density", to=9), "x", to=6)


CHAIN_STEPS = 1000
FLIPS = f"SELECT chain_id, step, node, arg_max(new, event_id) AS new FROM (SELECT event_id, event_id % 3 AS chain_id, 1 + event_id // 3 * 7 % {CHAIN_STEPS} AS step, event_id * 37 % (SELECT count(*) FROM customer) AS node, CAST((event_id * 11 + user_id) % {p.DISTRICTS} AS VARCHAR) AS new FROM events) WHERE node IN (SELECT c_custkey FROM customer) GROUP BY ALL"


@query(f"""SELECT t.chain_id, t.step, t.most::BIGINT AS most, t.least::BIGINT AS least, num_parts::BIGINT AS num_parts, split::BIGINT AS split, cut::BIGINT AS cut FROM
(SELECT chain_id, step, max(n) AS most, min(n) AS least FROM (SELECT chain_id, step, district, sum(totpop) AS n FROM whole JOIN units USING (node) GROUP BY ALL) GROUP BY ALL) t
JOIN (SELECT chain_id, step, sum(n) AS num_parts, count(*) FILTER (n > 1) AS split FROM (SELECT chain_id, step, county, count(DISTINCT district) AS n FROM whole JOIN units USING (node) GROUP BY ALL) GROUP BY ALL) USING (chain_id, step)
JOIN (SELECT a.chain_id, a.step, count(*) FILTER (a.district <> b.district) AS cut FROM edges e JOIN whole a ON a.node = e.u JOIN whole b ON b.node = e.v AND b.chain_id = a.chain_id AND b.step = a.step GROUP BY ALL) USING (chain_id, step)""",
    p.SQL + f", flips AS ({FLIPS}), whole AS MATERIALIZED (SELECT g.chain_id, g.step, g.node, coalesce(f.new, CAST(g.node % {W} // {W // p.DISTRICTS} AS VARCHAR)) AS district FROM (SELECT c.chain_id, s.step, c_custkey AS node FROM customer, (SELECT unnest(range(3)) AS chain_id) c, (SELECT unnest(range({CHAIN_STEPS + 1})) AS step) s WHERE s.step % 50 = 0 OR s.step > {CHAIN_STEPS - 20}) g ASOF LEFT JOIN flips f ON f.chain_id = g.chain_id AND f.node = g.node AND f.step <= g.step)")
def chain_changes(s, d):
    """Chains of 1,000 steps kept as changes: populations, splits and cut edges by running sums; every 50th and the last 20 steps are returned, to hold them against whole plans."""
    from ..operators import changes as ch

    units = p.units(s, d)
    n = units.count()
    node = F.col("event_id") * 37 % n
    flips = p.read(s, d, "events").select("event_id", (F.col("event_id") % 3).alias("chain_id"), (1 + F.expr("event_id div 3") * 7 % CHAIN_STEPS).alias("step"), node.alias("node"), ((F.col("event_id") * 11 + F.col("user_id")) % p.DISTRICTS).cast("string").alias("new"))
    flips = flips.join(units.select("node"), "node", "left_semi").groupBy("chain_id", "step", "node").agg(F.max_by("new", "event_id").alias("new"))
    base = p.stripes(s, d).select(F.explode(F.array(*(F.lit(k).cast("bigint") for k in range(3)))).alias("chain_id"), "node", "district")
    log = ch.followed(base, flips)
    people = ch.tallies(base, log, units, "totpop", CHAIN_STEPS).groupBy("chain_id", "step").agg(F.max("totpop").alias("most"), F.min("totpop").alias("least"))
    out = people.join(ch.splits(base, log, units, "county", CHAIN_STEPS), ["chain_id", "step"]).join(ch.cut_edges(base, log, p.edges(s, d), CHAIN_STEPS), ["chain_id", "step"])
    return out.where(f"step % 50 = 0 OR step > {CHAIN_STEPS - 20}")


@query("SELECT segment, totpop AS bin, count(*) AS n FROM units GROUP BY ALL")
def integer_histogram(s, d):
    return r.integer_histogram(p.units(s, d).select("segment", F.col("totpop").alias("value")), ["segment"])


@query("SELECT round(b, 8) AS centre, round(b - 0.125, 8) AS lo, round(b + 0.125, 8) AS hi, count(*) AS n FROM (SELECT plan_id, avg((a > m)::INT) - 0.5 AS b FROM (SELECT *, avg(a) OVER (PARTITION BY plan_id) AS m FROM seats) GROUP BY ALL) GROUP BY ALL", ALL)
def bias_bins(s, d):
    b = e.partisan_summary(e.partisan(p.assignment(s, d), p.votes(s, d))).select(F.round("partisan_bias", 12).alias("value"))
    return rounded(r.bias_bins(b, p.DISTRICTS), "centre", "lo", "hi")


REF = ", points AS (SELECT 'plan0' AS map_name, row_number() OVER (ORDER BY value, length(key), key) - 1 AS rank, value FROM steps WHERE step = 0 AND metric = 'share')"


@query("SELECT map_name, rank, round(value, 8) AS value FROM points", STEPS + REF)
def reference_points(s, d):
    ref = p.long_steps(s, d).where("step = 0 AND metric = 'share'").select(F.lit("plan0").alias("map_name"), "key", "value")
    return rounded(r.reference_points(ref).withColumn("rank", F.col("rank").cast("bigint")), "value")


@query("SELECT map_name, rank, round(count(*) FILTER (r.value <= points.value) / count(*), 8) AS position FROM ranked r JOIN points USING (rank) WHERE metric = 'share' GROUP BY ALL", STEPS + REF)
def outlier_position(s, d):
    long = p.long_steps(s, d)
    ref = r.reference_points(long.where("step = 0 AND metric = 'share'").select(F.lit("plan0").alias("map_name"), "key", "value"))
    out = r.outlier_position(r.rank_entries(long, "share"), ref, "share")
    return rounded(out.select("map_name", F.col("rank").cast("bigint").alias("rank"), "position"), "position")


EVENTS = "ev AS (SELECT user_id AS chain_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step, value AS score FROM events)"


def chain_steps(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return p.read(s, d, "events").select(F.col("user_id").alias("chain_id"), (F.row_number().over(w) - 1).cast("bigint").alias("step"), F.col("value").alias("score"))


@query("SELECT chain_id, step, min(score) OVER w AS best, arg_min(step, score) OVER w AS best_step FROM ev WINDOW w AS (PARTITION BY chain_id ORDER BY step ROWS UNBOUNDED PRECEDING)", EVENTS)
def running_best(s, d):
    return r.running_best(chain_steps(s, d)).select("chain_id", "step", "best", "best_step")


@query("SELECT chain_id, step, score FROM ev WHERE step % 9 = 8", EVENTS)
def coupon_spacing(s, d):
    return r.every(chain_steps(s, d), fc.coupon_spacing(4), last=True)


@query("SELECT chain_id, step, score, min(score) OVER w AS best, arg_min(step, score) OVER w AS best_step, coalesce(plan <> lag(plan) OVER (PARTITION BY chain_id ORDER BY step), true) AS differs FROM ev WINDOW w AS (PARTITION BY chain_id ORDER BY step ROWS UNBOUNDED PRECEDING)", "ev AS (SELECT user_id AS chain_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step, value AS score, event_type AS plan FROM events)")
def streamed_steps(s, d):
    """Chains followed as a stream that is stopped half-way and goes on from its checkpoint."""
    by = Window.partitionBy("user_id")
    ev = p.read(s, d, "events").select(F.col("user_id").alias("chain_id"), (F.row_number().over(by.orderBy("ts", "event_id")) - 1).cast("bigint").alias("step"), F.col("value").alias("score"), F.col("event_type").alias("plan"), F.count("*").over(by).alias("n"))
    folder, out, checkpoint = place(s, "stream"), place(s, "followed"), place(s, "checkpoint")
    for part in ("step * 2 < n", "step * 2 >= n"):
        ev.where(part).drop("n").write.mode("append").parquet(folder)
        st.run_once(st.followed(st.steps(s, folder, "chain_id bigint, step bigint, score double, plan string")), out, checkpoint)
    return s.read.parquet(out)


@query("SELECT event_id, key, json_extract_string(props, '$.' || key) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events)", "")
def flatten_json(s, d):
    ev = p.read(s, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("k", "j"))
    return r.flatten(ev, "k", "j").select("event_id", "key", "value")


@query("SELECT step, key, value FROM steps WHERE metric = 'population'", STEPS)
def time_series(s, d):
    return r.series(p.long_steps(s, d), "population", ["population", "share"]).select("step", "key", "value")


@query("SELECT plan_id, node, round(index_d, 8) AS value FROM assignment LEFT JOIN agg USING (plan_id, district)", ALL)
def values_by_unit(s, d):
    a = p.assignment(s, d)
    v = e.partisan(a, p.votes(s, d)).select("plan_id", "district", F.col("index_d").alias("value"))
    return rounded(r.values_by_unit(a, v).select("plan_id", "node", "value"), "value")


@query("SELECT 'index' AS kind, plan_id, node, round(index_d, 8) AS value, round(greatest(0, least(1, (index_d - 0.45) / 0.1)), 6) AS shade FROM assignment LEFT JOIN agg USING (plan_id, district) UNION ALL SELECT 'order', plan_id, node, NULL, round(r / 3.0, 6) FROM assignment JOIN (SELECT plan_id, district, row_number() OVER (PARTITION BY plan_id ORDER BY district) - 1 AS r, count(*) OVER (PARTITION BY plan_id) AS k FROM (SELECT DISTINCT plan_id, district FROM assignment)) USING (plan_id, district) WHERE k = 4", ALL)
def value_map(s, d):
    from ..operators import reports

    a = p.assignment(s, d)
    v = e.partisan(a, p.votes(s, d))
    own = reports.shaded(a, v, "index_d", (0.45, 0.55)).select(F.lit("index").alias("kind"), "plan_id", "node", "value", "shade")
    four = a.join(a.groupBy("plan_id").agg(F.count_distinct("district").alias("k")).where("k = 4"), "plan_id", "left_semi")
    return rounded(rounded(own.union(reports.shaded(four, v).select(F.lit("order"), "plan_id", "node", "value", "shade")), "value"), "shade", to=6)


SHARES = "shares AS (SELECT step, key AS district, value AS share FROM steps WHERE metric = 'share' AND value IS NOT NULL), seats AS (SELECT step, count(*) FILTER (share > 0.5) AS seats FROM shares GROUP BY step)"


@query("SELECT 'share' AS panel, district AS key, count(*)::BIGINT AS n, round(min(share), 8) AS low, round(median(share), 8) AS middle, round(max(share), 8) AS high, round(avg(share), 8) AS mean FROM shares GROUP BY district UNION ALL SELECT 'seats', CAST(k AS VARCHAR), (SELECT count(*) FROM won WHERE seats = k), (SELECT min(seats) FROM won)::DOUBLE, (SELECT median(seats) FROM won), (SELECT max(seats) FROM won)::DOUBLE, round((SELECT avg(seats) FROM won), 8) FROM (SELECT unnest(range((SELECT count(DISTINCT district) FROM shares) + 1)) AS k)", STEPS + ", " + SHARES.replace("seats AS (SELECT", "won AS (SELECT"))
def shares_and_seats(s, d):
    from ..operators import reports

    shares = p.long_steps(s, d).where("metric = 'share'").select("step", F.col("key").alias("district"), F.col("value").alias("share"))
    return rounded(reports.shares_and_seats(shares), "low", "middle", "high", "mean")


@query("SELECT step, sum(value) AS total, count(*)::BIGINT AS n_keys FROM steps WHERE metric = 'population' GROUP BY step", STEPS)
def results_files(s, d):
    from ..sources import io

    folder = place(s, "results")
    long = p.long_steps(s, d).where("metric = 'population'")
    io.write_results(long, long.groupBy("step").agg(F.sum("value").alias("total")), folder, ["step"])
    lines = r.read_jsonl(s, f"{folder}/ensemble_results.json", ["step", "population"])
    step = lines.where("metric = 'step'").select("line", F.col("json").cast("bigint").alias("step"))
    keys = r.flatten(lines.where("metric <> 'step'"), "metric", "json").join(step, "line").groupBy("step").agg(F.count("*").alias("n_keys"))
    total = s.read.option("header", True).csv(f"{folder}/ensemble_summary.csv").select(F.col("step").cast("bigint").alias("step"), F.col("total").cast("double").alias("total"))
    return total.join(keys, "step")


@query(f"SELECT round(min(x) - 0.05 * (max(x) + 1 - min(x)), 8) AS minx, round(min(y) - 0.05 * (max(y) + 1 - min(y)), 8) AS miny, round(max(x) + 1 + 0.05 * (max(x) + 1 - min(x)), 8) AS maxx, round(max(y) + 1 + 0.05 * (max(y) + 1 - min(y)), 8) AS maxy FROM units WHERE segment IN ('BUILDING', 'MACHINERY', 'FURNITURE', 'AUTOMOBILE')")
def bounding_box(s, d):
    u = p.units(s, d).select(F.col("segment").alias("name"), F.col("x").alias("minx"), F.col("y").alias("miny"), (F.col("x") + 1).alias("maxx"), (F.col("y") + 1).alias("maxy"))
    return rounded(r.bounds(u, ["building", "machinery", "furniture", "automobile"]), "minx", "miny", "maxx", "maxy")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL", "")
def event_windows(s, d):
    return rounded(st.windowed(p.read(s, d, "events"), "1 hour", by=("event_type",)).drop("end"), "total", to=4)


# Connected pieces and their repair

def torn_stripes(s, d):
    """The plan of stripes with every 97th unit in another stripe and every 113th row of units cut off."""
    return p.stripes(s, d).withColumn("district", F.expr(TORN))


TORN = f"cast(case when node % 97 = 5 then (node % {W} div {W // p.DISTRICTS} + 2) % {p.DISTRICTS} when node % {W} % 10 < 4 and node div {W} % 11 = 3 then {p.DISTRICTS - 1} - node % {W} div {W // p.DISTRICTS} else node % {W} div {W // p.DISTRICTS} end as string)"
TORN_SQL = "torn AS (SELECT 0::BIGINT AS plan_id, node, " + TORN.replace(" div ", " // ").replace(" as string", " as varchar") + " AS district FROM units)"

PIECES = """RECURSIVE {tables}, start AS ({start}),
inner_ AS (SELECT a.plan_id, e.u, e.v FROM edges e JOIN start a ON a.node = e.u JOIN start b ON b.node = e.v AND b.plan_id = a.plan_id AND b.district = a.district{region}),
links AS (SELECT * FROM inner_ UNION ALL SELECT plan_id, v, u FROM inner_),
reach AS (SELECT plan_id, node, node AS other FROM start UNION SELECT r.plan_id, r.node, l.v FROM reach r JOIN links l ON l.plan_id = r.plan_id AND l.u = r.other),
low AS (SELECT plan_id, node, min(other) AS low FROM reach GROUP BY ALL)"""
PIECES_SQL = "SELECT a.plan_id, a.district, count(*)::BIGINT AS n_components FROM low JOIN start a USING (plan_id, node) WHERE low = node GROUP BY ALL"


@query(PIECES_SQL, PIECES.format(tables=p.SQL + ", " + TORN_SQL, start="SELECT * FROM torn", region=""))
def contiguity(s, d):
    return rg.pieces(torn_stripes(s, d), p.edges(s, d))


@query("SELECT plan_id, count(*)::BIGINT AS num_pieces FROM low WHERE low = node GROUP BY plan_id", PIECES.format(tables=p.SQL, start="SELECT * FROM assignment", region=" JOIN units x ON x.node = e.u JOIN units y ON y.node = e.v AND y.county = x.county"))
def locality_pieces(s, d):
    x = rg.pieces(p.assignment(s, d), p.edges(s, d), p.units(s, d), "county")
    return x.groupBy("plan_id").agg(F.sum("n_components").alias("num_pieces"))


@query(PIECES_SQL, PIECES.format(tables=p.SQL, start="SELECT * FROM assignment UNION ALL SELECT 99, node, district FROM torn", region="").replace(", start AS", ", " + TORN_SQL + ", start AS", 1))
def torn_districts(s, d):
    every = p.assignment(s, d).union(torn_stripes(s, d).withColumn("plan_id", F.lit(99).cast("bigint")))
    return rg.pieces(every, p.edges(s, d), chunk=512)  # so that pieces cross chunks at any scale


def repair_sql(start: str, steps: int) -> str:
    """The repair in SQL, step by step: as many steps as the worst plan has repairs at sf0.01."""
    out = f"RECURSIVE {p.SQL}, {TORN_SQL}, own0 AS ({start}), ways AS (SELECT u, v FROM edges UNION ALL SELECT v, u FROM edges), names AS (SELECT *, row_number() OVER (PARTITION BY plan_id ORDER BY district) - 1 AS rank, count(*) OVER (PARTITION BY plan_id) AS k FROM (SELECT DISTINCT plan_id, district FROM own0)), at0 AS (SELECT DISTINCT plan_id, -1 AS place FROM names)"
    for i in range(steps):
        out += f""",
links{i} AS MATERIALIZED (SELECT a.plan_id, w.u, w.v FROM ways w JOIN own{i} a ON a.node = w.u JOIN own{i} b ON b.plan_id = a.plan_id AND b.node = w.v AND b.district = a.district),
reach{i} AS (SELECT plan_id, node, node AS other FROM own{i} UNION SELECT r.plan_id, r.node, l.v FROM reach{i} r JOIN links{i} l ON l.plan_id = r.plan_id AND l.u = r.other),
comp{i} AS MATERIALIZED (SELECT plan_id, node, district, min(other) AS root FROM reach{i} JOIN own{i} USING (plan_id, node) GROUP BY ALL),
kept{i} AS (SELECT plan_id, district, arg_max(root, n * 1000000 - root) AS keep FROM (SELECT plan_id, district, root, count(*) AS n FROM comp{i} GROUP BY ALL) GROUP BY ALL HAVING count(*) > 1),
due{i} AS MATERIALIZED (SELECT plan_id, min(place + 1 + ((rank - place - 1) % k + k) % k) AS place, arg_min(district, place + 1 + ((rank - place - 1) % k + k) % k) AS district, arg_min(keep, place + 1 + ((rank - place - 1) % k + k) % k) AS keep FROM kept{i} JOIN names USING (plan_id, district) JOIN at{i} USING (plan_id) WHERE place + 1 + ((rank - place - 1) % k + k) % k < 2 * k * k GROUP BY plan_id),
moving{i} AS (SELECT c.* FROM comp{i} c JOIN due{i} USING (plan_id, district) WHERE root <> keep),
to{i} AS MATERIALIZED (SELECT plan_id, root, first(other ORDER BY n DESC, other) AS other FROM (SELECT m.plan_id, m.root, o.district AS other, count(*) AS n FROM moving{i} m JOIN ways w ON w.u = m.node JOIN own{i} o ON o.plan_id = m.plan_id AND o.node = w.v WHERE o.district <> m.district GROUP BY ALL) GROUP BY ALL),
own{i + 1} AS MATERIALIZED (SELECT o.plan_id, o.node, coalesce(t.other, CASE WHEN m.node IS NOT NULL THEN (SELECT min(n.district) FROM names n WHERE n.plan_id = o.plan_id AND n.district <> o.district) END, o.district) AS district FROM own{i} o LEFT JOIN moving{i} m USING (plan_id, node) LEFT JOIN to{i} t ON t.plan_id = m.plan_id AND t.root = m.root),
at{i + 1} AS (SELECT plan_id, coalesce(d.place, a.place) AS place FROM at{i} a LEFT JOIN due{i} d USING (plan_id))"""
    return out


STEPS_OF_REPAIR = 12


@query(f"SELECT plan_id, node, district FROM own{STEPS_OF_REPAIR}", repair_sql("SELECT plan_id, node, district FROM assignment", STEPS_OF_REPAIR))
def contiguity_repair(s, d):
    return rg.repaired(p.assignment(s, d), p.edges(s, d))


def start(s, d, *regions):
    from ..operators.kernels import stored_graph

    units = p.units(s, d)
    g = stored_graph(units, p.edges(s, d), regions, p.weights(s, d).withColumnRenamed("w", "penalty"))
    return g, p.stripes(s, d), float(units.agg(F.sum("totpop")).first()[0] or 0) / p.DISTRICTS


@query()
def recombination_chain(s, d):
    from ..operators.chains import run_chains
    from ..operators.kernels import Recom

    g, first, ideal = start(s, d, "county")
    return run_chains(s, g, first, range(4), Recom(ideal, 0.1, {"county": 0.5}), steps=5, seed=7)


def states(chain, s, d, slack: float):
    """Of every state of a chain: its districts, people, pieces, districts further from the ideal than the chain may go, whether it differs from the state before, how many districts that change touches, and whether its score is worse."""
    units = p.units(s, d)
    chain = settle(chain.select("chain_id", "step", "node", "district"), "chain")  # walked once, and its size is known to what joins it
    plans = large(chain.select((F.col("chain_id") * 1000 + F.col("step")).alias("plan_id"), "node", "district"))
    people = e.tally(plans, units, "totpop")
    ideal = units.agg((F.sum("totpop") / p.DISTRICTS).alias("ideal"))
    off = F.sum((F.abs(F.col("totpop") - F.col("ideal")) > slack * F.col("ideal")).cast("bigint"))
    loss = F.sum(F.pow(F.col("totpop") - F.col("ideal"), 2))
    own = people.join(F.broadcast(ideal)).groupBy("plan_id").agg(F.count("*").alias("n_districts"), F.sum("totpop").alias("people"), off.alias("n_off"), loss.alias("loss"))
    torn = rg.pieces(plans, p.edges(s, d)).groupBy("plan_id").agg(F.sum("n_components").alias("n_pieces"))
    before = F.lag("district").over(Window.partitionBy("chain_id", "node").orderBy("step"))
    moves = chain.withColumn("old", before).where("old <> district").select((F.col("chain_id") * 1000 + F.col("step")).alias("plan_id"), F.explode(F.array("old", "district")).alias("x")).groupBy("plan_id").agg(F.count_distinct("x").alias("touched"))
    run = Window.partitionBy(F.expr("plan_id div 1000")).orderBy("plan_id")
    out = own.join(torn, "plan_id").join(moves, "plan_id", "left").withColumn("touched", F.coalesce("touched", F.lit(0)))
    return out.withColumn("worse", F.coalesce(F.col("loss") > F.lag("loss").over(run) + 1e-6, F.lit(False))).drop("loss")


def valid(chains: int, steps: int, more: str) -> str:
    """What a run has to give whatever its random numbers, and `more` that depends on its kind; c and k are chain and step."""
    return f"SELECT (c * 1000 + k)::BIGINT AS plan_id, {p.DISTRICTS}::BIGINT AS n_districts, (SELECT sum(totpop)::BIGINT FROM units) AS people, 0::BIGINT AS n_off, {p.DISTRICTS}::BIGINT AS n_pieces, {more} FROM (SELECT unnest(range({chains})) AS c), (SELECT unnest(range({steps})) AS k)"


@query(valid(4, 5, "CASE WHEN k = 0 THEN 0 ELSE 2 END::BIGINT AS touched"))
def recombination_states(s, d):
    return states(recombination_chain(s, d), s, d, 0.1).drop("worse")  # each step makes two districts anew


@query(valid(2, 3, "k > 0 AS moved"))
def coupon_states(s, d):
    return states(coupon_chain(s, d), s, d, 0.1).withColumn("moved", F.col("touched") > 1).drop("touched", "worse")


# Sources: what is written is read back

@query("SELECT step, metric || '_' || key AS key, round(value, 8) AS value FROM steps WHERE value IS NOT NULL", STEPS)
def step_log(s, d):
    from ..sources import io

    path = place(s, "steps")
    io.write_steps(p.long_steps(s, d).where("value IS NOT NULL"), path)
    lines = r.read_jsonl(s, path, ["step", "population", "share"])
    step = lines.where("metric = 'step'").select("line", F.col("json").cast("bigint").alias("step"))
    own = r.flatten(lines.where("metric <> 'step'"), "metric", "json").join(step, "line")
    return own.select("step", "key", F.round(F.col("value").cast("double"), 8).alias("value"))


@query("SELECT plan_id AS chain_id, node, district, (SELECT max(plan_id) + 1 FROM assignment)::BIGINT AS next_step FROM assignment")
def assignment_log(s, d):
    from ..sources import io

    path = place(s, "assignment")
    io.write_assignment(p.assignment(s, d).select(F.col("plan_id").alias("chain_id"), F.col("plan_id").alias("step"), "node", "district"), path)
    return s.read.parquet(path).select(F.col("chain_id").cast("bigint").alias("chain_id"), "node", "district", F.lit(io.next_step(s, path)).cast("bigint").alias("next_step"))


@query("SELECT plan_id, district, sum(totpop)::BIGINT AS totpop FROM assignment JOIN units USING (node) GROUP BY ALL")
def cached_metrics(s, d):
    from ..sources import io

    path = place(s, "cache")
    made = io.cached(s, path, lambda: e.tally(*plans(s, d), "totpop"))
    return made if made.schema == io.cached(s, path, lambda: 1 / 0).schema else None  # the second read makes nothing


@query("SELECT u, v, CASE WHEN a.county = b.county THEN 2.0 ELSE 0.5 END::DOUBLE AS w, 0.25::DOUBLE AS flat FROM edges JOIN units a ON a.node = u JOIN units b ON b.node = v")
def edge_weight_file(s, d):
    from ..sources import io

    county = p.units(s, d).select("node", "county")
    a, b = (county.select(F.col("node").alias(x), F.col("county").alias("c" + x)) for x in ("u", "v"))
    path = place(s, "weights")
    w = p.edges(s, d).join(a, "u").join(b, "v").select(F.col("v").alias("u"), F.col("u").alias("v"), F.when(F.col("cu") == F.col("cv"), 2.0).otherwise(0.5).alias("w"))
    w.write.option("header", True).csv(path)
    return io.edge_weights(s, path).join(io.constant_edge_weights(s, path, 0.25).withColumnRenamed("w", "flat"), ["u", "v"])


@query("SELECT step, sum(value) FILTER (metric = 'population') AS total, 0::BIGINT AS missing FROM steps GROUP BY step", STEPS)
def summary_file(s, d):
    from ..sources import io

    path = place(s, "summary")
    io.write_summary(p.long_steps(s, d).where("metric = 'population'").groupBy("step").agg(F.sum("value").alias("total")), path, ["step", "missing"])
    return s.read.option("header", True).csv(path).select(F.col("step").cast("bigint").alias("step"), F.col("total").cast("double").alias("total"), F.col("missing").cast("bigint").alias("missing"))


@query("SELECT plan_id, district, count(*)::DOUBLE AS area, sum(totpop)::BIGINT AS totpop FROM assignment JOIN units USING (node) GROUP BY ALL")
def plan_file(s, d):
    from ..sources import io

    path = place(s, "plan") + ".parquet"
    io.write_plan(p.assignment(s, d), p.geometry(s, d), path, ["totpop"])
    return io.load_boundaries(s, path).select("plan_id", "district", F.round("area", 6).alias("area"), F.col("totpop").cast("bigint").alias("totpop"))


KINDS = ("geojson", "shp", "zip")


@query(f"SELECT kind, plan_id, district, count(*)::DOUBLE AS area, sum(totpop)::BIGINT AS totpop, (SELECT count(*) FROM (SELECT DISTINCT plan_id, district FROM assignment))::BIGINT AS n_features FROM assignment JOIN units USING (node), (SELECT unnest({list(KINDS)}) AS kind) GROUP BY ALL")
def geo_files(s, d):
    """Every plan's districts written in each format, read back and counted."""
    from ..operators.spatial import dissolve
    from ..sources import io

    paths, out = {kind: place(s, "plan") + "." + kind for kind in KINDS}, None
    io.write_districts(lambda: dissolve(p.assignment(s, d), p.geometry(s, d), ["totpop"]), *paths.values())
    for kind, path in paths.items():
        own = io.load_units(s, path).select(F.lit(kind).alias("kind"), F.col("plan_id").cast("bigint").alias("plan_id"), "district", F.round("area", 6).alias("area"), F.col("totpop").cast("bigint").alias("totpop"), F.lit(io.district_count(s, path)).cast("bigint").alias("n_features"))
        out = own if out is None else out.union(own)
    return out


@query("SELECT county AS locality, count(*)::DOUBLE AS area FROM units GROUP BY county")
def locality_boundaries(s, d):
    from ..operators.spatial import with_area
    from ..sources import io

    return with_area(io.boundaries_by_dissolve(p.geometry(s, d), "county", "county")).select("locality", F.round("area", 6).alias("area"))


@query("SELECT node, totpop, 1.0::DOUBLE AS area, 'base' AS tag FROM units")
def dataset_registry(s, d):
    from ..sources import io

    path = place(s, "units") + ".parquet"
    p.geometry(s, d).select("node", "totpop", "geom").write.parquet(path)
    sets = io.Datasets(s, {"base": path, "other": {"data": p.units(s, d)}})
    own = [c for c in fc.shared_columns({k: sets[k] for k in sets.keys()}) if c in ("node", "totpop", "area")]
    return sets["base"].select(*own, F.lit(sets.keys()[0]).alias("tag"))


def short_votes(s, d):
    """Units with short election columns, a year a pair: the votes of 1992 and later under offices by turns; one pair has no votes for R."""
    v = p.votes(s, d).where("party <> '-'").withColumn("name", F.concat(F.substring("election", 3, 2), F.when(F.col("election") % 2 == 0, "PRE").otherwise("GOV"), "party"))
    names = [f"{y % 100:02d}{'GOV' if y % 2 else 'PRE'}{x}" for y in range(1992, 1999) for x in "DR"]
    wide = v.groupBy("node").pivot("name", names).agg(F.sum("votes"))
    return wide.withColumns({"92USSD": F.col("92PRED"), "92USSR": F.lit(None).cast("bigint"), "96PREO": F.lit(1)})


@query("SELECT election || CASE WHEN election::INT % 2 = 0 THEN '_PRE' ELSE '_GOV' END AS election, (sum(votes) FILTER (party = 'D'))::DOUBLE AS d, (sum(votes) FILTER (party = 'R'))::DOUBLE AS r FROM votes WHERE election BETWEEN '1992' AND '1998' GROUP BY ALL HAVING sum(votes) FILTER (party = 'D') > 0 AND sum(votes) FILTER (party = 'R') > 0")
def contested_elections(s, d):
    return fc.contested(short_votes(s, d), range(1992, 1999))


@query("SELECT election || '_GOV' AS election, 4::BIGINT AS n_columns FROM votes WHERE election IN ('1993', '1995') GROUP BY election HAVING sum(votes) FILTER (party = 'D') > 0 AND sum(votes) FILTER (party = 'R') > 0")
def chosen_elections(s, d):
    wide = short_votes(s, d)
    own = fc.contested(wide, range(1992, 1999)).where(fc.election_in("election", [1992, 1993, 1995], ["GOV"]))
    return own.select("election", F.lit(sum(c[:2] in ("93", "95") for c in fc.short_columns(wide.columns, offices=["GOV"]))).cast("bigint").alias("n_columns"))


@query("SELECT plan_id, district, election, party || (1 + node % 2) AS label, sum(votes)::BIGINT AS votes FROM assignment JOIN votes USING (node) GROUP BY ALL")
def label_tallies(s, d):
    v = p.votes(s, d).withColumn("label", F.concat("party", (1 + F.col("node") % 2).cast("string")))
    return e.label_votes(p.assignment(s, d), v)


SPLIT = "SELECT plan_id, count(*) FILTER (n > 1) AS n FROM (SELECT plan_id, {0}, count(DISTINCT district) AS n FROM assignment JOIN units USING (node) GROUP BY ALL) GROUP BY plan_id"


@query(f"SELECT plan_id, a.n::BIGINT AS split_county, b.n::BIGINT AS split_muni, 0::BIGINT AS split_parish FROM ({SPLIT.format('county')}) a JOIN ({SPLIT.format('muni')}) b USING (plan_id)")
def split_counts(s, d):
    return e.split_counts(p.assignment(s, d), p.units(s, d), ["county", "muni", "parish"])


@query(f"SELECT 'split_county' AS metric, round(avg(n), 8) AS mean FROM ({SPLIT.format('county')}) UNION ALL SELECT 'split_muni', round(avg(n), 8) FROM ({SPLIT.format('muni')})")
def summary_averages(s, d):
    counts = e.split_counts(p.assignment(s, d), p.units(s, d), ["county", "muni"])
    return rounded(r.averages(counts, ["split_county", "split_muni", "split_parish"]), "mean")


@query("""SELECT chain, bin, round(lo + bin * w, 6) AS lo, round(lo + (bin + 1) * w, 6) AS hi, count(*)::BIGINT AS n, round(count(*) / (any_value(m) * w), 6) AS density
FROM (SELECT chain, value, lo, m, (hi - lo) / k AS w, least(floor((value - lo) / ((hi - lo) / k)), k - 1)::INT AS bin FROM (SELECT *, ceil((hi - lo) / least((hi - lo) / (log2(m) + 1), greatest(2 * (q3 - q1) * pow(m, -1.0 / 3), (hi - lo) / sqrt(m) / 2))) AS k
  FROM ev JOIN (SELECT chain, count(*)::DOUBLE AS m, min(value) AS lo, max(value) AS hi, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM ev GROUP BY chain) USING (chain))) GROUP BY chain, bin, lo, w""", "ev AS (SELECT event_type AS chain, value FROM events)")
def auto_histogram(s, d):
    ev = p.read(s, d, "events").select(F.col("event_type").alias("chain"), "value")
    return rounded(r.histogram(ev, ["chain"], "auto"), "lo", "hi", "density", to=6)


@query("SELECT plan_id, labelled FROM (SELECT plan_id, list_sort(list(district || ':' || node)) AS h FROM assignment GROUP BY plan_id), (SELECT round(count(DISTINCT h) / count(*), 8) AS labelled FROM (SELECT plan_id, list_sort(list(district || ':' || node)) AS h FROM assignment GROUP BY plan_id))")
def labelled_plans(s, d):
    h = e.plan_hash(p.assignment(s, d), labelled=True)
    return rounded(h.select("plan_id").join(e.distinct_fraction(h).withColumnRenamed("distinct_fraction", "labelled")), "labelled")


@query("SELECT plan_id AS step, sum(totpop)::DOUBLE AS total, count(DISTINCT district)::DOUBLE AS districts, round(sum(totpop)::DOUBLE / count(DISTINCT district), 8) AS mean FROM assignment JOIN units USING (node) GROUP BY plan_id")
def objective_values(s, d):
    people = e.tally(*plans(s, d), "totpop").groupBy(F.col("plan_id").alias("step")).agg(F.map_from_entries(F.collect_list(F.struct("district", F.col("totpop").cast("double").alias("n")))).alias("m"))
    return rounded(people.select("step", r.objective(F.col("m"), "map").alias("total"), r.objective(F.map_keys("m"), "list").alias("districts"), r.average_margin(F.map_values("m")).alias("mean")), "mean")


@query("SELECT 'people' AS panel, step, key, value FROM steps WHERE metric = 'population' UNION ALL SELECT 'index', step, key, round(value, 8) FROM steps WHERE metric = 'share'", STEPS)
def stacked_panels(s, d):
    long = p.long_steps(s, d)
    names = ["population", "share"]
    return rounded(r.panels({"people": r.series(long, "population", names), "index": r.series(long, "share", names)}), "value")


@query("SELECT chain_id, step, best, max(step) FILTER (score = best) OVER w AS best_step FROM (SELECT *, min(score) OVER w AS best FROM ev WINDOW w AS (PARTITION BY chain_id ORDER BY step ROWS UNBOUNDED PRECEDING)) WINDOW w AS (PARTITION BY chain_id ORDER BY step ROWS UNBOUNDED PRECEDING)", EVENTS)
def running_best_latest(s, d):
    return r.running_best(chain_steps(s, d), latest=True).select("chain_id", "step", "best", "best_step")


@query("SELECT CAST(x // 10 AS VARCHAR) AS district, count(*)::DOUBLE AS area, (SELECT count(DISTINCT x // 10) FROM units)::BIGINT AS n_districts FROM units GROUP BY 1")
def plan_districts(s, d):
    from ..operators.spatial import with_area
    from ..sources import io

    path = place(s, "plan") + ".geojson"
    io.write_plan(p.stripes(s, d), p.geometry(s, d), path)
    return with_area(io.load_plan(s, path)).select("district", F.round("area", 6).alias("area"), F.lit(io.district_count(s, path)).cast("bigint").alias("n_districts"))


@query(f"SELECT plan_id, node, district FROM own{STEPS_OF_REPAIR}", repair_sql("SELECT plan_id, node, district FROM torn", STEPS_OF_REPAIR))
def partition_of_plan(s, d):
    """A torn plan as polygons, its units' districts by overlap, mended."""
    from ..operators.chains import partition
    from ..operators.spatial import dissolve

    return partition(p.geometry(s, d), dissolve(torn_stripes(s, d), p.geometry(s, d))).select("plan_id", "node", "district")


@query("SELECT plan_id, metric, key, round(value, 8) AS value FROM (SELECT 'map ' || plan_id AS plan_id, 'split_county' AS metric, CAST(NULL AS VARCHAR) AS key, n::DOUBLE AS value FROM (" + SPLIT.format("county") + ") UNION ALL SELECT 'map ' || plan_id, 'population', district, sum(totpop)::DOUBLE FROM assignment JOIN units USING (node) GROUP BY ALL) WHERE metric = 'split_county' OR metric = 'population'")
def reference_maps(s, d):
    from ..operators.config import Config, Context

    c = Config()
    c.set_pop_column("totpop")
    c.add_locality_splits(name="county", column_id="county")
    maps = p.assignment(s, d).withColumn("plan_id", F.concat(F.lit("map "), F.col("plan_id").cast("string")))
    got = c.on_maps(Context(maps, p.units(s, d)), place(s, "maps"))
    return rounded(got.where("metric IN ('split_county', 'population')"), "value")


def chain_of(kind, s, d, p_worse=0.2):
    from ..operators.chains import Scheme, run_chains
    from ..operators.kernels import Recom, log_sse

    g, first, ideal = start(s, d)
    scheme = Scheme(kind, score=lambda g_, x: log_sse(g_, x, ideal), p=p_worse, burst=2)
    return states(run_chains(s, g, first, range(2), Recom(ideal, 0.1), scheme=scheme, steps=8, seed=5), s, d, 0.1)


@query(valid(2, 8, "false AS worse"))
def tilted_states(s, d):
    return chain_of("tilted", s, d, 0.0).drop("touched")  # a run that accepts nothing worse


@query(valid(2, 8, "k > 0 AS moved"))
def burst_states(s, d):
    return chain_of("short_bursts", s, d).withColumn("moved", F.col("touched") > 1).drop("touched", "worse")


@query(f"SELECT c::BIGINT AS candidate_id, true AS success, {p.DISTRICTS}::BIGINT AS n_districts, (SELECT sum(totpop)::BIGINT FROM units) AS people, 0::BIGINT AS n_off FROM (SELECT unnest(range(2)) AS c)")
def annealed_states(s, d):
    own = annealed_plans(s, d)
    units = p.units(s, d)
    ideal = units.agg((F.sum("totpop") / p.DISTRICTS).alias("ideal"))
    people = own.join(units.select("node", "totpop"), "node").groupBy("candidate_id", "success", "district").agg(F.sum("totpop").alias("n"))
    off = F.sum((F.abs(F.col("n") - F.col("ideal")) >= 0.05 * F.col("ideal")).cast("bigint"))
    return people.join(F.broadcast(ideal)).groupBy("success", "candidate_id").agg(F.count("*").alias("n_districts"), F.sum("n").alias("people"), off.alias("n_off"))


# Units that are not convex: Ls and what they leave of their boxes, held against strips that cut them

STRIP = 7.3
LEFT = "CASE WHEN node % 2 = 1 THEN 0.5 * least(greatest({c} - x, 0), 2) + 2 * least(greatest({c} - x - 1.5, 0), 0.5) ELSE 2 * least(greatest({c} - x, 0), 1.5) END"  # area up to c


@query(f"SELECT 0::BIGINT AS plan_id, node, arg_min(district, (-round(share, 9), district)) AS district FROM (SELECT node, CAST(k AS VARCHAR) AS district, {LEFT.format(c=f'({STRIP} * (k + 1))')} - ({LEFT.format(c=f'({STRIP} * k)')}) AS share FROM (SELECT node, 2.0 * (node // 2 % {W}) AS x, k FROM units, (SELECT unnest(range(11)) AS k))) WHERE share > 1e-9 GROUP BY node")
def assign_odd_shapes(s, d):
    from ..functions.geometry import box
    from ..operators import spatial

    units = p.ells(s, d)
    top = 2.5 * (units.agg(F.max("node")).first()[0] // 2 // W + 1)
    strips = s.createDataFrame([(0, str(k), bytearray(box(STRIP * k, 0, STRIP * (k + 1), top))) for k in range(11)], "plan_id bigint, district string, geom binary")
    return spatial.assign(units, strips, dense=8).select("plan_id", "node", "district")


@query("SELECT u, v, round(w, 8) AS shared_perim FROM (SELECT least(a.node, b.node) AS u, greatest(a.node, b.node) AS v, least(a.l, b.l) + 1 - greatest(a.l, b.l) AS w FROM placed a JOIN placed b ON b.y = a.y + 1 AND abs(a.l - b.l) < 1 UNION ALL SELECT a.node, b.node, 1 FROM placed a JOIN placed b ON b.y = a.y AND b.x = a.x + 1) WHERE w > 1e-6", p.SQL + ", placed AS (SELECT node, x, y, x + y * 37 % 100 / 100.0::DOUBLE AS l FROM units)")
def uneven_adjacency(s, d):
    from ..operators.spatial import adjacency as adj

    return rounded(adj(p.bricks(s, d)), "shared_perim")


@query("SELECT node, round(4 - coalesce(sum(w), 0), 6) + 0 AS boundary_perim FROM placed LEFT JOIN (SELECT unnest([a.node, b.node]) AS node, least(a.l, b.l) + 1 - greatest(a.l, b.l) AS w FROM placed a JOIN placed b ON b.y = a.y + 1 AND abs(a.l - b.l) < 1 UNION ALL SELECT unnest([a.node, b.node]), 1 FROM placed a JOIN placed b ON b.y = a.y AND b.x = a.x + 1) USING (node) GROUP BY node", p.SQL + ", placed AS (SELECT node, x, y, x + y * 37 % 100 / 100.0::DOUBLE AS l FROM units)")
def uneven_boundary(s, d):
    from ..operators.spatial import boundary_perimeter as f

    return rounded(f(p.bricks(s, d)), "boundary_perim", to=6)


@query("SELECT plan_id, district, area, round(perimeter, 6) AS perimeter, n_components AS n_parts FROM per JOIN (" + PIECES_SQL + ") USING (plan_id, district) JOIN (SELECT plan_id, district, count(*)::DOUBLE AS area FROM start GROUP BY ALL) USING (plan_id, district)", PIECES.format(tables=p.SQL + PER, start="SELECT * FROM assignment", region=""))
def dissolved_outlines(s, d):
    """Area, outline and parts of every plan's districts, from the dissolved polygons alone."""
    import numpy as np

    from ..functions import geometry as g
    from ..operators.spatial import dissolve, with_area

    @F.pandas_udf("double")
    def around(geom: pd.Series) -> pd.Series:
        return geom.map(lambda b: float(sum(np.hypot(*np.diff(r, axis=0).T).sum() for q in g.polygons(bytes(b)) for r in q)))

    @F.pandas_udf("bigint")
    def parts(geom: pd.Series) -> pd.Series:
        return geom.map(lambda b: len(g.polygons(bytes(b))))

    out = dissolve(p.assignment(s, d), p.geometry(s, d), per_cell=500)  # so that outlines cross cells at any scale
    return with_area(out).select("plan_id", "district", F.round("area", 6).alias("area"), F.round(around("geom"), 6).alias("perimeter"), parts("geom").alias("n_parts"))


@query()
def coupon_chain(s, d):
    from ..operators.chains import Scheme, run_chains
    from ..operators.kernels import Recom

    g, first, ideal = start(s, d)
    return run_chains(s, g, first, range(2), Recom(ideal, 0.1), scheme=Scheme("coupon_collector", micro=3), steps=3, seed=7)


@query()
def annealed_plans(s, d):
    from ..operators.chains import equal_population
    from ..operators.kernels import PopulationFlip, log_sse

    g, first, ideal = start(s, d)
    seeds = first.withColumn("candidate_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(3).cast("bigint"))))
    return equal_population(s, g, seeds, 2, PopulationFlip(ideal), lambda g_, x: log_sse(g_, x, ideal), ideal, 400, seed=3, within=0.05 * ideal)
