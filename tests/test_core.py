"""Hand-computed fixtures, invariants of the kernels, and parity of errors and warnings."""

from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plansmith.functions import columns as fc
from plansmith.functions import geometry as g
from plansmith.operators import chains, ensemble, kernels, regions, results, spatial
from plansmith.operators.config import Config, Context
from plansmith.plans import queries
from plansmith.shared import place
from plansmith.sources import io
from plansmith.streaming import steps as st

VOTES = {1: (60, 40, 100), 2: (30, 70, 100), 3: (45, 55, 100), 4: (20, 80, 100)}


@pytest.fixture(scope="module")
def h1(spark):
    a = spark.createDataFrame([(0, d, str(d)) for d in VOTES], "plan_id bigint, node bigint, district string")
    v = spark.createDataFrame([(d, "2020PRE", p, n) for d, x in VOTES.items() for p, n in zip(("D1", "R1", "-1"), x, strict=True)], "node bigint, election string, party string, votes bigint")
    return a, v


def test_partisan_metrics_by_hand(h1):
    r = ensemble.partisan_summary(ensemble.partisan(*h1)).first()
    assert r.majority == "R" and r.majority_seats == 3
    got = (r.efficiency_gap, r.partisan_bias, r.partisan_bias_swing, r.mean_median_d, r.mean_median_r, r.stdev_share)
    assert got == pytest.approx((-0.025, 0.0, 0.0, 0.0125, -0.0125, 0.175))
    s = ensemble.partisan(*h1).where("district = 'S'").first()
    assert (s.vote_share_d, s.vote_share_r) == pytest.approx((0.3875, 0.6125))
    assert ensemble.majority_shares(ensemble.partisan(*h1)).select(F.map_keys("shares")).first()[0] == ["1", "2", "3", "4"]


def test_totals_and_zero_division(h1, spark):
    a, v = h1
    assert ensemble.partisan(a, v, total="all_votes").where("district = '1'").first().vote_share_d == pytest.approx(0.3)
    none = v.where("party <> '-1'")
    assert ensemble.partisan(a, none).where("district = '1'").first().vote_share_d is None
    assert ensemble.partisan(a, none, zero="inf").where("district = '1'").first().vote_share_d == float("inf")
    for bad in ({"method": "mode"}, {"total": "x"}, {"zero": "x"}):
        with pytest.raises(ValueError):
            ensemble.partisan(a, v, **bad)


def test_splits_by_hand(spark):
    u = spark.createDataFrame([(0, "A"), (1, "A"), (2, "A"), (3, "B")], "node bigint, county string")
    a = spark.createDataFrame([(0, 0, "0"), (0, 1, "0"), (0, 2, "1"), (0, 3, "1"), (1, 0, "0"), (1, 1, "1"), (1, 2, "2"), (1, 3, "2")], "plan_id bigint, node bigint, district string")
    got = {r.plan_id: (r.split, r.num_parts, r.num_localities, r.multi_splits, r.multi_split) for r in ensemble.splits(a, u, "county").collect()}
    assert got == {0: (1, 3, 2, 0, 0), 1: (1, 4, 2, 1, 1)}


def test_shapes_by_hand(spark):
    u = spark.createDataFrame([(0, bytearray(g.box(0, 0, 1, 1))), (1, bytearray(g.box(1, 0, 2, 1)))], "node bigint, geom binary")
    a = spark.createDataFrame([(0, 0, "x"), (0, 1, "x")], "plan_id bigint, node bigint, district string")
    e = spatial.adjacency(u)
    assert [tuple(r) for r in e.collect()] == [(0, 1, 1.0)]
    units = spatial.with_area(u).join(spatial.boundary_perimeter(u), "node")
    area, per = ensemble.tally(a, units, "area"), ensemble.perimeter(e, a, units)
    r = ensemble.polsby_popper(area, per).first()
    assert (r.area, r.perimeter, r.polsby_popper) == pytest.approx((2, 6, 0.6981317008))
    assert ensemble.reock(a, units, spatial.vertices(u)).first().reock_score == pytest.approx(0.5092958179)
    whole = spatial.dissolve(a, units, ["area"]).first()
    assert g.area(bytes(whole.geom)) == pytest.approx(2) and whole["area"] == 2
    plan = spark.createDataFrame([(5, "a", bytearray(g.box(0, 0, 1.2, 1))), (5, "b", bytearray(g.box(1.2, 0, 2, 1)))], "plan_id bigint, district string, geom binary")
    assert {r.node: r.district for r in spatial.assign(u, plan).collect()} == {0: "a", 1: "b"}


def test_clipping_and_holes():
    ring = g.wkb([np.array([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], float), np.array([(1, 1), (3, 1), (3, 3), (1, 3), (1, 1)], float)])
    assert g.area(ring) == 12 and g.overlap(g.box(0, 0, 2, 2), ring) == pytest.approx(3)
    assert g.polygons(ring)[0][1].shape == (5, 2) and g.overlap(g.box(9, 9, 10, 10), ring) == 0
    ell = g.wkb([np.array([(0, 0), (3, 0), (3, 1), (1, 1), (1, 3), (0, 3), (0, 0)], float)])
    assert g.overlap(ell, g.box(0, 0, 3, 3)) == pytest.approx(5) and g.overlap(ell, g.box(1, 1, 3, 3)) == pytest.approx(0) and g.overlap(ell, ell) == pytest.approx(5) and g.overlap(ring, ell) == pytest.approx(g.overlap(ell, ring))


def test_flatten_and_rank_by_hand(spark, tmp_path):
    df = spark.createDataFrame([(0, "population", '{"0":1,"1":2}'), (0, "items", '[{"x":1},{"y":2}]'), (0, "data", '{"a":{"b":1},"e":{},"l":[]}'), (0, "n", "7")], "line bigint, metric string, json string")
    assert {(r.key, r.value) for r in results.flatten(df, "metric", "json").collect()} == {("population_0", "1"), ("population_1", "2"), ("items_0_x", "1"), ("items_1_y", "2"), ("data_a_b", "1"), ("n", "7")}
    long = spark.createDataFrame([(0, "m", "0", 3.0), (0, "m", "1", 1.0), (0, "m", "2", None), (0, "x", "0", 30.0), (0, "x", "1", 10.0), (0, "x", "2", 99.0)], "step bigint, metric string, key string, value double")
    got = {(r.metric, r.rank): r.value for r in results.rank_entries(long, "m").collect()}
    assert got == {("m", 0): 1, ("m", 1): 3, ("x", 0): 10, ("x", 1): 30}
    (tmp_path / "a.jsonl").write_text('{"step":0,"p":{"1":2}}\n\n{"step":1,"p":{"1":3},"q":1}\n')
    rows = results.read_jsonl(spark, str(tmp_path / "a.jsonl"), ["p", "q"]).collect()
    assert sorted((r.metric, r.json) for r in rows) == [("p", '{"1":2}'), ("p", '{"1":3}'), ("q", "1")]
    (tmp_path / "b.jsonl").write_text("{bad\n")
    with pytest.raises(ValueError, match="bad"):
        results.read_jsonl(spark, str(tmp_path / "b.jsonl"), ["p"])
    for bad in (None, "p", []):
        with pytest.raises(ValueError):
            results.read_jsonl(spark, str(tmp_path / "a.jsonl"), bad)


def test_flatten_opens_every_level(spark):
    deep = '{"a":' * 9 + "[1,2]" + "}" * 9
    df = spark.createDataFrame([(0, "m", deep), (1, "n", "7")], "line bigint, metric string, json string")
    name = "m" + "_a" * 9
    assert sorted((r.key, r.value) for r in results.flatten(df, "metric", "json").collect()) == [(f"{name}_0", "1"), (f"{name}_1", "2"), ("n", "7")]


def test_spacing_and_columns(spark):
    assert [fc.coupon_spacing(k) for k in (4, 29, 75)] == [9, 115, 368] and [fc.coupon_spacing(k, half=True) for k in (4, 29, 75)] == [5, 58, 184]
    assert fc.election_columns(["G18USH", "G22USS", "G18USS", "TOTPOP", "Gxx"], [2018], ["USH"]) == ["G18USH"] and len(fc.election_columns(["G18USH", "G22USS", "G18USS", "TOTPOP"])) == 3
    cols = ["G18ATGDLIN", "G18ATGRKOV", "G22SENDMAY", "G22SENRSOL", "G22SENNTRU", "TOTPOP", "G18USH"]
    got = fc.election_labels(cols, overrides={"2022SEN": {"R2": "G22SENNTRU"}, "2026ATG": {"D1": "x"}})
    assert got == {"2018ATG": {"D1": "G18ATGDLIN", "R1": "G18ATGRKOV"}, "2022SEN": {"D1": "G22SENDMAY", "-1": "G22SENNTRU", "R1": "G22SENRSOL", "R2": "G22SENNTRU"}, "2026ATG": {"D1": "x"}}
    assert "-1" not in fc.election_labels(cols, parties=["D", "R"])["2022SEN"]
    df = spark.createDataFrame([(0, "", 10, 5), (1, None, 20, 15), (2, "707", 30, None), (3, "707", 40, 1)], "node bigint, muni string, v1 int, v2 int")
    assert [r.muni for r in fc.fill_empty_ids(df, ["muni", "none"]).orderBy("node").collect()] == ["708", "709", "707", "707"]
    assert [r.t for r in fc.add_total(df, "t", ["v1", "v2"]).orderBy("node").collect()] == [15, 35, 30, 41] and fc.add_total(df, "v1", ["v2"]) is df
    a, b = spark.createDataFrame([(1, 2)], "TOTPOP int, A int"), spark.createDataFrame([(1, 2)], "TOTPOP int, B int")
    assert fc.shared_columns({"a": a, "b": b}) == ["TOTPOP"] and fc.columns_unique_to({"a": a, "b": b}, "a") == ["A"]
    with pytest.raises(KeyError):
        fc.columns_unique_to({"a": a}, "z")
    m = spark.sql("SELECT map('10', 1, '9', 2, 'x', 3) AS m").select(F.map_keys(fc.sorted_map("m")).alias("m")).first().m
    assert m == ["9", "10", "x"]
    u = df.select(fc.uniform("node", seed=3).alias("u"))
    assert sorted(r.u for r in u.collect()) == sorted(r.u for r in df.repartition(3).select(fc.uniform("node", seed=3).alias("u")).collect())


def grid(w=8, n=64):
    e = [(k, k + 1) for k in range(n) if k % w < w - 1] + [(k, k + w) for k in range(n - w)]
    return kernels.Graph(np.arange(n), np.ones(n), *np.array(e).T, {"c": np.arange(n) // 16})


def test_kernels_keep_their_invariants():
    graph, label = grid(), (np.arange(64) % 8) // 2
    rng = kernels.rng_of(1, 2)
    seen = []
    for s in chains.walk(graph, label, kernels.Recom(16, 0.1), [kernels.is_contiguous, kernels.not_equal], chains.Scheme(), 15, rng):
        assert kernels.contiguous(graph, s) and np.abs(np.bincount(s) - 16).max() <= 1.6 + 1e-9
        assert not seen or not kernels.same_plan(s, seen[-1])
        seen.append(s)
    again = list(chains.walk(graph, label, kernels.Recom(16, 0.1), [kernels.is_contiguous, kernels.not_equal], chains.Scheme(), 15, kernels.rng_of(1, 2)))
    assert all((a == b).all() for a, b in zip(seen, again, strict=True))
    assert kernels.same_plan(np.array([0, 0, 1]), np.array([5, 5, 2])) and not kernels.same_plan(np.array([0, 0, 1]), np.array([0, 1, 1]))
    assert kernels.split_counts(graph, label, "c") == (4, 16 - 4 - 4)


def test_coupon_chain_states():
    count = lambda g_, s, r: s + 1
    run = lambda start: list(chains.walk(None, start, count, [], chains.Scheme("coupon_collector", micro=5), 10, None))
    assert run(0) == list(range(4, 50, 5)) and run(100)[0] == 104
    with pytest.raises(ValueError):
        chains.Scheme("other")
    with pytest.raises(TypeError):
        chains.Scheme("coupon_collector", micro=2.5)


def test_optimisers():
    graph, rng = grid(), kernels.rng_of(3, 0)
    label = (np.arange(64) % 8) // 2
    label[2] = 0
    best, value = chains.anneal(graph, label.copy(), kernels.BoundaryFlip(), [kernels.is_contiguous], lambda g_, s: kernels.log_sse(g_, s, 16), 250, rng)
    assert kernels.contiguous(graph, best) and value <= kernels.log_sse(graph, label, 16)
    m = [chains.Goal(lambda g_, s: float((s[g_.u] != s[g_.v]).sum())), chains.Goal(lambda g_, s: float(kernels.split_counts(g_, s, "c")[0]))]
    start = (np.arange(64) % 8) // 2
    _, score = chains.lexicographic(graph, start, m, [kernels.Recom(16, 0.1)] * 2, [{"steps": 15}] * 2, [kernels.is_contiguous], rng)
    assert score[0] <= m[0].loss(graph, start)
    with pytest.raises(ValueError):
        chains.lexicographic(graph, start, m, [], [{}], [], rng)
    t = chains.Goal(lambda g_, s: s, up=True, enough=5, closed=True, slack=0.5)
    assert chains.order([t], (-1,), (-1.5,)) == 0 and chains.order([t, t], (1, 3), (1.5, 2)) == -1 and chains.order([t], (1,), (3,)) == 1
    assert t.loss(None, 2) == -2 and t.reached(-4.5) and not t.reached(-4.4) and not chains.Goal(t.loss, enough=5).reached(5) and not chains.Goal(t.loss).reached(0)
    split, multi = kernels.split_counts(graph, start, "c")
    strict = kernels.PreconditionObjective(16, 0.01, {"c": split}, {"c": multi - 2}, start)
    assert strict(graph, start) == 4 + 1 and kernels.PreconditionObjective(16, 0.01, apart_from=start[::-1].copy())(graph, start) in (0, 1)
    goal = kernels.PreconditionObjective(16, 0.01, {"c": 4})
    assert goal(graph, start) == 0 and goal(graph, chains.precondition(graph, start, kernels.Recom(16, 0.1), goal, [kernels.is_contiguous], rng, 5)) == 0


def test_chains_do_not_depend_on_partitions(spark):
    graph, label = grid(), (np.arange(64) % 8) // 2
    first = spark.createDataFrame([(int(k), str(d)) for k, d in enumerate(label)], "node bigint, district string")
    run = lambda ids: {(r.chain_id, r.step, r.node): r.district for r in chains.run_chains(spark, graph, first, ids, kernels.Recom(16, 0.1), steps=3, seed=5).collect()}
    both, one = run([0, 1]), run([1])
    assert len(both) == 2 * 3 * 64 and all(both[k] == d for k, d in one.items())


def test_chains_polish_what_they_return(spark):
    graph, label = grid(), (np.arange(64) % 8) // 2
    first = spark.createDataFrame([(int(k), str(d)) for k, d in enumerate(label)], "node bigint, district string")
    cut = chains.Goal(lambda g_, s: float((s[g_.u] != s[g_.v]).sum()))

    def run(**more):
        found = {}
        for r in chains.run_chains(spark, graph, first, [0], kernels.Recom(16, 0.1), steps=3, seed=5, **more).collect():
            found.setdefault(r.step, {})[r.node] = int(r.district)
        return [np.array([found[k][n] for n in range(64)]) for k in sorted(found)]

    plain, fine = run(), run(polish=([cut], [kernels.Recom(16, 0.1)], [{"steps": 10}]))
    assert len(fine) == 3
    for k, (s, t) in enumerate(zip(plain, fine)):
        want, _ = chains.lexicographic(graph, s, [cut], [kernels.Recom(16, 0.1)], [{"steps": 10}], [kernels.is_contiguous], np.random.default_rng([5, 0, k]))
        assert (t == want).all() and cut.loss(graph, t) <= cut.loss(graph, s)


def test_chains_tell_of_dead_ends_and_replace_failed_runs(spark):
    graph, label = grid(), (np.arange(64) % 8) // 2
    rng = np.random.default_rng(1)
    still = lambda g_, s, r: s.copy()
    assert (chains.proposed(graph, label, still, [lambda g_, new, old: (new == label).all()], rng, 3) == label).all()
    with pytest.raises(ValueError, match="none of 3 proposals"):
        chains.proposed(graph, label, still, [lambda *_: False], rng, 3)
    uneven = np.array([0, 0, 0, 1, 2, 2, 3, 3])[np.arange(64) % 8]  # in one piece each, but two are off the ideal
    seeds = spark.createDataFrame([(c, int(k), str(d)) for c in (0, 1) for k, d in enumerate(uneven)], "candidate_id bigint, node bigint, district string")

    def lucky(g_, s, r):  # right in about one of twelve steps, so some run of three steps fails
        return label if r.random() < 0.08 else s

    def run(runs):
        return chains.equal_population(spark, graph, seeds, 2, lucky, lambda g_, s: float(kernels.max_deviation(g_, s, 16)), 16, 3, seed=1, runs=runs).select("candidate_id", "success").distinct().collect()

    assert len(run(1)) < 2 and [r.success for r in run(60)] == [True, True]


def test_proposal_holds_scaled_weights(spark):
    near = [(i, j) for i in range(16) for j in (i + 1, i + 4) if j < 16 and (j == i + 4 or j % 4)]
    grid = kernels.Graph(np.arange(16), np.full(16, 1.0), *(np.array(x) for x in zip(*near)))
    heavy = spark.createDataFrame([(u, v, 2.0) for u, v in near if v == u + 4], "u bigint, v bigint, w double")
    c = Config().set_edge_penalty_scale(50)
    recom = c.proposal(16, 2, 0.01, heavy)
    assert sorted(set(recom.weighed(grid).penalty.tolist())) == [0.0, 100.0] and recom.weighed(grid) is recom.weighed(grid)
    half = (np.arange(16) % 4 > 1).astype(np.int64)
    # Heavy edges between rows are cut first, so only halves of whole rows come out; unweighted, others do.
    rows = {tuple(recom(grid, half, np.random.default_rng(k)).reshape(4, 4).std(1).tolist()) for k in range(8)}
    assert rows == {(0.0,) * 4}
    plain = Config().proposal(16, 2, 0.01)
    assert any(plain(grid, half, np.random.default_rng(k)).reshape(4, 4).std(1).any() for k in range(8))


def test_config(spark, tmp_path, h1):
    c = Config().set_pop_column("totpop").constrain_region_splits("muni", "muni", 2, 1).constrain_region_splits("county", "county", 3).surcharge_region("county", 0.5).surcharge_region("x", 0).set_edge_penalty_scale(-1)
    c.constrain_not_equal().add_aggregator("agg", ["2020PRE"]).add_election_metrics("agg", ["efficiency_gap", "majority_seats", "mean_median", "majority_shares"]).add_pop_dev().add_shape_metrics(["polsby_popper", "reock_score"])
    assert c.constraint_params() == {"split_muni": 2, "muni_multi_splits": 1, "split_county": 3, "not_equal_constraint": True}
    assert c.surcharges == {"county": 0.5} and c.penalty_scale is None and "assignment_hash" not in c.updaters_to_save and "split_muni" in c.updaters_to_save
    c.to_yaml(str(tmp_path / "c.yaml"))
    d = Config.from_yaml(str(tmp_path / "c.yaml"))
    assert d.history == c.history and set(d.updaters) == set(c.updaters) and list(d.constraints) == list(c.constraints)
    a, v = h1
    units = spark.createDataFrame([(n, 10, "a", "b") for n in VOTES], "node bigint, totpop bigint, muni string, county string")
    context = Context(a, units, v)
    got = d.evaluate(context, ["efficiency_gap", "majority_seats", "population", "pop_dev", "split_muni"])
    assert got["efficiency_gap"].first().efficiency_gap == pytest.approx(-0.025) and got["majority_seats"].first().majority_seats == 3 and got["split_muni"].first().split == 1
    with pytest.raises(KeyError):
        d.evaluate(context, ["nothing"])
    odd = Config().add_election("20'20 OR 1=1", ignore_output=False)
    assert odd.evaluate(context, [n for n in odd.updaters_to_save if "20" in n])["20'20 OR 1=1"].count() == 0
    with pytest.warns(UserWarning):
        assert "polsby_popper" not in d.collect_metrics(context)
    context.close()
    with pytest.warns(UserWarning), pytest.raises(ValueError):
        Config().add_election_metrics("agg", ["x"])
    with pytest.raises(ValueError):
        Config().add_shape_metrics(["x"])
    with pytest.warns(UserWarning, match="aggregator"):
        Config().add_election_metrics("none", ["efficiency_gap"])
    with pytest.warns(UserWarning, match="scale"):
        assert Config().set_edge_penalty_scale(2).proposal(400, 4).target == 100
    with pytest.raises(FileNotFoundError):
        Config.from_yaml(str(tmp_path / "none.yaml"))
    off = Config().constrain_not_equal().constrain_not_equal(False)
    assert "not_equal" not in off.constraints


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "w.csv").write_text("u,v,w\n0,1,0.5\n2,1,0.8\n1,0,0.7\n")
    assert {(r.u, r.v): r.w for r in io.edge_weights(spark, str(tmp_path / "w.csv")).collect()} == {(0, 1): 0.7, (1, 2): 0.8}
    (tmp_path / "p.csv").write_text("u,v\n0,1\n")
    with pytest.warns(UserWarning):
        assert io.edge_weights(spark, str(tmp_path / "p.csv")).first().w == 1
    with pytest.warns(UserWarning):
        assert io.edge_weights(spark, str(tmp_path / "no.csv")).count() == 0
    with pytest.raises(FileNotFoundError):
        io.constant_edge_weights(spark, str(tmp_path / "no.csv"), 2)
    with pytest.warns(UserWarning):
        assert io.load_boundaries(spark, str(tmp_path / "no.parquet")) is None
    feature = lambda k, x: {"type": "Feature", "properties": {"id": k}, "geometry": {"type": "Polygon", "coordinates": [[[x, 0], [x + 1, 0], [x + 1, 1], [x, 1], [x, 0]]]}}
    (tmp_path / "u.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [feature("1", 0), feature("2", 1)]}))
    u = io.load_units(spark, str(tmp_path / "u.geojson"))
    assert sorted((r.id, r["area"]) for r in u.collect()) == [("1", 1.0), ("2", 1.0)]
    with pytest.raises(ValueError):
        io.load_units(spark, "x", crs="EPSG:4326")
    with pytest.raises(ValueError):
        io.Datasets(spark, {"a": 5})
    data = io.Datasets(spark, {"a": u, "b": {"data": str(tmp_path / "u.geojson"), "transitability": str(tmp_path / "w.csv")}})
    assert data.keys() == ["a", "b"] and data.weights["b"].count() == 2
    with pytest.raises(KeyError):
        data["z"]
    long = spark.createDataFrame([(0, "pop", "10", 1.0), (0, "pop", "9", 2.0), (0, "gap", None, 0.5), (1, "gap", None, 0.25)], "step bigint, metric string, key string, value double")
    io.write_steps(long, str(tmp_path / "steps"))
    got = sorted((json.loads(r.value) for r in spark.read.text(str(tmp_path / "steps")).collect()), key=lambda x: x["step"])
    assert got == [{"step": 0, "pop": {"9": 2.0, "10": 1.0}, "gap": 0.5}, {"step": 1, "gap": 0.25}]
    log = spark.createDataFrame([(0, 4, 1, "a")], "chain_id bigint, step bigint, node bigint, district string")
    assert io.next_step(spark, str(tmp_path / "log")) == 0
    io.write_assignment(log, str(tmp_path / "log"))
    assert io.next_step(spark, str(tmp_path / "log")) == 5
    calls = []
    make = lambda: calls.append(1) or long
    assert io.cached(spark, str(tmp_path / "cache"), make).count() == io.cached(spark, str(tmp_path / "cache"), make).count() == 4 and len(calls) == 1
    units = u.select(F.col("id").cast("bigint").alias("node"), "geom")
    io.write_plan(spark.createDataFrame([(0, 1, "x"), (0, 2, None)], "plan_id bigint, node bigint, district string"), units, str(tmp_path / "plan.geojson"))
    assert [r.district for r in io.load_plan(spark, str(tmp_path / "plan.geojson")).collect()] == ["x"]
    with pytest.raises(ValueError):
        io.write_plan(spark.createDataFrame([(0, 1, "x")], "plan_id bigint, node bigint, district string"), units, str(tmp_path / "plan.xyz"))
    io.write_summary(spark.createDataFrame([(1, 2)], "b int, a int"), str(tmp_path / "s"), ["b", "missing"])
    assert spark.read.option("header", True).csv(str(tmp_path / "s")).columns == ["b", "missing", "a"]
    io.write_metadata(str(tmp_path / "run"), population={"total": 5})
    assert io.run_directory(str(tmp_path / "run"))["population"] == {"total": 5} and io.newest_config(str(tmp_path / "run")).name == "run.yaml"
    assert io.chamber("us_house")["tolerance"] == 0.001
    with pytest.raises(ValueError):
        io.chamber("x")


def test_streams(spark, tmp_path):
    schema = "chain_id bigint, step bigint, score double"
    rows = spark.createDataFrame([(1, k, float(s)) for k, s in enumerate([5, 3, 4, 3, 1, 9])], schema).coalesce(1)
    rows.write.parquet(str(tmp_path / "in"))
    seen = []
    draw = lambda df, n: seen.append(sorted(r.step for r in df.collect()))
    stream, whole = st.steps(spark, str(tmp_path / "in"), schema), spark.read.schema(schema).parquet(str(tmp_path / "in"))
    st.periodic(stream, draw, str(tmp_path / "c1"), 2).awaitTermination()
    st.periodic(stream, draw, str(tmp_path / "c2"), 5, so_far=whole).awaitTermination()
    assert seen == [[2, 4], [0, 1, 2, 3, 4, 5]]  # the due steps, or all up to the last of them
    spark.createDataFrame([(1, 7, 1.0), (1, 8, 2.0)], schema).write.mode("append").parquet(str(tmp_path / "in"))
    st.periodic(stream, draw, str(tmp_path / "c2"), 5, so_far=whole).awaitTermination()
    assert len(seen) == 2  # nothing is due
    with pytest.raises(ValueError):
        st.periodic(None, None, "", 0)
    ev = spark.sql("SELECT * FROM VALUES (timestamp'2024-01-01 00:01:00', 1, 2.0), (timestamp'2024-01-01 00:20:00', 1, 3.0), (timestamp'2024-01-01 00:02:00', 1, 1.0) t(ts, user_id, value)")
    assert sorted((r.n, r.total) for r in st.sessions(ev, "5 minutes", "user_id").collect()) == [(1, 3.0), (2, 3.0)]


def test_chains_are_followed_over_restarts(spark, tmp_path):
    from datetime import datetime, timedelta

    schema = "chain_id bigint, step bigint, score double, plan string"
    batches = [
        [(1, 1, 5.0, "a"), (1, 0, 7.0, "a"), (2, 0, None, None), (1, 2, 5.0, None)],
        [(1, 3, 4.0, None), (2, 1, 3.0, "x"), (3, 0, 1.0, "q")],
        [(1, 4, 4.0, "b"), (2, 2, 3.0, "x"), (1, 5, 9.0, "b")],
    ]
    folder, out, at = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    for rows in batches:  # each run begins where the last one stopped
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        st.run_once(st.followed(st.steps(spark, folder, schema)), out, at)
    got = {(r.chain_id, r.step): (r.best, r.best_step, r.differs) for r in spark.read.parquet(out).collect()}
    assert got == {
        (1, 0): (7, 0, True), (1, 1): (5, 1, False), (1, 2): (5, 1, True), (1, 3): (4, 3, False), (1, 4): (4, 3, True), (1, 5): (4, 3, False),
        (2, 0): (None, 0, True), (2, 1): (3, 1, True), (2, 2): (3, 1, False), (3, 0): (1, 0, True),
    }
    st.run_once(st.followed(st.steps(spark, folder, schema)), out, at)
    assert spark.read.parquet(out).count() == 10
    folder, out, at = (str(tmp_path / n) for n in ("in2", "out2", "checkpoint2"))
    timed = schema + ", ts timestamp"
    for rows in ([(1, 0, 1.0, "a", 0), (4, 0, 1.0, "a", 50)], [(2, 0, 5.0, "b", 70)], [(1, 1, 8.0, "a", 80), (4, 1, 8.0, "a", 80)]):
        spark.createDataFrame([(*r[:4], datetime(2024, 1, 1, 0, 0, r[4] % 60) + timedelta(minutes=r[4] // 60)) for r in rows], timed).coalesce(1).write.mode("append").parquet(folder)
        st.run_once(st.followed(st.steps(spark, folder, timed), idle=30_000), out, at)
    last = {r.chain_id: (r.best, r.differs) for r in spark.read.parquet(out).where("step = 1").collect()}
    assert last == {1: (8, True), 4: (1, False)}  # the first was quiet for too long, and its state had gone


def test_every_query_has_its_columns_twice():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_short_election_columns(spark):
    df = spark.createDataFrame([(5, 1, 0, 0, 7, "x"), (None, 2, 3, 0, 1, "nan")], "20PRED int, 20PRER int, 16GOVD int, 16GOVR int, 20USSO int, `24ATGD` string")
    assert fc.short_columns([*df.columns, "2oPRED", "20XXXD", "20PREDX"]) == ["16GOVD", "16GOVR", "20PRED", "20PRER", "20USSO", "24ATGD"]
    assert fc.short_columns(df.columns, [2020], ["PRE"]) == ["20PRED", "20PRER"]
    assert [tuple(r) for r in fc.contested(df).collect()] == [("2020_PRE", 5.0, 3.0)]
    assert fc.contested(df.select("20PRED")).count() == 0
    names = spark.createDataFrame([("2020_PRE",), ("2016_GOV",), ("other",), ("x_GOV",)], "e string")
    kept = lambda *a: [r.e for r in names.where(fc.election_in("e", *a)).collect()]
    assert kept() == ["2020_PRE", "2016_GOV", "other", "x_GOV"]
    assert kept([2020, 2016], ["GOV"]) == ["2016_GOV"] and kept(["2020"]) == ["2020_PRE"] and kept([], ["PRE", "GOV"]) == ["2020_PRE", "2016_GOV"]


def test_bad_json_names_its_line(spark, tmp_path):
    path = tmp_path / "steps.jsonl"
    path.write_text('{"step": 0}\n\n  \n{"step": 1, "a": 2}\n[1]\nnonsense\n')
    with pytest.raises(ValueError, match="steps.jsonl, line 5: no JSON object: \\[1\\]"):
        results.read_jsonl(spark, str(path), ["step"])
    path.write_text('{"step": 0}\n\n{"a": 2}\n')
    assert [(r.metric, r.json) for r in results.read_jsonl(spark, str(path), ["step", "b"]).collect()] == [("step", "0")]


def test_summary_order_images_and_tags(spark, tmp_path):
    from datetime import date

    assert io.summary_columns(["share_10", "b", "share_2", "step", "a"], ["step", "splits"]) == ["step", "splits", "a", "b", "share_2", "share_10"]
    for n in ("step_10.png", "step_2.PNG", "step_x.png", "other.png", "step_3.txt"):
        (tmp_path / n).write_bytes(b"x")
    assert [tuple(r) for r in io.step_images(spark, str(tmp_path)).collect()] == [(10, "step_10.png"), (2, "step_2.PNG"), (None, "step_x.png")]
    assert io.run_tag("house", date(2021, 3, 4)) == "house-20210304"
    (tmp_path / "one.geojson").write_text("")
    assert io.chamber("us_house", str(tmp_path))["comparison_maps"] == {"one": str(tmp_path / "one.geojson")}


def test_partition_of_a_torn_plan(spark):
    cells = [(k, 1, g.box(k, 0, k + 1, 1)) for k in range(6)]
    units = spark.createDataFrame(cells, "node bigint, totpop bigint, geom binary")
    names = ["a", "a", "b", "b", "a", "b"]
    plan = spatial.dissolve(spark.createDataFrame([(0, k, x) for k, x in enumerate(names)], "plan_id bigint, node bigint, district string"), units)
    as_given = {r.node: r.district for r in chains.partition(units, plan, repair=False).collect()}
    assert as_given == dict(enumerate(names))
    own = chains.partition(units, plan)
    assert own.count() == 6 and regions.pieces(own, spatial.adjacency(units)).agg(F.max("n_components")).first()[0] == 1
    with pytest.warns(UserWarning, match="torn districts after repair"):  # a gap between units cannot be mended
        chains.partition(units, plan, edges=spark.createDataFrame([(0, 1), (3, 4), (4, 5)], "u bigint, v bigint"))


def test_long_form_of_metrics(spark):
    from plansmith.operators.config import long_form

    one = spark.createDataFrame([("m", 3)], "plan_id string, split bigint")
    two = spark.createDataFrame([("m", "1", 2.0, 1, "x")], "plan_id string, district string, a double, b int, c string")
    many = spark.createDataFrame([("m", {"1": 0.5})], "plan_id string, shares map<string,double>")
    got = sorted(map(tuple, long_form({"split": one, "t": two, "s": many}).collect()), key=str)
    assert got == sorted([("m", "split", None, 3.0), ("m", "t_a", "1", 2.0), ("m", "t_b", "1", 1.0), ("m", "s", "1", 0.5)], key=str)
    with pytest.raises(ValueError):
        long_form({})


def test_averages_and_auto_bins(spark):
    df = spark.createDataFrame([(1, None), (2, 4.0)], "a int, b double")
    assert {r.metric: r["mean"] for r in results.averages(df, ["a", "b", "c"]).collect()} == {"a": 1.5, "b": 4.0}
    assert results.averages(df, ["c"]).count() == 0
    rng = np.random.default_rng(3)
    for x in (rng.normal(size=500), np.array([1.0] * 90 + [2.0, 3.0, 9.0]), np.full(4, 2.0)):
        got = {r.bin: r.n for r in results.histogram(spark.createDataFrame([("g", float(v)) for v in x], "k string, value double"), ["k"], "auto").collect()}
        want, _ = np.histogram(x, "auto")
        assert got == {i: n for i, n in enumerate(want.tolist()) if n}


def plain_components(nodes, edges, label):
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for u, v in edges:
            if label[u] == label[v] and root[u] != root[v]:
                root[u] = root[v] = min(root[u], root[v])
                changed = True
    return root


def plain_repair(nodes, edges, label, k):
    near = {n: [v for u, v in edges if u == n] + [u for u, v in edges if v == n] for n in nodes}
    label = dict(label)
    modal = lambda x: min(set(x), key=lambda d: (-x.count(d), d))
    while any(d is None for d in label.values()):
        new = {n: modal(x) for n, d in label.items() if d is None and (x := [label[v] for v in near[n] if label[v] is not None])}
        label |= new or {n: min(d for d in label.values() if d) for n, d in label.items() if d is None}
    names = sorted(set(label.values()))
    for _ in range(2 * k):
        before = dict(label)
        for d in names:
            root = plain_components(nodes, edges, label)
            own = [root[n] for n in nodes if label[n] == d]
            keep = min(set(own), key=lambda r: (-own.count(r), r))
            for r in set(own) - {keep}:
                part = [n for n in nodes if root[n] == r]
                around = [label[v] for n in part for v in near[n] if label[v] != d]
                to = modal(around) if around else min(x for x in names if x != d)
                before[part[0]] = None
                for n in part:
                    label[n] = to
        if before == label:
            break
    return label


@pytest.mark.parametrize("chunk", [7, 1 << 16])
def test_pieces_and_repair_against_plain_python(spark, chunk):
    rng = np.random.default_rng(5)
    nodes = list(range(40))
    edges = [(k, k + 1) for k in nodes if k % 8 < 7] + [(k, k + 8) for k in nodes if k < 32]
    e = spark.createDataFrame(edges, "u bigint, v bigint")
    plans = {q: {n: (None if q < 2 and rng.random() < 0.15 else "abcd"[min(n % 8 // 2, 3)] if rng.random() < 0.8 else "abcd"[rng.integers(4)]) for n in nodes} for q in range(3)}
    plans[3] = {n: None if n == 0 else "ab"[n // 20] for n in nodes}
    a = spark.createDataFrame([(q, n, d) for q, x in plans.items() for n, d in x.items()], "plan_id bigint, node bigint, district string")
    got = {(r.plan_id, r.district): r.n_components for r in regions.pieces(a, e, chunk=chunk).collect()}
    want = {}
    for q, x in plans.items():
        root = plain_components(nodes, [(u, v) for u, v in edges if x[u] and x[v]], x)
        for n in nodes:
            if x[n] and root[n] == n:
                want[q, x[n]] = want.get((q, x[n]), 0) + 1
    assert got == want
    got = {(r.plan_id, r.node): r.district for r in regions.repaired(a, e, chunk=chunk).collect()}
    assert got == {(q, n): d for q, x in plans.items() for n, d in plain_repair(nodes, edges, x, len({d for d in x.values() if d})).items()}


def test_pieces_of_localities_and_stars(spark):
    line = spark.createDataFrame([(k, k + 1) for k in range(300)], "u bigint, v bigint")
    a = spark.createDataFrame([(0, k, "x") for k in range(301)], "plan_id bigint, node bigint, district string")
    root = regions.components(a.withColumn("part", F.lit("x")), line, chunk=1)
    assert {r.root for r in root.collect()} == {0}
    u = spark.createDataFrame([(k, None if k < 3 else "" if k < 5 else "b") for k in range(301)], "node bigint, county string")
    got = {r.locality: r.n_components for r in regions.pieces(a, line, u, "county").collect()}
    assert got == {None: 1, "": 1, "b": 1}
    assert regions.pieces(a.limit(0), line).count() == 0 and regions.repaired(a.limit(0), line).count() == 0
    islands = regions.repaired(a.withColumn("district", F.when(F.col("node") == 7, "y").when(F.col("node") < 9, "x")), line.limit(0), passes=1)
    assert islands.where("district IS NULL").count() == 0


def polygon(*ring, holes=()):
    return {"type": "Polygon", "coordinates": [[list(map(float, p)) for p in (*r, r[0])] for r in (ring, *holes)]}


def test_geojson_ranges_lose_and_double_nothing(spark, tmp_path):
    from plansmith.sources import geofiles

    box = polygon((0, 0), (1, 0), (1, 1), (0, 1))
    odd = {"quote": 'a " {"type": "Feature"} \\', "brace": "}{", "ö": "ü\n", "n": 5, "f": 1.5, "deep": {"a": ["{", 1]}, "none": None}
    own = [{"type": "Feature", "id": k, "properties": odd | {"k": str(k)}, "geometry": box} if k % 3 else {"properties": odd | {"k": str(k)}, "geometry": {"type": "MultiPolygon", "coordinates": [box["coordinates"]] * 2}, "type": "Feature"} for k in range(41)]
    own += [{"type": "Feature", "properties": None, "geometry": None}]
    whole = {"type": "FeatureCollection", "name": "x { \" y", "features": own}
    texts = {"line": json.dumps(whole, ensure_ascii=False), "tight": json.dumps(whole, separators=(",", ":")), "spread": json.dumps(whole, indent=3, ensure_ascii=False), "rows": "\n".join(map(json.dumps, own))}
    for name, text in texts.items():
        file = tmp_path / f"{name}.geojson"
        file.write_text(text)
        assert io.district_count(spark, str(file)) == 42, name
        data = geofiles.pa.BufferReader(text.encode())
        want = None
        for size in (7, 100, 333, 10**6):
            got = [x for low in range(0, data.size(), size) for x in geofiles.features(data, data.size(), low, min(low + size, data.size()), step=50)]
            assert [p.get("k") for _, p, _ in got] == [*map(str, range(41)), None], (name, size)
            want = want or got
            assert got == want
        assert got[1][1] == {k: v if isinstance(v, str) or v is None else json.dumps(v, separators=(",", ":")) for k, v in odd.items()} | {"k": "1"}
        assert g.area(got[0][2]) == 2 and got[-1][2] is None
        assert geofiles.read(spark, str(file), range_bytes=500).select("position").distinct().count() == 42
    for text, n in (("", 0), ('{"type":"FeatureCollection","features":[]}', 0), ('{"type":"Feature","properties":{},"geometry":null}', 1)):
        (tmp_path / "small.geojson").write_text(text)
        assert io.district_count(spark, str(tmp_path / "small.geojson")) == n
    (tmp_path / "small.geojson").write_text(json.dumps({"type": "Feature", "properties": {}, "geometry": {"type": "Point", "coordinates": [0, 0]}}))
    with pytest.raises(Exception, match="neither a polygon"):
        io.district_count(spark, str(tmp_path / "small.geojson"))
    with pytest.raises(Exception, match="FileNotFound|is not there|no.geojson"):
        io.district_count(spark, str(tmp_path / "no.geojson"))


@pytest.mark.parametrize("ending", ["geojson", "shp", "zip"])
def test_geo_files_come_back(spark, tmp_path, ending):
    from plansmith.sources import geofiles

    ring = g.wkb([np.array([(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)], float), np.array([(1, 1), (1, 3), (3, 3), (3, 1), (1, 1)], float)])
    many = g.multipolygon([g.polygons(ring)[0], g.polygons(g.box(9, 9, 11, 11))[0], g.polygons(g.box(1.5, 1.5, 2, 2))[0]])
    rows = [(1, "ä b", 2.5, True, ring, "x"), (2, None, None, False, many, "y"), (-3, "", 1e-300, None, None, "z")]
    df = spark.createDataFrame(rows, "node bigint, name string, share double, flag boolean, geom binary, a_column_of_many_letters string").repartition(2)
    path = str(tmp_path / f"units.{ending}")
    for _ in range(2):  # the second replaces the first
        geofiles.write(df, path)
    assert not [x for x in (tmp_path / f"units.{ending}").iterdir() if x.name.startswith("_temp")]
    got = {int(r.properties["node"]): r for r in geofiles.read(spark, path, range_bytes=60).collect()}
    assert sorted(got) == [-3, 1, 2] and got[-3].geom is None
    assert g.area(bytes(got[1].geom)) == 12 and g.area(bytes(got[2].geom)) == 16.25
    long = "a_column_of_many_letters" if ending == "geojson" else "a_column_o"
    assert [got[k].properties[long] for k in (1, 2, -3)] == ["x", "y", "z"] and got[1].properties["name"] == "ä b" and float(got[-3].properties["share"]) == 1e-300
    assert io.load_units(spark, path).where("area = 12").count() == 1
    with pytest.raises(Exception, match="column geom"):
        geofiles.write(df.drop("geom"), path)
    if ending != "geojson":
        with pytest.raises(Exception, match="do not fit"):
            geofiles.write(df.withColumn("name", F.lit("y" * 255)), path)
    assert geofiles.read(spark, path).count() == 3  # what failed left the files alone
    geofiles.write(df.limit(0), path)
    assert geofiles.read(spark, path).count() == 0


def test_shapefiles_of_others(spark, tmp_path):
    """Kinds with heights, records that were deleted, another encoding, and an archive of several files."""
    import struct
    import zipfile

    from plansmith.sources import geofiles

    parts = geofiles.Parts(".shp", spark.createDataFrame([], "name string, geom binary").schema)
    files = dict(parts.shapefile([{"name": n, "geom": g.box(k, 0, k + 1, 1)} for k, n in enumerate(["a", "b", "c"])]))
    flat = files[".shp"]
    heights = bytearray(flat)
    for k in range(3):
        struct.pack_into("<i", heights, 100 + k * (len(flat) - 100) // 3 + 8, 25)
    table = bytearray(files[".dbf"].replace(b"b" + b" " * 253, b"\xe9" + b" " * 253))
    table[struct.unpack_from("<H", table, 8)[0]] = ord("*")
    for name, data in ((".shp", bytes(heights)), (".shx", files[".shx"]), (".dbf", bytes(table)), (".cpg", b"ISO-8859-1")):
        (tmp_path / f"u{name}").write_bytes(data)
    got = geofiles.read(spark, str(tmp_path / "u.shp"), range_bytes=1)
    assert got.rdd.getNumPartitions() == 3 and sorted((r.position, r.properties["name"], g.area(bytes(r.geom))) for r in got.collect()) == [(1, "é", 1.0), (2, "c", 1.0)]
    with zipfile.ZipFile(tmp_path / "both.zip", "w") as z:
        for name in (".shp", ".shx", ".dbf"):
            z.writestr(f"in/u{name}", files[name])
        z.writestr("v.geojson", json.dumps({"type": "Feature", "properties": {"name": "d"}, "geometry": None}))
    assert sorted(r.properties["name"] for r in geofiles.read(spark, str(tmp_path / "both.zip")).collect()) == ["a", "b", "c", "d"]
    assert [tuple(r) for r in io.load_plan(spark, str(tmp_path / "both.zip"), "p").select("plan_id", "district").orderBy("district").collect()] == [("p", str(k)) for k in range(1, 5)]


def test_segments_that_do_not_match(spark):
    """Sides of several neighbours, of a slanted line, at a corner only, and a hole that another unit fills."""
    ring = lambda *xy: g.wkb([np.array([*xy, xy[0]], float)])
    shapes = {
        0: ring((0, 0), (6, 3), (0, 3)),
        1: ring((0, 0), (2, 1), (2, -3), (0, -3)),
        2: ring((2, 1), (6, 3), (6, -3), (2, -3)),
        3: ring((6, 3), (8, 3), (8, 5), (6, 5)),
        4: g.wkb([np.array([(-9, 0), (-3, 0), (-3, 6), (-9, 6), (-9, 0)], float), np.array([(-8, 1), (-8, 5), (-4, 5), (-4, 1), (-8, 1)], float)]),
        5: ring((-8, 1), (-6, 1), (-6, 5), (-8, 5)),
        6: ring((-6, 1), (-4, 1), (-4, 5), (-6, 5)),
        7: ring((-3, 2), (0, 2), (0, 2.5), (-3, 2.5)),
    }
    units = spark.createDataFrame([*((k, bytearray(b)) for k, b in shapes.items()), (8, None)], "node bigint, geom binary")
    got = {(r.u, r.v): round(r.shared_perim, 9) for r in spatial.adjacency(units).collect()}
    root5 = round(5**0.5, 9)
    assert got == {(0, 1): root5, (0, 2): round(2 * 5**0.5, 9), (1, 2): 4, (4, 5): 8, (4, 6): 8, (5, 6): 4, (4, 7): 0.5, (0, 7): 0.5}
    outer = {r.node: round(r.boundary_perim, 6) for r in spatial.boundary_perimeter(units).collect()}
    assert outer[5] == 0 and outer[3] == 8 and outer[7] == 6 and outer[4] == 23.5 and outer[8] == 0
    assert outer[0] == 6 + 2.5
    nothing = units.limit(0)
    assert spatial.adjacency(nothing).count() == 0 and spatial.boundary_perimeter(nothing).count() == 0


@pytest.mark.parametrize("per_cell", [3, 10**6])
def test_outlines_with_holes_islands_and_corners(spark, per_cell):
    rows = ["aaaaaa", "abbbba", "abaaba", "abaaba", "abbbba", "aaaaab"]
    cells = [(y * 6 + x, bytearray(g.box(x, y, x + 1, y + 1)), c) for y, row in enumerate(rows) for x, c in enumerate(row)]
    units = spark.createDataFrame([(n, geom, 1) for n, geom, _ in cells], "node bigint, geom binary, people int")
    a = spark.createDataFrame([(0, n, c) for n, _, c in cells] + [(1, n, "x" if n % 2 else None) for n, _, _ in cells], "plan_id bigint, node bigint, district string")
    got = {(r.plan_id, r.district): r for r in spatial.dissolve(a, units, ["people"], per_cell=per_cell).collect()}
    area = {k: g.area(bytes(r.geom)) for k, r in got.items()}
    assert area == {(0, "a"): 23.0, (0, "b"): 13.0, (1, "x"): 18.0} and {k: r.people for k, r in got.items()} == area
    form = lambda k: sorted((len(q), g.ring_area(q[0])) for q in g.polygons(bytes(got[k].geom)))
    assert form((0, "a")) == [(1, 4.0), (2, 35.0)] and form((0, "b")) == [(1, 1.0), (2, 16.0)]  # an island in a hole is a part
    assert form((1, "x")) == [(1, 6.0)] * 3
    assert spatial.dissolve(a.limit(0), units).count() == 0


def test_outlines_of_units_that_do_not_match(spark):
    units = spark.createDataFrame([(0, bytearray(g.box(0, 0, 4, 1))), (1, bytearray(g.box(0, 1, 1.5, 2))), (2, bytearray(g.box(1.5, 1, 4, 2)))], "node bigint, geom binary")
    a = spark.createDataFrame([(0, 0, "x"), (0, 1, "x"), (0, 2, "x"), (1, 0, "x"), (1, 2, "x"), (1, 1, "y")], "plan_id bigint, node bigint, district string")
    got = {(r.plan_id, r.district): (g.area(bytes(r.geom)), len(g.polygons(bytes(r.geom)))) for r in spatial.dissolve(a, units).collect()}
    assert got == {(0, "x"): (8.0, 1), (1, "x"): (6.5, 1), (1, "y"): (1.5, 1)}


def test_tiles_keep_every_area():
    rng = np.random.default_rng(0)
    angle = np.sort(rng.random(400)) * 2 * np.pi
    star = np.stack([np.cos(angle), np.sin(angle)], axis=1) * (3 + 4 * rng.random(400))[:, None]
    star = np.vstack([star, star[:1]])
    hole = np.vstack([(x := star[:-1] * 0.3), x[:1]])[::-1]
    for size in (0.7, 2.0, 50.0):
        cells = [(x, y, g.area(g.wkb(r))) for x, y, r in g.tiles([star, hole], size)]
        assert len({c[:2] for c in cells}) == len(cells)
        assert sum(c[2] for c in cells) == pytest.approx(g.area(g.wkb([star, hole])))
        for x, y, a in cells[::7]:
            assert a == pytest.approx(g.overlap(g.box(x * size, y * size, (x + 1) * size, (y + 1) * size), g.wkb([star, hole])))


@pytest.mark.parametrize("dense", [2, 64])
def test_overlay_cuts_dense_cells_further(spark, dense):
    rng = np.random.default_rng(1)
    xy = np.concatenate([rng.random((40, 2)) * 40, rng.random((60, 2))])
    units = spark.createDataFrame([(k, bytearray(g.box(x, y, x + s, y + s))) for k, ((x, y), s) in enumerate(zip(xy.tolist(), [2.0] * 40 + [0.1] * 60, strict=True))] + [(200, None), (201, bytearray(g.box(900, 900, 901, 901)))], "node bigint, geom binary")
    slant = {"a": [(0, 0), (25, 0), (5, 42), (0, 42)], "b": [(25, 0), (42, 0), (42, 42), (5, 42)]}
    plans = spark.createDataFrame([(q, d, bytearray(g.wkb([np.array([*r, r[0]], float)]))) for q in (0, 1) for d, r in slant.items() if (q, d) != (1, "b")], "plan_id bigint, district string, geom binary")
    got = {(r.plan_id, r.node): r.district for r in spatial.assign(units, plans, dense=dense).collect()}
    shapes = {r.node: r.geom for r in units.collect()}
    want = {}
    for n, geom in shapes.items():
        for q in (0, 1):
            share = {d: round(g.overlap(bytes(geom), g.wkb([np.array([*r, r[0]], float)])), 9) if geom else 0 for d, r in slant.items() if (q, d) != (1, "b")}
            want[q, n] = min((d for d in share if share[d] > 0), key=lambda d: (-share[d], d), default=None)
    assert got == want


@pytest.mark.parametrize("few", [0, 1 << 16])
def test_quantiles_of_any_group(spark, monkeypatch, few):
    from plansmith.operators import quantiles

    monkeypatch.setattr(quantiles, "FEW", few)
    rng = np.random.default_rng(6)
    groups = {"a": rng.normal(size=301), "b": rng.integers(0, 4, 400).astype(float), "c": np.array([5.0]), "d": np.array([2.0, 9.0]), None: rng.exponential(size=77)}
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("a", None), ("e", None)]
    df = spark.createDataFrame(rows, "k string, value double").repartition(5)
    qs = [0.5, 0.025, 0.975, 0.0, 1.0, 1 / 3]
    got = {r.k: list(r)[1:] for r in quantiles.quantiles(df, ["k"], qs, [f"q{i}" for i in range(len(qs))]).collect()}
    assert set(got) == set(groups)
    for k, v in groups.items():
        assert got[k] == pytest.approx(np.quantile(v, qs).tolist())
    rows = quantiles.ordered(df, ["k"]).where("k = 'b'").orderBy("value").collect()
    assert [(r.value, r.n, r.ahead, r.total) for r in rows] == [(float(x), int((groups["b"] == x).sum()), int((groups["b"] < x).sum()), 400) for x in range(4)]
    apart = {(r.k, r.value): r.from_median for r in results.from_median(df, ["k"]).collect()}
    assert apart[None, float(groups[None][0])] == pytest.approx(groups[None][0] - np.median(groups[None])) and apart["e", None] is None
    assert quantiles.quantiles(df.limit(0), ["k"], [0.5], ["m"]).count() == 0
    whole = quantiles.quantiles(df, [], [0.5], ["m"]).first().m
    assert whole == pytest.approx(np.median(np.concatenate(list(groups.values()))))
    with pytest.raises(ValueError):
        quantiles.quantiles(df, ["k"], [1.5], ["m"])


def test_density_is_near_the_direct_sum(spark):
    rng = np.random.default_rng(7)
    groups = {"a": rng.normal(size=200), "b": np.concatenate([rng.normal(size=60), rng.normal(8, 0.2, 90)]), None: np.array([0.0, 1.0])}
    df = spark.createDataFrame([(k, float(x)) for k, v in groups.items() for x in v] + [("one", 3.0), ("flat", 2.0), ("flat", 2.0), ("a", None), ("a", float("nan"))], "k string, value double")
    got = {}
    for r in results.density(df, ["k"]).orderBy("point").collect():
        got.setdefault(r.k, []).append((r.x, r.density))
    assert set(got) == set(groups)
    for k, v in groups.items():
        x, d = map(np.array, zip(*got[k], strict=True))
        h = v.std(ddof=1) * len(v) ** -0.2
        want = np.exp(-(((x[:, None] - v[None]) / h) ** 2) / 2).sum(axis=1) / (len(v) * h * np.sqrt(2 * np.pi))
        assert len(x) == 200 and x[0] == pytest.approx(v.min() - 3 * h) and x[-1] == pytest.approx(v.max() + 3 * h)
        assert np.abs(d - want).max() < 2e-4 * want.max() + 1e-4 and (d >= 0).all()
        assert ((d[1:] + d[:-1]) / 2 * np.diff(x)).sum() == pytest.approx(1, abs=0.01)
    with pytest.raises(ValueError):
        results.density(df, ["k"], points=1)


def test_what_a_distribution_shows(spark):
    assert results.named_references([0.5, "0.25", "x", None]) == {"Reference 1": 0.5, "Reference 2": 0.25}
    assert results.named_references({"now": "1", "bad": [2]}) == {"now": 1.0} and results.named_references(None) == {}
    df = spark.createDataFrame([("a", float(k)) for k in range(9)] + [("b", 10.0 * k) for k in range(9)], "k string, value double")
    shown = results.distribution(df, ["k"], [4], relative=True)
    assert sorted(shown) == ["histogram", "interval", "references"]
    assert {(r.k, r.name, r.value) for r in shown["references"].collect()} == {("a", "Reference 1", 0.0), ("b", "Reference 1", -36.0)}
    assert {(r.k, r.median) for r in shown["interval"].collect()} == {("a", 0.0), ("b", 0.0)}
    assert "density" in results.distribution(df, ["k"], curve=True)
    with pytest.raises(ValueError, match="no data"):
        results.distribution(df.withColumn("value", F.lit(None).cast("double")), ["k"])


def test_changes_of_a_chain(spark):
    from plansmith.operators import changes

    rng = np.random.default_rng(8)
    nodes, edges = list(range(12)), [(k, k + 1) for k in range(11)] + [(0, 6), (3, 9)]
    people, county = rng.integers(1, 9, 12).tolist(), ["x", "x", None, "y", "y", "y", "z", "z", "z", "z", "", "x"]
    units = spark.createDataFrame([(n, int(people[n]), county[n]) for n in nodes], "node bigint, totpop bigint, county string")
    e = spark.createDataFrame(edges, "u bigint, v bigint")
    plans = {}
    for c in range(2):
        plan = [("abc"[n % 3] if n else None) for n in nodes]
        for t in range(31):
            if t:
                for n in rng.choice(12, rng.integers(0, 3), replace=False):
                    plan[n] = [None, "a", "b", "c", "d"][rng.integers(5)]
            plans[c, t] = list(plan)
    df = spark.createDataFrame([(c, t, n, p[n]) for (c, t), p in plans.items() for n in nodes], "chain_id bigint, step bigint, node bigint, district string").repartition(3)
    base, log = changes.changes(df)
    assert log.count() == sum(a != b for c in range(2) for t in range(1, 31) for a, b in zip(plans[c, t], plans[c, t - 1], strict=True))
    assert sorted(map(tuple, changes.followed(base, df.where("step > 0").withColumnRenamed("district", "new")).collect()), key=str) == sorted(map(tuple, log.collect()), key=str)
    for t in (0, 7, 30):
        assert {(r.chain_id, r.node): r.district for r in changes.plan_at(base, log, t).collect()} == {(c, n): plans[c, t][n] for c in range(2) for n in nodes}
    got = {(r.chain_id, r.step, r.district): r.totpop for r in changes.tallies(base, log, units, "totpop", 30).collect()}
    assert all(got.get((c, t, d), 0) == sum(people[n] for n in nodes if p[n] == d) for (c, t), p in plans.items() for d in "abcd")
    got = {(r.chain_id, r.step): (r.num_parts, r.split) for r in changes.splits(base, log, units, "county", 30).collect()}
    kinds = lambda p: {(county[n], p[n]) for n in nodes if p[n]}
    assert got == {k: (len(kinds(p)), sum(sum(x == y for x, _ in kinds(p)) > 1 for y in set(county))) for k, p in plans.items()}
    got = {(r.chain_id, r.step): r.cut for r in changes.cut_edges(base, log, e, 30).collect()}
    assert got == {k: sum(bool(p[u] and p[v] and p[u] != p[v]) for u, v in edges) for k, p in plans.items()}


def test_candidates_go_in_waves(spark, tmp_path):
    graph, label = grid(), (np.arange(64) % 8) // 2
    tried = tmp_path / "tried"
    tried.mkdir()

    def propose(g_, s, rng):
        (tried / str(rng.integers(2**60))).touch()
        return s

    seeds = spark.createDataFrame([(c, int(n), str(d)) for c in range(6) for n, d in enumerate(label if c % 3 else label[::-1] * 0 + (np.arange(64) >= 8))], "candidate_id bigint, node bigint, district string")
    score = lambda g_, s: kernels.log_sse(g_, s, 16)
    run = lambda wanted, **how: chains.equal_population(spark, graph, seeds, wanted, propose, score, 16, 1, seed=4, runs=1, **how)
    assert {r.candidate_id for r in run(2, at_once=2).select("candidate_id").distinct().collect()} == {1, 2}
    assert 1 <= len(list(tried.iterdir())) <= 4  # the first two waves
    assert {r.candidate_id for r in run(9).select("candidate_id").distinct().collect()} == {1, 2, 4, 5}
    assert run(0).count() == 0


def test_runs_are_recorded_and_found_again(spark, tmp_path):
    from plansmith.operators.runs import Run

    units = spark.createDataFrame([(k, 10 + k, "x" if k < 4 else "y", bytearray(g.box(k, 0, k + 1, 1))) for k in range(8)], "node bigint, totpop bigint, county string, geom binary")
    units.write.parquet(str(tmp_path / "units.parquet"))
    config = Config().set_pop_column("totpop").add_locality_splits(name="county", column_id="county")
    run = Run(config, {"base": {"data": str(tmp_path / "units.parquet")}})
    seen = []
    run.add_callback("plan", lambda plan, step, folder: seen.append((step, plan.where("district = 'a'").count(), folder)), 2).add_callback("each", lambda *a: seen.append(a[1]))
    for action, every in ((None, 1), (print, 0), (print, -2)):
        with pytest.raises(ValueError):
            run.add_callback("bad", action, every)
    plans = spark.createDataFrame([(0, t, n, "a" if n <= t else "b") for t in range(4) for n in range(8)], "chain_id bigint, step bigint, node bigint, district string")
    folder = str(tmp_path / "run")
    own = run.units(spark)
    got = {(r.step, r.metric, r.key): r.value for r in run.record(plans, lambda a: Context(a, own), folder, steps=4).collect()}
    assert got[1, "population", "a"] == 10 and got[4, "population", "a"] == 46 and got[2, "split_county", None] == 1 and got[4, "split_county", None] == 0
    assert seen == [1, (2, 2, folder), 2, 3, (4, 4, folder), 4]
    lines = sorted((json.loads(r.value) for r in spark.read.text(f"{folder}/output").collect()), key=lambda x: x["step"])
    assert [x["step"] for x in lines] == [1, 2, 3, 4] and lines[3]["population"] == {"a": 46.0, "b": 62.0}
    again = Run.from_directory(folder)
    assert again.config.history == config.history and again.datasets == run.datasets and again.default == "base" and again.units(spark).count() == 8
    assert Run.steps(spark, folder).count() == 32 and io.next_step(spark, f"{folder}/assignments") == 5
    about = io.run_directory(folder)
    assert about["population"] == {"column": "totpop", "total": 108, "districts": 2, "ideal": 54.0} and about["callbacks"] == {"plan": 2, "each": 1} and about["run"] == {"steps": 4}
    io.write_metadata(str(tmp_path / "other"), population={})
    with pytest.raises(ValueError, match="geography"):
        Run.from_directory(str(tmp_path / "other"))
    with pytest.raises(FileNotFoundError):
        Run.from_directory(str(tmp_path / "nowhere"))
    with pytest.raises(ValueError):
        Run(config, {})
    with pytest.raises(KeyError):
        Run(config, {"a": {}}, "b")


def test_reports(spark):
    from plansmith.operators import reports

    a = spark.createDataFrame([(0, n, d) for n, d in enumerate(["10", "9", "9", None])] + [(1, 0, "x")], "plan_id bigint, node bigint, district string")
    v = spark.createDataFrame([(0, "9", 0.2), (0, "10", 0.9), (1, "x", None)], "plan_id bigint, district string, share double")
    rows = lambda df: {(r.plan_id, r.node): (r.value, r.shade) for r in df.collect()}
    assert rows(reports.shaded(a, v, "share", (0.4, 0.8))) == {(0, 0): (0.9, 1.0), (0, 1): (0.2, 0.0), (0, 2): (0.2, 0.0), (0, 3): (None, None), (1, 0): (None, None)}
    assert rows(reports.shaded(a, v, "share"))[0, 0] == (0.9, 0.9)
    with pytest.warns(UserWarning, match="no value 'other'"):
        assert rows(reports.shaded(a, v, "other")) == {(0, 0): (None, 1.0), (0, 1): (None, 0.0), (0, 2): (None, 0.0), (0, 3): (None, None), (1, 0): (None, 0.0)}
    with pytest.raises(ValueError):
        reports.shaded(a, v, "share", (1, 1))
    shares = spark.createDataFrame([(t, d, x) for t, own in enumerate([(0.6, 0.4, 0.7), (0.5, 0.3, 0.8), (0.6, None, 0.9)]) for d, x in zip("abc", own)], "step bigint, district string, share double")
    got = {(r.panel, r.key): (r.n, r.low, r.middle, r.high, round(r["mean"], 6)) for r in reports.shares_and_seats(shares).collect()}
    assert got["share", "b"] == (2, 0.3, 0.35, 0.4, 0.35) and got["share", "c"] == (3, 0.7, 0.8, 0.9, 0.8)
    assert {k: got["seats", k][0] for k in "0123"} == {"0": 0, "1": 1, "2": 2, "3": 0} and got["seats", "0"][1:] == (1.0, 2.0, 2.0, 1.666667)
    assert reports.shares_and_seats(shares.limit(0)).count() == 0
    summary = spark.createDataFrame([(0, 0.1, 3, 0.0), (1, 0.2, 4, 0.25)], "step bigint, efficiency_gap double, split_county int, partisan_bias double")
    panels = reports.summary_panels(summary, shares, 4)
    assert sorted(panels) == ["averages", "efficiency_gap", "partisan_bias", "shares_and_seats", "split_county"]
    assert {(r.bin, r.n) for r in panels["split_county"].collect()} == {(3, 1), (4, 1)} and panels["efficiency_gap"].count() == 2 and panels["partisan_bias"].count() == 2
    assert [tuple(r) for r in panels["averages"].collect()] == [("split_county", 3.5)]


def plain_tree(n, u, v, w):
    """Kruskal, edge by edge."""
    root, tree = list(range(n)), set()
    for k in np.argsort(w, kind="stable").tolist():
        a, b = root[u[k]], root[v[k]]
        if a != b:
            root, tree = [a if x == b else x for x in root], tree | {(u[k], v[k])}
    return tree


@pytest.mark.parametrize("seed", range(6))
def test_trees_and_cuts_on_arrays(seed):
    rng = np.random.default_rng(seed)
    n = 40
    every = [(i, j) for i in range(n) for j in range(i + 1, n)]
    u, v = np.array([every[k] for k in np.sort(rng.choice(len(every), 90, replace=False))]).T
    g = kernels.Graph(np.arange(n) * 3, rng.integers(1, 9, n).astype(float), u, v, {"c": rng.integers(-1, 3, n)}, rng.random(90))
    nodes = np.flatnonzero(rng.random(n) < 0.8)
    edges = np.flatnonzero(np.isin(u, nodes) & np.isin(v, nodes))
    a, b = kernels.spanning_tree(g, nodes, edges, np.random.default_rng(seed), {"c": 0.5})
    c, d = g.regions["c"][u[edges]], g.regions["c"][v[edges]]
    w = np.random.default_rng(seed).random(len(edges)) + g.penalty[edges] + 0.5 * ((c != d) | (c < 0) | (d < 0))
    assert set(zip(nodes[a].tolist(), nodes[b].tolist())) == plain_tree(n, u[edges].tolist(), v[edges].tolist(), w)
    label = rng.integers(0, 2, n)
    assert kernels.components(g, label).tolist() == list(plain_components(range(n), list(zip(u.tolist(), v.tolist())), label).values())
    if len(a) == len(nodes) - 1:
        target, tree, sides = g.pop[nodes].sum() / 2, list(zip(a.tolist(), b.tolist())), set()
        for k in range(len(tree)):  # both sides of every edge
            own = plain_components(range(len(nodes)), tree[:k] + tree[k + 1 :], [0] * len(nodes))
            side = frozenset(x for x in range(len(nodes)) if own[x] == own[tree[k][0]])
            if abs(g.pop[nodes][list(side)].sum() - target) <= 0.3 * target:
                sides |= {side, frozenset(range(len(nodes))) - side}
        got = [kernels.balanced_cut(g, nodes, (a, b), target, 0.3, np.random.default_rng(k)) for k in range(20)]
        if not sides:
            assert all(x is None for x in got)
        else:
            assert all(frozenset(np.searchsorted(nodes, x).tolist()) in sides for x in got)


def test_chains_walk_without_a_graph_on_the_driver(spark, monkeypatch):
    def refuse(self, *_):
        raise AssertionError("a table comes to the driver")

    for c in (type(spark.range(1)), DataFrame):
        monkeypatch.setattr(c, "toPandas", refuse)
    got = queries.QUERIES["recombination_states"](spark, "/root/testdata/sf0.01").drop("people").orderBy("plan_id").collect()
    assert [tuple(r) for r in got] == [(1000 * c + k, 4, 0, 4, 2 * (k > 0)) for c in range(4) for k in range(5)]
    e = spark.createDataFrame([(0, 2), (1, 2), (5, 9)], "u bigint, v bigint").repartition(2)
    units = spark.createDataFrame([(9, 4, "b"), (0, 1, " "), (1, 2, None), (2, 3, "a"), (5, 7, "b")], "node bigint, totpop bigint, c string").repartition(3)
    g = kernels.stored_graph(units, e, ("c",), spark.createDataFrame([(1, 2, 0.5)], "u bigint, v bigint, penalty double")).load()
    assert g.ids.tolist() == [0, 1, 2, 5, 9] and g.pop.tolist() == [1, 2, 3, 7, 4] and g.regions["c"].tolist() == [-1, -1, 0, 1, 1]
    assert list(zip(g.u.tolist(), g.v.tolist(), g.penalty.tolist())) == [(0, 2, 0.0), (1, 2, 0.5), (3, 4, 0.0)]
    start = place(spark, "start")
    spark.createDataFrame([(9, "10"), (0, "2"), (2, None), (7, "3"), (5, "2")], "node bigint, district string").repartition(3).write.parquet(start)
    label, names = kernels.stored_plan(start, g.ids)
    assert names == ["10", "2", "3"] and label.tolist() == [1, -1, -1, 1, 0]


def test_many_rings_find_their_homes_and_are_read_back():
    """As many holes as rings: what goes through all rings for each hole does not end."""
    import time

    from plansmith.sources import geofiles

    square = lambda x, y, s: np.array([(x, y), (x + s, y), (x + s, y + s), (x, y + s), (x, y)], float)
    nest = [square(0, 0, 100), square(10, 10, 50)[::-1], square(20, 20, 30), square(25, 25, 10)[::-1], square(70, 70, 5)[::-1], square(200, 0, 3)]
    order = np.random.default_rng(0).permutation(len(nest))
    many = [r for k in range(30_000) for r in (square(k % 40 * 4, k // 40 * 4, 3), square(k % 40 * 4 + 1, k // 40 * 4 + 1, 1)[::-1])]
    for rings, want in (([nest[k] for k in order], {(3, 10000.0), (2, 900.0), (1, 9.0)}), (many, {(2, 9.0)})):
        began = time.perf_counter()
        got = g.assembled(np.concatenate(rings), np.cumsum([0, *map(len, rings)]), some=1000)
        back = geofiles.shape(geofiles.shaped(got))
        assert time.perf_counter() - began < 30
        for x in (got, back):
            assert {(len(p), abs(g.ring_area(p[0]))) for p in g.polygons(x)} == want and g.area(x) == sum(g.ring_area(r) for r in rings)


def test_tables_of_units_are_not_broadcast(spark):
    """However small they are taken for: the driver would gather them."""
    from plansmith.plans import projection

    d = "/root/testdata/sf0.01"
    for df in (projection.units(spark, d), projection.edges(spark, d), projection.weights(spark, d), projection.with_boundary(spark, d)):
        assert df.count() > 0
        df.write.format("noop").mode("overwrite").save()
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_a_stored_graph_is_mapped_from_files(spark):
    e, u = spark.createDataFrame([(0, 1)], "u bigint, v bigint"), spark.createDataFrame([(0, 4), (1, 5)], "node bigint, totpop bigint")
    for units, edges in ((u, e), (u.limit(0), e.limit(0))):
        g = kernels.stored_graph(units, edges, (), edges.selectExpr("u", "v", "2D AS penalty")).load()
        n, m = units.count(), edges.count()
        assert g.ids.tolist() == [0, 1][:n] and g.pop.tolist() == [4, 5][:n] and g.u.tolist() == [0][:m] and g.v.tolist() == [1][:m] and g.penalty.tolist() == [2.0][:m]
        assert all(isinstance(x.base, np.memmap) or not len(x) for x in (g.ids, g.pop, g.u, g.v, g.penalty))


def test_states_are_joined_by_sorting(spark, monkeypatch):
    from plansmith.plans import projection

    seen = []
    for module, name in ((queries.e, "tally"), (queries.rg, "inner_edges")):
        monkeypatch.setattr(module, name, lambda *a, f=getattr(module, name): seen.append(f(*a)) or seen[-1])
    d = "/root/testdata/sf0.001"
    got = queries.states(projection.stripes(spark, d).selectExpr("0L AS chain_id", "0L AS step", "node", "district"), spark, d, 0.5).collect()
    assert len(got) == 1 and got[0].n_districts == 4 and len(seen) == 2
    assert not any("Broadcast" in df._jdf.queryExecution().executedPlan().toString() for df in seen)


def test_perimeters_are_joined_by_sorting(spark):
    """Plans have a row a unit and plan: the driver would gather them several times over."""
    from plansmith.plans import projection

    d = "/root/testdata/sf0.001"
    for df in (queries.perimeter(spark, d), ensemble.edge_districts(projection.edges(spark, d), projection.assignment(spark, d))):
        assert df.count() > 0
        df.write.format("noop").mode("overwrite").save()
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_polygons_are_packed_once():
    """Each byte of an outline is written in its place, and points that are handed over are held by nothing else."""
    ring = np.array([(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)], float)
    xy = (ring + np.arange(50_000)[:, None, None] * (2, 0)).reshape(-1, 2)
    first, every = np.arange(50_001) * 5, np.arange(50_000)
    got = g.packed(xy, first, every, every[:0], every[:0])
    assert g.area(got) == 50_000 and sum(1 for _ in g.each_polygon(got)) == 50_000
    own = [xy]
    assert g.assembled(own.pop, first) == g.assembled(xy, first) and not own
    assert g.area(g.packed(xy, first, every[:0], every[:3], np.zeros(3, int))) == 0


def test_long_outlines_are_in_row_groups_of_their_own(spark, tmp_path):
    import pyarrow.parquet as pq

    long = np.random.default_rng(0).bytes(9 << 20)
    rows = spark.createDataFrame([(0, str(k), bytearray(long)) for k in range(3)], "plan_id bigint, district string, geom binary")
    io.write_districts(rows.coalesce(1), str(tmp_path / "plan.parquet"))
    own = [pq.ParquetFile(f).metadata.num_row_groups for f in (tmp_path / "plan.parquet").glob("*.parquet")]
    assert sum(own) == 3 and spark.read.parquet(str(tmp_path / "plan.parquet")).where(f"length(geom) = {len(long)}").count() == 3
