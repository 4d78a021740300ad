"""The driver's star-schema tables read as units, votes, edges and plans.

A customer is a unit on a grid of WIDTH columns: its people are its orders and one, its county the nation, its municipality
the segment within the nation.  Order years are elections, order states parties.  Plans are fixed arithmetic on the unit.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import large

WIDTH = 40
PLANS = 6
DISTRICTS = 4


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, totpop, county, muni, region id, name, area, x, y; a customer without orders is a unit of one."""
    n = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    c = read(spark, sf_dir, "customer").join(large(n), "c_custkey", "left")
    county = F.col("c_nationkey").cast("string")
    return c.select(F.col("c_custkey").alias("node"), (1 + F.coalesce("n", F.lit(0))).alias("totpop"), county.alias("county"), F.concat_ws("-", county, "c_mktsegment").alias("muni"), F.col("c_mktsegment").alias("segment"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("acctbal"), F.lit(1.0).alias("area"), (F.col("c_custkey") % WIDTH).alias("x"), F.expr(f"c_custkey div {WIDTH}").alias("y"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each unit with its right and its upper neighbour."""
    u = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("u"))
    to = F.explode(F.array(F.when(F.col("u") % WIDTH < WIDTH - 1, F.col("u") + 1), F.col("u") + WIDTH))
    there = u.select(F.col("u").alias("v"))
    return u.select("u", to.alias("v")).where("v IS NOT NULL").join(large(there), "v", "left_semi").select("u", "v", F.lit(1.0).alias("shared_perim"))


def with_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units with boundary_perim: the sides that no neighbour shares."""
    e = edges(spark, sf_dir)
    sides = e.select("u").union(e.select("v")).groupBy(F.col("u").alias("node")).agg(F.count("*").alias("s"))
    return units(spark, sf_dir).join(large(sides), "node", "left").withColumn("boundary_perim", F.lit(4.0) - F.coalesce("s", F.lit(0))).drop("s")


def geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units with unit squares as WKB, put together from bytes in one batch function."""
    from ..functions.geometry import box

    @F.pandas_udf("binary")
    def square(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([box(a, b, a + 1, b + 1) for a, b in zip(x, y, strict=True)])

    return units(spark, sf_dir).withColumn("geom", square("x", "y"))


def bricks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units as bricks: rows are shifted, so the corners of a row lie on the sides of the next."""
    from ..functions.geometry import box

    @F.pandas_udf("binary")
    def brick(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([box(a, b, a + 1, b + 1) for a, b in zip(x, y, strict=True)])

    return units(spark, sf_dir).withColumn("geom", brick(F.col("x") + F.col("y") * 37 % 100 / 100, "y"))


def ells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two units a box of 2 x 2.5: an L along its lower and right side, and what that leaves."""
    import numpy as np

    from ..functions.geometry import wkb

    ell = np.array([(0, 0), (2, 0), (2, 2.5), (1.5, 2.5), (1.5, 0.5), (0, 0.5), (0, 0)], float)
    rest = np.array([(0, 0.5), (1.5, 0.5), (1.5, 2.5), (0, 2.5), (0, 0.5)], float)

    @F.pandas_udf("binary")
    def shape(node: pd.Series) -> pd.Series:
        return pd.Series([wkb([(ell if n % 2 else rest) + (2.0 * (n // 2 % WIDTH), 2.5 * (n // 2 // WIDTH))]) for n in node])

    return units(spark, sf_dir).withColumn("geom", shape("node"))


def votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node, election, party, votes."""
    party = F.when(F.col("o_orderstatus") == "F", "D").when(F.col("o_orderstatus") == "O", "R").otherwise("-")
    return read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("node"), F.year("o_orderdate").cast("string").alias("election"), party.alias("party")).agg(F.count("*").alias("votes"))


def assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """plan_id, node, district of PLANS plans: made from the unit alone, so nothing is joined."""
    p = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(PLANS - 1).cast("bigint"))).alias("plan_id"))
    return p.select("plan_id", "node", F.expr(f"cast((node * (2 * plan_id + 1) + 7 * plan_id + node div (plan_id + 3)) % {DISTRICTS} as string)").alias("district"))


def stripes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One plan of DISTRICTS vertical stripes: contiguous, for chains to start from."""
    return read(spark, sf_dir, "customer").select(F.lit(0).cast("bigint").alias("plan_id"), F.col("c_custkey").alias("node"), F.expr(f"cast(c_custkey % {WIDTH} div {WIDTH // DISTRICTS} as string)").alias("district"))


def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half a point on every edge between nations."""
    u = large(units(spark, sf_dir).select("node", "county"))
    e = edges(spark, sf_dir).join(u.select(F.col("node").alias("u"), F.col("county").alias("a")), "u").join(u.select(F.col("node").alias("v"), F.col("county").alias("b")), "v")
    return e.where("a <> b").select("u", "v", F.lit(0.5).alias("w"))


def long_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(step, metric, key, value) of the plans: people and two-party index by district, with plans as steps."""
    from ..operators import ensemble as e

    a = assignment(spark, sf_dir)
    pop = e.tally(a, units(spark, sf_dir), "totpop").select(F.col("plan_id").alias("step"), F.lit("population").alias("metric"), F.col("district").alias("key"), F.col("totpop").cast("double").alias("value"))
    share = e.partisan(a, votes(spark, sf_dir)).where("district <> 'S'").select(F.col("plan_id").alias("step"), F.lit("share").alias("metric"), F.col("district").alias("key"), F.col("index_d").alias("value"))
    return pop.union(share)


#: The same tables for DuckDB.
SQL = f"""
units AS (SELECT c_custkey AS node, 1 + count(o_orderkey) AS totpop, CAST(c_nationkey AS VARCHAR) AS county, CAST(c_nationkey AS VARCHAR) || '-' || c_mktsegment AS muni, c_mktsegment AS segment, c_name AS name, c_acctbal AS acctbal, 1.0::DOUBLE AS area, c_custkey % {WIDTH} AS x, c_custkey // {WIDTH} AS y
  FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL),
edges AS (SELECT a.c_custkey AS u, b.c_custkey AS v, 1.0::DOUBLE AS shared_perim FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1 WHERE a.c_custkey % {WIDTH} < {WIDTH - 1}
  UNION ALL SELECT a.c_custkey, b.c_custkey, 1.0::DOUBLE FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + {WIDTH}),
votes AS (SELECT o_custkey AS node, CAST(year(o_orderdate) AS VARCHAR) AS election, CASE o_orderstatus WHEN 'F' THEN 'D' WHEN 'O' THEN 'R' ELSE '-' END AS party, count(*) AS votes FROM orders GROUP BY ALL),
assignment AS (SELECT p.plan_id, c_custkey AS node, CAST((c_custkey * (2 * p.plan_id + 1) + 7 * p.plan_id + c_custkey // (p.plan_id + 3)) % {DISTRICTS} AS VARCHAR) AS district FROM customer, (SELECT unnest(range({PLANS})) AS plan_id) p)"""
PARTISAN = """
by_party AS (SELECT plan_id, district, election, party, sum(votes) AS votes FROM assignment JOIN votes USING (node) GROUP BY ALL),
long AS (SELECT * FROM by_party UNION ALL SELECT plan_id, 'S', election, party, sum(votes) FROM by_party GROUP BY ALL),
wide AS (SELECT plan_id, district, election, coalesce(sum(votes) FILTER (party = 'D'), 0)::DOUBLE AS d, coalesce(sum(votes) FILTER (party = 'R'), 0)::DOUBLE AS r, coalesce(sum(votes) FILTER (party = '-'), 0)::DOUBLE AS t FROM long GROUP BY ALL),
em AS (SELECT plan_id, district, election, d / nullif(t, 0) AS vote_share_d, r / nullif(t, 0) AS vote_share_r, d / nullif(d + r, 0) AS index_d, r / nullif(d + r, 0) AS index_r, t / nullif(max(t) FILTER (district = 'S') OVER (PARTITION BY plan_id, election), 0) AS statewide_prop FROM wide),
agg AS (SELECT plan_id, district, avg(vote_share_d) AS vote_share_d, avg(vote_share_r) AS vote_share_r, avg(index_d) AS index_d, avg(index_r) AS index_r, avg(statewide_prop) AS statewide_prop FROM em GROUP BY ALL),
state AS (SELECT plan_id, CASE WHEN vote_share_d >= vote_share_r THEN 'D' ELSE 'R' END AS majority, index_d AS sd, index_r AS sr FROM agg WHERE district = 'S'),
seats AS (SELECT a.plan_id, district, majority, CASE majority WHEN 'D' THEN index_d ELSE index_r END AS a, CASE majority WHEN 'D' THEN index_r ELSE index_d END AS b, CASE majority WHEN 'D' THEN sd ELSE sr END AS s, statewide_prop AS w, vote_share_d, vote_share_r FROM agg a JOIN state USING (plan_id) WHERE district <> 'S')"""
STEPS = """
steps AS (SELECT plan_id AS step, 'population' AS metric, district AS key, sum(totpop)::DOUBLE AS value FROM assignment JOIN units USING (node) GROUP BY ALL
  UNION ALL SELECT plan_id, 'share', district, index_d FROM agg WHERE district <> 'S'),
ranked AS (SELECT s.step, s.metric, s.key, s.value, r.rank FROM steps s JOIN (SELECT step, key, row_number() OVER (PARTITION BY step ORDER BY value, length(key), key) - 1 AS rank FROM steps WHERE metric = 'share') r USING (step, key))"""
