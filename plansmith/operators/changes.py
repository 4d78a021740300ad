"""A chain kept as its first plan and the units that change district, and what follows from it as running sums over the changes.

A chain of n steps over m units is n * m rows as plans, but a step moves few units.  Tallies, splits and cut edges of every
step come from the base plan and the changes alone: a change takes from one district and gives to another; a locality's part appears
or goes when its count of units leaves or reaches 0; an edge changes when one of its ends does.

base: (chain_id, node, district), the plan of step 0; log: (chain_id, step, node, old, new), steps from 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def changes(plans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Base and log of whole plans (chain_id, step, node, district), whose steps count from 0 without a gap."""
    before = F.lag("district").over(Window.partitionBy("chain_id", "node").orderBy("step"))
    moved = plans.withColumn("old", before).where("step > 0 AND NOT (old <=> district)")
    return plans.where("step = 0").select("chain_id", "node", "district"), moved.select("chain_id", "step", "node", "old", F.col("district").alias("new"))


def followed(base: DataFrame, moves: DataFrame) -> DataFrame:
    """The log of moves (chain_id, step, node, new), at most one a step and node: what each leaves is filled in, and moves to where a unit is drop out."""
    every = base.select("chain_id", F.lit(0).cast("bigint").alias("step"), "node", F.col("district").alias("new")).unionByName(moves.select("chain_id", F.col("step").cast("bigint").alias("step"), "node", "new"))
    old = F.lag("new").over(Window.partitionBy("chain_id", "node").orderBy("step"))
    return every.withColumn("old", old).where("step > 0 AND NOT (old <=> new)").select("chain_id", "step", "node", "old", "new")


def plan_at(base: DataFrame, log: DataFrame, step: int) -> DataFrame:
    """(chain_id, node, district) of one step."""
    last = log.where(F.col("step") <= step).groupBy("chain_id", "node").agg(F.max_by("new", "step").alias("new"), F.lit(True).alias("moved"))
    return base.join(last, ["chain_id", "node"], "left").select("chain_id", "node", F.when(F.col("moved"), F.col("new")).otherwise(F.col("district")).alias("district"))


def steps_of(base: DataFrame, steps: int) -> DataFrame:
    return base.select("chain_id").distinct().withColumn("step", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(steps).cast("bigint"))))


def running(deltas: DataFrame, grid: DataFrame, keys: list[str], value: str = "delta") -> DataFrame:
    """(keys, step, value) of every step of grid: the sum of the deltas up to it."""
    rows = deltas.select(*keys, "step", value).unionByName(grid.select(*keys, "step", F.lit(0).cast(deltas.schema[value].dataType).alias(value)))
    by = rows.groupBy(*keys, "step").agg(F.sum(value).alias(value))
    return by.withColumn(value, F.sum(value).over(Window.partitionBy(*keys).orderBy("step")))


def tallies(base: DataFrame, log: DataFrame, units: DataFrame, column: str, steps: int) -> DataFrame:
    """(chain_id, step, district, column): the sum of a unit column in each district at every step from 0 to steps."""
    own = units.select("node", F.col(column).alias("delta"))
    side = lambda c, sign: F.struct(F.col(c).alias("district"), (sign * F.col("delta")).alias("delta"))
    moved = log.join(own, "node").select("chain_id", "step", F.explode(F.array(side("old", -1), side("new", 1))).alias("x")).select("chain_id", "step", "x.*")
    first = base.join(own, "node").select("chain_id", F.lit(0).cast("bigint").alias("step"), "district", "delta")
    deltas = first.unionByName(moved).where("district IS NOT NULL").groupBy("chain_id", "district", "step").agg(F.sum("delta").alias("delta"))
    grid = deltas.select("chain_id", "district").distinct().join(steps_of(base, steps), "chain_id")
    return running(deltas, grid, ["chain_id", "district"]).select("chain_id", "step", "district", F.col("delta").alias(column))


def turns(rows: DataFrame, keys: list[str], held: str) -> DataFrame:
    """From running counts, the steps at which `held` becomes true (delta 1) or false (-1)."""
    now = F.expr(held).cast("bigint")
    before = F.lag(now, 1, 0).over(Window.partitionBy(*keys).orderBy("step"))
    return rows.withColumn("delta", now - before).where("delta <> 0")


def splits(base: DataFrame, log: DataFrame, units: DataFrame, locality: str, steps: int) -> DataFrame:
    """(chain_id, step, num_parts, split): distinct pairs of locality and district, and localities in several districts, at every step."""
    own = units.select("node", F.col(locality).cast("string").alias("locality"))
    side = lambda c, n: F.struct(F.col(c).alias("district"), F.lit(n).cast("bigint").alias("n"))
    moved = log.join(own, "node").select("chain_id", "step", "locality", F.explode(F.array(side("old", -1), side("new", 1))).alias("x")).select("chain_id", "step", "locality", "x.*")
    first = base.join(own, "node").select("chain_id", F.lit(0).cast("bigint").alias("step"), "locality", "district", F.lit(1).cast("bigint").alias("n"))
    part = ["chain_id", "locality", "district"]
    count = first.unionByName(moved).where("district IS NOT NULL").groupBy(*part, "step").agg(F.sum("n").alias("n"))
    count = count.withColumn("n", F.sum("n").over(Window.partitionBy(*part).orderBy("step")))
    parts = turns(count, part, "n > 0")  # a locality's part appears or goes
    by = ["chain_id", "locality"]
    kinds = parts.groupBy(*by, "step").agg(F.sum("delta").alias("n")).withColumn("n", F.sum("n").over(Window.partitionBy(*by).orderBy("step")))
    torn = turns(kinds, by, "n > 1")
    grid = steps_of(base, steps)
    total = lambda df, name: running(df.groupBy("chain_id", "step").agg(F.sum("delta").alias(name)), grid, ["chain_id"], name)
    return total(parts, "num_parts").join(total(torn, "split"), ["chain_id", "step"])


def cut_edges(base: DataFrame, log: DataFrame, edges: DataFrame, steps: int) -> DataFrame:
    """(chain_id, step, cut): edges between districts at every step; an edge is looked at only when one of its ends changes."""
    every = base.select("chain_id", F.lit(0).cast("bigint").alias("step"), "node", F.col("district").alias("new"), F.lit(True).alias("there")).unionByName(log.select("chain_id", "step", "node", "new", F.lit(True).alias("there")))
    end = lambda c: edges.select("u", "v", F.col(c).alias("node")).join(every, "node").select("chain_id", "u", "v", "step", *(F.when(F.lit(x == c), F.struct("new")).alias(f"d{x}") for x in ("u", "v")))
    by = Window.partitionBy("chain_id", "u", "v").orderBy("step")
    rows = end("u").unionByName(end("v")).groupBy("chain_id", "u", "v", "step").agg(F.max("du").alias("du"), F.max("dv").alias("dv"))
    rows = rows.withColumns({c: F.last(c, ignorenulls=True).over(by) for c in ("du", "dv")})
    cut = turns(rows, ["chain_id", "u", "v"], "coalesce(du.new <> dv.new, false)")
    return running(cut.groupBy("chain_id", "step").agg(F.sum("delta").alias("cut")), steps_of(base, steps), ["chain_id"], "cut")
