"""The tables behind the reports on an ensemble: shaded maps, shares and seats, and the panels of a summary."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import quantiles as q
from .results import averages, bias_bins, histogram, integer_histogram


def shaded(assignment: DataFrame, values: DataFrame, by: str | None = None, limits: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """(plan_id, node, district, value, shade): each unit with its district's value `by` and where that lies between the limits, from 0 to 1.

    values: (plan_id, district, numbers).  Without `by`, or with a warning where values lack it, districts are shaded by their order in the
    plan instead, and have no value.  ValueError for limits that are not in order."""
    low, high = map(float, limits)
    if not low < high:
        raise ValueError(f"the limits {limits} are not in order")
    own = assignment.withColumn("district", F.col("district").cast("string"))
    if by is not None and by not in values.columns:
        warnings.warn(f"there is no value {by!r} to shade by: districts are shaded by their order", stacklevel=2)
        by = None
    if by is None:
        plan = Window.partitionBy("plan_id")  # a plan's districts are few
        names = own.where("district IS NOT NULL").select("plan_id", "district").distinct()
        at, last = F.row_number().over(plan.orderBy(F.length("district"), "district")) - 1, F.count("*").over(plan) - 1
        shades = names.select("plan_id", "district", F.lit(None).cast("double").alias("value"), F.coalesce(F.try_divide(at.cast("double"), last), F.lit(0.0)).alias("shade"))
    else:
        value = F.col(by).cast("double")
        shades = values.select("plan_id", F.col("district").cast("string").alias("district"), value.alias("value"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (value - low) / (high - low))).alias("shade"))
        shades = shades.withColumn("shade", F.when(F.col("value").isNotNull(), F.col("shade")))
    return own.join(shades, ["plan_id", "district"], "left").select("plan_id", "node", "district", "value", "shade")


def shares_and_seats(shares: DataFrame, step: str = "step", win: float = 0.5) -> DataFrame:
    """(panel, key, n, low, middle, high, mean) of shares (step, district, share), in one table.

    Panel "share" has a row a district: how many steps have a share of it, the least, the median, the largest and the mean.  Panel "seats"
    has a row for every number of seats from none to all districts, even if no step has it: the steps with so many districts over
    `win`; and least, median, largest and mean number of seats over all steps.  Missing shares win nothing and count nowhere else."""
    own = shares.where(F.col("share").isNotNull())
    spread = own.groupBy("district").agg(F.count("*").alias("n"), F.min("share").alias("low"), F.max("share").alias("high"), F.avg("share").alias("mean"))
    middle = q.quantiles(own, ["district"], [0.5], ["middle"], "share")
    by_district = spread.join(middle, "district").select(F.lit("share").alias("panel"), F.col("district").cast("string").alias("key"), "n", "low", "middle", "high", "mean")
    seats = own.groupBy(step).agg(F.count_if(F.col("share") > win).alias("seats"))
    most = own.agg(F.count_distinct("district").alias("k")).where("k > 0").select(F.explode(F.sequence(F.lit(0).cast("bigint"), "k")).alias("seats"))
    whole = seats.agg(F.min("seats").cast("double").alias("low"), F.median("seats").alias("middle"), F.max("seats").cast("double").alias("high"), F.avg("seats").alias("mean"))  # at most as many values as districts
    counts = most.join(seats.groupBy("seats").agg(F.count("*").alias("n")), "seats", "left").join(F.broadcast(whole))
    return by_district.unionByName(counts.select(F.lit("seats").alias("panel"), F.col("seats").cast("string").alias("key"), F.coalesce("n", F.lit(0)).alias("n"), "low", "middle", "high", "mean"))


def summary_panels(summary: DataFrame, shares: DataFrame, districts: int, metrics: Sequence[str] = ("efficiency_gap", "mean_median"), splits: Sequence[str] = ("split_county", "split_muni")) -> dict[str, DataFrame]:
    """All panels of a summary (step, metrics, splits, perhaps partisan_bias), by name: histograms of the metrics and splits that are there, bias in bins of its own, averages, and shares and seats."""
    there = lambda names: [c for c in names if c in summary.columns]
    out = {c: histogram(summary.select(F.col(c).cast("double").alias("value")), [], 30) for c in there(metrics)}
    out |= {c: integer_histogram(summary.select(F.col(c).cast("double").alias("value")), []) for c in there(splits)}
    if "partisan_bias" in summary.columns:
        out["partisan_bias"] = bias_bins(summary.select(F.col("partisan_bias").alias("value")), districts)
    return out | {"averages": averages(summary, splits), "shares_and_seats": shares_and_seats(shares)}
