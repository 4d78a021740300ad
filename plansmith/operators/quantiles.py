"""Exact quantiles of groups of any size: equal values are counted before the shuffle, distinct values are dealt by range, and a place
in the whole order comes from sums of what lies ahead.  No task holds a group: a group's values lie in as many tasks as they need.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import settle

#: Distinct values of all groups together that any task may hold; more are dealt by range.
FEW = 1 << 16


def matches(a: Sequence[str], b: Sequence[str]) -> Column:
    """Null-safe equality of columns pair by pair."""
    out = F.lit(True)
    for x, y in zip(a, b, strict=True):
        out = out & F.col(x).eqNullSafe(F.col(y))
    return out


def ordered(long: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """(by, value, n, ahead, total): each distinct value, its rows, those of its group with smaller values, and all of the group's."""
    own = settle(long.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n")), "values")
    if own.count() <= FEW:
        part = Window.partitionBy(*by)
        return own.withColumns({"ahead": F.sum("n").over(part.orderBy(value)) - F.col("n"), "total": F.sum("n").over(part)})
    dealt = settle(own.repartitionByRange(*by, value).withColumn("part_", F.spark_partition_id()), "ranges")
    names = [f"{c}_by" for c in by]
    ranges = dealt.groupBy(*(F.col(c).alias(x) for c, x in zip(by, names, strict=True)), F.col("part_").alias("part_by")).agg(F.sum("n").alias("m_"))
    group = Window.partitionBy(*names)  # as many rows as a group has ranges
    ranges = ranges.withColumns({"before_": F.sum("m_").over(group.orderBy("part_by")) - F.col("m_"), "total": F.sum("m_").over(group)})
    within = Window.partitionBy(*by, "part_").orderBy(value)
    rows = dealt.join(ranges, matches([*by, "part_"], [*names, "part_by"]))
    return rows.withColumn("ahead", F.col("before_") + F.sum("n").over(within) - F.col("n")).select(*by, value, "n", "ahead", "total")


def quantiles(long: DataFrame, by: Sequence[str], qs: Sequence[float], names: Sequence[str], value: str = "value") -> DataFrame:
    """(by, names): quantiles interpolated between neighbours, for all of qs from one order; groups without values have no row."""
    if any(not 0 <= q <= 1 for q in qs):
        raise ValueError("a quantile lies between 0 and 1")
    rows = ordered(long, by, value)
    place = lambda q: F.lit(float(q)) * (F.col("total") - 1)
    at = lambda k: F.min(F.when(F.col("ahead") + F.col("n") > k, F.col(value)))  # noqa: E731  the value at place k
    ends = [x.alias(f"{side}{i}_") for i, q in enumerate(qs) for side, x in (("low", at(F.floor(place(q)))), ("high", at(F.ceil(place(q)))), ("at", F.max(place(q))))]
    found = rows.groupBy(*by).agg(*ends)
    part = lambda i: F.col(f"at{i}_") - F.floor(F.col(f"at{i}_"))
    low, high = (lambda i: F.col(f"low{i}_")), (lambda i: F.col(f"high{i}_"))
    return found.select(*by, *(F.when(low(i) == high(i), low(i)).otherwise(low(i) * (1 - part(i)) + high(i) * part(i)).alias(n) for i, n in enumerate(names)))
