"""Analysis of recorded ensembles: flattening, ranking, intervals, histograms and positions against reference maps.

The long form is (step, metric, key, value); wide frames come last, with their columns named beforehand.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import count

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import ratio
from . import quantiles as q

LEAF = "struct<k:string,v:string>"


def read_jsonl(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """(line, metric, json) of the asked top-level keys of each JSON object; blank lines are skipped.

    ValueError for no columns, and for the first line that is no JSON object, with its file, its number (from 1, blank lines included) and its text."""
    if columns is None or isinstance(columns, str) or not list(columns):
        raise ValueError("columns has to be a list of one name or more")
    every = spark.read.text(path).select(F.monotonically_increasing_id().alias("line"), "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    lines = every.where("trim(value) <> ''").withColumn("v", F.try_parse_json("value"))
    bad = lines.where("v IS NULL OR schema_of_variant(v) NOT LIKE 'OBJECT%'").orderBy("file", "block", "line").select("file", "block", "line", "value").head(1)
    if bad:
        b = bad[0]
        before = every.where((F.col("file") == b["file"]) & ((F.col("block") < b["block"]) | ((F.col("block") == b["block"]) & (F.col("line") < b["line"])))).count()
        raise ValueError(f"{b['file']}, line {before + 1}: no JSON object: {b['value'][:80]}")
    parsed = lines.withColumn("own", F.from_json("value", "map<string,string>"))
    return parsed.select("line", F.explode(F.map_filter("own", lambda k, _: k.isin(list(columns)))).alias("metric", "json"))


def flatten(df: DataFrame, key: str, json: str, depth: int | None = None) -> DataFrame:
    """Rows (.., key, value): maps and lists are opened level by level and their keys joined by underscores, down to the scalars or to `depth`; empty ones vanish.

    The driver asks at each level whether a map or list is left."""
    kept = [c for c in df.columns if c not in (key, json)]
    level = df.select(*kept, F.col(key).alias("key"), F.col(json).alias("json"))
    out = None
    for d in count():
        text = F.ltrim(F.col("json"))
        is_map, is_list = text.startswith("{"), text.startswith("[")
        last = d == depth
        leaf = level.where(F.col("json").isNull() | ~(is_map | is_list) | F.lit(last)).select(*kept, "key", F.col("json").alias("value"))
        out = leaf if out is None else out.unionByName(leaf)
        nested = level.where(is_map | is_list)
        if last or depth is None and not nested.head(1):
            return out
        entries = F.when(is_map, F.transform(F.map_entries(F.from_json("json", "map<string,string>")), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")))).when(is_list, F.transform(F.from_json("json", "array<string>"), lambda x, i: F.struct(i.cast("string").alias("k"), x.alias("v"))))
        level = nested.select(*kept, "key", F.explode(entries).alias("e")).select(*kept, F.concat_ws("_", "key", "e.k").alias("key"), F.col("e.v").alias("json"))


def suffix_order(key: str | Column) -> tuple[Column, Column]:
    key = F.col(key) if isinstance(key, str) else key
    return F.length(key), key


def rank_entries(long: DataFrame, by: str, ascending: bool = True, step: str = "step", start: int = 0) -> DataFrame:
    """(step, metric, rank, value): the keys of each step ranked by metric `by`, and every metric's values put in that order.

    Keys whose `by` is missing are left out; ties go by length and text of the key."""
    own = long.where((F.col("metric") == by) & F.col("value").isNotNull() & ~F.isnan("value"))
    order = F.col("value").asc() if ascending else F.col("value").desc()
    rank = own.select(step, "key", (F.row_number().over(Window.partitionBy(step).orderBy(order, *suffix_order("key"))) - 1 + start).alias("rank"))
    return long.join(rank, [step, "key"]).select(step, "metric", "rank", "key", "value")


def widen(ranked: DataFrame, metrics: Sequence[str], ranks: int, step: str = "step") -> DataFrame:
    """metric_0, metric_1, ...: a pivot over names known beforehand."""
    names = [f"{m}_{r}" for m in metrics for r in range(ranks)]
    return ranked.groupBy(step).pivot("name", names).agg(F.max("value")) if "name" in ranked.columns else ranked.withColumn("name", F.concat_ws("_", "metric", "rank")).groupBy(step).pivot("name", names).agg(F.max("value"))


def ranked_means(ranked: DataFrame) -> DataFrame:
    return ranked.groupBy("metric", "rank").agg(F.avg("value").alias("mean"))


def ranked_deviation(ranked: DataFrame, metric: str, step: str = "step") -> DataFrame:
    """Of each step, the root of the mean squared distance from the ranks' means."""
    own = ranked.where(F.col("metric") == metric)
    mean = ranked_means(own).select("rank", "mean")
    return own.join(mean, "rank").groupBy(step).agg(F.sqrt(F.avg(F.pow(F.col("value") - F.col("mean"), 2))).alias("rmd"))


def intervals(long: DataFrame, by: Sequence[str], quantiles: Sequence[float] = (0.025, 0.975), value: str = "value") -> DataFrame:
    """Median and exact quantiles, interpolated between neighbours."""
    return q.quantiles(long, by, [0.5, *quantiles], ["median", *(f"q{i}" for i in range(len(quantiles)))], value)


def from_median(long: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """value less the median of its group; missing where all of the group's values are."""
    names = [f"by{i}_" for i in range(len(by))]
    medians = q.quantiles(long, by, [0.5], ["median_"], value).withColumnsRenamed(dict(zip(by, names, strict=True)))
    return long.join(medians, q.matches(by, names), "left").withColumn("from_median", F.col(value) - F.col("median_")).drop(*names, "median_")


def auto_bins(n: Column, lo: Column, hi: Column, q1: Column, q3: Column) -> Column:
    """How many bins suit n values: the narrower of the rules of Sturges and of Freedman and Diaconis, of the latter no more than twice the root of n; one bin where all values are equal."""
    sturges = (hi - lo) / (F.log2(n) + 1)
    spread = 2 * (q3 - q1) * F.pow(n, F.lit(-1 / 3))
    return F.when(hi > lo, F.ceil((hi - lo) / F.least(sturges, F.greatest(spread, (hi - lo) / F.sqrt(n) / 2)))).otherwise(1)


def with_groups(df: DataFrame, groups: DataFrame, by: Sequence[str]) -> DataFrame:
    """df with its groups' columns; without grouping columns, groups is one row."""
    return df.join(groups, list(by)) if by else df.join(F.broadcast(groups))


def histogram(long: DataFrame, by: Sequence[str], bins: int | str = 30, value: str = "value") -> DataFrame:
    """Equal bins from the smallest to the largest value, the last one closed: bin, lo, hi, n and density.  With "auto", each group has the number that suits it."""
    span = long.groupBy(*by).agg(F.min(value).alias("lo_"), F.max(value).alias("hi_"), F.count(value).alias("n_"))
    if bins == "auto":
        span = with_groups(span, q.quantiles(long, by, [0.25, 0.75], ["q1_", "q3_"], value), by)
    k = auto_bins(*map(F.col, ("n_", "lo_", "hi_", "q1_", "q3_"))) if bins == "auto" else F.lit(bins)
    span = span.withColumn("k_", k).withColumn("width_", (F.col("hi_") - F.col("lo_")) / F.col("k_")).drop("hi_", "q1_", "q3_")
    width = F.col("width_")
    rows = with_groups(long.where(F.col(value).isNotNull()), span, by)
    at = F.when(width == 0, F.lit(0)).otherwise(F.least(F.floor(F.try_divide(F.col(value) - F.col("lo_"), width)), F.col("k_") - 1)).cast("int")
    out = rows.groupBy(*by, at.alias("bin"), "lo_", "width_", "n_").agg(F.count("*").alias("n"))
    return out.select(*by, "bin", (F.col("lo_") + F.col("bin") * width).alias("lo"), (F.col("lo_") + (F.col("bin") + 1) * width).alias("hi"), "n", F.try_divide(F.col("n").cast("double"), F.col("n_") * width).alias("density"))


#: Points of a density curve, bandwidths that it goes on beyond the values, and bins from one point to the next.
POINTS, BEYOND, FINE = 200, 3, 8


def density(long: DataFrame, by: Sequence[str], points: int = POINTS, beyond: float = BEYOND, fine: int = FINE, value: str = "value") -> DataFrame:
    """(by, point, x, density): a Gaussian kernel's density curve with Scott's bandwidth, for groups of several different values.

    Values are counted on a fine grid, each shared between its two neighbours, and the counts, no longer the values, are
    joined with the points whose bins are near enough to matter.  ValueError for fewer than two points."""
    if points < 2:
        raise ValueError("a curve has two points at least")
    rows = long.where(F.col(value).isNotNull() & ~F.isnan(value))
    names = [f"by{i}_" for i in range(len(by))]
    span = rows.groupBy(*(F.col(c).alias(n) for c, n in zip(by, names, strict=True))).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count("*").cast("double").alias("m"), F.stddev_samp(value).alias("sd")).where("sd > 0")
    span = span.withColumn("h", F.col("sd") * F.pow(F.col("m"), F.lit(-0.2)))
    span = span.withColumn("from", F.col("lo") - beyond * F.col("h")).withColumn("step", (F.col("hi") + beyond * F.col("h") - F.col("from")) / (fine * (points - 1)))
    at = (F.col(value) - F.col("from")) / F.col("step")
    both = F.array(F.struct(F.floor(at).alias("bin"), (1 - (at - F.floor(at))).alias("w")), F.struct((F.floor(at) + 1).alias("bin"), (at - F.floor(at)).alias("w")))
    grid = ["from", "step", "h", "m"]
    bins = rows.join(span, q.matches(by, names)).select(*by, *grid, F.explode(both).alias("x")).groupBy(*by, *grid, "x.bin").agg(F.sum("x.w").alias("w"))
    reach = F.ceil(9 * F.col("h") / F.col("step"))  # what lies further adds nothing that a double shows
    first, last = F.ceil((F.col("bin") - reach) / fine), F.floor((F.col("bin") + reach) / fine)
    near = bins.withColumn("point", F.explode(F.sequence(F.greatest(first, F.lit(0)).cast("bigint"), F.least(last, F.lit(points - 1)).cast("bigint"))))
    away = (F.col("point") * fine - F.col("bin")) * F.col("step") / F.col("h")
    total = F.sum(F.col("w") * F.exp(-away * away / 2)) / (F.col("m") * F.col("h") * F.sqrt(2 * F.pi()))
    curve = near.groupBy(*by, *grid, "point").agg(total.alias("density"))
    every = span.withColumn("at_", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(points - 1).cast("bigint")))).select(*names, F.col("at_"), (F.col("from") + F.col("at_") * fine * F.col("step")).alias("x"))
    same = q.matches(by, names) & (F.col("point") == F.col("at_"))
    return every.join(curve, same, "left").select(*(F.col(n).alias(c) for n, c in zip(names, by, strict=True)), F.col("at_").alias("point"), "x", F.coalesce("density", F.lit(0.0)).alias("density"))


def named_references(references: object) -> dict[str, float]:
    """Reference values by name: those of a list are Reference 1, 2, ...; text that is a number counts, anything else is left out."""
    if references is None:
        return {}
    pairs = references.items() if isinstance(references, Mapping) else ((f"Reference {k}", v) for k, v in enumerate(references, 1))
    out = {}
    for name, v in pairs:
        try:
            out[str(name)] = float(v)
        except (TypeError, ValueError):
            continue
    return out


def distribution(long: DataFrame, by: Sequence[str], references: object = None, curve: bool = False, relative: bool = False, quantiles: Sequence[float] = (0.025, 0.975), bins: int | str = 30, value: str = "value") -> dict[str, DataFrame]:
    """What a distribution plot shows: `histogram` or (curve) `density`, `interval`, and `references` (name, value) where there are any; relative: all about the groups' medians.  ValueError without data."""
    if long.where(F.col(value).isNotNull()).isEmpty():
        raise ValueError("there is no data to plot")
    named = named_references(references)
    points = long.sparkSession.createDataFrame(list(named.items()), "name string, value double") if named else None
    if relative:
        if points is not None:
            names = [f"by{i}_" for i in range(len(by))]
            medians = q.quantiles(long, by, [0.5], ["median_"], value).withColumnsRenamed(dict(zip(by, names, strict=True)))
            points = medians.join(points).select(*(F.col(n).alias(c) for n, c in zip(names, by, strict=True)), "name", (F.col("value") - F.col("median_")).alias("value"))
        long = from_median(long, by, value).withColumn(value, F.col("from_median")).drop("from_median")
    out = {"density": density(long, by, value=value)} if curve else {"histogram": histogram(long, by, bins, value)}
    return out | {"interval": intervals(long, by, quantiles, value)} | ({"references": points} if points is not None else {})


def averages(summary: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(metric, mean) of those of the columns that are there, from one pass; missing values do not count."""
    there = [c for c in columns if c in summary.columns]
    rows = F.array(*(F.struct(F.lit(c).alias("metric"), F.avg(c).alias("mean")) for c in there))
    return summary.agg(rows.alias("rows")).select(F.inline("rows")) if there else summary.sparkSession.createDataFrame([], "metric string, mean double")


def integer_histogram(long: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """One bin a whole number."""
    return long.where(F.col(value).isNotNull()).groupBy(*by, F.bround(value).cast("bigint").alias("bin")).agg(F.count("*").alias("n"))


def bias_bins(long: DataFrame, districts: int, value: str = "value") -> DataFrame:
    """Bins of width 1/k about each value that occurs: the edges that draw partisan bias."""
    half = 1.0 / (2 * districts)
    return long.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("centre")).agg(F.count("*").alias("n")).select("centre", (F.col("centre") - half).alias("lo"), (F.col("centre") + half).alias("hi"), "n")


def reference_points(reference: DataFrame) -> DataFrame:
    """(map_name, rank, value): each map's values in ascending order; missing ones are left out."""
    own = reference.where(F.col("value").isNotNull())
    return own.select("map_name", (F.row_number().over(Window.partitionBy("map_name").orderBy("value", *suffix_order("key"))) - 1).alias("rank"), "value")


def outlier_position(ranked: DataFrame, points: DataFrame, metric: str) -> DataFrame:
    """The share of the ensemble at or under each reference point of the same rank; counts are summed before the shuffle."""
    own = ranked.where(F.col("metric") == metric).select("rank", F.col("value").alias("x"))
    return own.join(points, "rank").groupBy("map_name", "rank", F.col("value")).agg(ratio(F.count_if(F.col("x") <= F.col("value")), F.count("*")).alias("position"))


def running_best(scores: DataFrame, chain: str = "chain_id", step: str = "step", score: str = "score", latest: bool = False) -> DataFrame:
    """The best (smallest) score so far and the step that gave it: the first such step, or with `latest` the last."""
    w = Window.partitionBy(chain).orderBy(step).rowsBetween(Window.unboundedPreceding, 0)
    tie = -F.col(step) if latest else F.col(step)
    return scores.withColumn("best", F.min(score).over(w)).withColumn("best_step", F.min_by(step, F.struct(F.col(score), tie)).over(w))


def every(steps: DataFrame, spacing: int, step: str = "step", last: bool = False) -> DataFrame:
    """Every spacing-th step from 0, or with `last` the last of each group."""
    if spacing <= 0:
        raise ValueError("the spacing has to be positive")
    return steps.where(F.col(step) % spacing == (spacing - 1 if last else 0))


def objective(value: Column, kind: str) -> Column:
    """An updater's value as one number: the sum of a map, the size of a list, a scalar as it is."""
    if kind == "map":
        return F.aggregate(F.map_values(value), F.lit(0.0), lambda a, x: a + x)
    return F.size(value).cast("double") if kind == "list" else value.cast("double")


def average_margin(values: Column) -> Column:
    """The mean of a list's values that are there."""
    own = F.filter(values, lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(own, F.lit(0.0), lambda a, x: a + x), F.size(own))


def series(long: DataFrame, metric: str, metrics: Sequence[str]) -> DataFrame:
    """(step, key, value) of one metric, for plotting; ValueError for an unknown one."""
    if metric not in metrics:
        raise ValueError(f"unknown metric {metric!r}")
    return long.where(F.col("metric") == metric).select("step", "key", "value")


def panels(frames: dict[str, DataFrame]) -> DataFrame:
    """Several named sets on one axis."""
    out = None
    for name, df in frames.items():
        df = df.withColumn("panel", F.lit(name))
        out = df if out is None else out.unionByName(df)
    return out


def values_by_unit(assignment: DataFrame, values: DataFrame) -> DataFrame:
    """District values for each unit, matched by the districts' text."""
    return assignment.withColumn("district", F.col("district").cast("string")).join(values.select("plan_id", F.col("district").cast("string").alias("district"), "value"), ["plan_id", "district"], "left")


def bounds(units: DataFrame, names: Sequence[str], column: str = "name", needed: int = 3, pad: float = 0.05) -> DataFrame:
    """The padded bounding box of regions by upper-case name; no row unless the first `needed` names are found."""
    own = units.where(F.upper(column).isin([n.upper() for n in names]))
    box = own.agg(F.min("minx").alias("x0"), F.min("miny").alias("y0"), F.max("maxx").alias("x1"), F.max("maxy").alias("y1"), F.count_distinct(F.when(F.upper(column).isin([n.upper() for n in names[:needed]]), F.upper(column))).alias("found"))
    w, h = (F.col("x1") - F.col("x0")) * pad, (F.col("y1") - F.col("y0")) * pad
    return box.where(F.col("found") >= needed).select((F.col("x0") - w).alias("minx"), (F.col("y0") - h).alias("miny"), (F.col("x1") + w).alias("maxx"), (F.col("y1") + h).alias("maxy"))
