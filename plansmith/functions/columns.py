"""Column builders and schema scans: totals, election columns and their labels, empty ids, guarded division."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ELECTION = re.compile(r"G(\d{2})(.{3})(.?)")
PARTIES = ("D", "R", "-")


def shared_columns(frames: Mapping[str, DataFrame]) -> list[str]:
    """Columns of every dataset, sorted."""
    return sorted(set.intersection(*(set(f.columns) for f in frames.values()))) if frames else []


def columns_unique_to(frames: Mapping[str, DataFrame], key: str) -> list[str]:
    """Columns of one dataset alone, sorted; KeyError for an unknown one."""
    if key not in frames:
        raise KeyError(f"no dataset {key!r}; there are {sorted(frames)}")
    return sorted(set(frames[key].columns).difference(*(f.columns for k, f in frames.items() if k != key)))


def number(c: str | Column) -> Column:
    """A vote or population count: what is no number, or not a number, counts as 0."""
    c = F.col(c) if isinstance(c, str) else c
    x = c.try_cast("double")
    return F.when(x.isNull() | F.isnan(x), 0.0).otherwise(x)


def add_total(df: DataFrame, name: str, sources: Sequence[str]) -> DataFrame:
    """The sum of those source columns that exist; nothing changes where the column exists or no source does."""
    there = [c for c in sources if c in df.columns]
    if name in df.columns or not there:
        return df
    return df.withColumn(name, reduce(lambda a, b: a + b, map(number, there)))


def election_columns(columns: Iterable[str], years: Sequence[int] = (), offices: Sequence[str] = ()) -> list[str]:
    """Names of the form GYYOFFICE..., of the years and offices asked for (none: all), sorted."""
    own = [(c, m) for c in columns if (m := ELECTION.match(c))]
    return sorted(c for c, m in own if (not years or 2000 + int(m[1]) in years) and (not offices or m[2] in offices))


def election_labels(columns: Iterable[str], years: Sequence[int] = (), offices: Sequence[str] = (), parties: Sequence[str] = PARTIES, overrides: Mapping[str, Mapping[str, str]] | None = None) -> dict[str, dict[str, str]]:
    """Election to label to column: labels number a party's candidates in column order; overrides are merged in and may add elections."""
    out: dict[str, dict[str, str]] = {}
    for c in election_columns(columns, years, offices):
        year, office, letter = ELECTION.match(c).groups()
        party = letter if letter in ("D", "R") else "-"
        if not letter or party not in parties:
            continue
        own = out.setdefault(f"{2000 + int(year)}{office}", {})
        own[party + str(1 + sum(k[0] == party for k in own))] = c
    for election, labels in (overrides or {}).items():
        out.setdefault(election, {}).update(labels)
    return out


#: The years and offices that short column names may have.
YEARS = (2016, 2018, 2020, 2024)
OFFICES = ("PRE", "GOV", "ATG", "AUD", "TRE", "USS")
SHORT = re.compile(r"(\d\d)(.{3})([DRO])", re.ASCII)


def short_columns(columns: Iterable[str], years: Sequence[int] = (), offices: Sequence[str] = OFFICES) -> list[str]:
    """Columns that are a year, an office and a party letter alone (20PRED), sorted; no years: all."""
    own = [(c, m) for c in columns if (m := SHORT.fullmatch(c))]
    return sorted(c for c, m in own if m[2] in offices and (not years or 2000 + int(m[1]) in years))


def contested(df: DataFrame, years: Sequence[int] = YEARS, offices: Sequence[str] = OFFICES) -> DataFrame:
    """(election, d, r): elections whose two short columns are there and both hold votes, summed in one pass."""
    have = set(df.columns)
    named = [(f"{y}_{o}", *own) for y in years for o in offices if have.issuperset(own := [f"{y % 100:02d}{o}{x}" for x in "DR"])]
    if not named:
        return df.sparkSession.createDataFrame([], "election string, d double, r double")
    rows = F.array(*(F.struct(F.lit(e).alias("election"), F.sum(number(d)).alias("d"), F.sum(number(r)).alias("r")) for e, d, r in named))
    return df.agg(rows.alias("rows")).select(F.inline("rows")).where("d > 0 AND r > 0")


def election_in(election: str | Column, years: Sequence[int] = (), offices: Sequence[str] = ()) -> Column:
    """Whether a YEAR_OFFICE is of the years and offices asked for (none: all); a name of another form passes only where nothing is asked."""
    e = F.col(election) if isinstance(election, str) else election
    if not years and not offices:
        return F.lit(True)
    ok = e.rlike("^[0-9]+_[^_]*$")
    if years:
        ok = ok & F.coalesce(F.split_part(e, F.lit("_"), F.lit(1)).try_cast("int").isin([int(y) for y in years]), F.lit(False))
    return ok & F.split_part(e, F.lit("_"), F.lit(2)).isin(list(offices)) if offices else ok


def melt_votes(units: DataFrame, elections: Mapping[str, Mapping[str, str]], node: str = "node") -> DataFrame:
    """Wide vote columns to (node, election, label, party, votes), once, by an explode that needs no shuffle."""
    rows = [F.struct(F.lit(e).alias("election"), F.lit(k).alias("label"), F.lit(k[:1]).alias("party"), number(c).alias("votes")) for e, own in elections.items() for k, c in own.items() if c in units.columns]
    return units.select(node, F.explode(F.array(*rows)).alias("v")).select(node, "v.*")


def is_empty(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c.isNull() | (F.trim(c.cast("string")) == "") | (F.lower(c.cast("string")) == "nan")


def fill_empty_ids(df: DataFrame, columns: Sequence[str], order: str = "node", buckets: int = 256) -> DataFrame:
    """New ids, as strings, for empty ones: from the largest number + 1, in order of `order`; other values stay.

    The running number comes from counts per range bucket, so no task sees all rows.
    """
    for c in (c for c in columns if c in df.columns):
        spark = df.sparkSession
        top = df.agg(F.max(F.when(~is_empty(c), F.col(c).try_cast("double"))).alias("m"), F.min(order).alias("a"), F.max(order).alias("b")).first()
        start, low, high = int(top["m"] or 0), top["a"] or 0, top["b"] or 0
        step = max(1, -(-(high - low + 1) // buckets))
        bucket = F.floor((F.col(order) - low) / step).cast("int")
        counts = df.where(is_empty(c)).groupBy(bucket.alias("bucket_")).agg(F.count("*").alias("n")).collect()  # `buckets` rows at most
        offsets, seen = [], start
        for r in sorted(counts, key=lambda r: r["bucket_"]):
            offsets.append((r["bucket_"], seen))
            seen += r["n"]
        if not offsets:
            df = df.withColumn(c, F.col(c).cast("string"))
            continue
        base = F.broadcast(spark.createDataFrame(offsets, "bucket_ int, base_ bigint"))
        n = F.row_number().over(Window.partitionBy("bucket_").orderBy(order))
        new = df.where(is_empty(c)).withColumn("bucket_", bucket).join(base, "bucket_").withColumn(c, (F.col("base_") + n).cast("string"))
        df = df.where(~is_empty(c)).withColumn(c, F.col(c).cast("string")).unionByName(new.select(*df.columns))
    return df


def ratio(a: str | Column, b: str | Column, zero: str = "null") -> Column:
    """a / b; by zero: null, or with zero="inf" infinity for a nonzero a."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    out = F.try_divide(a.cast("double"), b.cast("double"))
    if zero == "null":
        return out
    if zero != "inf":
        raise ValueError("zero has to be 'null' or 'inf'")
    return F.when((b == 0) & (a != 0), F.when(a > 0, float("inf")).otherwise(float("-inf"))).otherwise(out)


def uniform(*key: str | Column, seed: int = 0) -> Column:
    """A number from 0 to 1 that its key alone decides, however the rows are partitioned."""
    h = F.xxhash64(F.lit(seed), *(F.col(k) if isinstance(k, str) else k for k in key))
    return F.shiftrightunsigned(h, 11).cast("double") / float(2**53)


def region_mismatch(a: str | Column, b: str | Column) -> Column:
    """An edge crosses regions where the ids differ or one is missing."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.coalesce(a != b, F.lit(True))


def sorted_map(m: str | Column) -> Column:
    """A map with string keys, numbers in order of size before other keys."""
    m = F.col(m) if isinstance(m, str) else m
    entry = F.transform(F.map_entries(m), lambda e: F.struct(F.coalesce(e["key"].try_cast("double"), F.lit(float("inf"))).alias("n"), e["key"].cast("string").alias("k"), e["value"].alias("v")))
    return F.map_from_entries(F.transform(F.array_sort(entry), lambda e: F.struct(e["k"], e["v"])))


def coupon_spacing(k: int, half: bool = False) -> int:
    """Steps after which k districts have all been touched, by expectation: k H(k), or half of it, rounded up."""
    from fractions import Fraction
    from math import ceil

    return ceil(k * sum(Fraction(1, i) for i in range(1, k + 1)) / (2 if half else 1))
