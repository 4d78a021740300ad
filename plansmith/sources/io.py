"""Sources and sinks: unit tables, edge weights, plans, boundaries, step logs, caches and run metadata."""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable, Mapping, Sequence
from datetime import date
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.spatial import dissolve, with_area
from ..shared import settle
from . import geofiles

CRS = "EPSG:26912"
#: An outline may have a hundred MB: row groups end after 8 MB, looked at row by row, so that writers and readers hold few outlines at once.
GROUPS = {"parquet.block.size": str(8 << 20), "parquet.block.size.row.check.min": "1", "parquet.page.size.row.check.min": "1"}


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in any store that Spark knows."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def load_units(spark: SparkSession, path: str, crs: str | None = None, target: str = CRS) -> DataFrame:
    """Units from Parquet with WKB, GeoJSON, a shapefile or a zip archive of these; `area` is added where it is missing.  Data of another CRS is refused: nothing here reprojects."""
    if crs is not None and crs != target:
        raise ValueError(f"{path} is in {crs}; reproject it to {target} first")
    return with_area(geofiles.columns(spark, path) if path.endswith(geofiles.ENDINGS) else spark.read.parquet(path))


class Datasets:
    """Unit tables by tag; each value is a path, a DataFrame, or {"data": ..., "transitability": path}."""

    def __init__(self, spark: SparkSession, data: Mapping[str, object], crs: str = CRS):
        self.units: dict[str, DataFrame] = {}
        self.weights: dict[str, DataFrame] = {}
        for key, value in data.items():
            if isinstance(value, Mapping):
                if "data" not in value:
                    raise ValueError(f"dataset {key!r} has no 'data'")
                if value.get("transitability"):
                    self.weights[key] = edge_weights(spark, value["transitability"])
                value = value["data"]
            if not isinstance(value, (str, DataFrame)):
                raise ValueError(f"dataset {key!r} is neither a path nor a DataFrame nor a mapping")
            self.units[key] = load_units(spark, value, target=crs) if isinstance(value, str) else value

    def __getitem__(self, key: str) -> DataFrame:
        if key not in self.units:
            raise KeyError(f"no dataset {key!r}; there are {sorted(self.units)}")
        return self.units[key]

    def keys(self) -> list[str]:
        return sorted(self.units)


EDGE = "u bigint, v bigint, w double"


def edge_weights(spark: SparkSession, path: str) -> DataFrame:
    """(u, v, w) with u under v; the last of several rows for an edge counts; without a w column the weight is 1; a missing file is warned of and empty."""
    try:
        raw = spark.read.option("header", True).csv(path)
        raw.schema  # noqa: B018
    except AnalysisException:
        warnings.warn(f"{path} is not there: no edge weights", stacklevel=2)
        return spark.createDataFrame([], EDGE)
    if "w" not in raw.columns:
        warnings.warn(f"{path} has no column w: every weight is 1", stacklevel=2)
        raw = raw.withColumn("w", F.lit(1.0))
    rows = raw.select(F.col("u").cast("bigint").alias("a"), F.col("v").cast("bigint").alias("b"), F.col("w").cast("double").alias("w"), F.monotonically_increasing_id().alias("i"))
    return rows.groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.max_by("w", "i").alias("w"))


def constant_edge_weights(spark: SparkSession, path: str, penalty: float) -> DataFrame:
    """Every edge of a CSV with one penalty; FileNotFoundError where the file is missing."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return edge_weights(spark, path).select("u", "v", F.lit(float(penalty)).alias("w"))


def load_boundaries(spark: SparkSession, path: str) -> DataFrame | None:
    """An optional overlay: None, with a warning, where it is missing."""
    if not exists(spark, path):
        warnings.warn(f"boundaries {path} are not there", stacklevel=2)
        return None
    return load_units(spark, path)


def boundaries_by_dissolve(units: DataFrame, locality: str, name: str) -> DataFrame:
    """(district: the locality, geom) of localities with an id."""
    from ..functions.columns import is_empty

    own = units.where(~is_empty(locality)).select(F.lit(0).cast("bigint").alias("plan_id"), "node", F.col(locality).cast("string").alias("district"))
    from ..operators.ensemble import locality_names

    return dissolve(own, units).drop("plan_id").withColumnRenamed("district", "locality").join(locality_names(units, locality, name), "locality")


def write_plan(assignment: DataFrame, units: DataFrame, path: str, sums: Sequence[str] = ()) -> DataFrame:
    """District polygons as .parquet, .geojson, .shp or .zip, which load_plan reads back; unassigned units are left out."""
    return write_districts(lambda: dissolve(assignment, units, list(sums) or None), path)


def write_districts(districts: DataFrame | Callable[[], DataFrame], *paths: str) -> DataFrame:
    """District polygons that are there or still to be made, in each of several formats."""
    for path in paths:
        if not path.endswith((".parquet", ".geojson", ".shp", ".zip")):
            raise ValueError(f"{path}: the ending has to be .parquet, .geojson, .shp or .zip")
    out = districts if isinstance(districts, DataFrame) else districts()
    if len(paths) > 1:
        out = settle(out, "districts")  # dissolved once
    for path in paths:
        if path.endswith(".parquet"):
            out.write.mode("overwrite").options(**GROUPS).parquet(path)
        else:
            geofiles.write(out, path)
    return out


def write_steps(metrics: DataFrame, path: str, step: str = "step") -> None:
    """(step, metric, key, value) as JSON lines {step, metric: value or map}: keys are text, in order; a null key is a scalar."""
    by = metrics.groupBy(step, "metric").agg(F.max(F.when(F.col("key").isNull(), F.col("value"))).alias("one"), F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("key").isNotNull(), F.struct(F.col("key").cast("string").alias("key"), "value"))))).alias("many"))
    from ..functions.columns import sorted_map

    entry = F.concat(F.to_json(F.struct(F.col("metric"))).substr(F.lit(11), F.length(F.to_json(F.struct(F.col("metric")))) - 11), F.lit(":"), F.when(F.size("many") > 0, F.to_json(sorted_map("many"))).otherwise(F.coalesce(F.col("one").cast("string"), F.lit("null"))))
    by.groupBy(step).agg(F.concat_ws(",", F.array_sort(F.collect_list(entry))).alias("own")).select(F.concat(F.lit('{"step":'), F.col(step).cast("string"), F.when(F.col("own") != "", F.concat(F.lit(","), F.col("own"))).otherwise(F.lit("")), F.lit("}")).alias("value")).write.mode("append").text(path)


def write_assignment(assignment: DataFrame, path: str) -> None:
    """Parquet, a folder a chain, so a reader of one chain sees its files alone."""
    assignment.write.mode("append").partitionBy("chain_id").parquet(path)


def next_step(spark: SparkSession, path: str) -> int:
    """The step after the last one of an assignment log; 0 without a log."""
    if not exists(spark, path):
        return 0
    top = spark.read.parquet(path).agg(F.max("step")).first()[0]
    return 0 if top is None else top + 1


def cached(spark: SparkSession, path: str, make) -> DataFrame:
    """A table that is made once and read from then on."""
    if not exists(spark, path):
        make().write.parquet(path)
    return spark.read.parquet(path)


def summary_columns(columns: Sequence[str], first: Sequence[str], last: str = r".*_\d+") -> list[str]:
    """The columns of `first`, the others by name, and at the end those of single districts (that match `last`) by length and name."""
    rest = sorted(c for c in columns if c not in first)
    own = [c for c in rest if re.fullmatch(last, c)]
    return [*first, *(c for c in rest if c not in own), *sorted(own, key=lambda c: (c.rstrip("0123456789"), len(c), c))]


def write_summary(summary: DataFrame, path: str, first: Sequence[str]) -> None:
    """CSV with a header in the order of summary_columns; a column of `first` that is missing is 0."""
    summary.select(*(F.col(c) if c in summary.columns else F.lit(0).alias(c) for c in summary_columns(summary.columns, first))).write.mode("overwrite").option("header", True).csv(path)


def write_results(metrics: DataFrame, summary: DataFrame, folder: str, first: Sequence[str]) -> None:
    """What a run leaves: `ensemble_results.json`, a JSON line a step of (step, metric, key, value), and beside it `ensemble_summary.csv`."""
    write_steps(metrics, f"{folder}/ensemble_results.json")
    write_summary(summary, f"{folder}/ensemble_summary.csv", first)


CHAMBERS = {"us_house": {"tolerance": 0.001, "districts": 4}, "state_senate": {"tolerance": 0.01, "districts": 29}, "state_house": {"tolerance": 0.01, "districts": 75}}


def chamber(name: str, maps: str | None = None) -> dict:
    """Population tolerance and districts of a chamber, and the comparison maps of the folder `maps` by name; ValueError for an unknown one."""
    if name not in CHAMBERS:
        raise ValueError(f"unknown chamber {name!r}; there are {sorted(CHAMBERS)}")
    own = sorted(p for p in Path(maps).iterdir() if p.suffix in (".parquet", *geofiles.ENDINGS)) if maps else []
    return CHAMBERS[name] | {"comparison_maps": {p.stem: str(p) for p in own}}


def load_plan(spark: SparkSession, path: str, plan: object = 0, column: str = "district") -> DataFrame:
    """(plan_id, district, geom) of a plan's file; without the column the districts are numbered from 1, row by row, as only the rows tell them apart."""
    if path.endswith(geofiles.ENDINGS):
        units, order = geofiles.columns(spark, path, "file", "position"), ("file", "position")
    else:
        units, order = spark.read.parquet(path), (F.monotonically_increasing_id(),)
    if column not in units.columns:  # a plan has few rows
        units = units.withColumn(column, F.row_number().over(Window.orderBy(*order)))
    return units.select(F.lit(plan).alias("plan_id"), F.col(column).cast("string").alias("district"), "geom")


def district_count(spark: SparkSession, path: str) -> int:
    """How many features, or rows, a plan's file has."""
    return (geofiles.read(spark, path, shapes=False) if path.endswith(geofiles.ENDINGS) else spark.read.parquet(path)).count()


def step_images(spark: SparkSession, folder: str) -> DataFrame:
    """(step, name) of the images step_<n>.png of a folder by name; the images themselves are not read."""
    name = F.element_at(F.split("path", "/"), -1)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "step_*.[pP][nN][gG]").load(folder).select(name.alias("name"))
    return files.select(F.regexp_extract("name", r"_([0-9]+)\.[^_]*$", 1).try_cast("bigint").alias("step"), "name").orderBy("name")


def run_tag(prefix: str, when: date) -> str:
    """The name of a run: prefix and day."""
    return f"{prefix}-{when:%Y%m%d}"


def newest_config(folder: str) -> Path:
    """The YAML file that changed last."""
    own = sorted(Path(folder).glob("*.y*ml"), key=lambda p: p.stat().st_mtime)
    if not own:
        raise FileNotFoundError(f"no YAML in {folder}")
    return own[-1]


def write_metadata(folder: str, **sections: object) -> Path:
    import yaml

    path = Path(folder) / "run.yaml"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(yaml.safe_dump(sections, sort_keys=False))
    return path


def run_directory(folder: str) -> dict:
    """What write_metadata put there, and the folder's parts."""
    import yaml

    path = Path(folder) / "run.yaml"
    if not path.exists():
        raise FileNotFoundError(path)
    return yaml.safe_load(path.read_text()) | {"folder": str(folder), "parts": sorted(p.name for p in Path(folder).iterdir())}
