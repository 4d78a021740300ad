"""Tables in the folder that driver and executors share: written, read back, and dropped when nothing needs them any more."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def place(spark: SparkSession, what: str) -> str:
    """A new path in the folder named in spark.checkpoint.dir; one of our own only where that is unset and there is no cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a shared folder")
        place.own = getattr(place, "own", None) or "file://" + tempfile.mkdtemp(prefix="plansmith-")
        base = place.own
    return f"{base.rstrip('/')}/plansmith/{what}-{uuid.uuid4().hex}"


def settle(df: DataFrame, what: str) -> DataFrame:
    """A table written and read back: its lineage ends there, and an executor that is lost costs nothing."""
    path = place(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def large(df: DataFrame) -> DataFrame:
    """A table with a row a unit or more, for joins: they sort both sides, as an estimate may be far too low and a broadcast gathers the table on the driver."""
    return df.hint("merge")


def drop(*frames: DataFrame) -> None:
    """Delete settled tables."""
    for df in frames:
        spark = df.sparkSession
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/plansmith/" in folder:
                path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)
