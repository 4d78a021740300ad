"""Recorded runs: a chain's states evaluated set-at-a-time, written with their configuration, shown to callbacks, and found again.

A run's folder holds config.yaml (the replayable configuration), run.yaml (geography, population, constraints, callbacks),
output (a JSON line a step) and assignments (Parquet, a folder a chain).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import io
from .config import Config, Context, long_form

#: Called with the plan (node, district), its step and the run's folder.
Callback = Callable[[DataFrame, int, str], None]


class Run:
    """A configuration, the paths of its datasets (tag to {"data": ..., "plan": ..., "transitability": ...}) and callbacks."""

    def __init__(self, config: Config, datasets: Mapping[str, Mapping[str, str]], default: str | None = None, crs: str = io.CRS):
        if not datasets:
            raise ValueError("a run needs a dataset")
        self.config, self.datasets, self.crs = config, {k: dict(v) for k, v in datasets.items()}, crs
        self.default = default or next(iter(datasets))
        if self.default not in datasets:
            raise KeyError(f"no dataset {self.default!r}; there are {sorted(datasets)}")
        self.callbacks: dict[str, tuple[int, Callback]] = {}

    def add_callback(self, name: str, action: Callback | None, frequency: int = 1) -> Run:
        """Call action on every frequency-th step; ValueError without an action or a positive frequency."""
        if frequency <= 0:
            raise ValueError("the frequency has to be positive")
        if not callable(action):
            raise ValueError("a callback needs an action")
        self.callbacks[name] = (frequency, action)
        return self

    def units(self, spark: SparkSession) -> DataFrame:
        return io.load_units(spark, self.datasets[self.default]["data"], target=self.crs)

    def record(self, plans: DataFrame, context: Callable[[DataFrame], Context], folder: str, **about: object) -> DataFrame:
        """Evaluate the states (chain_id, step, node, district) of one chain and write the run's folder; the metrics (step, metric, key, value) come back.

        Steps are numbered from 1 in the folder and for the callbacks, which get each due state as it was written."""
        spark = plans.sparkSession
        out = Path(folder)
        out.mkdir(parents=True, exist_ok=True)
        io.write_assignment(plans.select("chain_id", (F.col("step") + 1).alias("step"), "node", "district"), f"{folder}/assignments")
        kept = spark.read.parquet(f"{folder}/assignments")
        own = context(kept.select(F.col("step").alias("plan_id"), "node", "district"))
        try:
            metrics = long_form(self.config.collect_metrics(own)).withColumnRenamed("plan_id", "step")
            io.write_steps(metrics, f"{folder}/output")
            people = own.units.agg(F.sum(self.config.pop_column)).first()[0]
        finally:
            own.close()
        districts = kept.select("district").distinct().count()
        self.config.to_yaml(str(out / "config.yaml"))
        io.write_metadata(
            folder, geography={"crs": self.crs, "datasets": self.datasets, "default_dataset": self.default},
            population={"column": self.config.pop_column, "total": int(people or 0), "districts": districts, "ideal": float(people or 0) / max(1, districts)},
            surcharges=dict(self.config.surcharges), updaters=sorted(self.config.updaters), constraints=self.config.constraint_params(),
            callbacks={n: f for n, (f, _) in self.callbacks.items()}, run=dict(about),
        )
        for step in [r[0] for r in kept.select("step").distinct().orderBy("step").collect()]:  # a number a step
            for frequency, action in self.callbacks.values():
                if step % frequency == 0:
                    action(kept.where(F.col("step") == step).select("node", "district"), step, folder)
        return metrics

    @classmethod
    def from_directory(cls, folder: str) -> Run:
        """The run that a folder was written by, without its callbacks; FileNotFoundError without its files, ValueError without its geography."""
        about = io.run_directory(folder)
        geography = about.get("geography") or {}
        if not geography.get("datasets"):
            raise ValueError(f"{folder}/run.yaml has no geography")
        return cls(Config.from_yaml(f"{folder}/config.yaml"), geography["datasets"], geography.get("default_dataset"), geography.get("crs", io.CRS))

    @staticmethod
    def steps(spark: SparkSession, folder: str) -> DataFrame:
        """The assignments of a run's folder, to go on from or to evaluate anew."""
        return spark.read.parquet(f"{folder}/assignments")
