"""Structured Streaming over recorded steps: periodic refresh, chains followed with state, and event-time windows.

The stream is an append-only folder of step records; a checkpoint makes a run resume where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

#: The state store that typed state and timers need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def steps(spark: SparkSession, path: str, schema: str, kind: str = "parquet") -> DataFrame:
    return spark.readStream.schema(schema).format(kind).load(path)


def periodic(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, every: int = 5, step: str = "step", so_far: DataFrame | None = None) -> StreamingQuery:
    """Call sink for each batch that reaches a step from `every` on that it divides; positive `every` alone.

    The sink gets the due steps, or, where the same records are given as a table, all records up to the last due step, to draw anew from."""
    if every <= 0:
        raise ValueError("the frequency has to be positive")

    def batch(df: DataFrame, n: int) -> None:
        due = df.where((F.col(step) >= every) & (F.col(step) % every == 0))
        last = due.agg(F.max(step)).first()[0]
        if last is not None:
            sink(due if so_far is None else so_far.where(F.col(step) <= last), n)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Follower(StatefulProcessor):
    """Follows a chain: its best score so far, the first step that had it, and whether each plan differs from the one before.

    The state is those few values, whatever the chain's length; a chain that brings nothing for `idle` milliseconds of the
    steps' own time is finished, and its state is dropped by a timer."""

    def __init__(self, chain: str, idle: int | None):
        self.chain, self.idle = chain, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", "score double, step bigint")
        self.last = handle.getValueState("last", "plan string")
        self.timer = handle.getValueState("timer", "at bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        df = pd.concat(list(rows)).sort_values("step", kind="stable")
        score, step = df["score"].to_numpy(float), df["step"].to_numpy()
        best, at = self.best.get() if self.best.exists() else (float("inf"), int(step[0]))
        least = np.minimum.accumulate(np.concatenate([[best], np.where(np.isnan(score), np.inf, score)]))
        place = np.maximum.accumulate(np.where(least[1:] < least[:-1], np.arange(1, len(df) + 1), 0))
        best_step = np.concatenate([[at], step])[place]
        plan = df["plan"].astype(object).where(df["plan"].notna(), None).tolist()
        before = [self.last.get()[0] if self.last.exists() else None, *plan[:-1]]
        known = [self.last.exists(), *[True] * (len(plan) - 1)]
        self.best.update((float(least[-1]), int(best_step[-1])))
        self.last.update((plan[-1],))
        if self.idle is not None:
            if self.timer.exists():
                self.handle.deleteTimer(self.timer.get()[0])
            at = int(df["time"].max().timestamp() * 1000) + self.idle
            self.handle.registerTimer(at)
            self.timer.update((at,))
        yield pd.DataFrame({self.chain: [key[0]] * len(df), "step": step, "score": score, "best": np.where(np.isinf(least[1:]), np.nan, least[1:]), "best_step": best_step, "differs": [not k or a != b for k, a, b in zip(known, before, plan, strict=True)]})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for state in (self.best, self.last, self.timer):
            state.clear()
        yield from ()

    def close(self) -> None:
        pass


def followed(stream: DataFrame, chain: str = "chain_id", idle: int | None = None, time: str = "ts", late: str = "0 seconds") -> DataFrame:
    """(chain_id, step, score, best, best_step, differs) of a stream (chain_id, step, score, plan) as steps arrive.

    Rows of a chain are taken in step order within a batch; the first best step is kept; the first plan of a chain differs.  With
    `idle`, the steps have a time: once the watermark is `idle` milliseconds past a chain's last step, its state goes, and
    what comes later begins anew; rows later than the watermark are dropped."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    kind = stream.schema[chain].dataType.simpleString()
    out = f"{chain} {kind}, step bigint, score double, best double, best_step bigint, differs boolean"
    columns = [chain, "step", "score", "plan"]
    if idle is None:
        return stream.select(*columns).groupBy(chain).transformWithStateInPandas(Follower(chain, None), out, "Append", "None")
    rows = stream.select(*columns, F.col(time).alias("time")).withWatermark("time", late)
    return rows.groupBy(chain).transformWithStateInPandas(Follower(chain, idle), out, "Append", "EventTime")


def run_once(df: DataFrame, path: str, checkpoint: str) -> None:
    """Take in what has arrived since the checkpoint, append the results to a Parquet folder, and stop."""
    query = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def windowed(events: DataFrame, size: str, slide: str | None = None, late: str = "10 minutes", time: str = "ts", by: tuple[str, ...] = ()) -> DataFrame:
    """Counts and sums in tumbling or sliding windows; on a stream, rows later than the watermark are dropped."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return events.withWatermark(time, late).groupBy(w, *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n", "total")


def sessions(events: DataFrame, gap: str, by: str, late: str = "10 minutes", time: str = "ts") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), by, "n", "total")
