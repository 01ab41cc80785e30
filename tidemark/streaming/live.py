"""The live path with Structured Streaming: counting under a watermark, and the state machine."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DELAY = "30 seconds"


def event_stream(spark: SparkSession, folder: str, files_each: int = 1) -> DataFrame:
    """The events of a folder of Parquet files as a stream; ``files_each`` bounds a batch."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_each).parquet(folder)


def windowed_counts(lines: DataFrame, delay: str = DELAY, window: str = "1 minute") -> DataFrame:
    """Counts by service, template and window, emitted once the watermark has passed the window; later lines are dropped."""
    timed = lines.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", delay)
    once = timed.dropDuplicatesWithinWatermark(["event_id"])
    return once.groupBy(F.window("at", window).alias("w"), "service", "template").agg(F.count("*").alias("n")).select("service", "template", F.col("w.start").alias("start"), "n")


def step(state: str, streak: int, high: bool, warm: int = 2, alert: int = 3, cool: int = 3) -> tuple[str, int]:
    """The state and streak after one more tick."""
    if state == "NORMAL":
        streak = streak + 1 if high else 0
        return ("WARMING" if streak >= warm else "NORMAL"), streak
    if state == "WARMING":
        if not high:
            return "NORMAL", 0
        return ("ALERTING", 0) if streak + 1 >= alert else ("WARMING", streak + 1)
    if high:
        return "ALERTING", 0
    if state == "ALERTING":
        return "COOLING", 1
    return ("NORMAL", 0) if streak + 1 >= cool else ("COOLING", streak + 1)


def state_changes(ticks: DataFrame) -> DataFrame:
    """Changes of state of each (service, key) in a stream of dense ticks with the flag ``high``.

    A key's ticks of a micro-batch come as several frames; they are put in order together, and a tick that is not after
    the last one that the state has seen is dropped, as it is late or was there before.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        state, streak, last = held.get if held.exists else ("NORMAL", 0, -1)
        rows, due = [], pd.concat([f[["tick", "high"]] for f in frames])
        for tick, high in due.sort_values("tick").itertuples(index=False):
            if tick <= last:
                continue
            new, streak = step(state, streak, bool(high))
            if new != state:
                rows.append((*key, int(tick) + 1, state, new))
            state, last = new, int(tick)
        held.update((state, streak, last))
        yield pd.DataFrame(rows, columns=["service", "key", "at", "from_state", "to_state"])

    return ticks.groupBy("service", "key").applyInPandasWithState(run, "service string, key string, at bigint, from_state string, to_state string", "state string, streak int, last bigint", "append", GroupStateTimeout.NoTimeout)


def replay(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Run a stream over what there is, and append its batches to a table: each batch is written once, under its own id."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
