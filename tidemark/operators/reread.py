"""The re-read lane: whole (service, day, hour) slices of a table are replaced by what the source gives on a second reading.

The table is Parquet in parts by service, day and hour.  A step covers ``hours_each`` hours: its lines are counted again and
its slices written with dynamic partition overwrite, which replaces the parts that the step has rows of and no others.  A
slice always has a row of its observed minutes, so one that is silent now is replaced as well.  The position is written
after the step's slices; a lane that was stopped anywhere repeats at most its last step, which gives the same parts.

A slice is left as it is if the table doesn't hold it, if it is still live, or if any source of its service lost the hour.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import stored
from . import counts as C

#: The key of a slice's observed minutes.
MINUTES = "*minutes"
SLICE = "key string, sum bigint, sumsq bigint, counts array<int>, service string, day date, hour int"


def hour_number(day: Column, hour: Column) -> Column:
    return F.datediff(day, F.lit("1970-01-01").cast("date")) * 24 + hour


def slice_rows(lines: DataFrame, slices: DataFrame, first: DataFrame) -> DataFrame:
    """Rows of the slices: moments and the 60 counts of each key with lines, and the minutes from the service's first one on.

    ``first``: service and first, its first minute.
    """
    on = ["service", "day", "hour"]
    minutes = C.minute_counts(lines).join(slices, on, "left_semi")
    keys = C.hourly_moments(minutes).join(C.minute_arrays(minutes), ["service", "key", "day", "hour"])
    start = hour_number(F.col("day"), F.col("hour")) * 60
    seen = F.transform(F.sequence(F.lit(0), F.lit(59)), lambda i: (F.col("start") + i >= F.col("first")).cast("int"))
    n = F.greatest(F.lit(0), F.least(F.lit(60), F.col("start") + 60 - F.col("first"))).cast("bigint")
    own = slices.join(first, "service").withColumn("start", start).select(*on, F.lit(MINUTES).alias("key"), n.alias("sum"), n.alias("sumsq"), seen.alias("counts")).filter("sum > 0")
    return keys.select(*own.columns).unionByName(own)


@dataclass
class RereadLane:
    """A lane over the table under ``path``; its position is beside the table."""

    spark: SparkSession
    path: str
    hours_each: int = 24

    def table(self) -> DataFrame:
        return self.spark.read.schema(SLICE).parquet(f"{self.path}/table")

    def write(self, rows: DataFrame) -> None:
        """Replaces the slices that ``rows`` has rows of."""
        rows.select(*(f.split()[0] for f in SLICE.split(", "))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("service", "day", "hour").parquet(f"{self.path}/table")

    def position(self) -> int | None:
        """The hour from which slices are still to be read; None before the first step."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/position")
        if not place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place):
            return None
        return self.spark.read.schema("hour bigint").parquet(f"{self.path}/position").agg(F.max("hour")).first()[0]

    def run(self, lines: DataFrame, scope: DataFrame, first: DataFrame, lost: DataFrame | None = None, live_from: int | None = None, steps: int | None = None) -> int:
        """Replaces the slices of ``scope`` (service, day, hour) from the position on; the number of steps taken.

        ``lost``: service, day, hour of slices that some source lost.  Hours from ``live_from`` on are live.
        """
        on = ["service", "day", "hour"]
        held = self.table().filter(F.col("key") == MINUTES).select(*on)
        todo = scope.select(*on).distinct().join(held, on, "left_semi")
        if lost is not None:
            todo = todo.join(lost.select(*on), on, "left_anti")
        todo = todo.withColumn("h", hour_number(F.col("day"), F.col("hour")))
        todo = todo if live_from is None else todo.filter(F.col("h") < live_from)
        # written down before the table changes
        todo, at, taken = stored(todo, "slices"), self.position(), 0
        span = todo.agg(F.min("h").alias("a"), F.max("h").alias("b")).first()
        if span.a is None:
            return 0
        at = span.a if at is None else at
        while at <= span.b and (steps is None or taken < steps):
            end = at + self.hours_each
            within = (F.col("h") >= at) & (F.col("h") < end)
            own = todo.filter(within).drop("h")
            if not own.isEmpty():
                window = lines.withColumn("h", hour_number(F.to_date("lts"), F.hour("lts"))).filter(within).drop("h")
                self.write(slice_rows(window, own, first))
            self.spark.createDataFrame([(end,)], "hour bigint").write.mode("append").parquet(f"{self.path}/position")
            at, taken = end, taken + 1
        return taken
