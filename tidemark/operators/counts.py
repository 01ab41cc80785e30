"""Counting: fan-out to keys, minutes, hourly moments, zero-filling, rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.driver_tables import minute_number, tick_number

#: Severity of a level; the most severe level of a template is kept.
SEVERITY = {"FATAL": 4, "CRITICAL": 4, "ERROR": 3, "WARN": 2, "INFO": 1}


def level_class(level: Column) -> Column:
    """ERROR, WARN or INFO; a null or unknown level is INFO."""
    up = F.upper(level)
    return F.when(up.isin("ERROR", "FATAL", "CRITICAL"), "ERROR").when(up.isin("WARN", "WARNING"), "WARN").otherwise("INFO")


def severity(level: Column) -> Column:
    out = F.lit(0)
    for name, rank in SEVERITY.items():
        out = F.when(F.upper(level) == name, rank).otherwise(out)
    return out


def partial_counts(lines: DataFrame) -> DataFrame:
    """One row for each (service, template, level, module, minute), with the count and the first event as a sample."""
    return lines.groupBy("service", "template", "level", "module", minute_number().alias("minute")).agg(F.count("*").alias("n"), F.min("event_id").alias("sample"))


def keyed(lines: DataFrame) -> DataFrame:
    """Each line under its template, the total and its level class."""
    keys = F.array(F.col("template"), F.lit("*total"), F.concat(F.lit("*"), F.lower(level_class(F.col("level")))))
    return lines.withColumn("key", F.explode(keys))


def minute_counts(lines: DataFrame) -> DataFrame:
    """service, key, day, hour, minute, n.

    Lines are counted before they fan out to their keys, so the fan-out multiplies groups and not lines.
    """
    per = lines.groupBy("service", "template", "level", F.to_date("lts").alias("day"), F.hour("lts").alias("hour"), minute_number().alias("minute")).agg(F.count("*").alias("n"))
    return keyed(per).groupBy("service", "key", "day", "hour", "minute").agg(F.sum("n").alias("n"))


def tick_counts(lines: DataFrame) -> DataFrame:
    """service, key, tick (hours), n."""
    per = lines.groupBy("service", "template", "level", tick_number().alias("tick")).agg(F.count("*").alias("n"))
    return keyed(per).groupBy("service", "key", "tick").agg(F.sum("n").alias("n"))


def module_counts(lines: DataFrame) -> DataFrame:
    return lines.groupBy("service", "template", "module", minute_number().alias("minute")).agg(F.count("*").alias("n"))


def hourly_moments(minutes: DataFrame) -> DataFrame:
    """service, key, day, hour, sum, sumsq: mergeable moments of the minute counts."""
    return minutes.groupBy("service", "key", "day", "hour").agg(F.sum("n").alias("sum"), F.sum(F.col("n") * F.col("n")).alias("sumsq"))


def merged_moments(*parts: DataFrame) -> DataFrame:
    """Moments of disjoint parts as one: sums add up."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.groupBy("service", "key", "day", "hour").agg(F.sum("sum").alias("sum"), F.sum("sumsq").alias("sumsq"))


def service_hours(lines: DataFrame) -> DataFrame:
    """service, day, hour, n_minutes: the minutes from a service's first to its last line, silent ones too."""
    ends = lines.groupBy("service").agg(F.min(minute_number()).alias("a"), F.max(minute_number()).alias("b"))
    hours = ends.select("service", "a", "b", F.explode(F.sequence(F.floor(F.col("a") / 60), F.floor(F.col("b") / 60))).alias("h"))
    n = F.least(F.col("b"), F.col("h") * 60 + 59) - F.greatest(F.col("a"), F.col("h") * 60) + 1
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("h") / 24).cast("int"))
    return hours.select("service", day.alias("day"), (F.col("h") % 24).cast("int").alias("hour"), n.alias("n_minutes"))


def minute_arrays(minutes: DataFrame) -> DataFrame:
    """service, key, day, hour, counts: an array of 60 counts."""
    per = minutes.groupBy("service", "key", "day", "hour").agg(F.map_from_entries(F.collect_list(F.struct((F.col("minute") % 60).cast("int"), "n"))).alias("m"))
    return per.select("service", "key", "day", "hour", F.transform(F.sequence(F.lit(0), F.lit(59)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)).cast("int")).alias("counts"))


def array_minutes(arrays: DataFrame) -> DataFrame:
    """The non-zero minutes of ``minute_arrays`` as rows again."""
    return arrays.select("service", "key", "day", "hour", F.posexplode("counts").alias("slot", "n")).filter("n > 0")


#: Keys that every service has in each minute from its first one on.
SERVICE_KEYS = ("*total", "*error", "*warn", "*info")


def dated(minutes: DataFrame) -> DataFrame:
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("minute") / 1440).cast("int"))
    return minutes.withColumn("day", day).withColumn("hour", (F.floor(F.col("minute") / 60) % 24).cast("int"))


def zero_filled(minutes: DataFrame) -> DataFrame:
    """Counts with zeros: a template's for every minute of an hour from its first minute in it, after which it is
    forgotten; a service's keys for every minute from its first one to the last that any service has."""
    on = ["service", "key", "day", "hour", "minute"]
    first = minutes.filter(~F.col("key").startswith("*")).groupBy("service", "key", "day", "hour").agg(F.min("minute").alias("first"))
    grid = first.select("service", "key", "day", "hour", F.explode(F.sequence("first", F.floor(F.col("first") / 60) * 60 + 59)).alias("minute"))
    ends = minutes.agg(F.max("minute").alias("b"))  # one row
    spans = minutes.groupBy("service").agg(F.min("minute").alias("a")).join(F.broadcast(ends))
    every = spans.select("service", F.explode(F.sequence("a", "b")).alias("minute")).withColumn("key", F.explode(F.array(*map(F.lit, SERVICE_KEYS))))
    return grid.unionByName(dated(every).select(*on)).join(minutes, on, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def dense_minutes(minutes: DataFrame) -> DataFrame:
    """Every key at every minute from its service's first to its last, absent ones as 0."""
    ends = minutes.groupBy("service").agg(F.min("minute").alias("a"), F.max("minute").alias("b"))
    keys = minutes.select("service", "key").distinct().join(ends, "service")
    grid = keys.select("service", "key", F.explode(F.sequence("a", "b")).alias("minute"))
    return dated(grid.join(minutes.select("service", "key", "minute", "n"), ["service", "key", "minute"], "left").withColumn("n", F.coalesce("n", F.lit(0))))


def dense_ticks(ticks: DataFrame) -> DataFrame:
    """Every key at every tick from its service's first to its last, absent ones as 0."""
    ends = ticks.groupBy("service").agg(F.min("tick").alias("a"), F.max("tick").alias("b"))
    keys = ticks.select("service", "key").distinct().join(ends, "service")
    grid = keys.select("service", "key", F.explode(F.sequence("a", "b")).alias("tick"))
    return grid.join(ticks, ["service", "key", "tick"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def template_dimension(lines: DataFrame) -> DataFrame:
    """First and last sight, and the most severe level, of each template."""
    return lines.groupBy("service", "template").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.max_by("level", severity(F.col("level"))).alias("level"), F.count("*").alias("n"))


def rejected(lines: DataFrame, late_after: int = 15) -> DataFrame:
    """Lines by fate: late (behind the newest line of a lower id by over ``late_after`` minutes), malformed, counted."""
    newest = F.max(minute_number()).over(Window.partitionBy("service").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1))
    late = minute_number() < newest - late_after
    fate = F.when(F.col("module").isNull(), "malformed").when(F.coalesce(late, F.lit(False)), "late").otherwise("counted")
    return lines.select("service", fate.alias("fate")).groupBy("service", "fate").agg(F.count("*").alias("n"))


def throughput(lines: DataFrame) -> DataFrame:
    """For each service: the count of its last tick, the mean of its last 15, and the change over a day."""
    ticks = lines.groupBy("service", tick_number().alias("tick")).agg(F.count("*").alias("n"))
    back = Window.partitionBy("service").orderBy(F.desc("tick"))
    ranked = ticks.withColumn("rn", F.row_number().over(back))
    return ranked.groupBy("service").agg(F.max_by("n", "tick").alias("last"), F.round(F.avg(F.when(F.col("rn") <= 15, F.col("n"))), 6).alias("mean_15"), (F.max_by("n", "tick") - F.max(F.when(F.col("rn") == 25, F.col("n")))).alias("change"))


def sliding_rates(lines: DataFrame, minutes: int = 60, step: int = 15) -> DataFrame:
    """Error share over sliding windows of ``minutes``, one every ``step`` minutes."""
    w = F.window(F.col("ts").cast("timestamp_ntz"), f"{minutes} minutes", f"{step} minutes")
    per = lines.groupBy("service", w.alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("level") == "ERROR").alias("errors"))
    return per.select("service", F.col("w.start").cast("timestamp_ntz").alias("start"), "n", F.round(F.col("errors") / F.col("n"), 9).alias("ratio"))
