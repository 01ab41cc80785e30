"""Seasonal baselines from hourly moments, their lookup, and the judgement of a count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The rules by which baselines are learned and counts judged.
#: Days of a profile at most.
DAY_CAP = {"weekday": 5, "weekend": 4}
#: Committed days from which a profile is full, and the sigma multipliers before and after.
FULL_AFTER, SIGMA, YOUNG_SIGMA = 3, 3.0, 4.0
FLOORS = {"ERROR": 5, "WARN": 10}
DROP_MIN_MEAN = 20.0


def daytype(day: Column) -> Column:
    return F.when(F.weekday(day) >= 5, "weekend").otherwise("weekday")


def mark_days(hours: DataFrame, today: Column) -> DataFrame:
    """Committed days: those before today that have a service hour."""
    return hours.filter(F.col("day") < today).select("service", "day", daytype(F.col("day")).alias("daytype")).distinct()


def picked_days(days: DataFrame) -> DataFrame:
    """The newest committed days of each profile."""
    by = Window.partitionBy("service", "daytype").orderBy(F.desc("day"))
    cap = F.when(F.col("daytype") == "weekday", DAY_CAP["weekday"]).otherwise(DAY_CAP["weekend"])
    return days.withColumn("rn", F.row_number().over(by)).filter(F.col("rn") <= cap).drop("rn")


def not_excluded(hours: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Hours outside all excluded ranges; ranges are split into hours, so that this is an equi-join."""
    out = exclusions.filter("decision = 'exclude'").select("service", "day", F.explode(F.sequence(F.col("hour_from"), F.col("hour_to") - 1)).alias("hour"))
    return hours.join(out.distinct(), ["service", "day", "hour"], "left_anti")


def rebuild(moments: DataFrame, hours: DataFrame, days: DataFrame, exclusions: DataFrame) -> DataFrame:
    """service, key, daytype, hour, mean, std, days.

    A key that is present in any picked hour of its service has a row for all picked hours of it, silent ones as zeros;
    the view-only level keys count from their first day on.
    """
    usable = not_excluded(hours.filter("n_minutes > 0").join(picked_days(days), ["service", "day"]), exclusions)
    keys = moments.join(usable, ["service", "day", "hour"], "left_semi").select("service", "key").distinct()
    born = moments.filter(F.col("key").isin("*warn", "*info")).groupBy("service", "key").agg(F.min("day").alias("born"))
    # all hours of a service for each of its keys: what is multiplied are the few picked hours
    grid = keys.join(usable, "service").join(born, ["service", "key"], "left").filter("born IS NULL OR day >= born")
    full = grid.join(moments, ["service", "key", "day", "hour"], "left")
    n, s, q = F.sum("n_minutes"), F.sum(F.coalesce("sum", F.lit(0))).cast("double"), F.sum(F.coalesce("sumsq", F.lit(0))).cast("double")
    mean = s / n
    return full.groupBy("service", "key", "daytype", "hour").agg(mean.alias("mean"), F.sqrt(F.greatest(q / n - mean * mean, F.lit(0.0))).alias("std"), F.count("*").alias("days"))


def lookups(counts: DataFrame, baseline: DataFrame, days: DataFrame) -> DataFrame:
    """``counts`` (service, key, day, hour, ...) with the statistics of this and of the next hour.

    A weekend of under two committed days borrows the weekday profile, and then never alerts on drops.
    """
    committed = days.groupBy("service", "daytype").agg(F.count("*").alias("n")).withColumn("n", F.least("n", F.when(F.col("daytype") == "weekday", DAY_CAP["weekday"]).otherwise(DAY_CAP["weekend"])))
    per = committed.groupBy("service").agg(F.coalesce(F.max(F.when(F.col("daytype") == "weekend", F.col("n"))), F.lit(0)).alias("weekends"), F.coalesce(F.max(F.when(F.col("daytype") == "weekday", F.col("n"))), F.lit(0)).alias("weekdays"))
    own = counts.join(per, "service", "left").withColumn("daytype", daytype(F.col("day")))
    borrowed = (F.col("daytype") == "weekend") & (F.coalesce("weekends", F.lit(0)) < 2)
    own = own.withColumn("upper_only", borrowed).withColumn("daytype", F.when(borrowed, "weekday").otherwise(F.col("daytype")))
    own = own.withColumn("profile_days", F.coalesce(F.when(F.col("daytype") == "weekday", F.col("weekdays")).otherwise(F.col("weekends")), F.lit(0))).drop("weekdays", "weekends")
    stats = baseline.select("service", "key", "daytype", "hour", "mean", "std")
    # the next hour of the same profile, 0 after 23
    after = stats.select("service", "key", "daytype", ((F.col("hour") + 23) % 24).cast("int").alias("hour"), F.col("mean").alias("next_mean"), F.col("std").alias("next_std"))
    on = ["service", "key", "daytype", "hour"]
    return own.join(stats, on, "left").join(after, on, "left")


def floor_of(key: Column, level: Column) -> Column:
    """The floor of a key: by its level class; totals and information have none."""
    cls = F.when(key == "*error", "ERROR").when(key == "*warn", "WARN").when(key.isin("*total", "*info"), "INFO").otherwise(level)
    return F.when(cls == "ERROR", FLOORS["ERROR"]).when(cls == "WARN", FLOORS["WARN"])


def judged(rows: DataFrame, floor: Column, drop_min_mean: float = DROP_MIN_MEAN, sigmas: tuple[float, float] = (SIGMA, YOUNG_SIGMA)) -> DataFrame:
    """Adds band_low, band_high, dropped, high and score to rows of ``lookups`` with n and the floor given."""
    k = F.when(F.col("profile_days") >= FULL_AFTER, sigmas[0]).otherwise(sigmas[1])
    # greatest and least skip what is null
    top = F.greatest(F.col("mean") + k * F.col("std"), F.col("next_mean") + k * F.col("next_std"))
    low = F.least(F.col("mean") - k * F.col("std"), F.col("next_mean") - k * F.col("next_std"))
    rows = rows.withColumn("floor", floor).withColumn("band_high", top).withColumn("band_low", low)
    known = F.col("band_high").isNotNull()
    upper = F.coalesce((F.col("n") > F.col("band_high")) & (F.col("n") >= F.col("floor")), F.lit(False))
    drop = F.coalesce((F.col("key") == "*total") & ~F.col("upper_only") & (F.col("profile_days") >= FULL_AFTER) & (F.col("mean") >= drop_min_mean) & (F.col("n") < F.col("band_low")), F.lit(False))
    high = F.when(known, upper | drop).otherwise(F.coalesce(F.col("n") >= F.col("floor"), F.lit(False)))
    banded = F.when(F.col("band_high") > 0, F.col("n") / F.col("band_high")).otherwise((F.col("n") > 0).cast("double"))
    score = F.when(known, banded).otherwise(F.coalesce(F.col("n") / F.col("floor"), F.lit(0.0)))
    return rows.withColumn("dropped", drop).withColumn("high", high).withColumn("score", score)


def usable_days(hours: DataFrame, days: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Days that each hour of a profile can be learned from; a warning below three."""
    usable = not_excluded(hours.filter("n_minutes > 0").join(picked_days(days), ["service", "day"]), exclusions)
    return usable.groupBy("service", "daytype", "hour").agg(F.count("*").alias("days")).withColumn("few", F.col("days") < 3)
