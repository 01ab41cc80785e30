"""Views of all keys against their bands: the review matrix, the series with its incidents, and contributors.

Everything is per hour of a service: rates a minute (sum / minutes read), the band that the baseline gives that hour, and
how far from it the rate is.  Hours without minutes read have no cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import baseline as B

# The least scale of a deviation, in events a minute, and the steps of the classes in sigmas.
SIGMA_FLOOR, STEPS = 1.0, (6, 10)
#: Lines of the contributors' list.
CONTRIBUTORS = 10
#: Differences of two rates that are less than this share of them are rounding: it depends on the order of a sum.
ROUNDING = 1e-12


def low_alerts(key: Column) -> Column:
    """Whether a drop below the band counts: of a total with a full profile of its own and a mean that is high enough."""
    return F.coalesce((key == "*total") & ~F.col("upper_only") & (F.col("profile_days") >= B.FULL_AFTER) & (F.col("mean") >= B.DROP_MIN_MEAN), F.lit(False))


def step_class(z: Column, k: Column, down: Column) -> Column:
    """in, or up / down with a step of 1 to 3 by how many sigmas; a drop that doesn't count is in."""
    step = F.when(F.abs(z) <= STEPS[0], "1").when(F.abs(z) <= STEPS[1], "2").otherwise("3")
    return F.when((F.abs(z) <= k) | ((z < 0) & ~down), "in").otherwise(F.concat(F.when(z > 0, "up").otherwise("down"), step))


def cells(moments: DataFrame, hours: DataFrame, baseline: DataFrame, days: DataFrame, sigmas: tuple[float, float] = (B.SIGMA, B.YOUNG_SIGMA)) -> DataFrame:
    """service, key, day, hour, sum, n_minutes, rate, mean, std, band_low, band_high, z, cls and low of each key's hours.

    A key has a cell for each hour that its service was read, silent ones too.  Without a baseline the class is none; where
    the baseline is zero any line is the top step.
    """
    read = hours.filter("n_minutes > 0")
    every = moments.select("service", "key").distinct().join(read, "service").join(moments.select("service", "key", "day", "hour", "sum"), ["service", "key", "day", "hour"], "left")
    rated = every.withColumn("sum", F.coalesce("sum", F.lit(0))).withColumn("rate", F.col("sum") / F.col("n_minutes"))
    rows = B.judged(B.lookups(rated.withColumn("n", F.lit(0)), baseline, days), F.lit(None).cast("int"), sigmas=sigmas)
    k = F.when(F.col("profile_days") >= B.FULL_AFTER, sigmas[0]).otherwise(sigmas[1])
    rows = rows.withColumn("low", low_alerts(F.col("key")))
    scale = F.when(F.col("mean") > 0, F.greatest("std", F.lit(SIGMA_FLOOR))).otherwise(F.col("std"))
    flat = (F.col("mean") == 0) & (F.col("std") == 0)
    z = F.when(F.col("mean").isNotNull() & ~flat, (F.col("rate") - F.col("mean")) / scale)
    rows = rows.withColumn("z", z)
    cls = F.when(F.col("mean").isNull(), "none").when(flat, F.when(F.col("rate") > 0, "up3").otherwise("in")).otherwise(step_class(F.col("z"), k, F.col("low")))
    return rows.withColumn("cls", cls).select("service", "key", "day", "hour", "sum", "n_minutes", "rate", "mean", "std", "band_low", "band_high", "z", "cls", "low")


def not_normal_minutes(periods: DataFrame) -> DataFrame:
    """service, day, hour and minutes that any key's period (start, end in minutes since 1970) covers: a union, not a sum."""
    hours = periods.select("service", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / 60), F.floor((F.col("end") - 1) / 60))).alias("h"))
    part = hours.select("service", "h", F.greatest("start", F.col("h") * 60).alias("a"), F.least("end", F.col("h") * 60 + 60).alias("b")).distinct()
    # what a part adds to those that began before it in its hour, of which there are as many as the hour has spans
    before = Window.partitionBy("service", "h").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    covered = F.coalesce(F.max("b").over(before), F.col("a"))
    own = part.withColumn("n", F.greatest(F.lit(0), F.col("b") - F.greatest("a", covered)))
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("h") / 24).cast("int"))
    return own.groupBy("service", "h").agg(F.sum("n").alias("minutes")).select("service", day.alias("day"), (F.col("h") % 24).cast("int").alias("hour"), F.col("minutes").alias("not_normal_minutes"))


def hourly_decisions(exclusions: DataFrame) -> DataFrame:
    """service, day, hour and the last decision of each hour, by id, as ``decided``."""
    hours = exclusions.select("service", "day", F.explode(F.sequence(F.col("hour_from"), F.col("hour_to") - 1)).alias("hour"), "decision", "id")
    return hours.groupBy("service", "day", "hour").agg(F.max(F.struct("id", "decision")).alias("decided"))


def matrix(cell: DataFrame, periods: DataFrame, exclusions: DataFrame, days: DataFrame) -> DataFrame:
    """The review matrix: cells with minutes that were not normal, decisions, hours suggested for review, and whether the
    day is one that the baseline learned from."""
    learned = B.picked_days(days).select("service", "day", F.lit(True).alias("in_baseline"))
    on = ["service", "day", "hour"]
    rows = cell.join(not_normal_minutes(periods), on, "left").join(hourly_decisions(exclusions), on, "left").join(learned, ["service", "day"], "left")
    rows = rows.withColumn("decision", F.col("decided.decision")).drop("decided")
    suggested = F.col("not_normal_minutes").isNotNull() & F.col("decision").isNull()
    return rows.withColumn("suggested", suggested).withColumn("not_normal_minutes", F.coalesce("not_normal_minutes", F.lit(0))).withColumn("in_baseline", F.coalesce("in_baseline", F.lit(False)))


def incidents(cell: DataFrame, periods: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Runs of hours of a day outside the band of their key: peak by distance from the mean, whether the run goes on at the
    newest hour read, how many times the normal rate, and what was decided, else ``review`` where some key was not normal."""
    newest = cell.groupBy("service", "key").agg(F.max(F.struct("day", "hour")).alias("newest"))
    out = F.coalesce((F.col("rate") > F.col("band_high")) | (F.col("low") & (F.col("rate") < F.col("band_low"))), F.lit(False))
    on = ["service", "day", "hour"]
    # consecutive hours share what is left of an hour less its place
    rows = cell.filter(out).withColumn("first", F.col("hour") - F.row_number().over(Window.partitionBy("service", "key", "day").orderBy("hour")))
    rows = rows.join(not_normal_minutes(periods), on, "left").join(hourly_decisions(exclusions), on, "left")
    far = F.abs(F.col("rate") - F.coalesce("mean", F.lit(0.0)))
    # of equal peaks the first
    peak = F.max_by(F.struct("hour", "rate", "mean", "band_low", "band_high", "z"), F.struct(far, -F.col("hour")))
    made = rows.groupBy("service", "key", "day", "first").agg(
        F.min("hour").alias("hour_from"), (F.max("hour") + 1).alias("hour_to"), peak.alias("peak"), F.max("decided").alias("decided"), F.max(F.coalesce("not_normal_minutes", F.lit(0))).alias("minutes"),
    ).join(newest, ["service", "key"])
    return made.select(
        "service", "key", "day", "hour_from", "hour_to", (F.col("hour_to") - F.col("hour_from")).alias("hours"), ((F.col("newest.day") == F.col("day")) & (F.col("newest.hour") == F.col("hour_to") - 1)).alias("ongoing"),
        F.col("peak.hour").alias("peak_hour"), F.col("peak.rate").alias("peak_rate"), F.col("peak.z").alias("peak_z"), F.when(F.col("peak.mean") != 0, F.round(F.col("peak.rate") / F.col("peak.mean"), 1)).alias("times_normal"),
        F.coalesce("decided.decision", F.when(F.col("minutes") > 0, "review")).alias("decision"),
    )


def contributors(cell: DataFrame, selections: DataFrame, first_seen: DataFrame, most: int = CONTRIBUTORS) -> DataFrame:
    """The templates that rose most in each selection (service, day, hour_from, hour_to): rate and mean over its hours, excess.

    ``first_seen``: service, key, day and hour of each template's first sight.  Templates first seen in the selection or the
    hour before it are new and have no excess.  A rate that equals its mean has none, in whatever order the mean was summed.
    """
    hours = selections.select("service", "day", "hour_from", "hour_to", F.explode(F.sequence(F.col("hour_from"), F.col("hour_to") - 1)).alias("hour"))
    own = cell.filter("NOT startswith(key, '*')").join(hours, ["service", "day", "hour"])
    place = ["service", "day", "hour_from", "hour_to"]
    per = own.groupBy(*place, "key").agg((F.sum("sum") / F.sum("n_minutes")).alias("rate"), F.avg(F.coalesce("mean", F.lit(0.0))).alias("mean"), F.sum("sum").alias("lines")).filter("lines > 0")
    at = lambda d, h: F.datediff(d, F.lit("1970-01-01").cast("date")) * 24 + h
    seen = first_seen.select("service", "key", at(F.col("day"), F.col("hour")).alias("seen"))
    start = at(F.col("day"), F.col("hour_from"))
    old = per.join(seen, ["service", "key"], "left").filter(F.col("seen").isNull() | (F.col("seen") < start - 1) | (F.col("seen") >= at(F.col("day"), F.col("hour_to"))))
    order = Window.partitionBy(*place).orderBy(F.round(F.col("rate") - F.col("mean"), 9).desc(), "key")
    rose = old.withColumn("excess", F.col("rate") - F.col("mean")).filter(F.col("excess") > F.col("rate") * ROUNDING).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    return rose.select(*place, "rank", "key", "rate", "mean", "excess", F.when(F.col("mean") > 0, F.round(F.col("rate") / F.col("mean"), 1)).alias("times_normal"))


# Keys of a service, sources of links that count for documents, and levels in the order of display.
SERVICE_KEYS = ("*total", "*error", "*warn", "*info")
LINKING = ("manual", "inherited", "corpus", "llm")
LEVEL_ORDER = ("FATAL", "CRITICAL", "SEVERE", "ERROR", "WARNING", "WARN", "NOTICE", "INFO", "DEBUG", "TRACE")


def level_place(level: Column) -> Column:
    """Where a level stands in a display; all that are not in the list come after it, to be ordered by name."""
    at = F.array_position(F.array(*map(F.lit, LEVEL_ORDER)), level)
    return F.when(at > 0, at).otherwise(len(LEVEL_ORDER) + 1)


def resolved(asked: DataFrame, links: DataFrame, documents: DataFrame, templates: DataFrame) -> DataFrame:
    """``asked`` (service, key) with kind and keys, those whose counts the key sums, in order; null for keys that are unknown.

    A service's key is its name without the star; ``doc:ID`` and ``verdict:action`` or ``:safe`` sum the templates that are
    linked (service, key, doc, source) to the document, or to active documents (doc, status, verdict) of the verdict; any
    other key is a template (service, key).
    """
    asked = asked.select("service", "key").distinct()
    counted = links.filter(F.col("source").isin(*LINKING)).select("service", F.col("key").alias("own"), "doc")
    judged = documents.filter((F.col("status") == "active") & F.col("verdict").isin("action", "safe")).select("doc", "verdict")
    by_doc = counted.select("service", F.concat(F.lit("doc:"), "doc").alias("key"), "own")
    by_verdict = counted.join(judged, "doc").select("service", F.concat(F.lit("verdict:"), "verdict").alias("key"), "own")
    named = ~F.col("key").isin(*SERVICE_KEYS) & ~F.col("key").startswith("doc:") & ~F.col("key").startswith("verdict:")
    own = templates.filter(named).select("service", "key", F.lit("template").alias("kind"), F.col("key").alias("own"))
    every = by_doc.unionByName(by_verdict).select("service", "key", F.lit("doc").alias("kind"), "own").unionByName(own)
    found = asked.join(every, ["service", "key"]).groupBy("service", "key", "kind").agg(F.array_sort(F.collect_set("own")).alias("keys"))
    service = F.col("key").isin(*SERVICE_KEYS)
    out = asked.join(found, ["service", "key"], "left")
    return out.select("service", "key", F.when(service, F.substring("key", 2, 9)).otherwise(F.col("kind")).alias("kind"), F.when(service, F.array("key")).otherwise(F.col("keys")).alias("keys"))
