"""Hysteresis over judged ticks, changes, periods, hours, and other interval work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Ticks until a key warms, alerts and is normal again, and the order of states.
WARM, ALERT, COOL = 2, 3, 3
STATE_RANK = {"NORMAL": 0, "COOLING": 1, "WARMING": 2, "ALERTING": 3}
GROUP_RANK = {"NORMAL": 0, "WARMING": 1, "COOLING": 2, "ALERTING": 3}


def runs(rows: DataFrame, keys: list[str], at: str, flag: str, name: str) -> DataFrame:
    """Adds ``name``: the place in its run of equal flags of each row (gaps and islands by two row numbers)."""
    whole, same = Window.partitionBy(*keys).orderBy(at), Window.partitionBy(*keys, flag).orderBy(at)
    rows = rows.withColumn("_island", F.row_number().over(whole) - F.row_number().over(same))
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys, flag, "_island").orderBy(at))).drop("_island")


def states(ticks: DataFrame, keys: list[str], at: str = "tick", warm: int = WARM, alert: int = ALERT, cool: int = COOL) -> DataFrame:
    """``ticks`` (dense by key, with the flag ``high``) with the state after each of them.

    NORMAL warms after ``warm`` high ticks, alerts after ``alert``, cools at the first low one and is NORMAL after
    ``cool``.  A key is on since its last run of enough high ticks if that is later than its last run of enough low ones.
    """
    rows = runs(ticks, keys, at, "high", "_run")
    back = Window.partitionBy(*keys).orderBy(at)
    on_at = F.max(F.when(F.col("high") & (F.col("_run") >= max(alert, warm + 1)), F.col(at))).over(back)
    off_at = F.max(F.when(~F.col("high") & (F.col("_run") >= max(cool, 2)), F.col(at))).over(back)
    rows = rows.withColumn("_on", F.coalesce(on_at > F.coalesce(off_at, F.lit(-1)), F.lit(False)))
    idle = F.when(F.col("high") & (F.col("_run") >= warm), "WARMING").otherwise("NORMAL")
    state = F.when(F.col("_on"), F.when(F.col("high"), "ALERTING").otherwise("COOLING")).otherwise(idle)
    return rows.withColumn("state", state).drop("_run", "_on")


def changes(rows: DataFrame, keys: list[str], at: str = "tick") -> DataFrame:
    """State changes, stamped with the end of their tick."""
    before = F.coalesce(F.lag("state").over(Window.partitionBy(*keys).orderBy(at)), F.lit("NORMAL"))
    rows = rows.withColumn("from_state", before).filter(F.col("from_state") != F.col("state"))
    return rows.withColumn("at", F.col(at) + 1).withColumnRenamed("state", "to_state")


def periods(changed: DataFrame, keys: list[str], now: Column, within: tuple[str, ...] = ("WARMING", "ALERTING", "COOLING")) -> DataFrame:
    """Spans in the given states: from the first change into them to the next change out, or to now."""
    rows = changed.withColumn("_in", F.col("to_state").isin(*within))
    order = Window.partitionBy(*keys).orderBy("at")
    was = F.coalesce(F.lag("_in").over(order), F.lit(False))
    edges = rows.withColumn("_was", was).filter(F.col("_in") != F.col("_was"))
    edges = edges.withColumn("end", F.coalesce(F.lead("at").over(order), now)).filter("_in")
    return edges.select(*keys, F.col("at").alias("start"), "end")


def islands(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Overlapping or touching spans (start, end) as one."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.withColumn("_new", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int"))
    rows = rows.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def by_day(spans: DataFrame) -> DataFrame:
    """Spans of hours split at days: day, hour_from, hour_to."""
    days = spans.withColumn("d", F.explode(F.sequence(F.floor(F.col("start") / 24), F.floor((F.col("end") - 1) / 24))))
    lo, hi = F.greatest(F.col("start"), F.col("d") * 24), F.least(F.col("end"), F.col("d") * 24 + 24)
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.col("d").cast("int"))
    return days.select("*", day.alias("day"), (lo - F.col("d") * 24).cast("int").alias("hour_from"), (hi - F.col("d") * 24).cast("int").alias("hour_to"))


def hours_touched(spans: DataFrame) -> DataFrame:
    """A row for each hour that a span touches; an empty span touches one."""
    return spans.withColumn("h", F.explode(F.sequence(F.col("start"), F.greatest(F.col("end"), F.col("start") + 1) - 1)))


def covered(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Ticks covered by any span by day: a union, not a sum."""
    parts = by_day(islands(spans, keys))
    return parts.groupBy(*keys, "day").agg(F.sum(F.col("hour_to") - F.col("hour_from")).alias("covered"))


def suggestions(spans: DataFrame, decided: DataFrame) -> DataFrame:
    """Hours to review: those touched by a service's periods and not decided, merged within days, with their keys."""
    hours = hours_touched(spans).select("service", "key", "h").distinct()
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("h") / 24).cast("int"))
    hours = hours.withColumn("day", day).withColumn("hour", (F.col("h") % 24).cast("int"))
    done = decided.select("service", "day", F.explode(F.sequence(F.col("hour_from"), F.col("hour_to") - 1)).alias("hour")).distinct()
    left = hours.join(done, ["service", "day", "hour"], "left_anti")
    cells = left.select("service", "day", "hour").distinct()
    cells = cells.withColumn("_island", F.col("hour") - F.row_number().over(Window.partitionBy("service", "day").orderBy("hour")))
    keyed = left.join(cells, ["service", "day", "hour"])
    out = keyed.groupBy("service", "day", "_island").agg(F.min("hour").alias("hour_from"), (F.max("hour") + 1).alias("hour_to"), F.concat_ws(",", F.array_sort(F.collect_set("key"))).alias("keys"))
    return out.drop("_island")


def joined_intervals(left: DataFrame, right: DataFrame, keys: list[str], width: int = 24) -> DataFrame:
    """Pairs of overlapping spans (start < other end and other start < end), by equi-join on buckets of time.

    A pair may share several buckets; it is kept in the first of them only.
    """
    cut = lambda df, a, b: df.withColumn("_b", F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.greatest(F.col(b) - 1, F.col(a)) / width))))
    other = right.withColumnsRenamed({"start": "other_start", "end": "other_end"})
    pairs = cut(left, "start", "end").join(cut(other, "other_start", "other_end"), [*keys, "_b"])
    pairs = pairs.filter((F.col("start") < F.col("other_end")) & (F.col("other_start") < F.col("end")))
    return pairs.filter(F.col("_b") == F.floor(F.greatest("start", "other_start") / width)).drop("_b")


def exported(rows: DataFrame) -> DataFrame:
    """One 0/1 row for each (service, key, state); of several states of a key the worst is on."""
    rank = F.lit(0)
    for s, r in STATE_RANK.items():
        rank = F.when(F.col("state") == s, r).otherwise(rank)
    worst = rows.groupBy("service", "key").agg(F.max_by("state", rank).alias("worst"))
    return worst.select("service", "key", "worst", F.explode(F.array(*map(F.lit, STATE_RANK))).alias("state")).select("service", "key", "state", (F.col("worst") == F.col("state")).cast("int").alias("on"))


def ranked(state: Column, ranks: dict[str, int]) -> Column:
    out = F.lit(0)
    for name, rank in ranks.items():
        out = F.when(state == name, rank).otherwise(out)
    return out


def module_alerts(changed: DataFrame, counts: DataFrame, lo: int, hi: int, warm: int = WARM) -> DataFrame:
    """Lines of modules in the ticks from ``lo`` to before ``hi`` in which their key warms or alerts.

    ``changed``: service, key, at (the end of a tick), from_state, to_state.  ``counts``: service, key, module, tick, n.  A
    period begins with the change into it or, if the key warmed from NORMAL, with the first of the ticks that made it
    warm; it ends with the last tick before the change out, and cooling is no part of it.
    """
    on = ["service", "key"]
    order = Window.partitionBy(*on).orderBy("at")

    def spans(within: tuple[str, ...]) -> DataFrame:
        rows = changed.withColumn("_in", F.col("to_state").isin(*within))
        rows = rows.withColumn("_was", F.coalesce(F.lag("_in").over(order), F.lit(False))).filter(F.col("_in") != F.col("_was"))
        rows = rows.withColumn("end", F.coalesce(F.lead("at").over(order) - 1, F.lit(hi))).filter("_in")
        back = F.when((F.col("from_state") == "NORMAL") & (F.col("to_state") == "WARMING"), warm - 1).otherwise(0)
        return rows.withColumn("start", F.col("at") - 1 - back).filter((F.col("start") < hi) & (F.col("end") > lo)).select(*on, "start", "end")

    ticks = spans(("WARMING", "ALERTING")).select(*on, F.explode(F.sequence(F.greatest("start", F.lit(lo)), F.least("end", F.lit(hi)) - 1)).alias("tick"))
    own = counts.join(ticks, [*on, "tick"])
    each = own.groupBy(*on, "tick").agg(F.sum("n").alias("n")).groupBy(*on).agg(F.sum("n").alias("template_total"), F.max("n").alias("template_peak"))
    per = own.groupBy(*on, "module").agg(F.sum("n").alias("total"), F.max("n").alias("peak"))
    alerting = spans(("ALERTING",)).select(*on).distinct().withColumn("_on", F.lit(True))
    rows = per.join(each, on).join(ticks.groupBy(*on).agg(F.count("*").alias("ticks")), on).join(alerting, on, "left")
    return rows.select(*on, "module", "ticks", "total", "peak", (F.col("total") / F.col("ticks")).alias("mean"), "template_total", "template_peak", F.when(F.col("_on"), "ALERTING").otherwise("WARMING").alias("peak_state"))


def alert_groups(stated: DataFrame, links: DataFrame, roots: DataFrame) -> DataFrame:
    """Groups of keys that are not NORMAL, at each tick: a service's own keys, those of a document, and other templates by
    the root of their cluster.

    ``links``: service, key, doc.  ``roots``: key, root, for templates without a document.
    """
    order = Window.partitionBy("service", "key").orderBy("tick")
    rows = stated.withColumn("_prev", F.coalesce(F.lag("state").over(order), F.lit("NORMAL")))
    rows = rows.withColumn("since", F.max(F.when(F.col("state") != F.col("_prev"), F.col("tick") + 1)).over(order)).filter("state <> 'NORMAL'")
    rows = rows.join(links, ["service", "key"], "left").join(roots, "key", "left")
    own = F.col("key").startswith("*")
    kind = F.when(own, "service").when(F.col("doc").isNotNull(), "document").otherwise("template")
    rows = rows.withColumn("kind", kind).withColumn("ident", F.when(~own, F.coalesce("doc", "root", "key")))
    groups = rows.groupBy("service", "tick", "kind", "ident").agg(F.count("*").alias("_n"), F.max_by("state", ranked(F.col("state"), GROUP_RANK)).alias("state"), F.min("since").alias("since"), F.array_join(F.sort_array(F.collect_list("key")), ",").alias("keys"))
    return groups.select("service", "tick", F.when((F.col("kind") == "template") & (F.col("_n") > 1), "cluster").otherwise(F.col("kind")).alias("kind"), F.when(F.col("kind") == "document", F.col("ident")).alias("doc"), "state", "since", "keys")
