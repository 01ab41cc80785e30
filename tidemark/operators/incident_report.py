"""The report of an incident test: onsets of alerts within phases, checks of bursts and spreads, recovery, false alerts.

Samples are what an operator would see at a tick: the states of keys, and the alert rows (``detect.alert_groups``) that
hold those out of their band.  A key or row that a sample doesn't hold is NORMAL in it.  Phases are spans of ticks, end
exclusive; targets say which key, of which document, a phase acts on.

Work is equi-joins on (service, key) and sums: phases and targets are small, samples may be of any size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .detect import ALERT

CARRIED = "n/a: already alerting at start"


def added(ticks: DataFrame, targets: DataFrame) -> DataFrame:
    """``ticks`` (service, key, tick, n) with ``size`` lines more in each tick of each target, and in the service's total."""
    each = targets.filter("size > 0 AND start < end").select("service", "key", "size", F.explode(F.sequence("start", F.col("end") - 1)).alias("tick"))
    both = each.unionByName(each.withColumn("key", F.lit("*total"))).groupBy("service", "key", "tick").agg(F.sum("size").alias("size"))
    return ticks.join(both, ["service", "key", "tick"], "left").select("service", "key", "tick", (F.col("n") + F.coalesce("size", F.lit(0))).alias("n"))


def with_documents(ticks: DataFrame, links: DataFrame) -> DataFrame:
    """``ticks`` and those of each document (key doc:ID): the sums of the templates (service, key, doc) that are linked to it."""
    sums = ticks.join(links, ["service", "key"]).groupBy("service", F.concat(F.lit("doc:"), "doc").alias("key"), "tick").agg(F.sum("n").alias("n"))
    return ticks.unionByName(sums)


def deadline(start: Column, checks: int = ALERT, close: int = 0) -> Column:
    """The last tick at which a burst's key may turn ALERTING: the ``checks``-th from the first whole tick, and what closing takes."""
    return F.ceil(start) + checks - 1 + close


def onsets(states: DataFrame, samples: DataFrame, targets: DataFrame, on: list[str]) -> DataFrame:
    """``targets`` (phase, start, end and ``on``, with the service among them) with what their states did in the phase.

    ``states``: ``on``, tick, state; of several states of a tick the greatest name counts.  ``samples``: service, tick.
    status is 'carried' if the last sample before the phase was ALERTING, 'onset' if one within it is, else 'none'; hit is
    the first such tick (null if carried), ever whether any was ALERTING within, final the state of the phase's last
    sample (null without samples).
    """
    keys = ["phase", "start", "end", *on]
    windows = targets.select(*keys).distinct()
    tick, inside = F.col("tick"), (F.col("tick") >= F.col("start")) & (F.col("tick") < F.col("end"))
    ends = windows.join(samples.select("service", "tick"), "service", "left").groupBy(*keys).agg(F.max(F.when(tick < F.col("start"), tick)).alias("_before"), F.max(F.when(inside, tick)).alias("_last"))
    alerting = F.col("state") == "ALERTING"
    first = F.min(F.when(inside & alerting, tick))
    at = lambda c: F.coalesce(F.max(F.when(tick == F.col(c), F.col("state"))), F.lit("NORMAL"))
    rows = ends.join(states.select(*on, "tick", "state"), on, "left").groupBy(*keys, "_before", "_last").agg(at("_before").alias("_was"), first.alias("_first"), at("_last").alias("_is"))
    carried = F.col("_was") == "ALERTING"
    status = F.when(carried, "carried").when(F.col("_first").isNotNull(), "onset").otherwise("none")
    return rows.select(*keys, status.alias("status"), F.when(~carried, F.col("_first")).alias("hit"), F.col("_first").isNotNull().alias("ever"), F.when(F.col("_last").isNotNull(), F.col("_is")).alias("final"))


def verdict(ok: Column) -> Column:
    """n/a for what was alerting before, else PASS or FAIL; an unknown ``ok`` fails."""
    return F.when(F.col("status") == "carried", CARRIED).when(ok, "PASS").otherwise("FAIL")


def _document_rows(rows: DataFrame) -> DataFrame:
    return rows.filter("kind = 'document'").select("service", "doc", "tick", "state")


def burst_checks(states: DataFrame, rows: DataFrame, targets: DataFrame, checks: int = ALERT, close: int = 0) -> DataFrame:
    """Checks 1, 2 and 4 of each target of a burst: phase, service, key, doc, check, after (ticks from the start), verdict.

    1: the key turns ALERTING by the deadline.  2: its document's row does within the phase.  4: the row that holds the
    key when it turns ALERTING shows its document.  ``states``: service, key, tick, state; ``rows``: alert rows.
    """
    samples = states.select("service", "tick").distinct()
    bursts = targets.filter("kind = 'burst'").select("phase", "start", "end", "service", "key", "doc")
    own = onsets(states, samples, bursts, ["service", "key"])
    shown = rows.select("service", F.explode(F.split("keys", ",")).alias("key"), F.col("tick").alias("hit"), F.col("doc").alias("shown"))
    keyed = bursts.join(own, ["phase", "start", "end", "service", "key"]).join(shown, ["service", "key", "hit"], "left")
    documents = bursts.join(onsets(_document_rows(rows), samples, bursts, ["service", "doc"]), ["phase", "start", "end", "service", "doc"])
    out = lambda df, check, ok: df.select("phase", "service", "key", "doc", F.lit(check).alias("check"), (F.col("hit") - F.col("start")).alias("after"), verdict(ok).alias("verdict"))
    hit = F.col("hit").isNotNull()
    first, fourth = out(keyed, 1, hit & (F.col("hit") <= deadline(F.col("start"), checks, close))), out(keyed, 4, F.col("shown") == F.col("doc"))
    return first.unionByName(out(documents, 2, hit)).unionByName(fourth)


def spread_checks(states: DataFrame, targets: DataFrame) -> DataFrame:
    """Check 3 of each document of a spread: its key turns ALERTING; alone: the targets that did so themselves, comma-joined."""
    samples = states.select("service", "tick").distinct()
    spread = targets.filter("kind = 'spread'").select("phase", "start", "end", "service", "key", "doc")
    sums = spread.select("phase", "start", "end", "service", "doc", F.concat(F.lit("doc:"), "doc").alias("key")).distinct()
    on = ["phase", "start", "end", "service"]
    own = spread.join(onsets(states, samples, spread, ["service", "key"]), [*on, "key"]).groupBy(*on, "doc")
    alone = own.agg(F.array_join(F.array_sort(F.collect_set(F.when(F.col("ever"), F.col("key")))), ",").alias("alone"))
    found = sums.join(onsets(states, samples, sums, ["service", "key"]), [*on, "key"]).join(alone, [*on, "doc"])
    return found.select("phase", "service", "key", "doc", F.lit(3).alias("check"), (F.col("hit") - F.col("start")).alias("after"), verdict(F.col("hit").isNotNull()).alias("verdict"), "alone")


def recoveries(states: DataFrame, rows: DataFrame, targets: DataFrame) -> DataFrame:
    """The state of each target and of its document's row at the end of each recovery; phases without samples are left out."""
    samples = states.select("service", "tick").distinct()
    ends = targets.filter("kind = 'recovery'").select("phase", "start", "end", "service", "key", "doc")
    on = ["phase", "start", "end", "service"]
    of = lambda df, by, name: onsets(df, samples, ends, ["service", by]).select(*on, by, F.col("final").alias(name))
    out = ends.join(of(states, "key", "template_state"), [*on, "key"]).join(of(_document_rows(rows), "doc", "document_state"), [*on, "doc"])
    return out.filter("template_state IS NOT NULL").select("phase", "service", "key", "doc", "template_state", "document_state")


def false_alerts(states: DataFrame, rows: DataFrame, phases: DataFrame, hours: float = 1.0) -> DataFrame:
    """Check 5: phase, service, row, onsets and onsets an hour of each alert row in the phases of control.

    A row turns ALERTING if it wasn't in the service's sample before, also when that sample lies before the phase.
    ``hours``: of one tick.
    """
    name = F.when(F.col("kind") == "document", F.concat(F.lit("doc "), F.col("doc"))).when(F.col("kind") == "service", "service").otherwise(F.element_at(F.split("keys", ","), 1))
    alerting = rows.filter("state = 'ALERTING'").select("service", name.alias("row"), "tick").distinct()
    samples = states.select("service", "tick").distinct().withColumn("_before", F.lag("tick").over(Window.partitionBy("service").orderBy("tick")))
    before = alerting.select("service", "row", F.col("tick").alias("_before"))
    starts = alerting.join(samples, ["service", "tick"]).join(before, ["service", "row", "_before"], "left_anti")
    control = F.broadcast(phases.filter("kind = 'control'").select("phase", "start", "end"))  # phases of a test: a few rows
    within = starts.join(control, (F.col("tick") >= F.col("start")) & (F.col("tick") < F.col("end")))
    per = within.groupBy("phase", "service", "row", "start", "end").agg(F.count("*").alias("onsets"))
    return per.select("phase", "service", "row", "onsets", (F.col("onsets") / ((F.col("end") - F.col("start")) * hours)).alias("per_hour"))
