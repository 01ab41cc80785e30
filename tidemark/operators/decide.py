"""Which method to use for a kind of keys: ratios with day-block intervals, gates, the decision, its strength and stability.

Measures are sums by (method, kind, service, day): n and winkler (interval scores) of judged slots, abs_err and abs_naive of
those with a naive forecast, covered, episodes, flaps, key_days.  They add up over services and days, so all that follows
works on rows as many as methods x kinds x days, however many lines were counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bands import winkler

# Limits of the gates and of the decision.
COVERAGE, MAX_FLAPS, RECALL_SLACK, BUDGET = (0.990, 0.999), 0.10, 0.05, 1.0
FIT_RATIO, WORSE_SHARE, RECALL_GAIN, MIX_RECALL, RECALL_GAP = 0.90, 0.20, 0.10, 0.5, 0.10
SUMS = ("n", "winkler", "abs_err", "abs_naive", "covered", "episodes", "flaps", "key_days")

#: Modulus of the draws, which any engine can compute in 64-bit integers.
PRIME = 2147483647


def drawn(draw: Column, slot: Column, size: Column, seed: int) -> Column:
    """Which of ``size`` days a slot of a draw takes, from 0: the same for the same seed in any engine."""
    x = (draw.cast("long") * 1000003 + slot.cast("long") * 7919 + seed) % PRIME
    x = (x * x + 12345) % PRIME
    x = (x * 48271 + slot) % PRIME
    return F.floor((x * x % PRIME) * size / F.lit(PRIME)).cast("int")


def day_measures(rows: DataFrame) -> DataFrame:
    """The sums of ``rows`` (method, kind, service, key, day, hour, y, mean, low, high, naive) by method, kind, service and day.

    An episode is a run of slots outside the band, of whatever rows the key has in order, and counts where it begins; a flap
    is one of a single slot.  Slots without a naive forecast (null) are in neither sum of errors.
    """
    order = Window.partitionBy("method", "service", "key").orderBy("day", "hour")
    rows = rows.withColumn("_out", (F.col("y") > F.col("high")) | (F.col("y") < F.col("low")))
    start = F.col("_out") & ~F.coalesce(F.lag("_out").over(order), F.lit(False))
    rows = rows.withColumn("_start", start).withColumn("_flap", F.col("_start") & ~F.coalesce(F.lead("_out").over(order), F.lit(False)))
    known = lambda c: F.sum(F.when(F.col("naive").isNotNull(), F.abs(F.col("y") - c)))
    sums = (F.count("*"), F.sum(winkler(F.col("y"), F.col("low"), F.col("high"))), known(F.col("mean")), known(F.col("naive")), F.count_if(~F.col("_out")), F.count_if("_start"), F.count_if("_flap"), F.count_distinct("key"))
    return rows.groupBy("method", "kind", "service", "day").agg(*(c.alias(name) for c, name in zip(sums, SUMS, strict=True)))


def _share(a: str, b: str) -> Column:
    return F.sum(a) / F.nullif(F.sum(b), F.lit(0))


def _ratio() -> Column:
    """Mean interval score of a method by that of the base; null where either has no slots or the base scores zero."""
    return (F.sum("winkler") / F.nullif(F.sum("n"), F.lit(0))) / F.nullif(F.sum("_winkler") / F.nullif(F.sum("_n"), F.lit(0)), F.lit(0.0))


def _beside(days: DataFrame, base: str, on: list[str]) -> DataFrame:
    """Sums by ``on`` and the base's of the same; days without key-days are no data."""
    days = days.filter("key_days > 0").groupBy("method", *on).agg(*(F.sum(c).alias(c) for c in ("n", "winkler")))
    return days.join(days.filter(F.col("method") == base).select(*on, F.col("n").alias("_n"), F.col("winkler").alias("_winkler")), on)


def ratios(days: DataFrame, base: str = "sigma", draws: int = 1000, seed: int = 11) -> DataFrame:
    """method, kind, ratio to the base over the days that both have, and low and high: the 5th and 95th percentile over
    ``draws`` resamplings of those days, each of as many days as there are."""
    rows = _beside(days, base, ["kind", "day"])
    order = Window.partitionBy("method", "kind")
    rows = rows.withColumn("i", F.row_number().over(order.orderBy("day")) - 1).withColumn("size", F.count("*").over(order))
    slots = rows.select("method", "kind", F.col("i").alias("slot"), "size", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw"))
    picked = slots.select("method", "kind", "draw", drawn(F.col("draw"), F.col("slot"), F.col("size"), seed).alias("i")).join(rows, ["method", "kind", "i"])
    each = picked.groupBy("method", "kind", "draw").agg(_ratio().alias("r")).groupBy("method", "kind").agg(F.percentile("r", F.lit(0.05)).alias("low"), F.percentile("r", F.lit(0.95)).alias("high"))
    return rows.groupBy("method", "kind").agg(_ratio().alias("ratio")).join(each, ["method", "kind"])


def measured(days: DataFrame, base: str = "sigma") -> DataFrame:
    """method, kind: coverage, alert_rate (episodes in 100 key-days; of ``*total`` in a key-week), flap_share, mase, and the
    share of services on which the method scores worse than the base."""
    kept = days.filter("key_days > 0")
    rate = F.when(F.col("kind") == "*total", _share("episodes", "key_days") * 7).otherwise(_share("episodes", "key_days") * 100)
    facts = kept.groupBy("method", "kind").agg(_share("covered", "n").alias("coverage"), rate.alias("alert_rate"), _share("flaps", "episodes").alias("flap_share"), _share("abs_err", "abs_naive").alias("mase"))
    per = _beside(kept, base, ["kind", "service"]).groupBy("method", "kind", "service").agg(_ratio().alias("r"))
    worse = per.filter(F.col("method") != base).groupBy("method", "kind").agg(F.avg((F.col("r") > 1).cast("int")).alias("worse_share"))
    return facts.join(worse, ["method", "kind"], "left")


def gated(facts: DataFrame, base: str = "sigma", coverage: tuple[float, float] = COVERAGE, budget: float = BUDGET) -> DataFrame:
    """``facts`` with gates, a map from name to pass, fail or not_checked.

    Read besides those of ``measured``: band (the method gives one), in_budget (so did its knob when tuned) and recall
    (null: not measured).  Recall is held against the base's of the kind.
    """
    own = facts.filter(F.col("method") == base).groupBy("kind").agg(F.max("recall").alias("_recall"))
    says = lambda c: F.when(c, "pass").otherwise("fail")
    gates = {
        "band": says(F.col("band")),
        "coverage": F.when(F.col("coverage").isNull(), "not_checked").otherwise(says(F.col("coverage").between(*coverage))),
        "alert_rate": says((F.col("alert_rate") <= budget) & F.col("in_budget")),
        "flaps": says(F.coalesce(F.col("flap_share") <= MAX_FLAPS, F.lit(True))),
        "detect": F.when(F.col("recall").isNull() | F.col("_recall").isNull(), "not_checked").otherwise(says(F.col("recall") >= F.col("_recall") - RECALL_SLACK)),
    }
    return facts.join(own, "kind", "left").withColumn("gates", F.create_map(*(x for name, c in gates.items() for x in (F.lit(name), c)))).drop("_recall")


def _fits(x: Column) -> Column:
    return F.coalesce((x["ratio"] <= FIT_RATIO) & (x["high"] < 1), F.lit(False))


def _failed(gates: Column) -> Column:
    return F.array_contains(F.map_values(gates), "fail")


def decisions(candidates: DataFrame, base: str = "sigma") -> DataFrame:
    """kind, verdict, leader, tied (names, comma-joined) and reason, for each kind with a candidate beside the base.

    Of the methods that fail no gate, the one with the least ratio (nulls last, then by name) and those whose interval
    meets its interval are tied; the lightest of them leads (heavy, cost, mase with nulls last, name).  It is adopted if it
    fits better, is worse on few services and passes all gates; otherwise the base stays, or the services are mixed.
    """
    rows = candidates.filter(F.col("method") != base)
    live = rows.filter(~_failed(F.col("gates")))
    last = lambda c: F.coalesce(c, F.lit(float("inf")))
    whole = F.struct("method", "ratio", "low", "high", "worse_share", "gates")
    top = live.groupBy("kind").agg(F.min_by(F.struct("method", "ratio", "low", "high"), F.struct(last(F.col("ratio")), "method")).alias("top"))
    meets = (F.col("method") == F.col("top.method")) | ((F.col("low") <= F.col("top.high")) & (F.col("top.low") <= F.col("high")))
    tied = live.join(top, "kind").filter(meets).groupBy("kind").agg(
        F.min_by(whole, F.struct("heavy", "cost", last(F.col("mase")), "method")).alias("lead"), F.array_join(F.array_sort(F.collect_list("method")), ",").alias("tied"), F.any_value("top").alias("top")
    )
    lead, first = F.col("lead"), F.col("top")
    open_gates = F.array_join(F.array_sort(F.map_keys(F.map_filter(lead["gates"], lambda _, v: v != "pass"))), ",")
    steps = [
        (lead.isNull(), base + " stays", F.lit("none passes the gates")),
        (~_fits(lead) & _fits(first) & (first["method"] != lead["method"]), base + " stays", F.concat(lead["method"], F.lit(" fits no better; it is simpler than "), first["method"], F.lit(", which does"))),
        (~_fits(lead), base + " stays", F.concat(lead["method"], F.lit(" fits no better"))),
        (F.coalesce(lead["worse_share"] > WORSE_SHARE, F.lit(False)), "mixed", F.concat(lead["method"], F.lit(" is worse on too many services"))),
        (open_gates != "", base + " stays", F.concat(lead["method"], F.lit(" fits better, but is not verified: "), open_gates)),
    ]
    verdict, reason = F.lit("adopt"), F.concat(lead["method"], F.lit(" fits better and passes all gates"))
    for when, what, why in reversed(steps):
        verdict, reason = F.when(when, what).otherwise(verdict), F.when(when, why).otherwise(reason)
    out = rows.select("kind").distinct().join(tied, "kind", "left")
    return out.select("kind", verdict.alias("verdict"), lead["method"].alias("leader"), "tied", reason.alias("reason"))


def detections(candidates: DataFrame, mix: bool, base: str = "sigma") -> DataFrame:
    """Decisions of kinds that only detection can tell apart: kind, verdict, leader, tied.

    Bursts of new templates: the best recall of those within the alert and flap gates, adopted if it is ``RECALL_GAIN`` above
    the base's.  ``mix``: the best recall of those that fail no gate, adopted from ``MIX_RECALL`` on.  A recall of zero
    leads nothing; without any recall the kind is pending.
    """
    rows = candidates.filter(F.col("method") != base)
    within = ~_failed(F.col("gates")) if mix else (F.col("gates")["alert_rate"] == "pass") & (F.col("gates")["flaps"] == "pass")
    live = rows.filter(within & (F.col("recall") > 0))
    order = F.struct(-F.col("recall"), F.col("heavy"), F.col("cost"), F.col("method"))
    lead = live.groupBy("kind").agg(F.min_by("method", order).alias("leader"), F.max("recall").alias("best"))
    tied = live.join(lead, "kind").filter(F.col("recall") == F.col("best")).groupBy("kind").agg(F.array_join(F.array_sort(F.collect_list("method")), ",").alias("tied"))
    kinds = candidates.groupBy("kind").agg(F.max("recall").isNotNull().alias("_any"), F.max(F.when(F.col("method") == base, F.col("recall"))).alias("_base"))
    out = rows.select("kind").distinct().join(kinds, "kind").join(lead, "kind", "left").join(tied, "kind", "left")
    wins = F.col("best") >= (F.lit(MIX_RECALL) if mix else F.col("_base") + RECALL_GAIN - 1e-9)
    verdict = F.when(~F.col("_any"), "pending").when(wins, "adopt").otherwise("no method" if mix else base + " stays")
    return out.select("kind", verdict.alias("verdict"), "leader", "tied")


def strength(days: Column, weekends: Column) -> Column:
    """How much a window of so many days, with so many weekends among its test days, can tell."""
    return F.when(days < 14, "exploratory").when((days >= 28) & (weekends >= 2), "final").otherwise("provisional")


def stability(decided: DataFrame, previous: DataFrame) -> DataFrame:
    """``decided`` with stability against the ``previous`` decisions (kind, leader): stable if the leader then leads or ties now."""
    old = previous.select("kind", F.col("leader").alias("_old"), F.lit(True).alias("_there"))
    same = (F.col("_old") == F.col("leader")) | F.array_contains(F.split("tied", ","), F.col("_old"))
    said = F.when(F.col("_there").isNull(), "no previous run").when(F.col("_old").isNull() | F.col("leader").isNull(), "previous run had no leader").when(same, "stable").otherwise("unstable")
    return decided.join(old, "kind", "left").withColumn("stability", said).drop("_old", "_there")


def recall_gaps(first: DataFrame, second: DataFrame) -> DataFrame:
    """method, kind, both recalls (of invented and of real incidents) and whether they differ by over ``RECALL_GAP``."""
    rows = first.select("method", "kind", F.col("recall").alias("a_recall")).join(second.select("method", "kind", F.col("recall").alias("c_recall")), ["method", "kind"])
    return rows.filter("a_recall IS NOT NULL AND c_recall IS NOT NULL").withColumn("gap", F.abs(F.col("a_recall") - F.col("c_recall")) > RECALL_GAP)
