"""Walk-forward evaluation: day arrays with observed slots, methods behind one protocol, and sinks over what they say.

A series is a row for each (service, key, day) with an array of counts, one for each slot; slots that were not observed
hold ``UNOBSERVED``: they are neither zero nor normal, no method learns from them and none is judged.  Which minutes of an
hour were observed is a mask of 60 bits for each service and hour, kept once for all keys.

A method learns from the days before a day and judges that day, knob by knob, with a state that goes on from day to day.
Keys are the groups: a task has one key's days at a time, as many as the calendar has.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNOBSERVED = -1


# ---- data


def observed_masks(minutes: DataFrame) -> DataFrame:
    """service, day, hour and mask (bit i: minute i of the hour) of (service, minute); repeated minutes count once."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("minute") / 1440).cast("int"))
    slots = minutes.select("service", "minute").distinct().select("service", day.alias("day"), (F.floor(F.col("minute") / 60) % 24).cast("int").alias("hour"), (F.col("minute") % 60).cast("int").alias("slot"))
    return slots.groupBy("service", "day", "hour").agg(F.sum(F.expr("shiftleft(1L, slot)")).alias("mask"))


def document_minutes(minutes: DataFrame, links: DataFrame) -> DataFrame:
    """Counts of documents (key doc:ID) by minute: the sums of the templates (service, key, doc) that are linked to them."""
    own = minutes.join(links, ["service", "key"]).withColumn("key", F.concat(F.lit("doc:"), F.col("doc")))
    return own.groupBy("service", "key", "day", "hour", "minute").agg(F.sum("n").alias("n"))


def day_series(minutes: DataFrame, masks: DataFrame) -> DataFrame:
    """service, key, day, counts: 1440 slots for each key on each day of which some minute of its service was observed."""
    slot = (F.col("minute") % 1440).cast("int")
    held = minutes.groupBy("service", "key", "day").agg(F.map_from_entries(F.collect_list(F.struct(slot, F.col("n").cast("int")))).alias("held"))
    hours = masks.groupBy("service", "day").agg(F.map_from_entries(F.collect_list(F.struct("hour", "mask"))).alias("hours"))
    every = minutes.select("service", "key").distinct().join(hours, "service").join(held, ["service", "key", "day"], "left")
    seen = lambda i: F.call_function("getbit", F.coalesce(F.try_element_at("hours", F.floor(i / 60).cast("int")), F.lit(0).cast("bigint")), i % 60) == 1
    count = lambda i: F.coalesce(F.try_element_at("held", i), F.lit(0))
    return every.select("service", "key", "day", F.transform(F.sequence(F.lit(0), F.lit(1439)), lambda i: F.when(seen(i), count(i)).otherwise(UNOBSERVED)).alias("counts"))


def tick_series(ticks: DataFrame) -> DataFrame:
    """service, key, day, counts: 24 slots of hourly ticks; ticks that are not there are not observed."""
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("tick") / 24).cast("int"))
    held = ticks.groupBy("service", "key", day.alias("day")).agg(F.map_from_entries(F.collect_list(F.struct((F.col("tick") % 24).cast("int"), F.col("n").cast("int")))).alias("held"))
    return held.select("service", "key", "day", F.transform(F.sequence(F.lit(0), F.lit(23)), lambda i: F.coalesce(F.try_element_at("held", i), F.lit(UNOBSERVED))).alias("counts"))


# ---- methods


@dataclass(frozen=True)
class Method:
    """``fit(history)`` gives a model of the days before, or None if they are too few; ``history`` maps days to counts, nan
    where unobserved, and holds the day that is due as ``history.day``.  ``judge(model, counts, knob, state)`` gives scores,
    flags and the state for the next day.  Knobs stand in order, the most sensitive first."""

    name: str
    knobs: tuple[float, ...]
    fit: Callable
    judge: Callable


@dataclass
class History:
    day: pd.Timestamp
    days: list = field(default_factory=list)
    counts: np.ndarray | None = None


REGISTRY: dict[str, Method] = {}


def register(name: str, knobs: tuple[float, ...]) -> Callable:
    """A class with ``fit`` and ``judge`` as a method of the registry."""

    def put(cls: type) -> type:
        REGISTRY[name] = Method(name, knobs, cls.fit, cls.judge)
        return cls

    return put


#: Days with a slot observed that a model of the slot needs.
LEAST_DAYS = 3


def _per_slot(counts: np.ndarray, of: Callable) -> np.ndarray:
    """A statistic of each slot's observed counts; nan where fewer than ``LEAST_DAYS`` days have it."""
    enough = (~np.isnan(counts)).sum(axis=0) >= LEAST_DAYS
    out = np.full(counts.shape[1], np.nan)
    if enough.any():
        out[enough] = of(counts[:, enough])
    return out


@register("mad", (3.0, 5.0, 8.0))
class _Mad:
    """Counts far from the median of their slot, in scaled median deviations, one count at least."""

    @staticmethod
    def fit(history: History):
        if history.counts is None:
            return None
        centre = _per_slot(history.counts, lambda x: np.nanmedian(x, axis=0))
        return centre, 1.4826 * _per_slot(np.abs(history.counts - centre), lambda x: np.nanmedian(x, axis=0))

    @staticmethod
    def judge(model, counts, knob, state):
        centre, mad = model
        off = np.abs(counts - centre)
        return off, off > np.maximum(knob * mad, 1.0), state


@register("sigma", (2.0, 3.0, 4.0))
class _Sigma:
    """Counts above the mean of their slot by a multiple of the deviation of pooled moments."""

    @staticmethod
    def fit(history: History):
        if history.counts is None:
            return None
        sums, squares, n = (_per_slot(history.counts, of) for of in (lambda x: np.nansum(x, axis=0), lambda x: np.nansum(x * x, axis=0), lambda x: (~np.isnan(x)).sum(axis=0)))
        mean = sums / n
        return mean, np.sqrt(np.maximum(squares / n - mean * mean, 0))

    @staticmethod
    def judge(model, counts, knob, state):
        mean, spread = model
        return counts - mean, counts > mean + knob * spread, state


@register("weekly", (1.5, 2.0, 3.0))
class _Weekly:
    """Counts above a multiple of those of the same slot a week before, five at least."""

    @staticmethod
    def fit(history: History):
        past = history.day - pd.Timedelta(days=7)
        return history.counts[history.days.index(past)] if past in history.days else None

    @staticmethod
    def judge(model, counts, knob, state):
        return counts - model, (counts > knob * model) & (counts >= 5), state


@register("cusum", (3.0, 5.0, 8.0))
class _Cusum:
    """Sums of log-likelihood ratios of a rate raised by half, which go on over midnight and begin anew after an alarm."""

    RAISED = 1.5

    @staticmethod
    def fit(history: History):
        if history.counts is None or np.isnan(history.counts).all():
            return None
        return max(float(np.nanmean(history.counts)), 1e-9)

    @staticmethod
    def judge(model, counts, knob, state):
        s, score = state or 0.0, np.full(len(counts), np.nan)
        for i, x in enumerate(counts):
            if not np.isnan(x):
                s = max(0.0, s + x * np.log(_Cusum.RAISED) - (_Cusum.RAISED - 1) * model)
                score[i] = s
                s = 0.0 if s > knob else s
        return score, score > knob, s


# ---- the runner and its sinks

JUDGED = "service string, key string, day date, method string, knob double, counts array<int>, score array<double>, high array<boolean>"


def walk_forward(series: DataFrame, methods: tuple[str, ...] = tuple(REGISTRY)) -> DataFrame:
    """What each method says of each key's days at each of its knobs; days that a method can't judge yet have no rows.

    A slot that is not observed, or of which the model knows nothing, has no score and is not high.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("day")
        days = [pd.Timestamp(d) for d in frame["day"]]
        counts = np.stack(frame["counts"].to_numpy()).astype(float)
        counts[counts == UNOBSERVED] = np.nan
        rows, service, key = [], frame["service"].iloc[0], frame["key"].iloc[0]
        for method in (REGISTRY[m] for m in methods):
            states: dict[float, object] = dict.fromkeys(method.knobs)
            for i, day in enumerate(days):
                model = method.fit(History(day, days[:i], counts[:i] if i else None))
                if model is None:
                    continue
                for knob in method.knobs:
                    with np.errstate(invalid="ignore"):
                        score, high, states[knob] = method.judge(model, counts[i], knob, states[knob])
                    rows.append((service, key, frame["day"].iloc[i], method.name, knob, frame["counts"].iloc[i], [None if np.isnan(s) else float(s) for s in score], high & ~np.isnan(counts[i]) & ~np.isnan(score)))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in JUDGED.split(", ")])

    return series.groupBy("service", "key").applyInPandas(run, JUDGED)


def alert_sink(judged: DataFrame) -> DataFrame:
    """Of each method, knob, service and key: days, slots judged and high, and episodes (runs of high slots within a day)."""
    starts = F.transform(F.col("high"), lambda h, i: h & ((i == 0) | ~F.get(F.col("high"), i - 1)))
    of = lambda a: F.size(F.filter(a, lambda x: x))
    rows = judged.select("method", "knob", "service", "key", F.size(F.filter("score", lambda s: s.isNotNull())).alias("slots"), of(F.col("high")).alias("n_high"), of(starts).alias("episodes"))
    return rows.groupBy("method", "knob", "service", "key").agg(F.count("*").alias("days"), F.sum("slots").alias("slots"), F.sum("n_high").alias("high"), F.sum("episodes").alias("episodes"))


def injected(series: DataFrame, incidents: DataFrame) -> DataFrame:
    """The series with incidents (service, key, day, start, end, size) added to their observed slots, ends exclusive."""
    own = incidents.groupBy("service", "key", "day").agg(F.collect_list(F.struct("start", "end", "size")).alias("_added"))
    added = lambda i: F.aggregate("_added", F.lit(0), lambda a, x: a + F.when((x["start"] <= i) & (i < x["end"]), x["size"]).otherwise(0))
    counts = F.when(F.col("_added").isNull(), F.col("counts")).otherwise(F.transform("counts", lambda n, i: F.when(n == UNOBSERVED, n).otherwise(n + added(i))))
    return series.join(own, ["service", "key", "day"], "left").select("service", "key", "day", counts.alias("counts"))


def incident_sink(judged: DataFrame, incidents: DataFrame) -> DataFrame:
    """Of each method, knob and size: incidents, those with a high slot, and the mean delay to it in slots."""
    first = F.array_position(F.slice("high", F.col("start") + 1, F.col("end") - F.col("start")), True)
    rows = judged.join(incidents, ["service", "key", "day"]).select("method", "knob", "size", F.nullif(first, F.lit(0)).alias("at"))
    return rows.groupBy("method", "knob", "size").agg(F.count("*").alias("n"), F.count("at").alias("hits"), F.avg(F.col("at") - 1).alias("delay"))


def chosen_knobs(clean: DataFrame, budget: float) -> DataFrame:
    """Of each method the most sensitive knob with at most ``budget`` episodes a key-day on clean days, else the least sensitive."""
    rates = clean.groupBy("method", "knob").agg((F.sum("episodes") / F.sum("days")).alias("alert_rate")).withColumn("in_budget", F.col("alert_rate") <= budget)
    orders = F.create_map(*(x for m in REGISTRY.values() for x in (F.lit(m.name), F.array(*map(F.lit, m.knobs)))))
    place = F.array_position(orders[F.col("method")], F.col("knob"))
    best = rates.groupBy("method").agg(F.min_by("knob", F.when(F.col("in_budget"), place)).alias("within"), F.max_by("knob", place).alias("last"))
    return best.select("method", F.coalesce("within", "last").alias("knob")).join(rates, ["method", "knob"])


def injection_test(series: DataFrame, incidents: DataFrame, budget: float, methods: tuple[str, ...] = tuple(REGISTRY)) -> DataFrame:
    """Test A: the knob of each method that clean days allow, and its recall and delay by size of incident."""
    knobs = chosen_knobs(alert_sink(walk_forward(series, methods)), budget)
    found = incident_sink(walk_forward(injected(series, incidents), methods), incidents)
    return found.join(knobs, ["method", "knob"]).withColumn("recall", F.col("hits") / F.col("n"))
