"""Masks, injections, splits, gates, tails and the slices of a re-read."""

from __future__ import annotations

import math
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import truncated


def log_bin(value: Column, low: float = 0.01, high: float = 1e6, bins: int = 600) -> Column:
    """0 below ``low``, ``bins`` + 1 from ``high`` on, else the logarithmic bin from 1."""
    at = F.floor(F.ln(value / low) / math.log(high / low) * bins).cast("int")
    return F.when(value < low, 0).when(value >= high, bins + 1).otherwise(1 + F.least(at, F.lit(bins - 1)))


def histogram_median(binned: DataFrame, keys: list[str], low: float = 0.01, high: float = 1e6, bins: int = 600) -> DataFrame:
    """The middle of the bin that holds the middle value; ``binned`` has keys, bin and n."""
    order = Window.partitionBy(*keys).orderBy("bin")
    rows = binned.withColumn("upto", F.sum("n").over(order)).withColumn("all", F.sum("n").over(Window.partitionBy(*keys)))
    first = rows.filter(2 * F.col("upto") >= F.col("all")).groupBy(*keys).agg(F.min("bin").alias("bin"))
    step = math.log(high / low) / bins
    return first.withColumn("mid", F.when(F.col("bin") == 0, low).when(F.col("bin") == bins + 1, high).otherwise(low * F.exp((F.col("bin") - 0.5) * step)))


def normal_mask(ticks: DataFrame, excluded: DataFrame, incidents: DataFrame, around: int = 1) -> DataFrame:
    """Ticks that are neither excluded (service, tick) nor within ``around`` of an incident (service, start, end)."""
    near = incidents.select("service", F.explode(F.sequence(F.col("start") - around, F.col("end") + around - 1)).alias("tick"))
    out = excluded.select("service", "tick").unionByName(near).distinct()
    return ticks.join(out, ["service", "tick"], "left_anti")


def injected(ticks: DataFrame, plan: DataFrame) -> DataFrame:
    """Counts with incidents: ``plan`` (service, key, start, end, factor, ramp) multiplies; totals take the difference too."""
    deltas = plan.withColumn("tick", F.explode(F.sequence("start", F.col("end") - 1)))
    part = F.when(F.col("ramp"), (F.col("tick") - F.col("start") + 1) / (F.col("end") - F.col("start"))).otherwise(1.0)
    rows = ticks.join(deltas.select("service", "key", "tick", (1 + (F.col("factor") - 1) * part).alias("f")), ["service", "key", "tick"])
    change = rows.select("service", "key", "tick", (F.round(F.col("n") * F.col("f")) - F.col("n")).cast("long").alias("d"))
    both = change.unionByName(change.withColumn("key", F.lit("*total"))).groupBy("service", "key", "tick").agg(F.sum("d").alias("d"))
    return ticks.join(both, ["service", "key", "tick"], "left").select("service", "key", "tick", F.greatest(F.col("n") + F.coalesce("d", F.lit(0)), F.lit(0)).alias("n"))


def recall(incidents: DataFrame, alerts: DataFrame, within: int) -> DataFrame:
    """hit and delay of each incident (service, key, start, end): its first alert from its start to ``within`` past its end."""
    ticks = incidents.withColumn("tick", F.explode(F.sequence("start", F.col("end") + within - 1)))
    first = ticks.join(alerts.select("service", "key", "tick"), ["service", "key", "tick"]).groupBy("service", "key", "start").agg(F.min("tick").alias("at"))
    rows = incidents.join(first, ["service", "key", "start"], "left")
    return rows.select("service", "key", "start", "end", F.col("at").isNotNull().alias("hit"), (F.col("at") - F.col("start")).alias("delay"))


def switched(model: DataFrame, ticks: DataFrame, hour: int = 2) -> DataFrame:
    """``ticks`` (service, key, day, hour) with their day's model (service, key, day, centre); before ``hour``, the day before's."""
    use = F.when(F.col("hour") < hour, F.date_sub("day", 1)).otherwise(F.col("day"))
    return ticks.withColumn("model_day", use).join(model.withColumnRenamed("day", "model_day"), ["service", "key", "model_day"])


def half(key: Column) -> Column:
    """tune or test, by the key's crc32."""
    return F.when(F.crc32(key.cast("binary")) % 2 == 0, "tune").otherwise("test")


def tail_above(mean: float, var: float, t: int) -> float:
    """P(X >= t) of the negative binomial of these moments, Poisson without overdispersion, normal above a mean of 1000."""
    if t <= 0:
        return 1.0
    if mean <= 0:
        return 0.0
    if mean > 1000:
        return 1 - NormalDist(mean, math.sqrt(max(var, mean))).cdf(t - 0.5)
    size = mean * mean / (var - mean) if var > mean else math.inf
    poisson = size > 1e6
    log_p = -mean if poisson else size * (math.log(size) - math.log(size + mean))
    below = 0.0
    for c in range(t):
        below += math.exp(log_p)
        log_p += math.log(mean) - math.log(c + 1) if poisson else math.log((c + size) / (c + 1)) + math.log(mean / (size + mean))
    return max(0.0, 1 - below)


def expected_outside(moments: DataFrame) -> DataFrame:
    """Adds p_above, the chance of a minute above ``high``, to rows with mean, var and high; distinct ones are worked out once."""

    def run(frames):
        for f in frames:
            yield f.assign(p_above=[tail_above(m, v, math.floor(h) + 1) for m, v, h in f.itertuples(index=False)])

    each = moments.select("mean", "var", "high").distinct().mapInPandas(run, "mean double, var double, high double, p_above double")
    return moments.join(each, ["mean", "var", "high"])


def replaced_slices(held: DataFrame, read: DataFrame, slices: DataFrame) -> DataFrame:
    """``held`` with whole (service, day, hour) slices taken from ``read`` instead."""
    on = ["service", "day", "hour"]
    return held.join(slices, on, "left_anti").unionByName(read.join(slices, on, "left_semi"))


def merged_spans(hours: DataFrame, keys: list[str]) -> DataFrame:
    """Contiguous hours as spans."""
    rows = hours.distinct().withColumn("_i", F.col("h") - F.row_number().over(Window.partitionBy(*keys).orderBy("h")))
    return rows.groupBy(*keys, "_i").agg(F.min("h").alias("start"), (F.max("h") + 1).alias("end")).drop("_i")


def merged_json(first: Column, second: Column) -> Column:
    """Two JSON objects of texts as one: of keys that both have, the second's values stay."""
    kind = "map<string,string>"
    a, b = F.from_json(first, kind), F.from_json(second, kind)
    return F.to_json(F.map_concat(F.map_filter(a, lambda k, _: ~F.array_contains(F.map_keys(b), k)), b))


def flattened_hit(source: Column, most: int = 8192) -> list[Column]:
    """service, level, module and message of a JSON document whose fields may be nested; null where there is none.

    A message is cut at ``most`` bytes of UTF-8, between characters, and has no NULs.
    """
    get = lambda *paths: F.coalesce(*(F.nullif(F.get_json_object(source, p), F.lit("")) for p in paths))
    return [get("$.service.name", "$.service", "$.service_code").alias("service"), F.upper(F.coalesce(get("$.level", "$.log.level"), F.lit("INFO"))).alias("level"), get("$.moduleCode", "$.module").alias("module"), truncated(get("$.message"), most).alias("message")]


def parsed_time(text: Column) -> Column:
    """A time given as ISO text, or as seconds or milliseconds since 1970 (those above 1e11)."""
    number = text.try_cast("double")
    seconds = F.when(number > 1e11, number / 1000).otherwise(number)
    return F.coalesce(F.timestamp_micros((seconds * 1e6).cast("long")), F.try_to_timestamp(text))


def ratio_quantiles(n: int, p: float, q: float) -> tuple[int, int]:
    """Smallest counts of a binomial whose chance of at most them reaches ``q`` and 1 - ``q``."""
    if n <= 0 or p <= 0:
        return 0, 0
    if p >= 1:
        return n, n
    log_p, below, low = n * math.log(1 - p), 0.0, None
    for k in range(n + 1):
        below += math.exp(log_p)
        if low is None and below >= q:
            low = k
        if below >= 1 - q:
            return low, k
        log_p += math.log((n - k) / (k + 1)) + math.log(p / (1 - p))
    return low or 0, n


def ratio_band(rows: DataFrame, q: float = 0.005) -> DataFrame:
    """low and high of the parts of totals: ``rows`` have total and share; distinct ones are worked out once."""

    def run(frames):
        for f in frames:
            got = [ratio_quantiles(int(n), s, q) for n, s in f.itertuples(index=False)]
            yield pd.DataFrame({"total": f["total"], "share": f["share"], "low": [a for a, _ in got], "high": [b for _, b in got]})

    each = rows.select("total", "share").distinct().mapInPandas(run, "total bigint, share double, low bigint, high bigint")
    return rows.join(each, ["total", "share"])
