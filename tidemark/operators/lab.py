"""Offline evaluation: detectors over day arrays, episodes, flaps, seasonal errors, bootstrap."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored

SERIES = "service string, key string, tick bigint, score double, high boolean"


def mad_band(ticks: DataFrame, k: float) -> DataFrame:
    """Flags counts further than ``k`` scaled deviations from the median of their key and hour of day."""
    rows = ticks.withColumn("hour", F.col("tick") % 24)
    centre = rows.groupBy("service", "key", "hour").agg(F.median("n").alias("c"))
    off = rows.join(centre, ["service", "key", "hour"]).withColumn("off", F.abs(F.col("n") - F.col("c")))
    spread = off.groupBy("service", "key", "hour").agg((1.4826 * F.median("off")).alias("mad"))
    out = off.join(spread, ["service", "key", "hour"]).withColumn("high", F.col("off") > F.greatest(k * F.col("mad"), F.lit(1.0)))
    return out.select("service", "key", "tick", "n", "c", "mad", "high")


def weekly(ticks: DataFrame, factor: float, least: float) -> DataFrame:
    """Flags counts above a factor of the same hour a week before."""
    before = ticks.select("service", "key", (F.col("tick") + 168).alias("tick"), F.col("n").alias("before"))
    rows = ticks.join(before, ["service", "key", "tick"])
    return rows.withColumn("high", (F.col("n") > factor * F.col("before")) & (F.col("n") >= least))


def cusum(ticks: DataFrame, h: float = 5.0, ratio: float = 1.5) -> DataFrame:
    """One-sided sums of log-likelihood ratios of a raised Poisson rate, which begin anew after an alarm.

    The fold over a key's ticks in order needs them together; a key has one count for each hour.
    """

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("tick")
        rate, s, out = max(float(frame["n"].mean()), 1e-9), 0.0, []
        for x in frame["n"]:
            s = max(0.0, s + x * np.log(ratio) - (ratio - 1) * rate)
            out.append(s)
            if s > h:
                s = 0.0
        return frame.assign(score=out, high=[x > h for x in out])[["service", "key", "tick", "score", "high"]]

    return ticks.groupBy("service", "key").applyInPandas(run, SERIES)


def left_profile(ticks: DataFrame, m: int = 24) -> DataFrame:
    """Distance of each z-normalised window of ``m`` ticks to the nearest earlier one that doesn't overlap it."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("tick")
        x = frame["n"].to_numpy(float)
        score = np.full(len(x), np.nan)
        if len(x) >= 2 * m:
            w = np.lib.stride_tricks.sliding_window_view(x, m)
            sd = w.std(axis=1, keepdims=True)
            z = np.divide(w - w.mean(axis=1, keepdims=True), sd, out=np.zeros_like(w), where=sd > 0)
            for i in range(m, len(z)):  # row by row: memory stays linear
                score[i + m - 1] = np.sqrt(np.maximum(((z[: i - m + 1] - z[i]) ** 2).sum(axis=1), 0).min())
        return frame.assign(score=score, high=score > np.sqrt(2 * m))[["service", "key", "tick", "score", "high"]]

    return ticks.groupBy("service", "key").applyInPandas(run, SERIES)


def principal(ticks: DataFrame, components: int = 2) -> DataFrame:
    """Squared residual of each tick's counts of all keys off their leading principal components, by service.

    The covariance of the keys is summed from the counts that are not zero, pair by pair within a tick; only that matrix of
    a service, keys by keys, comes together in a task, for power iteration with deflation.  Ticks are scored by sums over
    their own counts: a count of zero adds nothing to them, and what the means add is a constant of the service.
    """
    spans = ticks.groupBy("service").agg(F.countDistinct("tick").alias("ticks"))
    counts = ticks.filter("n <> 0").select("service", "tick", "key", F.col("n").cast("double").alias("n"))
    sums = ticks.groupBy("service", "key").agg(F.sum("n").cast("double").alias("total"))
    other = counts.select("service", "tick", F.col("key").alias("other"), F.col("n").alias("m"))
    products = counts.join(other, ["service", "tick"]).groupBy("service", "key", "other").agg(F.sum(F.col("n") * F.col("m")).alias("p"))
    # a key without counts has a row of its own, with no product
    entries = sums.join(spans, "service").join(products, ["service", "key"], "left").select("service", "key", "total", "ticks", "other", "p")

    def leading(frame: pd.DataFrame) -> pd.DataFrame:
        keys = sorted(frame["key"].unique())
        place, n, ticks_ = {k: i for i, k in enumerate(keys)}, len(keys), int(frame["ticks"].iloc[0])
        mean = frame.drop_duplicates("key").set_index("key")["total"].reindex(keys).to_numpy() / ticks_
        cov, some = np.zeros((n, n)), frame.dropna(subset=["other"])
        cov[some["key"].map(place), some["other"].map(place)] = some["p"]
        cov = (cov - ticks_ * np.outer(mean, mean)) / max(ticks_ - 1, 1)
        out = pd.DataFrame({"service": frame["service"].iloc[0], "key": keys, "mean": mean})
        found = []
        for _ in range(components):
            v = np.ones(n) / np.sqrt(n)
            for _ in range(200):
                u = cov @ v
                if not (size := np.linalg.norm(u)):
                    break
                v = u / size
            cov = cov - np.outer(cov @ v, v)
            found.append(v if len(found) < n else np.zeros(n))
        return out.assign(v=np.stack(found, axis=1).tolist())

    weights = stored(entries.groupBy("service").applyInPandas(leading, "service string, key string, mean double, v array<double>"), "components")
    along = lambda x: [F.sum(x * F.col("v")[i]).alias(f"a{i}") for i in range(components)]
    constant = weights.groupBy("service").agg(F.sum(F.col("mean") * F.col("mean")).alias("m2"), *(c.alias(f"c{i}") for i, c in enumerate(along(F.col("mean")))))
    own = counts.join(weights, ["service", "key"]).groupBy("service", "tick").agg(F.sum(F.col("n") * F.col("n") - 2 * F.col("n") * F.col("mean")).alias("x2"), *along(F.col("n")))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    rows = ticks.select("service", "tick").distinct().join(own, ["service", "tick"], "left").join(constant, "service")
    score = zero("x2") + F.col("m2") - sum((F.pow(zero(f"a{i}") - F.col(f"c{i}"), 2) for i in range(components)), F.lit(0.0))
    scored = stored(rows.select("service", "tick", F.greatest(score, F.lit(0.0)).alias("score")), "residuals")
    limit = scored.groupBy("service").agg(F.percentile("score", F.lit(0.995)).alias("limit"))
    return scored.join(limit, "service").select("service", F.lit("*pca").alias("key"), "tick", "score", (F.col("score") > F.col("limit")).alias("high"))


def vote(*flags: DataFrame, least: int = 2) -> DataFrame:
    """High where at least ``least`` detectors are."""
    whole = flags[0].select("service", "key", "tick", "high")
    for f in flags[1:]:
        whole = whole.unionByName(f.select("service", "key", "tick", "high"))
    return whole.groupBy("service", "key", "tick").agg((F.count_if("high") >= least).alias("high"))


def episodes(stated: DataFrame) -> DataFrame:
    """Runs of non-NORMAL ticks that reached ALERTING: begin, end, ticks on alert, and highest score."""
    order = Window.partitionBy("service", "key").orderBy("tick")
    rows = stated.withColumn("_out", F.col("state") != "NORMAL")
    rows = rows.withColumn("_new", (F.col("_out") & ~F.coalesce(F.lag("_out").over(order), F.lit(False))).cast("int"))
    rows = rows.withColumn("_run", F.sum("_new").over(order)).filter("_out")
    per = rows.groupBy("service", "key", "_run").agg(F.min("tick").alias("start"), (F.max("tick") + 1).alias("end"), F.count_if(F.col("state") == "ALERTING").alias("alerted"), F.max("n").alias("peak"))
    return per.filter("alerted > 0").drop("_run")


def flaps(found: DataFrame, short: int = 5, gap: int = 30) -> DataFrame:
    """Episodes that are short, or come soon after the last of their key."""
    order = Window.partitionBy("service", "key").orderBy("start")
    soon = F.col("start") - F.lag("end").over(order) < gap
    return found.withColumn("flap", (F.col("end") - F.col("start") < short) | F.coalesce(soon, F.lit(False)))


def naive_errors(ticks: DataFrame) -> DataFrame:
    """Mean absolute error of the counts of a week and of a day before, and their ratio."""
    w = Window.partitionBy("service", "key").orderBy("tick")
    rows = ticks.withColumn("week", F.lag("n", 168).over(w)).withColumn("day", F.lag("n", 24).over(w)).filter("week IS NOT NULL")
    per = rows.groupBy("service", "key").agg(F.avg(F.abs(F.col("n") - F.col("week"))).alias("mae_week"), F.avg(F.abs(F.col("n") - F.col("day"))).alias("mae_day"))
    return per.withColumn("ratio", F.when(F.col("mae_day") > 0, F.col("mae_week") / F.col("mae_day")))


def bootstrap(days: DataFrame, value: str, draws: int = 1000, seed: int = 11) -> DataFrame:
    """5th and 95th percentile of the mean over resampled days, by service: each draw picks as many days as there are."""
    n = F.count("*").over(Window.partitionBy("service"))
    numbered = days.withColumn("i", F.row_number().over(Window.partitionBy("service").orderBy("day")) - 1).withColumn("n", n)
    picks = numbered.select("service", "n", F.col("i").alias("slot")).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws))))
    picks = picks.withColumn("i", F.pmod(F.xxhash64(F.lit(seed), "service", "draw", "slot"), F.col("n")).cast("int"))
    means = picks.join(numbered.select("service", "i", F.col(value).alias("v")), ["service", "i"]).groupBy("service", "draw").agg(F.avg("v").alias("m"))
    return means.groupBy("service").agg(F.percentile("m", F.lit(0.05)).alias("low"), F.percentile("m", F.lit(0.95)).alias("high"))
