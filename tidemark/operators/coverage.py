"""Whether coverage that is estimated from hourly moments agrees with coverage counted minute by minute.

Tuning bands from moments alone saves reading minutes; this check says when that may be trusted.  For each kind of key,
method and number of deviations, the minutes outside a band are counted, and estimated as a negative binomial of the
hour's own moments.  A method passes a kind if the two differ by at most ``GAP`` from the best number of deviations on,
and choose numbers at most one step of the grid apart.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import bands as N
from .evaluation import tail_above

# The grid, the coverage wanted, and the largest difference.
GRID, TARGET, GAP = (2.0, 2.5, 3.0, 3.5, 4.0, 5.0, 6.0, 8.0), 0.995, 0.002
#: Lines a minute from which a template is busy.
BUSY = 2.0
ON = ["service", "key", "day", "hour"]


def key_kinds(history: DataFrame, tests: DataFrame, busy: float = BUSY) -> DataFrame:
    """service, key, kind: totals and errors by their name, templates by their rate before the first test day.

    A template that has no history before that day is judged by all of it.
    """
    first = tests.agg(F.min("day").alias("first"))
    rows = history.join(F.broadcast(first))  # one row
    before = F.col("day") < F.col("first")
    of = lambda c: F.coalesce(F.sum(F.when(before, F.col(c))), F.sum(c))
    mean = rows.groupBy("service", "key").agg((of("s") / of("n")).alias("mean"))
    kind = F.when(F.col("key").isin("*total", "*error"), F.col("key")).when(F.col("key").isin("*warn", "*info"), "*warn/*info")
    return mean.select("service", "key", kind.otherwise(F.when(F.col("mean") >= busy, "busy").otherwise("sparse")).alias("kind"))


def linear_bands(centre: DataFrame, method: str, grid: tuple[float, ...] = GRID) -> DataFrame:
    """Bands of each number of deviations from a band of one deviation (mean, high)."""
    k, spread = F.col("k"), F.col("high") - F.col("mean")
    rows = centre.select(*ON, "mean", "high", F.explode(F.array(*map(F.lit, grid))).alias("k"))
    return rows.select(*ON, F.lit(method).alias("method"), "k", (F.col("mean") - k * spread).alias("low"), (F.col("mean") + k * spread).alias("high"))


def nb_bands(trained: DataFrame, grid: tuple[float, ...] = GRID) -> DataFrame:
    """Negative binomial quantiles with the tails of a normal at each number of deviations."""
    pooled = N.moments_band(trained, 1.0).select(*ON, F.round("mean", 6).alias("mean"), F.round("var", 6).alias("var"), F.explode(F.array(*map(F.lit, grid))).alias("k"))

    def quantiles(frames):
        for f in frames:
            got = [N.nb_quantiles(m, v, NormalDist().cdf(-k)) for m, v, k in f.itertuples(index=False)]
            yield f.assign(low=[float(a) for a, _ in got], high=[float(b) for _, b in got])

    each = pooled.select("mean", "var", "k").distinct().mapInPandas(quantiles, "mean double, var double, k double, low double, high double")
    return pooled.join(each, ["mean", "var", "k"]).select(*ON, F.lit("nb").alias("method"), "k", "low", "high")


def all_bands(trained: DataFrame, trained_ewma: DataFrame) -> DataFrame:
    """The four methods' bands over the grid."""
    linear = [linear_bands(N.sigma_band(trained, 1.0), "sigma"), linear_bands(N.median_band(trained, 1.0), "median"), linear_bands(N.ewma_band(trained_ewma, 1.0), "ewma")]
    return linear[0].unionByName(linear[1]).unionByName(linear[2]).unionByName(nb_bands(trained))


def outside(tests: DataFrame, minutes: DataFrame, bands: DataFrame, kinds: DataFrame, floor: Column) -> DataFrame:
    """kind, method, k, estimated and exact minutes outside and all minutes, of the hours ``tests`` (ON, n, s, q).

    Above a band counts from the floor on; below it counts for ``*total`` alone.  Minutes without a row are zeros.
    """
    held = minutes.groupBy(*ON).agg(F.collect_list("n").alias("counts"))  # 60 at most
    mean = F.col("s") / F.col("n")
    hours = tests.join(kinds, ["service", "key"]).join(held, ON, "left").select(*ON, "kind", "n", F.round(mean, 9).alias("m"), F.round(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0)), 9).alias("v"), F.coalesce("counts", F.array().cast("array<bigint>")).alias("counts"), floor.alias("floor"))
    # bounds that are whole but for the last digits of a double are taken as whole
    most = F.greatest(F.floor(F.round("high", 9)) + 1, F.coalesce("floor", F.lit(0)).cast("bigint"))
    least = F.when(F.col("key") == "*total", F.ceil(F.round("low", 9)) - 1).otherwise(-1)
    rows = hours.join(bands, ON).withColumn("t", most).withColumn("lo", F.greatest(least, F.lit(-1)))

    def tails(frames):
        for f in frames:
            yield f.assign(p=[min(1.0, tail_above(m, v, t) + (1 - tail_above(m, v, lo + 1))) for m, v, t, lo in f.itertuples(index=False)])

    each = rows.select("m", "v", "t", "lo").distinct().mapInPandas(tails, "m double, v double, t bigint, lo bigint, p double")
    zeros = F.when((F.col("t") <= 0) | (F.col("lo") >= 0), F.col("n") - F.size("counts")).otherwise(0)
    exact = F.size(F.filter("counts", lambda c: (c >= F.col("t")) | (c <= F.col("lo")))) + zeros
    sums = rows.join(each, ["m", "v", "t", "lo"]).select("kind", "method", "k", "n", (F.col("p") * F.col("n")).alias("e"), exact.alias("x"))
    return sums.groupBy("kind", "method", "k").agg(F.sum("e").alias("estimated"), F.sum("x").alias("exact"), F.sum("n").alias("minutes"))


def coverage_gate(counted: DataFrame, grid: tuple[float, ...] = GRID, target: float = TARGET, gap: float = GAP) -> DataFrame:
    """kind, method, best_estimated and best_exact (least k that covers ``target``, else the largest), the largest difference
    at best_exact and above, steps between the two, and whether the gate is passed."""
    share = lambda c: 1 - F.col(c) / F.col("minutes")
    rows = counted.select("kind", "method", "k", share("estimated").alias("estimated"), share("exact").alias("exact"))
    of = Window.partitionBy("kind", "method")  # a row for each k of the grid
    best = lambda c: F.coalesce(F.min(F.when(F.col(c) >= target, F.col("k"))).over(of), F.lit(max(grid)))
    rows = rows.withColumn("best_estimated", best("estimated")).withColumn("best_exact", best("exact"))
    off = F.max(F.when(F.col("k") >= F.col("best_exact"), F.abs(F.col("estimated") - F.col("exact"))))
    out = rows.groupBy("kind", "method", "best_estimated", "best_exact").agg(off.alias("gap"))
    place = lambda c: F.array_position(F.array(*map(F.lit, grid)), F.col(c))
    out = out.withColumn("steps", F.abs(place("best_estimated") - place("best_exact")))
    return out.withColumn("passed", (F.col("gap") <= gap) & (F.col("steps") <= 1))
