"""Registered queries of the decision between bands, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bands as N
from ..operators import coverage as G
from ..operators import decide as X
from ..sources.shared import stored
from .forecast_queries import _history
from .link_queries import HISTORY, SIGMA_SQL
from .log_queries import query
from .report_queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]

#: Deviations of the bands, and limits that suit tables with few lines an hour.
K, COVERAGE, BUDGET, SEED, DRAWS = 3, (0.5, 1.0), 1000.0, 11, 1000
#: Heavy methods and their costs: fixed values of the registry.
METHODS = {"sigma": (False, 1), "median": (False, 1), "ewma": (False, 2)}

MEASURES = f"""WITH {HISTORY}, {SIGMA_SQL}, kind AS (SELECT service, key, CASE WHEN key IN ('*total', '*error') THEN key WHEN sum(s) / sum(n) >= {G.BUSY} THEN 'busy' ELSE 'sparse' END AS kind FROM hist GROUP BY service, key),
w AS (SELECT *, 0.5 ** ((max(past) OVER (PARTITION BY service, key, day, hour) - past) / 2.0) AS w FROM trained28),
ewma AS (SELECT service, key, day, hour, sum(w * s) / sum(w * n) AS mean, sqrt(greatest(sum(w * q) / sum(w * n) - (sum(w * s) / sum(w * n)) ** 2, 0)) AS sd FROM w GROUP BY ALL HAVING count(*) >= 2 AND sum(s) > 0),
r AS (SELECT *, s / n AS x, greatest(q / n - (s / n) ** 2, 0) AS v FROM trained), c AS (SELECT service, key, day, hour, median(x) AS c, median(v) AS v, count(*) AS rows, sum(s) AS total FROM r GROUP BY ALL),
md AS (SELECT c.service, c.key, c.day, c.hour, any_value(c.c) AS mean, sqrt(any_value(c.v) + (1.4826 * median(abs(r.x - c.c))) ** 2) AS sd FROM r JOIN c USING (service, key, day, hour) WHERE c.rows >= 3 AND c.total > 0 GROUP BY ALL),
cen AS (SELECT service, key, day, hour, 'sigma' AS method, mean, sqrt(var) AS sd FROM sigma UNION ALL SELECT service, key, day, hour, 'median', mean, sd FROM md UNION ALL SELECT service, key, day, hour, 'ewma', mean, sd FROM ewma),
sc AS (SELECT e.method, kind.kind, t.service, t.key, t.day, t.hour, round(t.s / t.n, 9) AS y, round(e.mean, 9) AS mean, round(e.mean - {K} * e.sd, 9) AS low, round(e.mean + {K} * e.sd, 9) AS high, round(b.s / b.n, 9) AS naive
  FROM hist t JOIN kind USING (service, key) JOIN cen e USING (service, key, day, hour) LEFT JOIN hist b ON b.service = t.service AND b.key = t.key AND b.day = t.day - 7 AND b.hour = t.hour),
oo AS (SELECT *, y > high OR y < low AS o FROM sc), st AS (SELECT *, o AND NOT coalesce(lag(o) OVER k, false) AS starts, coalesce(lead(o) OVER k, false) AS goes FROM oo WINDOW k AS (PARTITION BY method, service, key ORDER BY day, hour)),
m AS (SELECT method, kind, service, day, count(*) AS n, sum(high - low + 2 / {N.ALPHA} * (greatest(low - y, 0) + greatest(y - high, 0))) AS winkler, sum(abs(y - mean)) FILTER (naive IS NOT NULL) AS abs_err, sum(abs(y - naive)) AS abs_naive,
  count(*) FILTER (NOT o) AS covered, count(*) FILTER (starts) AS episodes, count(*) FILTER (starts AND NOT goes) AS flaps, count(DISTINCT key) AS key_days FROM st GROUP BY ALL),
md_ AS (SELECT method, kind, day, sum(n) AS n, sum(winkler) AS w FROM m GROUP BY ALL),
pool AS (SELECT a.*, b.n AS bn, b.w AS bw, row_number() OVER (PARTITION BY a.method, a.kind ORDER BY a.day) - 1 AS i, count(*) OVER (PARTITION BY a.method, a.kind) AS size FROM md_ a JOIN md_ b ON b.method = 'sigma' AND b.kind = a.kind AND b.day = a.day),
x1 AS (SELECT method, kind, size, draw, i AS slot, (draw * 1000003 + i * 7919 + {SEED}) % {X.PRIME} AS x FROM pool, range(1, {DRAWS} + 1) g(draw)), x2 AS (SELECT *, ((x * x + 12345) % {X.PRIME} * 48271 + slot) % {X.PRIME} AS z FROM x1),
pk AS (SELECT method, kind, draw, floor((z * z % {X.PRIME}) * size / {X.PRIME})::BIGINT AS i FROM x2),
dr AS (SELECT method, kind, draw, sum(w) / sum(n) / nullif(sum(bw) / sum(bn), 0) AS r FROM pk JOIN pool USING (method, kind, i) GROUP BY ALL),
ci AS (SELECT method, kind, quantile_cont(r, 0.05) AS low, quantile_cont(r, 0.95) AS high FROM dr GROUP BY ALL), ra AS (SELECT method, kind, sum(w) / sum(n) / nullif(sum(bw) / sum(bn), 0) AS ratio FROM pool GROUP BY ALL)"""


def _measures(spark: SparkSession, sf: str) -> DataFrame:
    """Sums by day of three bands over all hours of all keys but the view-only ones, against the same hour a week before."""
    _, _, _, days, _, history = _history(spark, sf)
    on = ["service", "key", "day", "hour"]
    keys = history.select(*on)
    trained = N.training(history, keys, days)
    made = {"sigma": N.sigma_band(trained, 1.0), "median": N.median_band(trained, 1.0), "ewma": N.ewma_band(N.training(history, keys, days, True), 1.0)}
    bands = None
    for name, band in made.items():
        part = band.select(*on, F.lit(name).alias("method"), "mean", (F.col("high") - F.col("mean")).alias("sd"))
        bands = part if bands is None else bands.unionByName(part)
    y = F.round(F.col("s") / F.col("n"), 9)
    before = history.select("service", "key", F.date_add("day", 7).alias("day"), "hour", y.alias("naive"))
    rows = history.select(*on, y.alias("y")).join(bands, on).join(before, on, "left").join(G.key_kinds(history, keys), ["service", "key"])
    near = lambda c: F.round(c, 9)
    rows = rows.withColumn("low", near(F.col("mean") - K * F.col("sd"))).withColumn("high", near(F.col("mean") + K * F.col("sd"))).withColumn("mean", near(F.col("mean")))
    return stored(X.day_measures(rows), "measures")


@query(f"{MEASURES} SELECT method, kind, round(ratio, 6) AS ratio, round(low, 6) AS low, round(high, 6) AS high FROM ra JOIN ci USING (method, kind)")
def a19_block_ratios(spark, sf):
    """Interval scores of bands by that of sigma, with intervals from 1,000 seeded draws of days."""
    out = X.ratios(_measures(spark, sf), draws=DRAWS, seed=SEED)
    return out.select("method", "kind", *(F.round(c, 6).alias(c) for c in ("ratio", "low", "high")))


@query(f"""{MEASURES}, fa AS (SELECT method, kind, sum(covered) / sum(n) AS coverage, sum(episodes) / sum(key_days) * CASE WHEN kind = '*total' THEN 7 ELSE 100 END AS alert_rate, sum(flaps) / nullif(sum(episodes), 0) AS flap_share, sum(abs_err) / nullif(sum(abs_naive), 0) AS mase FROM m GROUP BY method, kind),
ms AS (SELECT method, kind, service, sum(winkler) / sum(n) AS s FROM m GROUP BY ALL), ws AS (SELECT a.method, a.kind, avg((a.s / nullif(b.s, 0) > 1)::INT) AS worse_share FROM ms a JOIN ms b ON b.method = 'sigma' AND b.kind = a.kind AND b.service = a.service GROUP BY ALL),
cand AS (SELECT *, method = 'ewma' AS dear FROM fa LEFT JOIN ra USING (method, kind) LEFT JOIN ci USING (method, kind) LEFT JOIN ws USING (method, kind) WHERE method <> 'sigma'),
live AS (SELECT * FROM cand WHERE coverage BETWEEN {COVERAGE[0]} AND {COVERAGE[1]} AND alert_rate <= {BUDGET} AND coalesce(flap_share <= {X.MAX_FLAPS}, true)),
tp AS (SELECT * FROM live QUALIFY row_number() OVER (PARTITION BY kind ORDER BY ratio NULLS LAST, method) = 1),
td AS (SELECT l.*, t.method AS top, t.ratio AS top_ratio, t.high AS top_high FROM live l JOIN tp t ON t.kind = l.kind WHERE l.method = t.method OR (l.low <= t.high AND t.low <= l.high)),
ld AS (SELECT *, string_agg(method, ',' ORDER BY method) OVER (PARTITION BY kind ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS tied FROM td QUALIFY row_number() OVER (PARTITION BY kind ORDER BY dear, mase NULLS LAST, method) = 1),
f AS (SELECT k.kind, l.method, l.tied, coalesce(l.ratio <= {X.FIT_RATIO} AND l.high < 1, false) AS fits, coalesce(l.top_ratio <= {X.FIT_RATIO} AND l.top_high < 1, false) AND l.top <> l.method AS other, l.top, coalesce(l.worse_share > {X.WORSE_SHARE}, false) AS worse FROM (SELECT DISTINCT kind FROM cand) k LEFT JOIN ld l USING (kind)),
sp AS (SELECT max(day) - min(day) + 1 AS days, count(DISTINCT CASE WHEN isodow(day) >= 6 THEN date_trunc('week', day) END) AS weekends FROM m)
SELECT kind, CASE WHEN method IS NOT NULL AND fits AND worse THEN 'mixed' ELSE 'sigma stays' END AS verdict, method AS leader, tied,
CASE WHEN method IS NULL THEN 'none passes the gates' WHEN NOT fits AND other THEN method || ' fits no better; it is simpler than ' || top || ', which does' WHEN NOT fits THEN method || ' fits no better' WHEN worse THEN method || ' is worse on too many services' ELSE method || ' fits better, but is not verified: detect' END AS reason,
CASE WHEN days < 14 THEN 'exploratory' WHEN days >= 28 AND weekends >= 2 THEN 'final' ELSE 'provisional' END AS strength FROM f, sp""")
def b17_decisions(spark, sf):
    """Whether another band takes sigma's place, kind by kind; recall isn't measured here, so none is adopted unseen."""
    days = _measures(spark, sf)
    known = F.create_map(*(x for m, (heavy, cost) in METHODS.items() for x in (F.lit(m), F.struct(F.lit(heavy).alias("heavy"), F.lit(cost).alias("cost")))))[F.col("method")]
    facts = X.measured(days).join(X.ratios(days, draws=DRAWS, seed=SEED), ["method", "kind"], "left")
    facts = facts.withColumns({"heavy": known["heavy"], "cost": known["cost"], "band": F.lit(True), "in_budget": F.lit(True), "recall": F.lit(None).cast("double")})
    decided = X.decisions(X.gated(facts, coverage=COVERAGE, budget=BUDGET))
    weekend = F.when(F.weekday("day") >= 5, F.date_trunc("week", "day"))
    span = days.agg((F.datediff(F.max("day"), F.min("day")) + 1).alias("d"), F.count_distinct(weekend).alias("w"))
    # one row: the days there are
    return decided.join(F.broadcast(span.select(X.strength(F.col("d"), F.col("w")).alias("strength"))))
