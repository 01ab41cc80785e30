"""Registered queries of minute bands from hourly forecasts and of the coverage check, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bands as N
from ..operators import counts as C
from ..operators import coverage as G
from ..operators import forecast as P
from ..sources import driver_tables as S
from ..sources.shared import stored
from .lab_queries import ORACLES, QUERIES
from .link_queries import HISTORY, SIGMA_SQL
from .log_queries import FLOOR, _days, _lines, query

__all__ = ["ORACLES", "QUERIES"]

Z = P.z_of()
FLOOR_SQL = f"CASE WHEN key = '*error' OR key LIKE '%:error' OR key LIKE '%:signup' THEN {FLOOR} END"


def _floor():
    key = F.col("key")
    return F.when((key == "*error") | key.endswith(":error") | key.endswith(":signup"), FLOOR)


def _history(spark, sf):
    """Minutes, moments, hours, days, exclusions and the dense history of all keys but the view-only ones; each written once."""
    minutes = stored(C.minute_counts(_lines(spark, sf)), "minutes")
    moments = C.hourly_moments(minutes).filter("key NOT IN ('*warn', '*info')")
    hours, days, exclusions = _days(spark, sf)
    grid = moments.select("service", "key").distinct().join(hours.filter("n_minutes > 0"), "service").join(moments, ["service", "key", "day", "hour"], "left")
    history = grid.select("service", "key", "day", "hour", F.col("n_minutes").alias("n"), F.coalesce("sum", F.lit(0)).alias("s"), F.coalesce("sumsq", F.lit(0)).alias("q"))
    return minutes, moments, hours, days, exclusions, stored(history, "history")


WIDENED = f"""{HISTORY}, used AS (SELECT h.service, h.day, h.hour, h.n_minutes FROM hours h WHERE h.n_minutes > 0 AND NOT EXISTS (SELECT 1 FROM exclusions x WHERE x.decision = 'exclude' AND x.service = h.service AND x.day = h.day AND h.hour >= x.hour_from AND h.hour < x.hour_to)),
v AS (SELECT m.service, m.key, m.day, m.hour, greatest(m.sumsq / u.n_minutes - (m.sum / u.n_minutes) ** 2, 0) AS v FROM moments m JOIN used u USING (service, day, hour)),
asked AS (SELECT DISTINCT service, day, hour FROM tests), nu AS (SELECT t.service, t.day, t.hour, count(u.day) AS n FROM asked t LEFT JOIN used u ON u.service = t.service AND u.hour = t.hour AND u.day BETWEEN t.day - 14 AND t.day - 1 GROUP BY ALL),
noise AS (SELECT t.service, t.key, t.day, t.hour, coalesce(sum(v.v) / nullif(any_value(nu.n), 0), 0) AS noise FROM tests t JOIN nu USING (service, day, hour) LEFT JOIN v ON v.service = t.service AND v.key = t.key AND v.hour = t.hour AND v.day BETWEEN t.day - 14 AND t.day - 1 GROUP BY ALL),
f AS (SELECT service, key, day, hour, avg(s / n) AS expected, stddev_pop(s / n) AS sd FROM trained GROUP BY ALL HAVING count(*) >= 2),
wide AS (SELECT service, key, day, hour, expected, {Z!r} * sqrt(sd * sd + noise) AS half FROM f JOIN noise USING (service, key, day, hour))"""


@query(f"WITH {WIDENED} SELECT service, key, day, hour, round(expected, 6) AS expected, round(expected - half, 6) AS low, round(expected + half, 6) AS high FROM wide")
def m9_widened_bands(spark, sf):
    """Bands of single minutes: the hourly forecast's half and the noise within hours, in quadrature."""
    _, moments, hours, days, exclusions, history = _history(spark, sf)
    tests = history.select("service", "key", "day", "hour")
    bands = P.minute_forecast(N.training(history, tests, days), P.within_variance(moments, hours, exclusions, tests), Z)
    return bands.select("service", "key", "day", "hour", *(F.round(c, 6).alias(c) for c in ("expected", "low", "high")))


@query(f"""WITH {WIDENED}, ob AS (SELECT service, (DATE '1970-01-01' + (mn // 1440)::INT)::DATE AS day, ((mn // 60) % 24)::INT AS hour, (mn % 60)::INT AS slot FROM (SELECT service, unnest(generate_series(a, b)) AS mn FROM bounds)),
seen AS (SELECT t.service, t.day, t.hour, o.slot, count(*) AS c FROM asked t JOIN ob o ON o.service = t.service AND o.hour = t.hour AND o.day BETWEEN t.day - 7 AND t.day - 1 GROUP BY ALL),
complete AS (SELECT service, day, hour FROM seen GROUP BY ALL HAVING count(*) = 60),
sums AS (SELECT t.service, t.key, t.day, t.hour, (m.minute % 60)::INT AS slot, sum(m.n) AS s FROM tests t JOIN minutes m ON m.service = t.service AND m.key = t.key AND m.hour = t.hour AND m.day BETWEEN t.day - 7 AND t.day - 1 GROUP BY ALL),
means AS (SELECT s.service, s.key, s.day, s.hour, s.slot, s.s / seen.c AS m FROM sums s JOIN complete USING (service, day, hour) JOIN seen USING (service, day, hour, slot)),
tot AS (SELECT service, key, day, hour, sum(m) / 60 AS m, max(m) AS top FROM means GROUP BY ALL),
own AS (SELECT service, key, day, hour, (minute % 60)::INT AS slot, n FROM minutes),
j AS (SELECT w.service, w.key, w.day, w.hour, coalesce(t.top / t.m, 1) AS peak, coalesce(own.n, 0) AS n, {FLOOR_SQL} AS floor, CASE WHEN t.m > 0 THEN coalesce(e.m, 0) / t.m ELSE 1 END AS f, w.expected, w.half
  FROM wide w JOIN ob USING (service, day, hour) LEFT JOIN tot t USING (service, key, day, hour) LEFT JOIN means e USING (service, key, day, hour, slot) LEFT JOIN own USING (service, key, day, hour, slot))
SELECT service, key, day, hour, round(max(peak), 6) AS peak, count(*) AS observed, count(*) FILTER (n > (expected + half) * f AND n >= floor OR key = '*total' AND expected * f >= 20 AND n < greatest((expected - half) * f, 0)) AS flagged,
round(max(CASE WHEN (expected + half) * f > expected * f THEN (n - expected * f) / ((expected + half) * f - expected * f) ELSE 0 END), 5) AS top_score FROM j GROUP BY ALL""")
def m9_shaped_minutes(spark, sf):
    """Minutes judged against bands that follow the shape of their hour: its peak, minutes observed and flagged, top score."""
    minutes, moments, hours, days, exclusions, history = _history(spark, sf)
    tests = history.select("service", "key", "day", "hour")
    bands = P.minute_forecast(N.training(history, tests, days), P.within_variance(moments, hours, exclusions, tests), Z)
    masks = stored(P.span_masks(minutes), "masks")
    rows = P.judged_minutes(bands, P.minute_shapes(minutes, masks, tests), minutes, masks, _floor())
    flagged = F.size(F.filter("slots", lambda x: x["flag"])).cast("bigint")
    top = F.array_max(F.transform("slots", lambda x: x["score"]))
    return rows.select("service", "key", "day", "hour", F.round(F.array_max("shape"), 6).alias("peak"), F.size("slots").cast("bigint").alias("observed"), flagged.alias("flagged"), F.round(top, 5).alias("top_score"))


GRID_SQL = f"(SELECT unnest([{', '.join(f'{k}::DOUBLE' for k in G.GRID)}]) AS k)"
#: Chance of ``t`` or more of a negative binomial of mean m and variance v, Poisson without overdispersion.
TAIL = """CASE WHEN {t} <= 0 THEN 1 WHEN m <= 0 THEN 0 ELSE greatest(0, 1 - list_sum([exp(CASE WHEN v <= m OR m * m / (v - m) > 1e6 THEN c * ln(m) - m - lgamma(c + 1)
ELSE lgamma(c + m * m / (v - m)) - lgamma(m * m / (v - m)) - lgamma(c + 1) + m * m / (v - m) * ln(m / v) + c * ln(1 - m / v) END) FOR c IN range({t}::BIGINT)])) END"""


@query(f"""WITH {HISTORY}, {SIGMA_SQL}, lastdays AS (SELECT DISTINCT day FROM days ORDER BY day DESC LIMIT 3), t3 AS (SELECT * FROM hist WHERE day IN (SELECT day FROM lastdays)),
pr AS (SELECT *, day < (SELECT min(day) FROM lastdays) AS before FROM hist), km AS (SELECT service, key, coalesce(sum(s) FILTER (before), sum(s)) / coalesce(sum(n) FILTER (before), sum(n)) AS mean FROM pr GROUP BY ALL),
kind AS (SELECT service, key, CASE WHEN key IN ('*total', '*error') THEN key WHEN mean >= 2 THEN 'busy' ELSE 'sparse' END AS kind FROM km),
w AS (SELECT *, 0.5 ** ((max(past) OVER (PARTITION BY service, key, day, hour) - past) / 2.0) AS w FROM trained28),
ewma AS (SELECT service, key, day, hour, sum(w * s) / sum(w * n) AS mean, sqrt(greatest(sum(w * q) / sum(w * n) - (sum(w * s) / sum(w * n)) ** 2, 0)) AS sd FROM w GROUP BY ALL HAVING count(*) >= 2 AND sum(s) > 0),
r AS (SELECT *, s / n AS x, greatest(q / n - (s / n) ** 2, 0) AS v FROM trained), c AS (SELECT service, key, day, hour, median(x) AS c, median(v) AS v, count(*) AS rows, sum(s) AS total FROM r GROUP BY ALL),
md AS (SELECT c.service, c.key, c.day, c.hour, any_value(c.c) AS mean, sqrt(any_value(c.v) + (1.4826 * median(abs(r.x - c.c))) ** 2) AS sd FROM r JOIN c USING (service, key, day, hour) WHERE c.rows >= 3 AND c.total > 0 GROUP BY ALL),
cen AS (SELECT service, key, day, hour, 'sigma' AS method, mean, sqrt(var) AS sd FROM sigma UNION ALL SELECT service, key, day, hour, 'median', mean, sd FROM md UNION ALL SELECT service, key, day, hour, 'ewma', mean, sd FROM ewma),
b AS (SELECT t.service, t.key, t.day, t.hour, t.n, round(t.s / t.n, 9) AS m, round(greatest(t.q / t.n - (t.s / t.n) ** 2, 0), 9) AS v, kind.kind, e.method, g.k, {FLOOR_SQL.replace('key', 't.key')} AS fl,
  floor(round(e.mean + g.k * e.sd, 9))::BIGINT + 1 AS up, CASE WHEN t.key = '*total' THEN greatest(ceil(round(e.mean - g.k * e.sd, 9))::BIGINT - 1, -1) ELSE -1 END AS lo FROM t3 t JOIN kind USING (service, key) JOIN cen e USING (service, key, day, hour), {GRID_SQL} g),
bt AS (SELECT *, greatest(up, coalesce(fl, 0)) AS t FROM b),
ex AS (SELECT bt.service, bt.key, bt.day, bt.hour, bt.method, bt.k, count(*) FILTER (x.n >= bt.t OR x.n <= bt.lo) + CASE WHEN bt.lo >= 0 OR bt.t <= 0 THEN any_value(bt.n) - count(x.n) ELSE 0 END AS x FROM bt LEFT JOIN minutes x USING (service, key, day, hour) GROUP BY bt.service, bt.key, bt.day, bt.hour, bt.method, bt.k, bt.lo, bt.t),
agg AS (SELECT kind, method, k, 1 - sum(n * least(1, {TAIL.format(t='t')} + 1 - {TAIL.format(t='(lo + 1)')})) / sum(n) AS est, 1 - sum(x) / sum(n) AS exact FROM bt JOIN ex USING (service, key, day, hour, method, k) GROUP BY ALL),
best AS (SELECT *, coalesce(min(k) FILTER (est >= 0.995) OVER p, 8) AS best_estimated, coalesce(min(k) FILTER (exact >= 0.995) OVER p, 8) AS best_exact FROM agg WINDOW p AS (PARTITION BY kind, method)),
gate AS (SELECT kind, method, best_estimated, best_exact, max(abs(est - exact)) FILTER (k >= best_exact) AS gap FROM best GROUP BY ALL), o AS (SELECT *, row_number() OVER (ORDER BY k) AS i FROM {GRID_SQL})
SELECT kind, method, best_estimated, best_exact, round(gap, 6) AS gap, abs(p.i - q.i) AS steps, gap <= 0.002 AND abs(p.i - q.i) <= 1 AS passed FROM gate JOIN o p ON p.k = best_estimated JOIN o q ON q.k = best_exact""")
def b5_coverage_gate(spark, sf):
    """Estimated against counted coverage on the last three committed days, for the bands that are linear in their deviations."""
    minutes, _, _, days, _, history = _history(spark, sf)
    last = days.select("day").distinct().orderBy(F.desc("day")).limit(3)
    tests = stored(history.join(F.broadcast(last), "day", "left_semi").select(*history.columns), "tests")  # three rows
    keys = tests.select("service", "key", "day", "hour")
    trained, older = N.training(history, keys, days), N.training(history, keys, days, True)
    bands = G.linear_bands(N.sigma_band(trained, 1.0), "sigma").unionByName(G.linear_bands(N.median_band(trained, 1.0), "median")).unionByName(G.linear_bands(N.ewma_band(older, 1.0), "ewma"))
    counted = G.outside(tests, minutes, bands, G.key_kinds(history, tests), _floor())
    return G.coverage_gate(counted).withColumn("gap", F.round("gap", 6))
