"""Registered queries over the log tables, each with the SQL that checks it.

Rates of the driver's events are low, so ticks are hours here and detection uses a floor of 2; the operators' defaults
stay one minute and 5.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import baseline as B
from ..operators import counts as C
from ..operators import detect as D
from ..operators import lab as L
from ..operators import links as K
from ..sources import driver_tables as S
from ..sources.shared import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- SQL that several checks share

FLOOR = 2
CLASS = "CASE WHEN level IN ('ERROR', 'FATAL', 'CRITICAL') THEN 'error' WHEN level IN ('WARN', 'WARNING') THEN 'warn' ELSE 'info' END"
KEYED = f"keyed AS (SELECT *, unnest([template, '*total', '*' || {CLASS}]) AS key FROM lines)"
MINUTES = f"{S.LINES_SQL}, {KEYED}, minutes AS (SELECT service, key, lts::DATE AS day, hour(lts)::INT AS hour, floor(epoch(lts) / 60)::BIGINT AS minute, count(*) AS n FROM keyed GROUP BY ALL)"
TICKS = f"{S.LINES_SQL}, {KEYED}, ticks AS (SELECT service, key, floor(epoch(lts) / 3600)::BIGINT AS tick, count(*) AS n FROM keyed GROUP BY ALL)"
ENDS = "ends AS (SELECT service, min(tick) AS a, max(tick) AS b FROM ticks GROUP BY service)"
DENSE = f"{TICKS}, {ENDS}, dense AS (SELECT k.service, k.key, k.tick, coalesce(t.n, 0) AS n FROM (SELECT d.service, d.key, unnest(generate_series(e.a, e.b)) AS tick FROM (SELECT DISTINCT service, key FROM ticks) d JOIN ends e USING (service)) k LEFT JOIN ticks t USING (service, key, tick))"
MOMENTS = f"{MINUTES}, moments AS (SELECT service, key, day, hour, sum(n)::BIGINT AS sum, sum(n * n)::BIGINT AS sumsq FROM minutes GROUP BY ALL)"
HOURS = """bounds AS (SELECT service, floor(min(epoch(lts)) / 60)::BIGINT AS a, floor(max(epoch(lts)) / 60)::BIGINT AS b FROM lines GROUP BY service),
hours AS (SELECT service, (DATE '1970-01-01' + (h // 24)::INT)::DATE AS day, (h % 24)::INT AS hour, least(b, h * 60 + 59) - greatest(a, h * 60) + 1 AS n_minutes FROM (SELECT *, unnest(generate_series(a // 60, b // 60)) AS h FROM bounds))"""
DAYS = "days AS (SELECT DISTINCT service, day, CASE WHEN isodow(day) >= 6 THEN 'weekend' ELSE 'weekday' END AS daytype FROM hours WHERE day < (SELECT max(day) FROM hours))"
PICKED = "picked AS (SELECT service, day, daytype FROM (SELECT *, row_number() OVER (PARTITION BY service, daytype ORDER BY day DESC) AS rn FROM days) WHERE rn <= CASE daytype WHEN 'weekday' THEN 5 ELSE 4 END)"
USABLE = "usable AS (SELECT h.*, p.daytype FROM hours h JOIN picked p USING (service, day) WHERE h.n_minutes > 0 AND NOT EXISTS (SELECT 1 FROM exclusions x WHERE x.decision = 'exclude' AND x.service = h.service AND x.day = h.day AND h.hour >= x.hour_from AND h.hour < x.hour_to))"
BASE = f"""{MOMENTS}, {HOURS}, {DAYS}, {PICKED}, {S.EXCLUSIONS_SQL}, {USABLE},
keys AS (SELECT DISTINCT m.service, m.key FROM moments m JOIN usable u USING (service, day, hour)),
born AS (SELECT service, key, min(day) AS born FROM moments WHERE key IN ('*warn', '*info') GROUP BY ALL),
baseline AS (SELECT k.service, k.key, u.daytype, u.hour, sum(coalesce(m.sum, 0))::DOUBLE / sum(u.n_minutes) AS mean,
  sqrt(greatest(sum(coalesce(m.sumsq, 0))::DOUBLE / sum(u.n_minutes) - (sum(coalesce(m.sum, 0))::DOUBLE / sum(u.n_minutes)) ** 2, 0)) AS std, count(*) AS days
  FROM keys k JOIN usable u ON u.service = k.service LEFT JOIN born b ON b.service = k.service AND b.key = k.key
  LEFT JOIN moments m ON m.service = k.service AND m.key = k.key AND m.day = u.day AND m.hour = u.hour
  WHERE b.born IS NULL OR u.day >= b.born GROUP BY ALL)"""
#: Sigmas of the bands of hourly ticks: few of these tables' hours leave a wider one.
TICK_SIGMAS = (0.5, 0.75)
FLAGGED = f"""{DENSE}, {S.EXCLUSIONS_SQL.replace('exclusions AS', 't_out AS', 1)},
t_rows AS (SELECT *, (DATE '1970-01-01' + (tick // 24)::INT)::DATE AS day, (tick % 24)::INT AS hour FROM dense),
t_days AS (SELECT DISTINCT service, day, CASE WHEN isodow(day) >= 6 THEN 'weekend' ELSE 'weekday' END AS daytype FROM t_rows WHERE day < (SELECT max(day) FROM t_rows)),
t_picked AS (SELECT service, day, daytype FROM (SELECT *, row_number() OVER (PARTITION BY service, daytype ORDER BY day DESC) AS rn FROM t_days) WHERE rn <= CASE daytype WHEN 'weekday' THEN 5 ELSE 4 END),
t_used AS (SELECT r.*, p.daytype FROM t_rows r JOIN t_picked p USING (service, day) WHERE NOT EXISTS (SELECT 1 FROM t_out x WHERE x.decision = 'exclude' AND x.service = r.service AND x.day = r.day AND r.hour >= x.hour_from AND r.hour < x.hour_to)),
t_base AS (SELECT service, key, daytype, hour, avg(n) AS mean, sqrt(greatest(avg(n * n) - avg(n) * avg(n), 0)) AS std FROM t_used WHERE (service, key) IN (SELECT (service, key) FROM t_used WHERE n > 0) GROUP BY ALL),
t_per AS (SELECT service, count(*) FILTER (daytype = 'weekend') AS we, count(*) FILTER (daytype = 'weekday') AS wd FROM t_picked GROUP BY service),
t_own AS (SELECT r.*, isodow(r.day) >= 6 AND coalesce(p.we, 0) < 2 AS upper_only, CASE WHEN isodow(r.day) >= 6 AND coalesce(p.we, 0) >= 2 THEN 'weekend' ELSE 'weekday' END AS daytype,
  coalesce(CASE WHEN isodow(r.day) >= 6 AND p.we >= 2 THEN p.we ELSE p.wd END, 0) AS pd, CASE WHEN key = '*error' OR key LIKE '%:error' OR key LIKE '%:signup' THEN {FLOOR} END AS floor FROM t_rows r LEFT JOIN t_per p USING (service) WHERE key NOT IN ('*warn', '*info')),
t_band AS (SELECT o.*, a.mean, greatest(a.mean + k * a.std, b.mean + k * b.std) AS top, least(a.mean - k * a.std, b.mean - k * b.std) AS low FROM (SELECT *, CASE WHEN pd >= 3 THEN {TICK_SIGMAS[0]} ELSE {TICK_SIGMAS[1]} END AS k FROM t_own) o
  LEFT JOIN t_base a ON a.service = o.service AND a.key = o.key AND a.daytype = o.daytype AND a.hour = o.hour LEFT JOIN t_base b ON b.service = o.service AND b.key = o.key AND b.daytype = o.daytype AND b.hour = (o.hour + 1) % 24),
flagged AS (SELECT service, key, tick, n, CASE WHEN top IS NULL THEN coalesce(n >= floor, false) ELSE coalesce(n > top AND n >= floor, false) OR coalesce(key = '*total' AND NOT upper_only AND pd >= 3 AND mean >= 20 AND n < low, false) END AS high FROM t_band)"""
STATED = f"""{FLAGGED},
isl AS (SELECT *, row_number() OVER (PARTITION BY service, key ORDER BY tick) - row_number() OVER (PARTITION BY service, key, high ORDER BY tick) AS g FROM flagged),
run AS (SELECT *, row_number() OVER (PARTITION BY service, key, high, g ORDER BY tick) AS r FROM isl),
mark AS (SELECT *, max(CASE WHEN high AND r >= 3 THEN tick END) OVER w AS on_at, max(CASE WHEN NOT high AND r >= 3 THEN tick END) OVER w AS off_at FROM run WINDOW w AS (PARTITION BY service, key ORDER BY tick)),
stated AS (SELECT service, key, tick, n, high, CASE WHEN coalesce(on_at > coalesce(off_at, -1), false) THEN CASE WHEN high THEN 'ALERTING' ELSE 'COOLING' END
  WHEN high AND r >= 2 THEN 'WARMING' ELSE 'NORMAL' END AS state FROM mark)"""
CHANGED = f"""{STATED},
changed AS (SELECT service, key, tick + 1 AS at, from_state, state AS to_state FROM (SELECT *, coalesce(lag(state) OVER (PARTITION BY service, key ORDER BY tick), 'NORMAL') AS from_state FROM stated) WHERE from_state <> state)"""
LAST = "(SELECT max(tick) + 1 FROM ticks)"
PERIODS = f"""{CHANGED},
edges AS (SELECT c.*, c.to_state <> 'NORMAL' AS inside, coalesce(lag(c.to_state <> 'NORMAL') OVER (PARTITION BY c.service, c.key ORDER BY c.at), false) AS was_in FROM changed c),
periods AS (SELECT p.service, p.key, p.at AS start, p."end" FROM (SELECT e.*, coalesce(lead(e.at) OVER (PARTITION BY e.service, e.key ORDER BY e.at), {LAST}) AS "end" FROM edges e WHERE e.inside <> e.was_in) p WHERE p.inside)"""


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return S.lines(spark, sf)


def _dense(spark: SparkSession, sf: str) -> DataFrame:
    return C.dense_ticks(C.tick_counts(_lines(spark, sf)))


def _days(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Hours, committed days (today is the last day there is) and exclusions; hours are written once."""
    hours = stored(C.service_hours(_lines(spark, sf)), "hours")
    today = hours.agg(F.max("day").alias("today"))
    # one row: the last day
    return hours, B.mark_days(hours.join(F.broadcast(today)), F.col("today")), S.exclusions(spark)


def _parts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Moments, hours, committed days and exclusions.

    Moments and hours are tables of the data model: they are written once, and no later step scans the lines for them.
    """
    return stored(C.hourly_moments(C.minute_counts(_lines(spark, sf))), "moments"), *_days(spark, sf)


def _baseline(spark: SparkSession, sf: str) -> DataFrame:
    return B.rebuild(*_parts(spark, sf))


def _judged_ticks(spark: SparkSession, sf: str, altered: Callable[[DataFrame], DataFrame] = lambda dense: dense) -> DataFrame:
    """Dense hourly ticks of all keys but the view-only ones, judged against the baseline of the ticks themselves."""
    dense = altered(C.dense_ticks(stored(C.tick_counts(_lines(spark, sf)), "ticks")))
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("tick") / 24).cast("int"))
    dense = stored(dense.withColumn("day", day).withColumn("hour", (F.col("tick") % 24).cast("int")), "dense")
    hours = dense.filter("key = '*total'").select("service", "day", "hour", F.lit(1).alias("n_minutes"))
    # one row: the last day
    days = B.mark_days(hours.join(F.broadcast(hours.agg(F.max("day").alias("today")))), F.col("today"))
    moments = dense.filter("n > 0").select("service", "key", "day", "hour", F.col("n").alias("sum"), (F.col("n") * F.col("n")).alias("sumsq"))
    rows = B.lookups(dense.filter("key NOT IN ('*warn', '*info')"), B.rebuild(moments, hours, days, S.exclusions(spark)), days)
    key = F.col("key")
    return B.judged(rows, F.when((key == "*error") | key.endswith(":error") | key.endswith(":signup") | key.startswith("doc:"), FLOOR), sigmas=TICK_SIGMAS)


def _stated(spark: SparkSession, sf: str, altered: Callable[[DataFrame], DataFrame] = lambda dense: dense) -> DataFrame:
    return D.states(_judged_ticks(spark, sf, altered).select("service", "key", "tick", "n", "high"), ["service", "key"])


def _changed(spark: SparkSession, sf: str) -> DataFrame:
    return D.changes(_stated(spark, sf), ["service", "key"]).select("service", "key", "at", "from_state", "to_state")


def _periods(spark: SparkSession, sf: str) -> DataFrame:
    now = _lines(spark, sf).agg((F.max(S.tick_number()) + 1).alias("now"))
    # one row: the last tick
    return stored(D.periods(_changed(spark, sf).join(F.broadcast(now)), ["service", "key"], F.col("now")), "periods")


# ---- sources


@query(f"WITH {S.LINES_SQL} SELECT event_id, ts, service, level FROM lines WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12' AND level = 'ERROR'")
def s1_range_scan(spark, sf):
    t = F.col("ts")
    return _lines(spark, sf).filter(t.between(F.lit("2024-01-10").cast("timestamp_ntz"), F.lit("2024-01-12").cast("timestamp_ntz")) & (F.col("level") == "ERROR")).select("event_id", "ts", "service", "level")


@query(f"WITH {S.LINES_SQL} SELECT count(*) AS n, min(ts) AS oldest FROM lines WHERE service = 'svc1'")
def s2_s3_count_and_oldest(spark, sf):
    return _lines(spark, sf).filter("service = 'svc1'").agg(F.count("*").alias("n"), F.min("ts").alias("oldest"))


@query("SELECT p AS pattern, count(*) AS n FROM (SELECT CASE WHEN event_type LIKE 'p%' THEN 'p*' WHEN event_type LIKE '%c%' THEN '*c*' WHEN event_type <> 'view' THEN '*' END AS p FROM events) WHERE p IS NOT NULL GROUP BY p")
def s5_first_pattern(spark, sf):
    e = F.col("event_type")
    first = F.when(e.startswith("p"), "p*").when(e.contains("c"), "*c*").when(e != "view", "*")
    return S.table(spark, sf, "events").select(first.alias("pattern")).filter("pattern IS NOT NULL").groupBy("pattern").agg(F.count("*").alias("n"))


DOC_ROWS = [("error", "DOC-001"), ("signup", "DOC-001"), ("purchase", "DOC-002")]
DOC_LINKS = "links AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in DOC_ROWS) + ") v(suffix, doc))"


@query(f"""WITH {STATED}, {DOC_LINKS}, now AS (SELECT s.service, coalesce(l.doc, s.key) AS key, s.state FROM stated s LEFT JOIN links l ON s.key = s.service || ':' || l.suffix WHERE s.tick = (SELECT max(tick) - 200 FROM stated)),
worst AS (SELECT service, key, arg_max(state, CASE state WHEN 'ALERTING' THEN 3 WHEN 'WARMING' THEN 2 WHEN 'COOLING' THEN 1 ELSE 0 END) AS worst FROM now GROUP BY ALL) SELECT service, key, s.state, (worst = s.state)::INT AS "on" FROM worst, (VALUES ('NORMAL'), ('COOLING'), ('WARMING'), ('ALERTING')) s(state)""")
def s12_export(spark, sf):
    """The states that keys have at a time, as one 0/1 row for each; a document's is the worst of its templates'."""
    stated = stored(_stated(spark, sf), "stated")
    at = stated.agg((F.max("tick") - 200).alias("tick"))
    links = spark.createDataFrame(DOC_ROWS, "suffix string, doc string")
    # one row, and the rows of a fixed list
    now = stated.join(F.broadcast(at), "tick", "left_semi").withColumn("suffix", F.element_at(F.split("key", ":"), -1)).join(F.broadcast(links), "suffix", "left")
    linked = F.col("key").contains(":") & F.col("doc").isNotNull()
    return D.exported(now.select("service", F.when(linked, F.col("doc")).otherwise(F.col("key")).alias("key"), "state"))


@query(f"""WITH {MOMENTS}, {HOURS}, per AS (SELECT m.service, m.key, m.hour, sum(m.sum)::DOUBLE / sum(h.n_minutes) AS mean FROM moments m JOIN hours h USING (service, day, hour) WHERE m.sum > 0 AND h.n_minutes >= 30 GROUP BY ALL),
whole AS (SELECT service, key, avg(mean) AS mean FROM per GROUP BY ALL), grid AS (SELECT service, key, unnest(generate_series(0, 23))::INT AS hour FROM whole)
SELECT g.service, g.key, g.hour, round(coalesce(a.mean, b.mean, w.mean), 9) AS mean FROM grid g JOIN whole w USING (service, key) LEFT JOIN per a USING (service, key, hour) LEFT JOIN per b ON b.service = g.service AND b.key = g.key AND b.hour = 23 - g.hour""")
def s15_world(spark, sf):
    """Mean rates by hour of day; a gap takes the mirrored hour's, then the key's own."""
    moments, hours, _, _ = _parts(spark, sf)
    rows = moments.join(hours.filter("n_minutes >= 30"), ["service", "day", "hour"]).filter(F.col("sum") > 0)
    per = rows.groupBy("service", "key", "hour").agg((F.sum("sum") / F.sum("n_minutes")).alias("mean"))
    whole = per.groupBy("service", "key").agg(F.avg("mean").alias("whole"))
    grid = whole.withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23))))
    mirrored = per.select("service", "key", (23 - F.col("hour")).alias("hour"), F.col("mean").alias("mirrored"))
    on = ["service", "key", "hour"]
    return grid.join(per, on, "left").join(mirrored, on, "left").select(*on, F.round(F.coalesce("mean", "mirrored", "whole"), 9).alias("mean"))


# ---- counting


@query(f"WITH {S.LINES_SQL} SELECT service, template, level, module, floor(epoch(lts) / 60)::BIGINT AS minute, count(*) AS n, min(event_id) AS sample FROM lines GROUP BY ALL")
def a1_partial_counts(spark, sf):
    return C.partial_counts(_lines(spark, sf))


@query(f"WITH {MINUTES} SELECT * FROM minutes")
def a2_fan_out(spark, sf):
    return C.minute_counts(_lines(spark, sf))


@query(f"WITH {S.LINES_SQL} SELECT service, template, module, floor(epoch(lts) / 60)::BIGINT AS minute, count(*) AS n FROM lines GROUP BY ALL")
def a3_module_counts(spark, sf):
    return C.module_counts(_lines(spark, sf))


@query(f"WITH {MOMENTS} SELECT * FROM moments")
def a4_hourly_moments(spark, sf):
    return C.hourly_moments(C.minute_counts(_lines(spark, sf)))


@query(f"WITH {MOMENTS} SELECT * FROM moments")
def a5_merged_moments(spark, sf):
    """Moments of two halves of the minutes, merged, are those of the whole."""
    minutes = C.minute_counts(_lines(spark, sf))
    return C.merged_moments(C.hourly_moments(minutes.filter("minute % 2 = 0")), C.hourly_moments(minutes.filter("minute % 2 = 1")))


@query(f"WITH {MINUTES} SELECT service, key, day, hour, (minute % 60)::INT AS slot, n::INT AS n FROM minutes")
def a6_minute_arrays(spark, sf):
    """Counts packed into arrays of 60 and unpacked again."""
    return C.array_minutes(C.minute_arrays(C.minute_counts(_lines(spark, sf))))


@query(f"WITH {BASE} SELECT service, key, daytype, hour, round(mean, 9) AS mean, round(std, 9) AS std, days FROM baseline")
def a7_baseline_rebuild(spark, sf):
    return _baseline(spark, sf).withColumn("mean", F.round("mean", 9)).withColumn("std", F.round("std", 9))


@query(f"WITH {S.LINES_SQL}, {HOURS}, {DAYS} SELECT * FROM days")
def a8_mark_days(spark, sf):
    return _days(spark, sf)[1]


@query(f"WITH {S.LINES_SQL} SELECT service, count(*) FILTER (level = 'ERROR') AS errors, count(*) FILTER (level <> 'ERROR' AND value > 50) AS large, count(DISTINCT user_id) AS users, round(avg(value), 6) AS mean FROM lines GROUP BY service HAVING count(DISTINCT user_id) > 1")
def a9_a10_filtered_aggregates(spark, sf):
    out = _lines(spark, sf).groupBy("service").agg(F.count_if(F.col("level") == "ERROR").alias("errors"), F.count_if((F.col("level") != "ERROR") & (F.col("value") > 50)).alias("large"), F.countDistinct("user_id").alias("users"), F.round(F.avg("value"), 6).alias("mean"))
    return out.filter("users > 1")


@query(f"WITH {S.LINES_SQL} SELECT service, module, round(median(value), 6) AS mid, round(quantile_cont(value, 0.9), 6) AS p90 FROM lines GROUP BY ALL")
def a14_a15_percentiles(spark, sf):
    return _lines(spark, sf).groupBy("service", "module").agg(F.round(F.median("value"), 6).alias("mid"), F.round(F.percentile("value", F.lit(0.9)), 6).alias("p90"))


@query(f"""WITH {S.LINES_SQL}, t AS (SELECT service, floor(epoch(lts) / 3600)::BIGINT AS tick, count(*) AS n FROM lines GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY service ORDER BY tick DESC) AS rn FROM t)
SELECT service, arg_max(n, tick) AS last, round(avg(n) FILTER (rn <= 15), 6) AS mean_15, arg_max(n, tick) - max(n) FILTER (rn = 25) AS change FROM r GROUP BY service""")
def a21_throughput(spark, sf):
    return C.throughput(_lines(spark, sf))


@query(f"""WITH {S.LINES_SQL}, w AS (SELECT *, unnest(generate_series(0, 3)) AS i FROM lines)
SELECT service, time_bucket(INTERVAL 15 MINUTE, ts) - i * INTERVAL 15 MINUTE AS start, count(*) AS n, round(count(*) FILTER (level = 'ERROR') / count(*), 9) AS ratio FROM w GROUP BY ALL""")
def a22_sliding_rates(spark, sf):
    return C.sliding_rates(_lines(spark, sf))


@query(f"""WITH {S.LINES_SQL}, l AS (SELECT *, floor(epoch(lts) / 60)::BIGINT AS m FROM lines), f AS (SELECT *, max(m) OVER (PARTITION BY service ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM l)
SELECT service, CASE WHEN module IS NULL THEN 'malformed' WHEN m < newest - 15 THEN 'late' ELSE 'counted' END AS fate, count(*) AS n FROM f GROUP BY ALL""")
def a23_rejected(spark, sf):
    return C.rejected(_lines(spark, sf))


@query(f"WITH {S.LINES_SQL} SELECT service, template, min(ts) AS first_seen, max(ts) AS last_seen, arg_max(level, CASE level WHEN 'ERROR' THEN 3 WHEN 'WARN' THEN 2 ELSE 1 END) AS level, count(*) AS n FROM lines GROUP BY ALL")
def l2_template_dimension(spark, sf):
    return C.template_dimension(_lines(spark, sf))


@query(f"""WITH {MINUTES}, f AS (SELECT service, key, day, hour, min(minute) AS first FROM minutes WHERE key NOT LIKE '*%' GROUP BY ALL), span AS (SELECT service, min(minute) AS a FROM minutes GROUP BY service),
g AS (SELECT service, key, day, hour, unnest(generate_series(first, first // 60 * 60 + 59)) AS minute FROM f
  UNION ALL SELECT service, key, (DATE '1970-01-01' + (minute // 1440)::INT)::DATE, (minute // 60 % 24)::INT, minute FROM (SELECT service, unnest(generate_series(a, (SELECT max(minute) FROM minutes))) AS minute FROM span), (VALUES ('*total'), ('*error'), ('*warn'), ('*info')) v(key))
SELECT g.service, g.key, g.day, g.hour, g.minute, coalesce(m.n, 0) AS n FROM g LEFT JOIN minutes m USING (service, key, day, hour, minute)""")
def x4_zero_fill(spark, sf):
    return C.zero_filled(C.minute_counts(_lines(spark, sf)))


# ---- baseline and detection


@query(f"WITH {S.LINES_SQL}, {HOURS}, {DAYS}, {PICKED} SELECT * FROM picked")
def w1_picked_days(spark, sf):
    return B.picked_days(_days(spark, sf)[1])


@query(f"WITH {S.LINES_SQL}, {HOURS}, {DAYS}, {PICKED}, {S.EXCLUSIONS_SQL}, {USABLE} SELECT service, daytype, hour, count(*) AS days, count(*) < 3 AS few FROM usable GROUP BY ALL")
def d3_usable_days(spark, sf):
    hours, days, out = _days(spark, sf)
    return B.usable_days(hours, days, out)


JUDGED = f"""{BASE}, committed AS (SELECT service, daytype, least(count(*), CASE daytype WHEN 'weekday' THEN 5 ELSE 4 END) AS n FROM days GROUP BY service, daytype),
per AS (SELECT service, coalesce(max(n) FILTER (daytype = 'weekend'), 0) AS we, coalesce(max(n) FILTER (daytype = 'weekday'), 0) AS wd FROM committed GROUP BY service),
own AS (SELECT m.*, CASE WHEN isodow(m.day) >= 6 AND coalesce(p.we, 0) >= 2 THEN 'weekend' ELSE 'weekday' END AS daytype, isodow(m.day) >= 6 AND coalesce(p.we, 0) < 2 AS upper_only,
  coalesce(CASE WHEN isodow(m.day) >= 6 AND p.we >= 2 THEN p.we ELSE p.wd END, 0) AS pd FROM minutes m LEFT JOIN per p USING (service)),
looked AS (SELECT o.*, a.mean, a.std, b.mean AS next_mean, b.std AS next_std, CASE WHEN o.pd >= 3 THEN 3.0 ELSE 4.0 END AS k,
  CASE WHEN o.key = '*error' OR o.key LIKE '%:error' THEN 2 WHEN o.key = '*warn' OR o.key LIKE '%:signup' THEN 2 END AS floor
  FROM own o LEFT JOIN baseline a ON a.service = o.service AND a.key = o.key AND a.daytype = o.daytype AND a.hour = o.hour
  LEFT JOIN baseline b ON b.service = o.service AND b.key = o.key AND b.daytype = o.daytype AND b.hour = (o.hour + 1) % 24),
banded AS (SELECT *, greatest(mean + k * std, next_mean + k * next_std) AS band_high, least(mean - k * std, next_mean - k * next_std) AS band_low FROM looked)"""


DENSE_JUDGED = JUDGED.replace("own AS (SELECT m.*,", """span AS (SELECT service, min(minute) AS a, max(minute) AS b FROM minutes GROUP BY service), present AS (SELECT DISTINCT service, key FROM minutes),
whole AS (SELECT p.service, p.key, unnest(generate_series(s.a, s.b)) AS minute FROM present p JOIN span s USING (service)),
every AS (SELECT w.service, w.key, w.minute, (DATE '1970-01-01' + (w.minute // 1440)::INT)::DATE AS day, (w.minute // 60 % 24)::INT AS hour, coalesce(m.n, 0) AS n FROM whole w LEFT JOIN minutes m USING (service, key, minute)),
own AS (SELECT m.*,""").replace("FROM minutes m LEFT JOIN per p USING (service)", "FROM every m LEFT JOIN per p USING (service)")


@query(f"""WITH {DENSE_JUDGED}, j AS (SELECT *, coalesce(key = '*total' AND NOT upper_only AND pd >= 3 AND mean >= 20 AND n < band_low, false) AS "drop" FROM banded)
SELECT service, key, day, hour, count(*) AS minutes, sum(n)::BIGINT AS n, round(max(band_high), 6) AS band_high, round(min(band_low), 6) AS band_low, count(*) FILTER ("drop") AS drops,
count(*) FILTER ("drop" OR CASE WHEN band_high IS NULL THEN coalesce(n >= floor, false) ELSE coalesce(n > band_high AND n >= floor, false) END) AS high,
round(max(CASE WHEN band_high IS NULL THEN coalesce(n / floor, 0) WHEN band_high > 0 THEN n / band_high ELSE (n > 0)::INT END), 6) AS score FROM j GROUP BY ALL""")
def d1_d2_judged_minutes(spark, sf):
    """Every minute of each key from its service's first line to its last judged, silent ones too, and summed up by hour."""
    moments, hours, days, out = _parts(spark, sf)
    minutes = C.dense_minutes(stored(C.minute_counts(_lines(spark, sf)), "minutes"))
    rows = B.lookups(minutes, stored(B.rebuild(moments, hours, days, out), "baseline"), days)
    key = F.col("key")
    floor = F.when((key == "*error") | key.endswith(":error") | (key == "*warn") | key.endswith(":signup"), 2)
    rows = B.judged(rows, floor)
    per = rows.groupBy("service", "key", "day", "hour").agg(F.count("*").alias("minutes"), F.sum("n").alias("n"), F.round(F.max("band_high"), 6).alias("band_high"), F.round(F.min("band_low"), 6).alias("band_low"), F.count_if("dropped").alias("drops"), F.count_if("high").alias("high"), F.round(F.max("score"), 6).alias("score"))
    return per


@query(f"WITH {STATED} SELECT service, key, tick, n, high, state FROM stated")
def x6_hysteresis(spark, sf):
    return _stated(spark, sf).select("service", "key", "tick", "n", "high", "state")


@query(f"WITH {CHANGED} SELECT * FROM changed")
def x7_changes(spark, sf):
    return _changed(spark, sf)


@query(f"""WITH {BASE}, {DOC_LINKS}, t AS (SELECT m.service, l.doc, m.minute, m.day, m.hour, sum(m.n)::BIGINT AS n FROM minutes m JOIN links l ON m.key = m.service || ':' || l.suffix GROUP BY ALL),
b AS (SELECT b.service, l.doc, b.daytype, b.hour, sum(mean) AS mean, sum(std) AS std FROM baseline b JOIN links l ON b.key = b.service || ':' || l.suffix GROUP BY ALL)
SELECT t.service, 'doc:' || t.doc AS key, t.minute, t.n, round(b.mean + 3 * b.std, 6) AS band_high FROM t LEFT JOIN b ON b.service = t.service AND b.doc = t.doc AND b.hour = t.hour AND b.daytype = CASE WHEN isodow(t.day) >= 6 THEN 'weekend' ELSE 'weekday' END""")
def x8_document_keys(spark, sf):
    """A document's count is that of its templates; its band sums their means and deviations."""
    links = F.broadcast(spark.createDataFrame([("error", "DOC-001"), ("signup", "DOC-001"), ("purchase", "DOC-002")], "suffix string, doc string"))
    suffix = F.element_at(F.split("key", ":"), -1)
    counts = C.minute_counts(_lines(spark, sf)).filter(F.col("key").contains(":")).withColumn("suffix", suffix).join(links, "suffix")
    counts = counts.groupBy("service", "doc", "minute", "day", "hour").agg(F.sum("n").alias("n")).withColumn("daytype", B.daytype(F.col("day")))
    base = _baseline(spark, sf).filter(F.col("key").contains(":")).withColumn("suffix", suffix).join(links, "suffix")
    base = base.groupBy("service", "doc", "daytype", "hour").agg(F.sum("mean").alias("mean"), F.sum("std").alias("std"))
    rows = counts.join(base, ["service", "doc", "daytype", "hour"], "left")
    return rows.select("service", F.concat(F.lit("doc:"), "doc").alias("key"), "minute", "n", F.round(F.col("mean") + 3 * F.col("std"), 6).alias("band_high"))


# ---- periods and review


@query(f"WITH {PERIODS} SELECT * FROM periods")
def d8_periods(spark, sf):
    return _periods(spark, sf)


@query(f"""WITH {PERIODS}, {S.EXCLUSIONS_SQL}, h AS (SELECT DISTINCT service, key, unnest(generate_series(start, greatest("end", start + 1) - 1)) AS h FROM periods),
c AS (SELECT service, key, (DATE '1970-01-01' + (h // 24)::INT)::DATE AS day, (h % 24)::INT AS hour FROM h),
l AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM exclusions x WHERE x.service = c.service AND x.day = c.day AND c.hour >= x.hour_from AND c.hour < x.hour_to)),
i AS (SELECT *, hour - dense_rank() OVER (PARTITION BY service, day ORDER BY hour) AS g FROM l)
SELECT service, day, min(hour)::INT AS hour_from, (max(hour) + 1)::INT AS hour_to, string_agg(DISTINCT key, ',' ORDER BY key) AS keys FROM i GROUP BY service, day, g""")
def d9_suggestions(spark, sf):
    return D.suggestions(_periods(spark, sf), S.exclusions(spark))


@query(f"""WITH {PERIODS}, h AS (SELECT DISTINCT service, unnest(generate_series(start, "end" - 1)) AS h FROM periods)
SELECT service, (DATE '1970-01-01' + (h // 24)::INT)::DATE AS day, count(*)::BIGINT AS covered FROM h GROUP BY ALL""")
def u4_covered_hours(spark, sf):
    return D.covered(_periods(spark, sf), ["service"])


@query(f"""WITH {CHANGED}, lo AS (SELECT min(c.at) + 200 AS lo FROM changed c), before AS (SELECT c.service, c.key, max(c.at) AS at, arg_max(c.to_state, c.at) AS to_state FROM changed c, lo WHERE c.at < lo.lo GROUP BY c.service, c.key)
SELECT b.service, b.key, b.at, b.to_state FROM before b UNION ALL SELECT c.service, c.key, c.at, c.to_state FROM changed c, lo WHERE c.at >= lo.lo AND c.at < lo.lo + 100""")
def j14_u2_as_of(spark, sf):
    """The latest change of each key before a time, and all within a window after it."""
    rows = stored(_changed(spark, sf), "changes")
    rows = rows.join(F.broadcast(rows.agg((F.min("at") + 200).alias("lo"))))  # one row
    before = rows.filter("at < lo").groupBy("service", "key").agg(F.max("at").alias("at"), F.max_by("to_state", "at").alias("to_state"))
    return before.unionByName(rows.filter("at >= lo AND at < lo + 100").select("service", "key", "at", "to_state"))


@query(f"""WITH {PERIODS} SELECT a.service, a.key, a.start, b.key AS other_key, b.start AS other_start FROM periods a JOIN periods b ON a.service = b.service AND a.start < b."end" AND b.start < a."end" AND a.key < b.key""")
def j13_overlaps(spark, sf):
    spans = _periods(spark, sf)
    pairs = D.joined_intervals(spans, spans.withColumnRenamed("key", "other_key"), ["service"])
    return pairs.filter("key < other_key").select("service", "key", "start", "other_key", "other_start")


#: The window of hours that module alerts are asked for.
WINDOW = (200, 500)


@query(f"""WITH {CHANGED}, lo AS (SELECT min(tick) + {WINDOW[0]} AS lo, min(tick) + {WINDOW[1]} AS hi FROM ticks),
e AS (SELECT x.*, x.to_state IN ('WARMING', 'ALERTING') AS inside, coalesce(lag(x.to_state IN ('WARMING', 'ALERTING')) OVER (PARTITION BY x.service, x.key ORDER BY x.at), false) AS was FROM changed x WHERE x.key NOT LIKE '*%'),
p AS (SELECT * FROM (SELECT x.service, x.key, x.inside, x.at - 1 - CASE WHEN x.from_state = 'NORMAL' AND x.to_state = 'WARMING' THEN 1 ELSE 0 END AS a, coalesce(lead(x.at) OVER (PARTITION BY x.service, x.key ORDER BY x.at) - 1, (SELECT hi FROM lo)) AS b FROM e x WHERE x.inside <> x.was), lo WHERE inside AND a < hi AND b > lo),
al AS (SELECT DISTINCT service, key FROM (SELECT x.service, x.key, x.to_state, x.at - 1 AS a, coalesce(lead(x.at) OVER (PARTITION BY x.service, x.key ORDER BY x.at) - 1, (SELECT hi FROM lo)) AS b FROM changed x), lo WHERE to_state = 'ALERTING' AND a < hi AND b > lo),
h AS (SELECT service, key, unnest(generate_series(greatest(a, lo), least(b, hi) - 1)) AS tick FROM p),
m AS (SELECT service, template AS key, module, floor(epoch(lts) / 3600)::BIGINT AS tick, count(*) AS n FROM lines GROUP BY ALL),
w AS (SELECT service, key, sum(n)::BIGINT AS total, max(n) AS peak FROM (SELECT service, key, tick, sum(n)::BIGINT AS n FROM m JOIN h USING (service, key, tick) GROUP BY ALL) GROUP BY ALL),
c AS (SELECT service, key, count(*) AS ticks FROM h GROUP BY ALL)
SELECT m.service, m.key, m.module, max(c.ticks) AS ticks, sum(m.n)::BIGINT AS total, max(m.n) AS peak, round(sum(m.n) / max(c.ticks), 6) AS mean, max(w.total) AS template_total, max(w.peak) AS template_peak, CASE WHEN max(al.key) IS NULL THEN 'WARMING' ELSE 'ALERTING' END AS peak_state
FROM m JOIN h USING (service, key, tick) JOIN w USING (service, key) JOIN c USING (service, key) LEFT JOIN al ON al.service = m.service AND al.key = m.key GROUP BY m.service, m.key, m.module""")
def d11_j15_module_alerts(spark, sf):
    """Lines of each module while their template warms or alerts, within a window of hours."""
    lines = _lines(spark, sf)
    first = lines.agg(F.min(S.tick_number())).first()[0] or 0
    per = lines.groupBy("service", F.col("template").alias("key"), "module", S.tick_number().alias("tick")).agg(F.count("*").alias("n"))
    changed = stored(_changed(spark, sf).filter("key NOT LIKE '*%'"), "changes")
    out = D.module_alerts(changed, per, first + WINDOW[0], first + WINDOW[1])
    return out.withColumn("mean", F.round("mean", 6))


ALERT_LINKS = [("svc0", "svc0:purchase", "DOC-002"), ("svc2", "svc2:signup", "DOC-001")]
ALERT_EDGES = [("svc0:error", "svc0:signup"), ("svc1:signup", "svc1:error"), ("svc2:signup", "svc2:error")]


@query(f"""WITH {STATED}, linked AS (SELECT * FROM (VALUES ('svc0', 'svc0:purchase', 'DOC-002'), ('svc2', 'svc2:signup', 'DOC-001')) v(service, key, doc)), roots AS (SELECT * FROM (VALUES ('svc0:signup', 'svc0:error'), ('svc1:signup', 'svc1:error')) v(key, root)),
m AS (SELECT *, max(CASE WHEN state <> prev THEN tick + 1 END) OVER (PARTITION BY service, key ORDER BY tick) AS since FROM (SELECT *, coalesce(lag(state) OVER (PARTITION BY service, key ORDER BY tick), 'NORMAL') AS prev FROM stated)),
g AS (SELECT m.*, CASE WHEN m.key LIKE '*%' THEN 'service' WHEN doc IS NOT NULL THEN 'document' ELSE 'template' END AS kind, CASE WHEN m.key LIKE '*%' THEN NULL ELSE coalesce(doc, root, m.key) END AS ident FROM m LEFT JOIN linked l USING (service, key) LEFT JOIN roots r ON r.key = m.key WHERE state <> 'NORMAL')
SELECT service, tick, CASE WHEN kind = 'template' AND count(*) > 1 THEN 'cluster' ELSE kind END AS kind, CASE WHEN kind = 'document' THEN ident END AS doc, arg_max(state, CASE state WHEN 'ALERTING' THEN 3 WHEN 'COOLING' THEN 2 ELSE 1 END) AS state, min(since) AS since, string_agg(key, ',' ORDER BY key) AS keys FROM g GROUP BY service, tick, kind, ident""")
def d12_alert_groups(spark, sf):
    """What an operator sees at each hour: groups of keys out of their band, by service, document, or cluster of templates."""
    stated = stored(_stated(spark, sf), "stated")
    links = spark.createDataFrame(ALERT_LINKS, "service string, key string, doc string")
    edges = spark.createDataFrame(ALERT_EDGES, "a string, b string").join(links.select(F.col("key").alias("a")), "a", "left_anti").join(links.select(F.col("key").alias("b")), "b", "left_anti")
    roots = K.clusters(stated.filter("key NOT LIKE '*%'").select(F.col("key").alias("id")).distinct(), edges)
    return D.alert_groups(stated, links, roots.select(F.col("id").alias("key"), F.col("cluster").alias("root")))


# ---- views


@query(f"""WITH {BASE} SELECT m.service, m.day, m.hour, m.sum, round(m.sum / h.n_minutes, 9) AS rate, round((m.sum / h.n_minutes - b.mean) / greatest(b.std, CASE WHEN b.mean > 0 THEN 1.0 ELSE 0 END), 6) AS z
FROM moments m JOIN hours h USING (service, day, hour) JOIN baseline b ON b.service = m.service AND b.key = m.key AND b.hour = m.hour AND b.daytype = CASE WHEN isodow(m.day) >= 6 THEN 'weekend' ELSE 'weekday' END WHERE m.key = '*total' AND b.mean > 0""")
def d4_m7_review_matrix(spark, sf):
    """Days by hours of a service: rate, and deviation in sigmas of at least 1."""
    moments, hours, days, out = _parts(spark, sf)
    base = B.rebuild(moments, hours, days, out).filter("key = '*total' AND mean > 0").drop("days")
    rows = moments.filter("key = '*total'").join(hours, ["service", "day", "hour"]).withColumn("daytype", B.daytype(F.col("day"))).join(base, ["service", "key", "daytype", "hour"])
    rate = F.col("sum") / F.col("n_minutes")
    return rows.select("service", "day", "hour", "sum", F.round(rate, 9).alias("rate"), F.round((rate - F.col("mean")) / F.greatest("std", F.lit(1.0)), 6).alias("z"))


@query(f"""WITH {MOMENTS}, r AS (SELECT service, key, day, hour, sum, row_number() OVER (PARTITION BY service, day ORDER BY sum DESC, hour, key) AS rn FROM moments WHERE key NOT LIKE '*%')
SELECT service, key, day, hour, sum FROM r WHERE rn <= 3""")
def d5_t2_top_contributors(spark, sf):
    order = Window.partitionBy("service", "day").orderBy(F.desc("sum"), "hour", "key")
    moments = C.hourly_moments(C.minute_counts(_lines(spark, sf))).filter(~F.col("key").startswith("*"))
    return moments.withColumn("rn", F.row_number().over(order)).filter("rn <= 3").select("service", "key", "day", "hour", "sum")


@query(f"""WITH {DENSE}, f AS (SELECT *, n > 8 AS out FROM dense WHERE key = '*total'), i AS (SELECT *, row_number() OVER (PARTITION BY service ORDER BY tick) - row_number() OVER (PARTITION BY service, out ORDER BY tick) AS g FROM f)
SELECT service, min(tick) AS start, max(tick) + 1 AS "end", max(n) AS peak FROM i WHERE out GROUP BY service, g""")
def d6_w7_incident_runs(spark, sf):
    """Contiguous hours above a limit, with their peak."""
    rows = _dense(spark, sf).filter("key = '*total'").withColumn("out", F.col("n") > 8)
    rows = D.runs(rows, ["service"], "tick", "out", "run").filter("out")
    return rows.groupBy("service", (F.col("tick") - F.col("run") + 1).alias("start")).agg((F.max("tick") + 1).alias("end"), F.max("n").alias("peak"))


@query(f"WITH {S.LINES_SQL} SELECT template, level, count(*) AS n, max(ts) AS last_seen FROM lines GROUP BY template, level ORDER BY CASE level WHEN 'ERROR' THEN 0 WHEN 'WARN' THEN 1 ELSE 2 END, last_seen DESC, template LIMIT 5 OFFSET 2")
def t1_p17_template_page(spark, sf):
    rank = F.when(F.col("level") == "ERROR", 0).when(F.col("level") == "WARN", 1).otherwise(2)
    rows = _lines(spark, sf).groupBy("template", "level").agg(F.count("*").alias("n"), F.max("ts").alias("last_seen"))
    return rows.orderBy(rank, F.desc("last_seen"), "template").offset(2).limit(5)


@query(f"""WITH {S.LINES_SQL}, r AS (SELECT service, template, event_id, row_number() OVER (PARTITION BY service, template ORDER BY ts DESC, event_id DESC) AS rn FROM lines) SELECT service, template, event_id, rn::INT AS rn FROM r WHERE rn <= 20""")
def w4_newest_samples(spark, sf):
    order = Window.partitionBy("service", "template").orderBy(F.desc("ts"), F.desc("event_id"))
    return _lines(spark, sf).withColumn("rn", F.row_number().over(order)).filter("rn <= 20").select("service", "template", "event_id", "rn")


@query(f"""WITH {S.LINES_SQL}, w AS (SELECT service, module, count(*) AS n, max(ts) AS last_seen, max(ts) >= TIMESTAMP '2024-01-30' AS recent FROM lines GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY service ORDER BY recent DESC, n DESC, last_seen DESC, module) AS rn FROM w) SELECT service, module, n, last_seen, rn::INT AS rn FROM r""")
def t6_module_list(spark, sf):
    per = _lines(spark, sf).groupBy("service", "module").agg(F.count("*").alias("n"), F.max("ts").alias("last_seen"))
    order = Window.partitionBy("service").orderBy(F.desc(F.col("last_seen") >= F.lit("2024-01-30").cast("timestamp_ntz")), F.desc("n"), F.desc("last_seen"), "module")
    return per.withColumn("rn", F.row_number().over(order))


@query(f"""WITH {DENSE} SELECT a.service, a.key, a.tick, a.n, b.n AS before FROM dense a JOIN dense b ON b.service = a.service AND b.key = a.key AND b.tick = a.tick - 168 WHERE a.key = '*total'""")
def j16_week_before(spark, sf):
    w = Window.partitionBy("service", "key").orderBy("tick")
    return _dense(spark, sf).filter("key = '*total'").withColumn("before", F.lag("n", 168).over(w)).filter("before IS NOT NULL")


@query("""WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND ts < TIMESTAMP '2024-01-15'), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-15')
SELECT 'coming' AS side, count(*) AS n FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT 'leaving', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'both', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)""")
def u3_set_differences(spark, sf):
    e = S.table(spark, sf, "events").filter("event_type = 'error'")
    cut = F.lit("2024-01-15").cast("timestamp_ntz")
    a, b = e.filter(F.col("ts") < cut).select("user_id").distinct(), e.filter(F.col("ts") >= cut).select("user_id").distinct()
    named = lambda df, side: df.agg(F.count("*").alias("n")).select(F.lit(side).alias("side"), "n")
    return named(b.subtract(a), "coming").unionByName(named(a.subtract(b), "leaving")).unionByName(named(a.intersect(b), "both"))


@query(f"""WITH {MINUTES}, m AS (SELECT service, key, hour, count(*) AS minutes, sum(n)::BIGINT AS n FROM minutes WHERE key NOT LIKE '*%' GROUP BY ALL), k AS (SELECT service, key, avg(n)::DOUBLE AS mean FROM m GROUP BY ALL)
SELECT service, key, CASE WHEN mean >= 20 THEN 'busy' ELSE 'sparse' END AS kind, round(mean, 6) AS mean FROM k""")
def p13_p14_kinds(spark, sf):
    """Busy and sparse keys by their mean over the hours with any line."""
    per = C.minute_counts(_lines(spark, sf)).filter(~F.col("key").startswith("*")).groupBy("service", "key", "hour").agg(F.sum("n").alias("n"))
    out = per.groupBy("service", "key").agg(F.avg("n").alias("mean"))
    return out.select("service", "key", F.when(F.col("mean") >= 20, "busy").otherwise("sparse").alias("kind"), F.round("mean", 6).alias("mean"))


# ---- lab


MAD = """e AS (SELECT *, tick % 24 AS h FROM dense), c AS (SELECT service, key, h, median(n)::DOUBLE AS c FROM e GROUP BY ALL), o AS (SELECT e.*, c.c, abs(e.n - c.c) AS off FROM e JOIN c USING (service, key, h)),
s AS (SELECT service, key, h, 1.4826 * median(off) AS mad FROM o GROUP BY ALL), mad AS (SELECT service, key, tick, n, c, round(mad, 9) AS mad, off > greatest(4 * mad, 1) AS high FROM o JOIN s USING (service, key, h))"""
WEEKLY = "weekly AS (SELECT a.service, a.key, a.tick, a.n, b.n AS before, a.n > 2 * b.n AND a.n >= 4 AS high FROM dense a JOIN dense b ON b.service = a.service AND b.key = a.key AND b.tick = a.tick - 168)"
#: One tick of all keys at a time.
CUSUM = """series AS MATERIALIZED (SELECT service, key, tick, n, greatest(avg(n) OVER (PARTITION BY service, key), 1e-9)::DOUBLE AS rate, row_number() OVER (PARTITION BY service, key ORDER BY tick) AS i FROM dense),
sums AS (SELECT service, key, tick, i, greatest(n * ln(1.5) - 0.5 * rate, 0)::DOUBLE AS s FROM series WHERE i = 1
    UNION ALL SELECT x.service, x.key, x.tick, x.i, greatest(CASE WHEN c.s > 5 THEN 0 ELSE c.s END + x.n * ln(1.5) - 0.5 * x.rate, 0)::DOUBLE FROM sums c JOIN series x ON x.service = c.service AND x.key = c.key AND x.i = c.i + 1),
cusum AS (SELECT service, key, tick, round(s, 6) AS score, s > 5 AS high FROM sums)"""


@query(f"WITH {DENSE}, {MAD} SELECT * FROM mad")
def b7_mad(spark, sf):
    return L.mad_band(_dense(spark, sf), 4.0).withColumn("mad", F.round("mad", 9))


@query(f"WITH {DENSE}, {WEEKLY} SELECT * FROM weekly")
def b7_weekly(spark, sf):
    return L.weekly(_dense(spark, sf), 2, 4)


@query(f"""WITH {STATED}, o AS (SELECT *, state <> 'NORMAL' AS out FROM stated), s AS (SELECT *, CASE WHEN out AND NOT coalesce(lag(out) OVER (PARTITION BY service, key ORDER BY tick), false) THEN 1 ELSE 0 END AS new FROM o),
r AS (SELECT *, sum(new) OVER (PARTITION BY service, key ORDER BY tick) AS run FROM s), e AS (SELECT service, key, run, min(tick) AS start, max(tick) + 1 AS "end", count(*) FILTER (state = 'ALERTING') AS alerted, max(n) AS peak FROM r WHERE out GROUP BY ALL)
SELECT service, key, start, "end", alerted, peak, "end" - start < 5 OR coalesce(start - lag("end") OVER (PARTITION BY service, key ORDER BY start) < 30, false) AS flap FROM e WHERE alerted > 0""")
def b11_b13_episodes(spark, sf):
    return L.flaps(L.episodes(_stated(spark, sf)))


@query(f"""WITH {DENSE}, l AS (SELECT *, lag(n, 168) OVER w AS week, lag(n, 24) OVER w AS day FROM dense WINDOW w AS (PARTITION BY service, key ORDER BY tick)),
p AS (SELECT service, key, avg(abs(n - week)) AS a, avg(abs(n - day)) AS b FROM l WHERE week IS NOT NULL GROUP BY ALL) SELECT service, key, round(a, 9) AS mae_week, round(b, 9) AS mae_day, round(CASE WHEN b > 0 THEN a / b END, 9) AS ratio FROM p""")
def a18_naive_errors(spark, sf):
    out = L.naive_errors(_dense(spark, sf))
    return out.select("service", "key", *(F.round(c, 9).alias(c) for c in ("mae_week", "mae_day", "ratio")))


@query(f"WITH RECURSIVE {DENSE}, {CUSUM} SELECT * FROM cusum")
def b7_cusum(spark, sf):
    return L.cusum(_dense(spark, sf)).withColumn("score", F.round("score", 6))


@query()
def b7_pca(spark, sf):
    return L.principal(_dense(spark, sf).filter("key NOT LIKE '*%'"))


@query(f"""WITH RECURSIVE {DENSE}, {MAD}, {WEEKLY}, {CUSUM}, flags AS (SELECT service, key, tick, high FROM mad UNION ALL SELECT service, key, tick, high FROM weekly UNION ALL SELECT service, key, tick, high FROM cusum)
SELECT service, key, tick, count(*) FILTER (high) >= 2 AS high FROM flags GROUP BY ALL""")
def b7_vote(spark, sf):
    ticks = _dense(spark, sf)
    return L.vote(L.mad_band(ticks, 4.0), L.weekly(ticks, 2, 4), L.cusum(ticks))


@query()
def w8_left_profile(spark, sf):
    return L.left_profile(_dense(spark, sf))


@query()
def a19_bootstrap(spark, sf):
    days = C.hourly_moments(C.minute_counts(_lines(spark, sf))).filter("key = '*total'").groupBy("service", "day").agg(F.sum("sum").alias("n"))
    return L.bootstrap(days, "n")
