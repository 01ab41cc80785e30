"""Registered queries of the incident report, each with its SQL.

The phases lie at the same ticks for all services; the lines of bursts and spreads are added to the counts of the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import counts as C
from ..operators import detect as D
from ..operators import incident_report as R
from ..operators import views as V
from ..sources import driver_tables as S
from ..sources.shared import stored
from .forecast_queries import ORACLES, QUERIES
from .log_queries import DENSE, DOC_LINKS, DOC_ROWS, FLOOR, STATED, _lines, _stated, query

__all__ = ["ORACLES", "QUERIES"]

#: phase, kind, first tick and end, counted from the first tick of all.
PHASES = [("control", "control", 0, 168), ("burst 1", "burst", 168, 174), ("recovery 1", "recovery", 174, 190), ("spread", "spread", 190, 196), ("burst 2", "burst", 196, 200), ("recovery 2", "recovery", 200, 203)]
#: phase, template, lines added to each tick.
MARKS = [("burst 1", "error", 30), ("recovery 1", "error", 0), ("spread", "error", 1), ("spread", "signup", 1), ("burst 2", "signup", 30), ("recovery 2", "signup", 0)]

_values = lambda rows: ", ".join(str(r) for r in rows)
TESTED = (DENSE.replace("dense AS (", "dense0 AS (") + f""", {DOC_LINKS}, t0 AS (SELECT min(tick) AS t0 FROM ticks),
phases AS (SELECT phase, kind, t0 + s AS start, t0 + e AS "end" FROM t0, (VALUES {_values(PHASES)}) v(phase, kind, s, e)), marks AS (SELECT * FROM (VALUES {_values(MARKS)}) v(phase, suffix, size)),
targets AS (SELECT p.*, k.service, k.key, l.doc, m.size FROM phases p JOIN marks m USING (phase) JOIN links l USING (suffix) JOIN (SELECT DISTINCT service, key FROM ticks) k ON k.key = k.service || ':' || m.suffix),
adds AS (SELECT service, key, size, unnest(generate_series(start, "end" - 1)) AS tick FROM targets), more AS (SELECT service, key, tick, sum(size)::BIGINT AS size FROM (SELECT * FROM adds UNION ALL SELECT service, '*total', size, tick FROM adds) GROUP BY ALL),
mixed AS (SELECT d.service, d.key, d.tick, d.n + coalesce(b.size, 0) AS n FROM dense0 d LEFT JOIN more b USING (service, key, tick)),
dense AS (SELECT * FROM mixed UNION ALL SELECT m.service, 'doc:' || l.doc, m.tick, sum(m.n)::BIGINT FROM mixed m JOIN links l ON m.key = m.service || ':' || l.suffix GROUP BY ALL)""")
SEEN = STATED.replace(DENSE, TESTED).replace(f"key LIKE '%:signup' THEN {FLOOR}", f"key LIKE '%:signup' OR key LIKE 'doc:%' THEN {FLOOR}") + """,
lk AS (SELECT k.service, k.key, l.doc FROM (SELECT DISTINCT service, key FROM ticks) k JOIN links l ON k.key = k.service || ':' || l.suffix),
held AS (SELECT s.service, s.key, s.tick, s.state, lk.doc, CASE WHEN s.key LIKE '*%' THEN 'service' WHEN lk.doc IS NOT NULL THEN 'doc ' || lk.doc ELSE s.key END AS row FROM stated s LEFT JOIN lk USING (service, key) WHERE s.state <> 'NORMAL' AND s.key NOT LIKE 'doc:%'),
shown AS (SELECT service, row, tick, any_value(doc) AS doc, arg_max(state, CASE state WHEN 'ALERTING' THEN 3 WHEN 'COOLING' THEN 2 ELSE 1 END) AS state FROM held GROUP BY ALL)"""


def _tested(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """States of all keys with the test's lines, alert rows, phases, and targets that the tables have."""
    ticks = stored(C.tick_counts(_lines(spark, sf)), "ticks")
    known = ticks.select("service", "key").distinct()
    links = known.withColumn("suffix", F.substring_index("key", ":", -1)).filter(F.col("key") == F.concat_ws(":", "service", "suffix"))
    links = stored(links.join(F.broadcast(spark.createDataFrame(DOC_ROWS, "suffix string, doc string")), "suffix"), "links")  # a few rows
    # one row: the first tick
    phases = spark.createDataFrame(PHASES, "phase string, kind string, s int, e int").join(F.broadcast(ticks.agg(F.min("tick").alias("t0"))))
    phases = stored(phases.select("phase", "kind", (F.col("t0") + F.col("s")).alias("start"), (F.col("t0") + F.col("e")).alias("end")), "phases")
    targets = stored(phases.join(spark.createDataFrame(MARKS, "phase string, suffix string, size int"), "phase").join(links, "suffix").drop("suffix"), "targets")
    links = links.drop("suffix")
    stated = stored(_stated(spark, sf, lambda dense: R.with_documents(R.added(dense, targets), links)), "stated")
    rows = D.alert_groups(stated.filter("key NOT LIKE 'doc:%'"), links, spark.createDataFrame([], "key string, root string"))
    return stated.select("service", "key", "tick", "state"), stored(rows, "rows"), phases, targets


def _onset(states: str, on: str, targets: str) -> str:
    """Status, first alerting tick and last state of targets in SQL."""
    return f"""(SELECT p.phase, p.service, p.{on}, p.start, p."end", coalesce(max(CASE WHEN s.tick = e.before THEN s.state END), 'NORMAL') = 'ALERTING' AS carried,
  min(s.tick) FILTER (s.state = 'ALERTING' AND s.tick >= p.start AND s.tick < p."end") AS first, CASE WHEN any_value(e.last) IS NOT NULL THEN coalesce(max(CASE WHEN s.tick = e.last THEN s.state END), 'NORMAL') END AS final
  FROM (SELECT DISTINCT phase, service, {on}, start, "end" FROM {targets}) p JOIN (SELECT t.phase, t.service, max(x.tick) FILTER (x.tick < t.start) AS before, max(x.tick) FILTER (x.tick >= t.start AND x.tick < t."end") AS last
    FROM (SELECT DISTINCT phase, service, start, "end" FROM targets) t JOIN samples x USING (service) GROUP BY ALL) e USING (phase, service) LEFT JOIN {states} s ON s.service = p.service AND s.{on} = p.{on} GROUP BY ALL)"""


VERDICT = f"CASE WHEN carried THEN '{R.CARRIED}' WHEN {{ok}} THEN 'PASS' ELSE 'FAIL' END AS verdict"
AFTER = "CASE WHEN NOT carried THEN first - start END AS after"


@query(f"""WITH {SEEN}, samples AS (SELECT DISTINCT service, tick FROM stated), docrows AS (SELECT service, doc, tick, state FROM shown WHERE doc IS NOT NULL),
own AS {_onset('stated', 'key', 'targets')}, docs AS {_onset('docrows', 'doc', 'targets')}, sums AS (SELECT DISTINCT phase, service, 'doc:' || doc AS key, start, "end" FROM targets WHERE kind = 'spread'), spread AS {_onset('stated', 'key', 'sums')},
b AS (SELECT t.phase, t.service, t.key, t.doc, o.carried, o.first, t.start FROM targets t JOIN own o USING (phase, service, key) WHERE t.kind = 'burst')
SELECT phase, service, key, doc, 1 AS "check", {AFTER}, {VERDICT.format(ok='first <= start + 2')}, NULL AS alone FROM b
UNION ALL SELECT t.phase, t.service, t.key, t.doc, 2, CASE WHEN NOT carried THEN first - d.start END, {VERDICT.format(ok='first IS NOT NULL')}, NULL FROM targets t JOIN docs d USING (phase, service, doc) WHERE t.kind = 'burst'
UNION ALL SELECT b.phase, b.service, b.key, b.doc, 4, {AFTER}, {VERDICT.format(ok='h.doc = b.doc')}, NULL FROM b LEFT JOIN held h ON h.service = b.service AND h.key = b.key AND h.tick = b.first AND NOT b.carried
UNION ALL SELECT phase, service, key, key[5:], 3, {AFTER}, {VERDICT.format(ok='first IS NOT NULL')}, (SELECT coalesce(string_agg(o.key, ',' ORDER BY o.key), '') FROM own o WHERE o.phase = spread.phase AND o.service = spread.service AND o.first IS NOT NULL AND EXISTS (SELECT 1 FROM targets t WHERE t.phase = o.phase AND t.service = o.service AND t.key = o.key AND 'doc:' || t.doc = spread.key)) FROM spread""")
def b19_incident_checks(spark, sf):
    """Checks 1 to 4 of an incident test: keys, documents and alert rows that turn ALERTING in bursts and spreads."""
    states, rows, _, targets = _tested(spark, sf)
    bursts = R.burst_checks(states, rows, targets).withColumn("alone", F.lit(None).cast("string"))
    return bursts.unionByName(R.spread_checks(states, targets))


@query(f"""WITH {SEEN}, samples AS (SELECT DISTINCT service, tick FROM stated), docrows AS (SELECT service, doc, tick, state FROM shown WHERE doc IS NOT NULL), own AS {_onset('stated', 'key', 'targets')}, docs AS {_onset('docrows', 'doc', 'targets')}
SELECT t.phase, t.service, t.key, t.doc, o.final AS template_state, d.final AS document_state FROM targets t JOIN own o USING (phase, service, key) JOIN docs d ON d.phase = t.phase AND d.service = t.service AND d.doc = t.doc WHERE t.kind = 'recovery' AND o.final IS NOT NULL""")
def b19_recoveries(spark, sf):
    """States of an incident test's targets at the end of each recovery."""
    states, rows, _, targets = _tested(spark, sf)
    return R.recoveries(states, rows, targets)


@query(f"""WITH {SEEN}, samples AS (SELECT *, lag(tick) OVER (PARTITION BY service ORDER BY tick) AS before FROM (SELECT DISTINCT service, tick FROM stated)), a AS (SELECT service, row, tick FROM shown WHERE state = 'ALERTING')
SELECT p.phase, a.service, a.row, count(*) AS onsets, round(count(*) / (p."end" - p.start), 9) AS per_hour FROM a JOIN samples s USING (service, tick) JOIN phases p ON p.kind = 'control' AND a.tick >= p.start AND a.tick < p."end"
WHERE NOT EXISTS (SELECT 1 FROM a b WHERE b.service = a.service AND b.row = a.row AND b.tick = s.before) GROUP BY p.phase, a.service, a.row, p.start, p."end" """)
def b19_false_alerts(spark, sf):
    """Check 5 of an incident test: alert rows that turn ALERTING in its control, and how often an hour."""
    states, rows, phases, _ = _tested(spark, sf)
    return R.false_alerts(states, rows, phases).withColumn("per_hour", F.round("per_hour", 9))


KNOWN_DOCS = [("DOC-001", "active", "action"), ("DOC-002", "active", "safe"), ("DOC-003", "draft", "action")]
KNOWN_LINKS = [("error", "DOC-001", "manual"), ("signup", "DOC-001", "corpus"), ("purchase", "DOC-002", "llm"), ("click", "DOC-002", "draft"), ("click", "DOC-003", "manual")]
ASKED = ["*total", "*error", "doc:DOC-001", "doc:DOC-002", "doc:DOC-003", "doc:DOC-004", "verdict:action", "verdict:safe", "verdict:none", "nothing"]


@query(f"""WITH {S.LINES_SQL}, t AS (SELECT DISTINCT service, template AS key FROM lines), d AS (SELECT * FROM (VALUES {_values(KNOWN_DOCS)}) v(doc, status, verdict)),
l AS (SELECT t.service, t.key, v.doc FROM t JOIN (VALUES {_values(KNOWN_LINKS)}) v(suffix, doc, source) ON t.key = t.service || ':' || v.suffix WHERE v.source IN {V.LINKING}),
asked AS (SELECT service, key FROM t UNION SELECT service, unnest({ASKED}) FROM t),
e AS (SELECT service, 'doc:' || doc AS key, 'doc' AS kind, key AS own FROM l UNION SELECT l.service, 'verdict:' || d.verdict, 'doc', l.key FROM l JOIN d USING (doc) WHERE d.status = 'active' AND d.verdict IN ('action', 'safe') UNION SELECT service, key, 'template', key FROM t UNION SELECT service, key, key[2:], key FROM asked WHERE key LIKE '*%')
SELECT a.service, a.key, any_value(e.kind) AS kind, string_agg(e.own, ',' ORDER BY e.own) AS keys FROM asked a LEFT JOIN e USING (service, key) GROUP BY a.service, a.key""")
def d13_resolved_keys(spark, sf):
    """What each key that may be asked for sums: service keys, documents, verdicts, templates, and unknown ones."""
    templates = _lines(spark, sf).select("service", F.col("template").alias("key")).distinct()
    known = F.broadcast(spark.createDataFrame(KNOWN_LINKS, "suffix string, doc string, source string"))  # a few rows
    links = templates.join(known, F.col("key") == F.concat_ws(":", "service", "suffix")).drop("suffix")
    asked = templates.unionByName(templates.select("service", F.explode(F.array(*map(F.lit, ASKED))).alias("key")))
    out = V.resolved(asked, links, spark.createDataFrame(KNOWN_DOCS, "doc string, status string, verdict string"), templates)
    return out.withColumn("keys", F.array_join("keys", ","))


@query(f"""WITH {S.LINES_SQL} SELECT level, count(DISTINCT template) AS templates, count(*) AS n, coalesce(nullif(list_position({list(V.LEVEL_ORDER)}, level), 0), {len(V.LEVEL_ORDER) + 1})::INT AS place FROM lines GROUP BY level""")
def p18_levels(spark, sf):
    """Levels with their templates and lines, in the order of display."""
    per = _lines(spark, sf).groupBy("level", "template").agg(F.count("*").alias("n")).groupBy("level").agg(F.count("template").alias("templates"), F.sum("n").alias("n"))
    return per.withColumn("place", V.level_place(F.col("level")).cast("int")).orderBy("place", "level")
