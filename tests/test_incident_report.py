"""The incident report against plain loops over samples."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import incident_report as R

STATE, ROW = "service string, key string, tick long, state string", "service string, tick long, kind string, doc string, state string, since long, keys string"
TARGET = "phase string, kind string, start long, end long, service string, key string, doc string"
DOCS = {"k0": "D1", "k1": "D1", "k2": "D2"}
PHASES = [("c", "control", 3, 12), ("b1", "burst", 12, 16), ("r1", "recovery", 16, 20), ("sp", "spread", 20, 24), ("b2", "burst", 24, 27), ("r2", "recovery", 27, 29), ("late", "burst", 90, 95), ("r3", "recovery", 90, 95)]
TARGETS = [(*p, s, k, DOCS[k]) for p in PHASES if p[1] != "control" for s in "ab" for k in ("k0", "k1", "k2")]


def samples(seed):
    """service -> tick -> key -> state; service b lacks every seventh sample, documents have keys of their own."""
    rng, out = random.Random(seed), {}
    for s in "ab":
        for t in range(30):
            if s == "a" or t % 7 != 3:
                now = out.setdefault(s, {}).setdefault(t, {})
                for k in ("*total", "k0", "k1", "k2", "k3", "doc:D1", "doc:D2"):
                    old = out[s].get(t - 1, {}).get(k, "NORMAL")
                    now[k] = old if rng.random() < 0.6 else rng.choice(["NORMAL", "WARMING", "ALERTING", "COOLING"])
    return out


def alert_rows(state):
    """(kind, doc, first key) -> (state, keys) of one sample."""
    rank, rows = ["NORMAL", "WARMING", "COOLING", "ALERTING"], {}
    for k in sorted(state):
        if state[k] != "NORMAL" and not k.startswith("doc:"):
            ident = ("service", None, None) if k.startswith("*") else ("document", DOCS[k], None) if k in DOCS else ("template", None, k)
            held = rows.setdefault(ident, ["NORMAL", []])
            held[0] = max(held[0], state[k], key=rank.index)
            held[1].append(k)
    return rows


def look(seen, service, start, end, of):
    """Status, hit and whether any sample within was ALERTING; the last state."""
    ticks = sorted(seen[service])
    before, within = [t for t in ticks if t < start], [t for t in ticks if start <= t < end]
    hits = [t for t in within if of(seen[service][t]) == "ALERTING"]
    carried = bool(before) and of(seen[service][before[-1]]) == "ALERTING"
    return "carried" if carried else "onset" if hits else "none", None if carried or not hits else hits[0], bool(hits), of(seen[service][within[-1]]) if within else None


def says(status, ok):
    return R.CARRIED if status == "carried" else "PASS" if ok else "FAIL"


def doc_state(d):
    return lambda x: alert_rows(x).get(("document", d, None), ["NORMAL"])[0]


@pytest.mark.parametrize("seed", range(3))
def test_report(spark, seed):
    seen = samples(seed)
    states = spark.createDataFrame([(s, k, t, v) for s in seen for t in seen[s] for k, v in seen[s][t].items()], STATE)
    rows = spark.createDataFrame([(s, t, kind, doc, v[0], 0, ",".join(v[1])) for s in seen for t in seen[s] for (kind, doc, _), v in alert_rows(seen[s][t]).items()], ROW)
    targets = spark.createDataFrame(TARGETS, TARGET)
    bursts, spread, recovered = set(), set(), set()
    for phase, kind, start, end, s, k, d in TARGETS:
        own, docs = look(seen, s, start, end, lambda x: x[k]), look(seen, s, start, end, doc_state(d))  # noqa: B023
        after = lambda h: None if h is None else h - start  # noqa: E731, B023
        if kind == "burst":
            bursts |= {(phase, s, k, d, 1, after(own[1]), says(own[0], own[1] is not None and own[1] <= start + 2)), (phase, s, k, d, 2, after(docs[1]), says(docs[0], docs[1] is not None)), (phase, s, k, d, 4, after(own[1]), says(own[0], own[1] is not None))}
        elif kind == "spread":
            sums = look(seen, s, start, end, lambda x: x[f"doc:{d}"])  # noqa: B023
            alone = ",".join(x for x in sorted(DOCS) if DOCS[x] == d and look(seen, s, start, end, lambda y: y[x])[2])  # noqa: B023
            spread.add((phase, s, f"doc:{d}", d, 3, after(sums[1]), says(sums[0], sums[1] is not None), alone))
        elif own[3] is not None:
            recovered.add((phase, s, k, d, own[3], docs[3]))
    got = [tuple(r) for r in R.burst_checks(states, rows, targets).collect()]
    assert len(got) == len(bursts) and set(got) == bursts
    got = [tuple(r) for r in R.spread_checks(states, targets).collect()]
    assert len(got) == len(spread) and set(got) == spread
    got = [tuple(r) for r in R.recoveries(states, rows, targets).collect()]
    assert len(got) == len(recovered) and set(got) == recovered
    counted = {}
    for s in seen:
        prev = set()
        for t in sorted(seen[s]):
            now = {f"doc {doc}" if kind == "document" else "service" if kind == "service" else v[1][0] for (kind, doc, _), v in alert_rows(seen[s][t]).items() if v[0] == "ALERTING"}
            for row in now - prev:
                if 3 <= t < 12:
                    counted[s, row] = counted.get((s, row), 0) + 1
            prev = now
    phases = spark.createDataFrame(PHASES, "phase string, kind string, start long, end long")
    got = {(r.service, r.row): (r.onsets, r.per_hour) for r in R.false_alerts(states, rows, phases, hours=1 / 60).collect()}
    assert got == {k: (n, pytest.approx(n / (9 / 60))) for k, n in counted.items()}


def test_added_lines(spark):
    """Overlapping targets add up, also in totals; documents sum their templates; empty tables give empty results."""
    ticks = spark.createDataFrame([("a", k, t, 1) for k in ("*total", "k0", "k1") for t in range(4)], "service string, key string, tick long, n long")
    targets = spark.createDataFrame([("p", 1, 3, "a", "k0", 5), ("q", 2, 4, "a", "k0", 7), ("q", 2, 4, "a", "k1", 0), ("r", 2, 2, "a", "k1", 9)], "phase string, start long, end long, service string, key string, size long")
    out = R.added(ticks, targets)
    assert {(r.key, r.tick): r.n for r in out.collect()} == {(k, t): 1 + (k != "k1") * {0: 0, 1: 5, 2: 12, 3: 7}[t] for k in ("*total", "k0", "k1") for t in range(4)}
    links = spark.createDataFrame([("a", "k0", "D"), ("a", "k1", "D")], "service string, key string, doc string")
    assert [r.n for r in R.with_documents(out, links).filter("key = 'doc:D'").orderBy("tick").collect()] == [2, 7, 14, 9]
    assert R.added(ticks.limit(0), targets).count() == 0
    assert R.burst_checks(spark.createDataFrame([], STATE), spark.createDataFrame([], ROW), spark.createDataFrame([], TARGET)).count() == 0


def test_deadline(spark):
    assert spark.range(1).select(R.deadline(F.lit(10)), R.deadline(F.lit(10.5), 5, 2)).first()[:] == (12, 17)
