"""Decisions between methods against plain loops."""

import datetime
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tidemark.operators import decide as X

INF = float("inf")
CAND = "method string, kind string, heavy boolean, cost int, ratio double, low double, high double, mase double, worse_share double, recall double, gates map<string,string>"
DAYS = "method string, kind string, service string, day date, n double, winkler double, abs_err double, abs_naive double, covered double, episodes double, flaps double, key_days double"


def candidates(seed, kinds=60):
    rng, rows = random.Random(seed), []
    for k in range(kinds):
        for m in ("sigma", "a", "b", "c")[: rng.randint(2, 4)]:
            ratio = rng.choice([None, 0.5, 0.7, 0.85, 0.95, 1.2])
            spread = rng.choice([0.02, 0.1, 0.3])
            gates = {g: rng.choice(["pass"] * 9 + ["fail", "not_checked"]) for g in ("band", "coverage", "alert_rate", "flaps", "detect")}
            rows.append((m, f"k{k}", rng.random() < 0.3, rng.randint(1, 2), ratio, ratio and ratio - spread, ratio and ratio + spread, rng.choice([None, 0.8, 1.1]), rng.choice([None, 0.1, 0.3]), rng.choice([None, 0.0, 0.4, 0.55, 0.7]), gates))
    return rows


def plain(rows):
    out = {}
    for kind in {r[1] for r in rows if r[0] != "sigma"}:
        live = [r for r in rows if r[1] == kind and r[0] != "sigma" and "fail" not in r[10].values()]
        if not live:
            out[kind] = ("sigma stays", None, None)
            continue
        top = min(live, key=lambda r: (INF if r[4] is None else r[4], r[0]))
        tied = [r for r in live if r is top or (r[5] is not None and top[5] is not None and r[5] <= top[6] and top[5] <= r[6])]
        lead = min(tied, key=lambda r: (r[2], r[3], INF if r[7] is None else r[7], r[0]))
        fits = lead[4] is not None and lead[4] <= 0.9 and lead[6] < 1
        verdict = "sigma stays" if not fits else "mixed" if lead[8] is not None and lead[8] > 0.2 else "sigma stays" if set(lead[10].values()) != {"pass"} else "adopt"
        out[kind] = (verdict, lead[0], ",".join(sorted(r[0] for r in tied)))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_decisions(spark, seed):
    rows = candidates(seed)
    got = {r.kind: (r.verdict, r.leader, r.tied) for r in X.decisions(spark.createDataFrame(rows, CAND)).collect()}
    assert got == plain(rows)


@pytest.mark.parametrize("mix", [False, True])
def test_detections(spark, mix):
    rows, want = candidates(7), {}
    for kind in {r[1] for r in rows if r[0] != "sigma"}:
        own = [r for r in rows if r[1] == kind]
        base = next(r[9] for r in own if r[0] == "sigma")
        ok = (lambda g: "fail" not in g.values()) if mix else (lambda g: g["alert_rate"] == g["flaps"] == "pass")
        live = sorted((r for r in own if r[0] != "sigma" and r[9] and ok(r[10])), key=lambda r: (-r[9], r[2], r[3], r[0]))
        none = "no method" if mix else "sigma stays"
        if all(r[9] is None for r in own):
            want[kind] = ("pending", None, None)
        elif not live:
            want[kind] = (none, None, None)
        else:
            wins = live[0][9] >= 0.5 if mix else base is not None and live[0][9] >= base + 0.1 - 1e-9
            want[kind] = ("adopt" if wins else none, live[0][0], ",".join(sorted(r[0] for r in live if r[9] == live[0][9])))
    assert {r.kind: (r.verdict, r.leader, r.tied) for r in X.detections(spark.createDataFrame(rows, CAND), mix).collect()} == want


def test_ratios_and_measures(spark):
    rng, d0, rows = random.Random(5), datetime.date(2026, 3, 2), []
    for m in ("sigma", "a"):
        for s in ("x", "y"):
            for d in range(9):
                if (m, d) not in (("a", 0), ("sigma", 8)):
                    rows.append((m, "busy", s, d0 + datetime.timedelta(days=d), 24.0, rng.uniform(5, 9), rng.uniform(1, 2), rng.uniform(1, 2), 23.0, 2.0, 1.0, 0.0 if d == 3 else 4.0))
    df = spark.createDataFrame(rows, DAYS)
    pool = [d0 + datetime.timedelta(days=d) for d in (1, 2, 4, 5, 6, 7)]
    score = lambda m, days: sum(sum(r[5] for r in rows if r[0] == m and r[3] == d) for d in days) / (48 * len(days))
    picks = {(r.draw, r.slot): r.i for r in spark.range(1, 301).selectExpr("id AS draw", "explode(sequence(0, 5)) AS slot").select("draw", "slot", X.drawn(F.col("draw"), F.col("slot"), F.lit(6), 11).alias("i")).collect()}
    assert set(picks.values()) == set(range(6)) and max(abs(sum(v == i for v in picks.values()) - 300) for i in range(6)) < 75
    means = sorted(score("a", [pool[picks[d, s]] for s in range(6)]) / score("sigma", [pool[picks[d, s]] for s in range(6)]) for d in range(1, 301))
    cuts = statistics.quantiles(means, n=20, method="inclusive")
    got = {r.method: r for r in X.ratios(df, draws=300).collect()}
    assert (got["a"].ratio, got["a"].low, got["a"].high) == (pytest.approx(score("a", pool) / score("sigma", pool)), pytest.approx(cuts[0]), pytest.approx(cuts[-1]))
    assert (got["sigma"].ratio, got["sigma"].low, got["sigma"].high) == pytest.approx((1, 1, 1))
    fact = {r.method: r for r in X.measured(df).collect()}["a"]
    assert (fact.coverage, fact.alert_rate, fact.flap_share) == pytest.approx((23 / 24, 50, 0.5))
    own = [r for r in rows if r[0] == "a" and r[11]]
    assert fact.mase == pytest.approx(sum(r[6] for r in own) / sum(r[7] for r in own))
    worse = [sum(r[5] for r in rows if r[:1] + r[2:3] == ("a", s) and r[11]) / (24 * 7) > sum(r[5] for r in rows if r[:1] + r[2:3] == ("sigma", s) and r[11]) / (24 * 7) for s in "xy"]
    assert fact.worse_share == sum(worse) / 2


def test_gates_strength_stability_and_gaps(spark):
    facts = spark.createDataFrame([("sigma", "k", True, 0.995, 0.5, True, 0.0, 0.6), ("a", "k", True, None, 1.0, True, None, 0.55), ("b", "k", False, 0.9995, None, False, 0.2, 0.5), ("c", "k", True, 0.99, 2.0, True, 0.1, None)], "method string, kind string, band boolean, coverage double, alert_rate double, in_budget boolean, flap_share double, recall double")
    got = {r.method: r.gates for r in X.gated(facts).collect()}
    order = ("band", "coverage", "alert_rate", "flaps", "detect")
    assert {m: tuple(g[x][0] for x in order) for m, g in got.items()} == {"sigma": tuple("ppppp"), "a": tuple("pnppp"), "b": tuple("fffff"), "c": tuple("ppfpn")}
    said = spark.createDataFrame([(13, 4), (14, 0), (28, 1), (28, 2)], "d int, w int").select(X.strength(F.col("d"), F.col("w"))).collect()
    assert [r[0] for r in said] == ["exploratory", "provisional", "provisional", "final"]
    now = spark.createDataFrame([("p", "a", "a,b"), ("q", "a", "a,b"), ("r", "a", "a"), ("s", None, None), ("t", "a", "a"), ("u", "a", "a")], "kind string, leader string, tied string")
    old = spark.createDataFrame([("p", "a"), ("q", "b"), ("r", "b"), ("s", "a"), ("t", None)], "kind string, leader string")
    assert {r.kind: r.stability for r in X.stability(now, old).collect()} == {"p": "stable", "q": "stable", "r": "unstable", "s": "previous run had no leader", "t": "previous run had no leader", "u": "no previous run"}
    other = facts.withColumn("recall", F.when(F.col("method") == "b", 0.65).otherwise(F.col("recall")))
    assert {r.method: r.gap for r in X.recall_gaps(facts, other).collect()} == {"sigma": False, "a": False, "b": True}
