"""The walk-forward runner against plain loops: masks, gaps, states over midnight, sinks and the injection test."""

import datetime
import math
import statistics

import pytest
from pyspark.sql import functions as F

from tidemark.operators import walkforward as W

D0 = datetime.date(2026, 10, 12)
SERIES = "service string, key string, day date, counts array<int>"


def series_rows():
    rows = []
    for k in range(3):
        for d in range(12):
            counts = [(7 * d + 3 * k + h * h) % 11 + (40 if (d + k) % 6 == 5 and h == 4 else 0) for h in range(24)]
            if d == 4:
                counts[3:9] = [W.UNOBSERVED] * 6
            if (k, d) != (1, 6):  # a day without a row
                rows.append(("s", f"k{k}", D0 + datetime.timedelta(days=d), counts))
    return rows


@pytest.fixture(scope="module")
def judged(spark):
    return {(r.key, r.day, r.method, r.knob): r for r in W.walk_forward(spark.createDataFrame(series_rows(), SERIES).repartition(3)).collect()}


def plain(method, knob, key):
    """day -> flags, by loops over slots."""
    own = sorted(((d, c) for _, k, d, c in series_rows() if k == key))
    out, s = {}, 0.0
    for i, (day, counts) in enumerate(own):
        before = own[:i]
        flags = []
        known = [x for _, c in before for x in c if x >= 0]
        rate = max(sum(known) / len(known), 1e-9) if known else None
        week = dict(before).get(day - datetime.timedelta(days=7))
        if (method == "weekly" and week is None) or not before:
            continue
        for h, x in enumerate(counts):
            past = [c[h] for _, c in before if c[h] >= 0]
            if x < 0:
                flags.append(False)
            elif method == "weekly":
                flags.append(week[h] >= 0 and x > knob * week[h] and x >= 5)
            elif method == "cusum":
                s = max(0.0, s + x * math.log(1.5) - 0.5 * rate)
                flags.append(s > knob)
                s = 0.0 if s > knob else s
            elif len(past) < 3:
                flags.append(False)
            elif method == "mad":
                c = statistics.median(past)
                flags.append(abs(x - c) > max(knob * 1.4826 * statistics.median(abs(p - c) for p in past), 1))
            else:
                mean = sum(past) / len(past)
                flags.append(x > mean + knob * math.sqrt(max(sum(p * p for p in past) / len(past) - mean * mean, 0)))
        out[day] = flags
    return out


@pytest.mark.parametrize("method", sorted(W.REGISTRY))
def test_methods_against_loops(judged, method):
    for knob in W.REGISTRY[method].knobs:
        for key in ("k0", "k1", "k2"):
            want = plain(method, knob, key)
            got = {d: list(r.high) for (k, d, m, q), r in judged.items() if (k, m, q) == (key, method, knob)}
            assert got == want
    for r in judged.values():  # what was not observed has no score
        assert all(s is None for s, n in zip(r.score, r.counts, strict=True) if n == W.UNOBSERVED)


def test_sinks(spark, judged):
    df = spark.createDataFrame(series_rows(), SERIES)
    out = {(r.method, r.knob, r.key): r for r in W.alert_sink(W.walk_forward(df)).collect()}
    for (method, knob, key), r in out.items():
        own = [list(x.high) for (k, _, m, q), x in judged.items() if (k, m, q) == (key, method, knob)]
        assert (r.days, r.high) == (len(own), sum(map(sum, own)))
        assert r.episodes == sum(h and not (i and f[i - 1]) for f in own for i, h in enumerate(f))


def test_injection(spark):
    df = spark.createDataFrame(series_rows(), SERIES)
    day = D0 + datetime.timedelta(days=10)
    incidents = spark.createDataFrame([("s", f"k{k}", day, 10, 13, size) for k, size in ((0, 500), (1, 500), (2, 1))], "service string, key string, day date, start int, end int, size int")
    changed = {(r.key, r.day): r.counts for r in W.injected(df, incidents).collect()}
    before = {(k, d): c for _, k, d, c in series_rows()}
    assert changed["k0", day][9:14] == [a + b for a, b in zip(before["k0", day][9:14], [0, 500, 500, 500, 0], strict=True)]
    assert {p: c for p, c in changed.items() if p[1] != day} == {p: c for p, c in before.items() if p[1] != day}
    got = {(r.method, r["size"]): r for r in W.injection_test(df, incidents, 3.0).collect()}
    assert all(got[m, 500].recall == 1.0 and got[m, 500].delay == 0 for m in ("mad", "sigma", "cusum"))
    rates = {(r.method, r.knob): r.rate for r in W.alert_sink(W.walk_forward(df)).groupBy("method", "knob").agg((F.sum("episodes") / F.sum("days")).alias("rate")).collect()}
    for (method, _), r in got.items():
        knobs = W.REGISTRY[method].knobs
        assert r.knob == next((k for k in knobs if rates[method, k] <= 3.0), knobs[-1]) and r.in_budget == (rates[method, r.knob] <= 3.0)


def test_masks_and_documents(spark):
    base = (D0 - datetime.date(1970, 1, 1)).days * 1440
    minutes = spark.createDataFrame([("a", "t1", D0, 0, base + 5, 2), ("a", "t2", D0, 0, base + 5, 3), ("a", "t2", D0, 1, base + 61, 1)], "service string, key string, day date, hour int, minute long, n long")
    seen = spark.createDataFrame([("a", base + m) for m in (*range(3, 8), 59, 61, 61)], "service string, minute long")
    masks = W.observed_masks(seen)
    assert {(r.hour, r.mask) for r in masks.collect()} == {(0, sum(1 << m for m in (3, 4, 5, 6, 7, 59))), (1, 2)}
    links = spark.createDataFrame([("a", "t1", "D"), ("a", "t2", "D")], "service string, key string, doc string")
    got = {r.key: r.counts for r in W.day_series(minutes.unionByName(W.document_minutes(minutes, links)), masks).collect()}
    assert got["doc:D"][5] == 5 and got["doc:D"][61] == 1 and got["t1"][61] == 0 and got["t1"][8] == W.UNOBSERVED
    assert [i for i, n in enumerate(got["t2"]) if n != W.UNOBSERVED] == [3, 4, 5, 6, 7, 59, 61]
