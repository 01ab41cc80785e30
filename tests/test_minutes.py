"""Closing minutes of a stream: zeros, late lines, sources that fail, and batches that are run again."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.plans import link_queries
from tidemark.streaming import minutes

BASE = datetime.datetime(2026, 10, 12, 8, 0)
M0 = int((BASE - datetime.datetime(1970, 1, 1)).total_seconds() // 60)


def line(minute, event_id, service="a", template="a:T", level="INFO", source="s0"):
    return {"kind": "line", "source": source, "event_id": event_id, "service": service, "template": template, "level": level, "lts": BASE + datetime.timedelta(minutes=minute)}


def poll(source, at, failed=False, upper=None, caught_up=False):
    return {"kind": "poll", "source": source, "at": at, "failed": failed, "upper": None if upper is None else BASE + datetime.timedelta(minutes=upper), "caught_up": caught_up}


@pytest.fixture
def clock(spark, tmp_path):
    return minutes.MinuteClock(spark, str(tmp_path), now=M0 + 200)


def feed(clock, *rows):
    names = [f.split()[0] for f in minutes.FEED.split(", ")]
    return clock.spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], minutes.FEED)


def counts(clock, key=None):
    rows = clock.closed().filter(F.col("key") == key if key else F.lit(True)).collect()
    return {(r.service, r.key, r.minute - M0): r.n for r in rows}


def test_zeros_within_the_hour_only(clock):
    clock.advance(feed(clock, line(58, 1, level="ERROR"), line(58, 2)), 0)
    clock.advance(feed(clock, poll("s0", 1, upper=63, caught_up=True)), 1)
    got = counts(clock)
    assert {k: v for k, v in got.items() if k[1] == "a:T"} == {("a", "a:T", 58): 2, ("a", "a:T", 59): 0}  # forgotten in the next hour
    assert [got["a", "*error", m] for m in range(58, 63)] == [1, 0, 0, 0, 0] and got["a", "*total", 62] == 0 and ("a", "*total", 63) not in got
    clock.advance(feed(clock, line(61, 3), line(64, 4, "b", "b:T")), 2)  # a late line, and a service from its first minute on
    clock.finish(2, M0 + 66)
    got = counts(clock)
    assert got["a", "*total", 61] == 0 and {k[2] for k in got if k[0] == "b" and k[1] == "*warn"} == {64, 65}
    assert {(r.service, r.fate): r.n for r in clock.fates().collect()} == {("a", "counted"): 2, ("a", "late"): 1, ("b", "counted"): 1}


def test_watermark_of_healthy_sources(clock):
    clock.advance(feed(clock, line(10, 1), line(2, 1, source="s1")), 0)
    clock.advance(feed(clock, line(20, 2), poll("s1", 1, True), poll("s1", 2, True)), 1)
    assert counts(clock) == {}  # two errors: s1 still holds
    clock.advance(feed(clock, poll("s1", 3, True)), 2)
    assert max(m for _, _, m in counts(clock)) == 19  # failing: s0 alone
    clock.advance(feed(clock, poll("s1", 4), line(21, 5, source="s1"), line(3, 6, source="s1"), line(30, 7), poll("s0", 5, True), poll("s0", 6, True), poll("s0", 7, True)), 3)
    assert max(m for _, _, m in counts(clock)) == 20  # s1 is back, s0 fails
    clock.advance(feed(clock, *(poll("s1", 8 + i, True) for i in range(3))), 4)
    assert max(m for _, _, m in counts(clock)) == 20  # none is healthy: they hold at their positions
    fates = {r.fate: r.n for r in clock.fates().groupBy("fate").agg(F.sum("n").alias("n")).collect()}
    assert fates == {"counted": 5, "late": 1}


def test_fates_add_up_and_batches_repeat(clock):
    clock.off = ("off",)
    rows = [line(5, 1), line(5, 1), line(6, 2, template=None), line(6, 3, "off"), {**line(6, 4), "lts": None}, line(7, 5)]
    clock.advance(feed(clock, *rows), 0)
    for _ in range(2):  # a batch that is run again gives the same tables
        clock.advance(feed(clock, line(7, 5), line(4, 6), line(9, 7)), 1)
    fates = {r.fate: r.n for r in clock.fates().groupBy("fate").agg(F.sum("n").alias("n")).collect()}
    assert fates == {"counted": 3, "duplicate": 2, "malformed": 2, "skipped_off": 1, "late": 1} and sum(fates.values()) == 9
    clock.finish(1, M0 + 10)
    assert {k[2]: v for k, v in counts(clock, "*total").items()} == {5: 1, 6: 0, 7: 1, 8: 0, 9: 1}
    assert all(r.historic for r in clock.closed().collect())
    recent = minutes.MinuteClock(clock.spark, f"{clock.path}/recent", now=M0 + 10)
    recent.advance(feed(recent, line(5, 1), line(9, 2)), 0)
    assert not any(r.historic for r in recent.closed().collect())


def test_no_window_has_closed(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").limit(14)
    rows.withColumn("ts", F.to_timestamp_ntz(F.lit("2024-01-05 10:00:00")) + F.expr("make_dt_interval(0, 0, int(event_id % 40))")).coalesce(1).write.parquet(f"{tmp_path}/w")
    (tmp_path / "events.parquet").write_bytes(next((tmp_path / "w").glob("part-*")).read_bytes())
    assert sum(r.n for r in link_queries.QUERIES["x3_x5_stream_totals"](spark, str(tmp_path)).collect()) == 14
