"""The re-read lane: slices are replaced whole, others stay, and a lane that was stopped goes on."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators import reread

T0 = datetime.datetime(2026, 10, 12)
H0 = (T0.date() - datetime.date(1970, 1, 1)).days * 24


def lines(spark, rows):
    made = [(i, T0 + datetime.timedelta(minutes=m), s, "INFO", f"{s}:T") for i, (s, m) in enumerate(rows)]
    return spark.createDataFrame(made, "event_id long, lts timestamp_ntz, service string, level string, template string")


def state(lane):
    return {(r.service, r.hour, r.key): (r["sum"], r.sumsq, tuple(r.counts)) for r in lane.table().collect()}


@pytest.fixture
def made(spark, tmp_path):
    old = lines(spark, [("a", 70), ("a", 70), ("a", 130), ("b", 65), ("b", 250), ("a", 190), ("a", 260)])
    first = spark.createDataFrame([("a", H0 * 60 + 70), ("b", H0 * 60 + 65)], "service string, first long")
    every = spark.createDataFrame([(s, T0.date(), h) for s in "ab" for h in range(1, 5)], "service string, day date, hour int")

    def lane(name, hours_each=1):
        out = reread.RereadLane(spark, f"{tmp_path}/{name}", hours_each)
        out.write(reread.slice_rows(old, every, first))
        return out

    return lane, every, first


def test_slices_are_replaced_whole(spark, made):
    lane, every, first = made
    new = lines(spark, [("a", 75), ("b", 66), ("b", 125), ("a", 200), ("b", 251)])
    one = lane("one")
    before = state(one)
    assert before["a", 1, "*total"][0] == 2 and before["a", 1, "*minutes"][0] == 50 and before["b", 3, "*minutes"] == (60, 60, (1,) * 60)
    lost = every.filter("service = 'b' AND hour = 2")
    scope = every.filter("hour <= 3").union(spark.createDataFrame([("c", T0.date(), 1)], every.schema))
    assert one.run(new, scope, first, lost, live_from=H0 + 4) == 3
    after = state(one)
    assert after["a", 1, "*total"][0] == 1 and after["a", 1, "*total"][2][15] == 1
    assert ("a", 2, "*total") not in after and after["a", 2, "*minutes"][0] == 60  # silent now
    assert ("b", 2, "*total") not in after  # the lost hour stays without its new line
    assert {k: v for k, v in after.items() if k[1] == 4} == {k: v for k, v in before.items() if k[1] == 4}
    assert not any(k[0] == "c" for k in after)


def test_a_stopped_lane_goes_on(spark, made):
    lane, every, first = made
    new = lines(spark, [("a", 75), ("b", 66), ("b", 125), ("a", 200), ("b", 251)])
    whole, parts = lane("whole", 24), lane("parts")
    whole.run(new, every, first)
    taken = [parts.run(new, every, first, steps=1) for _ in range(6)]
    assert taken == [1, 1, 1, 1, 0, 0] and state(parts) == state(whole)
    # a step that was written without its position is taken again
    again = lane("again")
    again.write(reread.slice_rows(new, every.filter("hour = 1"), first))
    again.run(new, every, first)
    assert state(again) == state(whole) and again.table().filter(F.col("key") == "*total").count() == 5
