"""Operators on small hand-made rows."""

import itertools
import math
import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import bands, baseline, counts, detect, lab, links, templates
from tidemark.streaming import live
from tidemark.streaming.live import step


def lines(spark, rows):
    df = spark.createDataFrame(rows, "event_id bigint, at string, service string, level string, template string, module string")
    return df.withColumn("ts", F.col("at").cast("timestamp_ntz")).withColumn("lts", F.col("ts"))


def test_level_keys_add_up_to_the_total(spark):
    rows = [(i, f"2024-01-0{1 + i % 3} 0{i % 5}:1{i % 10}:00", "s", ("ERROR", "WARNING", None, "debug", "FATAL")[i % 5], f"s:T{i % 4}", "M0") for i in range(60)]
    got = {r.key: r.n for r in counts.minute_counts(lines(spark, rows)).groupBy("key").agg(F.sum("n").alias("n")).collect()}
    assert got["*total"] == 60 == got["*error"] + got["*warn"] + got["*info"] == sum(got[f"s:T{i}"] for i in range(4))
    assert got["*error"] == 24 and got["*warn"] == 12


def test_moments_of_parts_are_those_of_the_whole(spark):
    rows = [(i, f"2024-01-01 0{i % 3}:{i % 7:02d}:00", "s", "INFO", "s:T", "M0") for i in range(50)]
    minutes = counts.minute_counts(lines(spark, rows))
    merged = counts.merged_moments(counts.hourly_moments(minutes.filter("minute % 3 = 0")), counts.hourly_moments(minutes.filter("minute % 3 > 0")))
    assert sorted(merged.collect()) == sorted(counts.hourly_moments(minutes).collect())


def test_zero_fill_stays_within_the_hour(spark):
    rows = [(1, "2024-01-01 00:58:00", "s", "INFO", "s:T", "M0"), (2, "2024-01-01 02:00:00", "s", "INFO", "s:T", "M0")]
    got = counts.zero_filled(counts.minute_counts(lines(spark, rows))).filter("key = 's:T'").collect()
    assert len(got) == 2 + 60 and sum(r.n for r in got) == 2


def _rebuilt(spark, hours, moments, exclusions=()):
    h = spark.createDataFrame(hours, "service string, day date, hour int, n_minutes int")
    m = spark.createDataFrame(moments, "service string, key string, day date, hour int, sum bigint, sumsq bigint")
    x = spark.createDataFrame([*exclusions], "service string, day date, hour_from int, hour_to int, decision string")
    days = baseline.mark_days(h, F.lit(date(2026, 10, 20)))
    return {(r.key, r.daytype, r.hour): (r.mean, r["std"], r.days) for r in baseline.rebuild(m, h, days, x).collect()}


def test_baseline_counts_silent_minutes(spark):
    got = _rebuilt(spark, [("s", date(2026, 10, 12), 3, 60)], [("s", "k", date(2026, 10, 12), 3, 6, 18)])
    assert got["k", "weekday", 3] == (pytest.approx(0.1), pytest.approx(math.sqrt(0.29)), 1)


def test_baseline_takes_the_newest_five_weekdays(spark):
    days = [date(2026, 10, d) for d in (8, 9, 12, 13, 14, 15, 16)]
    moments = [("s", "k", d, 1, 60 if d.day >= 12 else 6000, 60 if d.day >= 12 else 600000) for d in days] + [("s", "k", date(2026, 10, 20), 1, 9999, 9)]
    got = _rebuilt(spark, [("s", d, 1, 60) for d in [*days, date(2026, 10, 20)]], moments)
    assert got["k", "weekday", 1] == (1.0, 0.0, 5)


def test_excluded_hours_are_left_out_and_kept_ones_not(spark):
    days = [date(2026, 10, 12), date(2026, 10, 13)]
    hours = [("s", d, h, 60) for d in days for h in (10, 11)]
    moments = [("s", "k", d, h, 60, 60) for d in days for h in (10, 11)]
    got = _rebuilt(spark, hours, moments, [("s", days[0], 10, 11, "exclude"), ("s", days[1], 10, 12, "keep")])
    assert got["k", "weekday", 10][2] == 1 and got["k", "weekday", 11][2] == 2


def test_level_keys_count_from_their_first_day(spark):
    days = [date(2026, 10, 12), date(2026, 10, 13)]
    got = _rebuilt(spark, [("s", d, 1, 60) for d in days], [("s", "*warn", days[1], 1, 60, 60), ("s", "*total", days[1], 1, 60, 60)])
    assert got["*warn", "weekday", 1] == (1.0, 0.0, 1) and got["*total", "weekday", 1][2] == 2


def test_judgement(spark):
    rows = spark.createDataFrame(
        [("k", 7, 3.0, 1.0, None, None, 5, False), ("k", 6, 3.0, 1.0, None, None, 5, False), ("k", 7, 3.0, 1.0, 4.0, 1.0, 5, False), ("k", 10, None, None, None, None, 0, False), ("*total", 5, 20.0, 1.0, None, None, 5, False), ("*total", 5, 20.0, 1.0, None, None, 5, True)],
        "key string, n bigint, mean double, std double, next_mean double, next_std double, profile_days int, upper_only boolean",
    )
    got = baseline.judged(rows, F.when(F.col("key") == "k", 5)).collect()
    assert [r.high for r in got] == [True, False, False, True, True, False]
    assert got[0].band_high == 6 and got[2].band_high == 7 and got[3].score == 2.0 and got[3].band_high is None


def test_states_are_those_of_the_steps(spark):
    random.seed(1)
    flags = {f"k{i}": [random.random() < p for _ in range(200)] for i, p in enumerate((0.2, 0.5, 0.8))} | {"hand": [True] * 5 + [False] * 3}
    want = {}
    for k, own in flags.items():
        state, streak = "NORMAL", 0
        for t, high in enumerate(own):
            state, streak = step(state, streak, high)
            want[k, t] = state
    assert [want["hand", t] for t in range(8)] == ["NORMAL", "WARMING", *["ALERTING"] * 3, "COOLING", "COOLING", "NORMAL"]
    rows = spark.createDataFrame([(k, t, h) for k, own in flags.items() for t, h in enumerate(own)], "key string, tick bigint, high boolean")
    assert {(r.key, r.tick): r.state for r in detect.states(rows, ["key"]).collect()} == want


@pytest.mark.parametrize(("warm", "alert", "cool"), [(1, 2, 2), (2, 3, 3), (3, 4, 2)])
def test_states_for_other_thresholds(spark, warm, alert, cool):
    random.seed(warm)
    own = [random.random() < 0.6 for _ in range(300)]
    state, streak, want = "NORMAL", 0, []
    for high in own:
        state, streak = step(state, streak, high, warm, alert, cool)
        want.append(state)
    rows = spark.createDataFrame([("k", t, h) for t, h in enumerate(own)], "key string, tick bigint, high boolean")
    assert [r.state for r in detect.states(rows, ["key"], "tick", warm, alert, cool).orderBy("tick").collect()] == want


def test_intervals(spark):
    spans = spark.createDataFrame([("s", 1, 4), ("s", 3, 6), ("s", 8, 9), ("t", 20, 30)], "service string, start bigint, end bigint")
    assert sorted(map(tuple, detect.islands(spans, ["service"]).collect())) == [("s", 1, 6), ("s", 8, 9), ("t", 20, 30)]
    assert {(r.service, str(r.day)): r.covered for r in detect.covered(spans, ["service"]).collect()} == {("s", "1970-01-01"): 6, ("t", "1970-01-01"): 4, ("t", "1970-01-02"): 6}
    random.seed(2)
    a = [(i, s, s + random.randint(1, 60)) for i, s in enumerate(random.randint(0, 500) for _ in range(60))]
    left = spark.createDataFrame([("s", *x) for x in a], "service string, i int, start bigint, end bigint")
    got = detect.joined_intervals(left, left.withColumnRenamed("i", "j"), ["service"])
    assert sorted((r.i, r.j) for r in got.collect()) == sorted((x[0], y[0]) for x, y in itertools.product(a, a) if x[1] < y[2] and y[1] < x[2])


def test_normalised_messages(spark):
    cases = {
        "2026-10-12 10:11:12,123 user 42 from 10.0.0.1 a=; b=7": "user <*> from <*> a <*> b <*>",
        "GET https://host.example.com:80/path/x took 15ms": "GET <*>/path/x took <*>ms",
        "<soap:Envelope><soap:Body><ns:getUser id='1'>bob</ns:getUser></soap:Body></soap:Envelope>": "getUser bob",
        "id deadbeef01 token A1b2C3d4E5f6G7h8I9": "id <*> token <*>",
        "values [1, 2, 3]": "values <*>",
        "": "",
    }
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "m string")
    got = {r.m: r.n for r in df.select("m", T.normalised(F.col("m")).alias("n")).collect()}
    assert got == {**cases, None: ""}


def test_whole_texts_are_collapsed(spark):
    random.seed(5)
    texts = [" ".join(random.choices(["<*>", "(<*>)", "<*>ms", "word", "-"], k=n)) for n in (0, 1, 7, 41, 900)] + ["<*> " * 5000 + "late words", "<*> <*> <*>x"]

    def brute(text):
        out = []
        for t in text.split():
            if "<*>" in t and not any(c.isalnum() for c in t.replace("<*>", "")):
                t = "<*>"
            if t != "<*>" or out[-1:] != ["<*>"]:
                out.append(t)
        return out

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", T.collapsed(T.tokens_of(F.col("t"))).alias("some"), T.collapsed(T.tokens_of(F.col("t")), None).alias("all")).collect():
        assert (r.some, r.all) == (" ".join(brute(r.t)[:40]), " ".join(brute(r.t)))
    lines = ["user 42 gone", "", "17 18", "1 " * 500 + "late words", "--", "x " * 50]
    want = ["user <*> gone", "<*> late words", "--", " ".join(["x"] * 40)]
    df = spark.createDataFrame([("\n".join(lines),), ("\r\n".join(lines),), (None,)], "t string")
    assert [r.n for r in df.select(T.error_lines(F.col("t")).alias("n")).collect()] == [want, want, []]


def test_queries_read_whole_texts(spark, tmp_path):
    from tidemark.plans import link_queries as Q

    spark.createDataFrame([(1, "first line\nsecond 7 line\n\nlast")], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "<html><p>" + " word" * 600 + "</p> end</html>")], "page_id bigint, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert Q.f1_f12_normalised(spark, str(tmp_path)).first().lines == ["first line", "second <*> line", "last"]
    assert Q.f3_f5_pages(spark, str(tmp_path)).first().words == " ".join(["html", "p", *["word"] * 600, "end"])


def test_small_text_functions(spark):
    row = spark.sql("SELECT '[main] 2026-01-01 ERROR boom' AS a, 'the ERROR is late' AS b, 'aé漢' AS c, '\\n 1. Restart it\\n2. Wait' AS d").select(
        T.find_level(F.col("a")), T.find_level(F.col("b")), T.truncated(F.col("c"), 4), T.truncated(F.col("c"), 99), T.first_step(F.col("d"))
    )
    assert tuple(row.first()) == ("ERROR", None, "aé", "aé漢", "Restart it")
    ids = spark.createDataFrame([("DOC-009",), ("DOC-x",), ("DOC-012",)], "i string")
    assert ids.agg(T.next_doc_id(F.col("i"))).first()[0] == "DOC-013"


def test_templates(spark):
    rows = [("s", "user alice logged in", 1), ("s", "user bob logged in", 2), ("s", "disk full", 3), ("t", "user carol logged in", 4)]
    got = {r.text: (r.template_id, r.template) for r in templates.mined(spark.createDataFrame(rows, "service string, text string, first_seen bigint")).collect()}
    assert got["user alice logged in"] == got["user bob logged in"] and got["user bob logged in"][1] == "user <*> logged in"
    assert got["user carol logged in"][1] == "user carol logged in" and got["disk full"][1] == "disk full"


def test_nb_quantiles():
    assert bands.nb_quantiles(0, 0, 0.001) == (0, 0)
    for mean, var in ((3.0, 3.0), (3.0, 9.0), (40.0, 90.0)):
        low, high = bands.nb_quantiles(mean, var, 0.00135)
        assert low <= mean - 0 and high > mean and high < mean + 8 * math.sqrt(var)
    low, high = bands.nb_quantiles(3.0, 3.0, 0.00135)  # Poisson: P(X > 9) = 0.0011, P(X > 8) = 0.0038
    assert (low, high) == (0, 9)


def test_links(spark):
    def at(s):
        return [s, math.sqrt(1 - s * s)]

    t = spark.createDataFrame([(1, "s", "ERROR", True, at(1.0)), (2, "s", "ERROR", False, at(0.9)), (3, "s", "ERROR", False, at(0.8)), (4, "s", "INFO", False, at(0.9)), (5, "u", "ERROR", False, at(0.99))], "id bigint, service string, class string, manual boolean, embedding array<double>")
    assert [(r.id, r.doc) for r in links.inherited(t).collect()] == [(2, 1)]
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101)], "a bigint, b bigint")
    nodes = spark.range(1, 45).unionByName(spark.range(100, 102))
    got = {r.id: r.cluster for r in links.clusters(nodes, chain).collect()}
    assert all(got[i] == 1 for i in range(1, 41)) and got[42] == 42 and got[101] == 100


def test_lab(spark):
    ticks = spark.createDataFrame([("s", "k", t, 20 if t in (100, 101, 102) else 2) for t in range(200)], "service string, key string, tick bigint, n bigint")
    high = {r.tick for r in lab.cusum(ticks).filter("high").collect()}
    assert high and min(high) == 100
    boot = lab.bootstrap(spark.createDataFrame([("s", date(2026, 1, 1 + i), float(i)) for i in range(20)], "service string, day date, v double"), "v").first()
    assert boot.low < 9.5 < boot.high
    assert lab.left_profile(ticks).filter("score IS NOT NULL").count() == 200 - 24 - 23


def test_stream_counts_late_and_double_lines(spark, tmp_path):

    def put(i, rows):
        spark.createDataFrame(rows, "event_id bigint, ts timestamp, service string, template string").coalesce(1).write.parquet(f"{tmp_path}/in/{i}")

    at = lambda m, s=0: datetime(2026, 1, 1, 10, m, s)
    put(1, [(1, at(0), "s", "t"), (2, at(0, 30), "s", "t"), (2, at(0, 30), "s", "t")])
    put(2, [(3, at(5), "s", "t")])
    put(3, [(5, at(9), "s", "t")])
    put(4, [(4, at(0, 10), "s", "t"), (6, at(12), "s", "t")])  # 4 is late by now
    schema = "event_id bigint, ts timestamp, service string, template string"
    import time

    for i in range(1, 5):
        target = tmp_path / "flat"
        target.mkdir(exist_ok=True)
        part = next((tmp_path / "in" / str(i)).glob("*.parquet"))
        (target / f"{i}.parquet").write_bytes(part.read_bytes())
        time.sleep(1.1)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "flat"))
    live.replay(live.windowed_counts(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {(r.start.minute): r.n for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got[0] == 2 and got[5] == 1


@pytest.mark.parametrize(
    ("message", "wording"),
    [
        ("03/11/2025 07:08:09.555  WARN [pool-2] job-7-Loader: cache is warm", "job-<*>-Loader: cache is warm"),
        ("Job: code = 17, started: Mon Nov 03 07:08:09 CET 2025", "Job: code <*> started:"),
        ("seen 2025-11-03T07:08:09.001+01:00 here", "seen here"),
        ("lap 07:08:09,333 over", "lap over"),
        ("shard 12 of 340", "shard <*> of <*>"),
        ("<e:Envelope xmlns:e='u'><e:Header/><e:Body><m:quote><price>12</price><unit>each</unit></m:quote></e:Body></e:Envelope>", "quote price <*> unit each"),
        ("&lt;row id=&apos;v&apos;&gt;cell;", "row cell"),
        ("user&apos;s id=5;", "user s id <*>"),
        ("order 0b5c77aa-91de-4c1f-8f60-2f4de9a0c111 at 0xdeadbeef1 via 192.168.7.9:5432 for jo.do@mail.example.org", "order <*> at <*> via <*> for <*>"),
        ("token=Q0k3dDl4VnB6TG1x7a, model=XJ900", "token <*> model XJ<*>"),
        ("get ==https://files.example.net:99/Store?list", "get <*>/Store?list"),
        ("copied to 10.1.1.1:5 10.1.1.2:5 10.1.1.3:5 twice", "copied to <*> twice"),
        ("path/10.1.1.1:5x v1.2.3", "path/<*>:<*>x v<*>.<*>.<*>"),
        ("name=, next=\nlast=", "name <*> next <*> last <*>"),
        ("a\x1cb\u00a0c\u3000d", "a b c d"),
        ("2025-11-03 07:08:09 SEVERE [main] - queue full", "queue full"),
        ("Mon Nov 03 07:08:09 CET 2025 queue full", "queue full"),
        ("notice: cache cold", "cache cold"),
        ("[x] (y) 12 -- WARNING| low", "x y <*> -- WARNING| low"),
        ("30/09/2026 14:00:31 [main] message", "message"),
        ("13-Aug-2020 and 13 Aug 2020 9:05", "and"),
        ("Peer ERROR closed", "Peer ERROR closed"),
        ("a &lt;b&gt;&eacute;t&#233;&lt;/b&gt; &amp;", "a b été &"),
        ("", ""),
        (None, ""),
    ],
)
def test_wording_of_messages(spark, message, wording):
    got = spark.createDataFrame([(message,)], "m string").select(T.normalised(F.col("m")).alias("w")).first().w
    assert got == wording


def test_references_are_those_of_html(spark):
    import html

    random.seed(11)
    parts = ["&amp", "&amp;", "&apos;", "&notit;", "&copy", "&NotEqualTilde;", "&#233;", "&#xe9", "&#150;", "&#0;", "&#x110000;", "&#99999999999;", "&#1;", "&#13;", "&zz;", "&", ";", "a", " ", "&#", "&#x;", "&#xD800;", "&#xFDD0;", "&nbsp;", "&hellip;", "7"]
    texts = ["".join(random.choices(parts, k=random.randrange(1, 7))) + ";&" for _ in range(500)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.unescaped(F.col("t")).alias("u")).collect()
    assert [(r.t, r.u) for r in got if r.u != html.unescape(r.t)] == []


def test_messages_have_no_limits_unless_asked(spark):
    long = " ".join(["w"] * 60) + " " + "z" * 9000 + " END"
    df = spark.createDataFrame([(long,)], "t string")
    whole, cut, lines = df.select(T.normalised(F.col("t"), None, None), T.normalised(F.col("t")), T.error_lines(F.col("t"), None, None)).first()
    assert whole == long and lines == [long] and cut == " ".join(["w"] * 40)


def test_levels_of_messages(spark):
    want = {"12:00 [t] Error: x": "ERROR", "<notice> y": "NOTICE", "plain ERROR": None, "1 2 3 4 INFO": "INFO", "1 2 3 4 5 INFO": None, "": None, "(SEVERE)": "SEVERE", "INFORMATION x": None}
    df = spark.createDataFrame([(m,) for m in want], "m string").select("m", T.find_level(F.col("m")).alias("level"))
    assert {r.m: r.level for r in df.collect()} == want


def test_stream_changes_whatever_the_batches(spark, tmp_path):
    key, old = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    rows = [(s, k, t, hash((s, k, t // 3)) % 3 == 0) for s in "ab" for k in "xy" for t in range(400)]
    want, flags = [], {}
    for s, k, t, high in rows:
        flags.setdefault((s, k), []).append((t, high))
    for (s, k), own in flags.items():
        state, streak = "NORMAL", 0
        for t, high in own:
            new, streak = live.step(state, streak, high)
            want += [(s, k, t + 1, state, new)] * (new != state)
            state = new
    schema = "service string, key string, tick bigint, high boolean"
    random.seed(3)
    for i in range(4):  # four micro-batches in the order of time, each in no order; some ticks come again
        part = [r for r in rows if 100 * i <= r[2] < 100 * (i + 1) or i == 3 and r[2] == 50]
        random.shuffle(part)
        spark.createDataFrame(part, schema).repartition(3).write.parquet(f"{tmp_path}/in/part{i}")
    spark.conf.set(key, "7")
    try:
        for i in range(4):
            stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in/part[0-{i}]")
            live.replay(live.state_changes(stream), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    finally:
        spark.conf.set(key, old)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").drop("batch").collect())) == sorted(want)


def test_replay_goes_on_after_a_restart(spark, tmp_path):
    for i in range(3):
        spark.range(5 * i, 5 * i + 5).write.mode("append").parquet(f"{tmp_path}/in")
        for _ in range(2):  # the second run finds nothing new
            live.replay(spark.readStream.schema("id bigint").parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
        assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(5 * i + 5))


def test_module_alert_counts_from_the_first_high_minute_to_cooling(spark):
    # in minutes of a day: warm at the end of 481 (8:02), alerting from 8:03, cooling at 8:07
    changed = spark.createDataFrame([("a", "a:T1", 482, "NORMAL", "WARMING"), ("a", "a:T1", 483, "WARMING", "ALERTING"), ("a", "a:T1", 487, "ALERTING", "COOLING")], "service string, key string, at bigint, from_state string, to_state string")
    rows = spark.createDataFrame([("a", "a:T1", m, 480 + i, n) for i in range(9) for m, n in (("M1", 10), ("M2", 5))], "service string, key string, module string, tick bigint, n bigint")
    one = detect.module_alerts(changed, rows, 480, 495).filter("module = 'M1'").first()
    assert (one.ticks, one.total, one.peak, one["mean"], one.template_total, one.template_peak, one.peak_state) == (6, 60, 10, 10.0, 90, 15, "ALERTING")
    clipped = detect.module_alerts(changed, rows, 484, 486).filter("module = 'M1'").first()
    assert (clipped.ticks, clipped.total) == (2, 20)
    assert detect.module_alerts(changed, rows, 486, 495).count() == 0


def test_service_keys_are_filled_from_the_first_minute(spark):
    own = [(1, "2024-01-01 00:58:00", "a", "ERROR", "a:T", "M0"), (2, "2024-01-01 01:02:00", "b", "INFO", "b:T", "M0")]
    got = {(r.service, r.key, r.minute % 1440): r.n for r in counts.zero_filled(counts.minute_counts(lines(spark, own))).collect()}
    assert {k[2] for k in got if k[:2] == ("a", "*warn")} == {58, 59, 60, 61, 62} and {k[2] for k in got if k[:2] == ("b", "*warn")} == {62}
    assert {k[2] for k in got if k[:2] == ("a", "a:T")} == {58, 59} and got["a", "*error", 58] == 1 and got["a", "*total", 60] == 0


def test_principal_residuals_are_those_of_the_whole_matrix(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    counts_ = {s: rng.poisson(rng.uniform(0.2, 9, n), (60, n)) for s, n in (("a", 5), ("b", 3), ("c", 1))}
    counts_["b"][:, 1] = 0  # a key without counts
    rows = [(s, f"k{j}", i, int(x[i, j])) for s, x in counts_.items() for i in range(60) for j in range(x.shape[1])]
    got = {(r.service, r.tick): r for r in lab.principal(spark.createDataFrame(rows, "service string, key string, tick bigint, n bigint")).collect()}
    assert len(got) == 180
    for s, x in counts_.items():
        x = x - x.mean(axis=0)
        _, vectors = np.linalg.eigh(x.T @ x)
        lead = vectors[:, ::-1][:, :2]
        want = ((x - x @ lead @ lead.T) ** 2).sum(axis=1)
        assert np.allclose([got[s, i].score for i in range(60)], want, rtol=1e-3, atol=1e-2)
        have = np.array([got[s, i].score for i in range(60)])
        if want.max() > 1e-6:
            assert [got[s, i].high for i in range(60)] == (have > np.quantile(have, 0.995)).tolist()
