"""Keys that may be asked for, and the order of levels."""

from pyspark.sql import functions as F

from tidemark.operators import views as V


def test_resolved(spark):
    links = spark.createDataFrame([("s", "t2", "D1", "manual"), ("s", "t1", "D1", "corpus"), ("s", "t1", "D1", "manual"), ("s", "t3", "D1", "draft"), ("s", "t3", "D2", "llm"), ("r", "t1", "D2", "llm"), ("s", None, "D4", "draft")], "service string, key string, doc string, source string")
    documents = spark.createDataFrame([("D1", "active", "action"), ("D2", "draft", "action"), ("D3", "active", "safe"), ("D5", None, None)], "doc string, status string, verdict string")
    templates = spark.createDataFrame([("s", k) for k in ("t1", "t2", "t3", "doc:D9")], "service string, key string")
    asked = [("s", k) for k in ("*warn", "*other", "t1", "t1", "t9", "doc:D1", "doc:D2", "doc:D4", "doc:D9", "verdict:action", "verdict:safe", None)] + [("r", "t1"), ("r", "doc:D2")]
    got = [tuple(r) for r in V.resolved(spark.createDataFrame(asked, "service string, key string"), links, documents, templates).collect()]
    want = [("s", "*warn", "warn", ["*warn"]), ("s", "t1", "template", ["t1"]), ("s", "doc:D1", "doc", ["t1", "t2"]), ("s", "doc:D2", "doc", ["t3"]), ("s", "verdict:action", "doc", ["t1", "t2"]), ("r", "doc:D2", "doc", ["t1"])]
    unknown = [("s", k, None, None) for k in ("*other", "t9", "doc:D4", "doc:D9", "verdict:safe", None)] + [("r", "t1", None, None)]
    assert sorted(got, key=str) == sorted(want + unknown, key=str)
    assert V.resolved(spark.createDataFrame([], "service string, key string"), links, documents, templates).count() == 0


def test_level_place(spark):
    rows = spark.createDataFrame([(x,) for x in ("INFO", None, "ALPHA", "FATAL", "", "WARNING", "ERROR")], "level string")
    got = rows.orderBy(V.level_place(F.col("level")), "level").collect()
    assert [r.level for r in got] == ["FATAL", "ERROR", "WARNING", "INFO", None, "", "ALPHA"]
