"""Adapters: the driver's tables as log lines, vectors and review tables.

The event table stands for a log: the service comes from the user, the level and template from the event type, the module
from the props.  ``LINES_SQL`` is the same adapter for the SQL checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hours from UTC to local time; a fixed offset without daylight saving.
OFFSET_HOURS = 7

LINES_SQL = """lines AS (
  SELECT event_id, ts, ts + INTERVAL 7 HOUR AS lts, 'svc' || (user_id % 3) AS service,
         CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' ELSE 'INFO' END AS level,
         'svc' || (user_id % 3) || ':' || event_type AS template,
         'M' || (CAST(json_extract_string(props, '$.k') AS INT) % 5) AS module, user_id, value, event_type
  FROM events)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ts, lts (local), service, level, template, module, user_id, value, event_type."""
    service = F.concat(F.lit("svc"), F.col("user_id") % 3)
    level = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "signup", "WARN").otherwise("INFO")
    module = F.concat(F.lit("M"), F.get_json_object("props", "$.k").cast("int") % 5)
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", (F.col("ts") + F.expr(f"INTERVAL {OFFSET_HOURS} HOURS")).alias("lts"), service.alias("service"), level.alias("level"), F.concat(service, F.lit(":"), "event_type").alias("template"), module.alias("module"), "user_id", "value", "event_type"
    )


def day_of(lts: str = "lts") -> Column:
    return F.to_date(lts)


def minute_number(lts: str = "lts") -> Column:
    """Whole minutes since 1970 of a local time, whatever the session's zone."""
    return F.datediff(F.to_date(lts), F.lit("1970-01-01").cast("date")).cast("long") * 1440 + F.hour(lts) * 60 + F.minute(lts)


def tick_number(lts: str = "lts") -> Column:
    """Whole hours since 1970 of a local time."""
    return F.datediff(F.to_date(lts), F.lit("1970-01-01").cast("date")).cast("long") * 24 + F.hour(lts)


#: Review decisions, as a small table: half-open hour ranges of a service's day.
EXCLUSIONS = [("svc0", "2024-01-23", 10, 12, "exclude"), ("svc1", "2024-01-24", 0, 6, "exclude"), ("svc1", "2024-01-25", 3, 5, "keep"), ("svc2", "2024-01-27", 20, 24, "exclude")]
#: Services that are switched off.
OFF_SERVICES = ("svc9",)

EXCLUSIONS_SQL = "exclusions AS (SELECT * FROM (VALUES " + ", ".join(f"('{s}', DATE '{d}', {a}, {b}, '{x}')" for s, d, a, b, x in EXCLUSIONS) + ") v(service, day, hour_from, hour_to, decision))"


def exclusions(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(EXCLUSIONS, "service string, day string, hour_from int, hour_to int, decision string")
    return rows.withColumn("day", F.to_date("day"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates with vectors: id, service (by id), class (by label), source (manual for every tenth), embedding."""
    cls = F.when(F.col("label") % 3 == 0, "ERROR").when(F.col("label") % 3 == 1, "WARN").otherwise("INFO")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("svc"), F.col("vec_id") % 3).alias("service"), cls.alias("class"), (F.col("vec_id") % 10 == 0).alias("manual"), "label", "embedding")


VECTORS_SQL = """vectors AS (
  SELECT vec_id AS id, 'svc' || (vec_id % 3) AS service, CASE label % 3 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'WARN' ELSE 'INFO' END AS class,
         vec_id % 10 = 0 AS manual, label, embedding FROM embeddings)"""
