"""Closing minutes: open counts, late and rejected lines, zero-filling, and the watermark of healthy sources.

A stream of lines and polls is advanced micro-batch by micro-batch.  What Spark's own watermark can't say is a few small
tables here, one version for each batch, in a folder that all executors share: a source that fails must stop holding the
watermark, late lines are a result and not a loss, and a minute without lines still closes, with zeros for the keys that
are known.  Each batch reads the version before it and writes its own, so a batch that is run again gives the same tables.

All of it is joins and sums over counts; a service's lines are summed by minute before they meet the state, so no service
is one task.  Rows of a batch (``kind``):

- ``line``: source, event_id, service, template, level, lts (local time).
- ``poll``: source, at (order of the polls), failed, upper (how far the poll looked), caught_up.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.counts import SERVICE_KEYS, dated, keyed
from ..sources.driver_tables import minute_number

# Polls that fail in a row until a source is failing, and minutes after which a closed minute is historic.
FAILING_AFTER, HISTORIC_AFTER = 3, 15

FEED = "kind string, source string, event_id bigint, service string, template string, level string, lts timestamp_ntz, at bigint, failed boolean, upper timestamp_ntz, caught_up boolean"
CLOSED = "service string, key string, minute bigint, n bigint, day date, hour int, historic boolean"
_STATE = {
    "sources": "source string, position bigint, upper bigint, caught_up boolean, errors bigint",
    "open": "service string, key string, minute bigint, n bigint",
    "hours": "service string, key string, hour bigint, first bigint",
    "services": "service string, first bigint",
    "ids": "source string, event_id bigint, minute bigint",
    "clock": "closed bigint",
}


def source_progress(before: DataFrame, feed: DataFrame) -> DataFrame:
    """source, position, upper, caught_up, errors after a batch.

    The position is the newest minute read.  Errors are the polls that failed since the last one that did not.
    """
    lines = feed.filter("kind = 'line'").groupBy("source").agg(F.max(minute_number()).alias("read"))
    good = feed.filter("kind = 'poll' AND NOT failed").groupBy("source").agg(F.max("at").alias("good"), F.max_by(minute_number("upper"), "at").alias("looked"), F.max_by("caught_up", "at").alias("done"))
    bad = feed.filter("kind = 'poll' AND failed").join(good.select("source", "good"), "source", "left").filter("good IS NULL OR at > good").groupBy("source").agg(F.count("*").alias("bad"))
    both = before.join(lines, "source", "full").join(good, "source", "full").join(bad, "source", "full")
    errors = F.when(F.col("good").isNull(), F.coalesce("errors", F.lit(0))).otherwise(0) + F.coalesce("bad", F.lit(0))
    return both.select(
        "source", F.greatest("position", "read").alias("position"), F.coalesce("looked", "upper").alias("upper"),
        (F.coalesce("done", "caught_up", F.lit(False)) & F.col("bad").isNull()).alias("caught_up"), errors.alias("errors"),
    )


def watermark(sources: DataFrame, delay: int = 0) -> DataFrame:
    """One row: the least mark of the healthy sources in minutes, of all sources if none is healthy, null without any.

    A source that has caught up stands where its poll looked to, others at their position.
    """
    mark = F.when(F.col("caught_up"), F.greatest("upper", "position")).otherwise(F.col("position"))
    healthy = F.min(F.when(F.col("errors") < FAILING_AFTER, mark))
    return sources.agg((F.coalesce(healthy, F.min(mark)) - delay).alias("mark"))


def fates(lines: DataFrame, closed: Column, ids: DataFrame, off: tuple[str, ...]) -> DataFrame:
    """The lines with their minute and fate: malformed, skipped_off, duplicate, late or counted.

    ``closed`` is the first minute that is still open.  A line is a duplicate if its source's event id was seen in an open
    minute, or comes again in the batch.
    """
    minute = minute_number()
    malformed = F.col("lts").isNull() | F.col("service").isNull() | F.col("template").isNull() | F.col("event_id").isNull()
    off_now = F.col("service").isin(*off) if off else F.lit(False)
    fate = F.when(malformed, "malformed").when(off_now, "skipped_off").when(minute < closed, "late")
    judged = lines.withColumn("minute", minute).withColumn("fate", fate)
    again = F.row_number().over(Window.partitionBy("source", "event_id").orderBy("minute", "service", "template", "level")) > 1
    fresh = judged.filter("fate IS NULL").withColumn("again", again)
    fresh = fresh.join(ids.select("source", "event_id", F.lit(True).alias("seen")), ["source", "event_id"], "left")
    fresh = fresh.withColumn("fate", F.when(F.col("again") | F.col("seen").isNotNull(), "duplicate").otherwise("counted")).drop("again", "seen")
    return judged.filter("fate IS NOT NULL").unionByName(fresh)


def closed_minutes(counts: DataFrame, hours: DataFrame, services: DataFrame, start: int, end: int) -> DataFrame:
    """service, key, day, hour, minute, n of the minutes from ``start`` up to before ``end``, silent ones as zero.

    A template has each minute from its first one in an hour to that hour's end, a service's own keys each from its first.
    """
    own = hours.select("service", "key", F.greatest("first", F.lit(start)).alias("a"), F.least(F.col("hour") * 60 + 59, F.lit(end - 1)).alias("b"))
    every = services.select("service", F.explode(F.array(*map(F.lit, SERVICE_KEYS))).alias("key"), F.greatest("first", F.lit(start)).alias("a"), F.lit(end - 1).alias("b"))
    grid = own.unionByName(every).filter("a <= b").select("service", "key", F.explode(F.sequence("a", "b")).alias("minute"))
    return dated(grid.join(counts, ["service", "key", "minute"], "left").withColumn("n", F.coalesce("n", F.lit(0))))


@dataclass
class MinuteClock:
    """Advances a stream and keeps its state and results under ``path``: closed minutes, fates, and versions of the state.

    ``off`` names services that are switched off; ``delay`` minutes are waited for behind every source; ``now`` is the
    minute against which closed ones are historic, by default the machine's (local time must then be the session's).
    """

    spark: SparkSession
    path: str
    off: tuple[str, ...] = ()
    delay: int = 0
    now: int | None = None

    def _at(self, batch: int, name: str) -> str:
        return f"{self.path}/state/{name}/batch={batch}"

    def _read(self, batch: int, name: str) -> DataFrame:
        if batch < 0:
            return self.spark.createDataFrame([], _STATE[name])
        return self.spark.read.schema(_STATE[name]).parquet(self._at(batch, name))

    def _write(self, df: DataFrame, batch: int, name: str) -> DataFrame:
        types = [f.split()[0] for f in _STATE[name].split(", ")]
        df.select(*types).write.mode("overwrite").parquet(self._at(batch, name))
        return self._read(batch, name)

    def _close(self, counts: DataFrame, hours: DataFrame, services: DataFrame, start: int, end: int, batch: int) -> None:
        now = F.floor(F.unix_timestamp() / 60) if self.now is None else F.lit(self.now)
        rows = closed_minutes(counts, hours, services, start, end).withColumn("historic", now - (F.col("minute") + 1) > HISTORIC_AFTER)
        rows.write.mode("overwrite").parquet(f"{self.path}/closed/batch={batch}")

    def advance(self, feed: DataFrame, batch: int) -> None:
        """One micro-batch."""
        before = {name: self._read(batch - 1, name) for name in _STATE}
        last = before["clock"].first()
        closed = last.closed if last else None  # of one row
        sources = self._write(source_progress(before["sources"], feed), batch, "sources")
        lines = fates(feed.filter("kind = 'line'"), F.lit(closed), before["ids"], self.off)
        # judged once, for the counts, the fates and the ids
        path = f"{self.path}/judged/batch={batch}"
        lines.select("source", "event_id", "service", "template", "level", "minute", "fate").write.mode("overwrite").parquet(path)
        judged = self.spark.read.parquet(path)
        judged.groupBy("service", "fate").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{self.path}/fates/batch={batch}")
        counted = judged.filter("fate = 'counted'")
        fresh = keyed(counted.groupBy("service", "template", "level", "minute").agg(F.count("*").alias("n"))).groupBy("service", "key", "minute").agg(F.sum("n").alias("n"))
        counts = before["open"].unionByName(fresh).groupBy("service", "key", "minute").agg(F.sum("n").alias("n"))
        hours = before["hours"].unionByName(fresh.filter("NOT startswith(key, '*')").select("service", "key", F.floor(F.col("minute") / 60).alias("hour"), F.col("minute").alias("first")))
        hours = hours.groupBy("service", "key", "hour").agg(F.min("first").alias("first"))
        services = before["services"].unionByName(fresh.select("service", F.col("minute").alias("first"))).groupBy("service").agg(F.min("first").alias("first"))
        mark = watermark(sources, self.delay).first().mark
        start = closed
        if start is None and mark is not None:
            least = services.agg(F.min("first")).first()[0]
            start = mark if least is None else min(least, mark)
        end = start if mark is None or start is None else max(start, mark)
        if end is not None and end > start:
            self._close(counts, hours, services, start, end, batch)
        else:
            self.spark.createDataFrame([], CLOSED).write.mode("overwrite").parquet(f"{self.path}/closed/batch={batch}")
        open_from = F.lit(end) if end is not None else F.lit(-(2**62))
        self._write(counts.filter(F.col("minute") >= open_from), batch, "open")
        self._write(hours.filter(F.col("hour") >= F.floor(open_from / 60)), batch, "hours")
        self._write(services, batch, "services")
        self._write(before["ids"].unionByName(counted.select("source", "event_id", "minute")).filter(F.col("minute") >= open_from), batch, "ids")
        self._write(self.spark.createDataFrame([(end,)] if end is not None else [], _STATE["clock"]), batch, "clock")

    def run(self, stream: DataFrame, checkpoint: str) -> None:
        """Advance a stream over what there is; the checkpoint tells which batches are done."""
        stream.writeStream.foreachBatch(self.advance).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    def finish(self, batch: int, upto: int) -> None:
        """Close what is open after ``batch`` up to before minute ``upto``: for the end of a stream."""
        state = {name: self._read(batch, name) for name in ("open", "hours", "services", "clock")}
        last = state["clock"].first()
        start = last.closed if last else state["services"].agg(F.min("first")).first()[0]
        if start is not None and upto > start:
            self._close(state["open"], state["hours"], state["services"], start, upto, batch + 1)

    def closed(self) -> DataFrame:
        return self.spark.read.schema(CLOSED).parquet(f"{self.path}/closed/*")

    def fates(self) -> DataFrame:
        """service, fate and n of all lines so far: late, malformed, skipped_off, duplicate and counted add up to all."""
        return self.spark.read.parquet(f"{self.path}/fates/*").groupBy("service", "fate").agg(F.sum("n").alias("n"))
