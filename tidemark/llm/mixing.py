"""Mixing sources to target weights by weighted fair queueing.

The documents of each source are shuffled by the md5 of their id and text.  A copy's virtual finish time is the source's
tokens up to and with it, divided by the source's target; copies of later epochs follow after the whole source.  All
copies are range-sorted by their finish times, and the mix ends before the first copy with which the tokens so far would
pass the total budget.

Both sums, that along each source and that along the mix, are sums over ranges of a sorted table (``running``): no source
and no key is a group of its own.  Rows get a number when their sizes are written, which tells equal rows apart.

Defined results: a null text has size 0; a document of size 0 is never taken; very long texts are counted whole; null is a source, the last in order; equal
rows are rows of their own, each with its own place; reruns agree, but for which of several rows of equal id and text is
taken; an empty table gives an empty result; other columns are ignored by ``mix_sources`` and kept by ``mixed``, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._spark import WORD, materialize, partitions, running, text_or_empty, whole

#: Weights of sources in the order of their names, over and over.
WEIGHTS = (5, 2, 1)
#: A document is taken so often at most.
EPOCHS = 3


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size, target and ahead of each source, from rows with source and size.

    Targets share the total by weight; a source that would pass ``epochs`` times its size gets just that, and what is
    left over is shared again.  In the order of (epochs * size / weight) the full sources come first, so one pass over
    the sources finds them.  There is a row for each source, and ``ahead`` has the tokens of those before it in order.  The
    windows are over the sources, whose number is small against that of documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    i = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), i + 1).cast("double"))
    per = per.withColumn("most", (F.col("source_size") * epochs).cast("double"))
    fill = Window.orderBy((F.col("most") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    every = fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(every).cast("double")
    left = total - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    weight_left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    per = per.withColumn("share", left / weight_left)
    full = F.col("most") <= F.col("weight") * F.col("share")
    # the sources that are not full all share what the first of them found
    level = F.min(F.when(~full, F.struct(F.col("most") / F.col("weight"), F.col("share")))).over(every)["share"]
    per = per.withColumn("target", F.when(full, F.col("most")).otherwise(F.col("weight") * level))
    ahead = F.sum("source_size").over(by_name.rowsBetween(Window.unboundedPreceding, 0)) - F.col("source_size")
    return per.withColumn("ahead", ahead).select("source", "source_size", "target", "ahead")


def sizes_of(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, source, size (words) and key (of the shuffle) of each document, and the columns named."""
    key = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text_or_empty()).cast("binary"))
    return docs.select("doc_id", "source", F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"), key.alias("key"), *more)


def _queued(sizes: DataFrame, weights: tuple[int, ...], epochs: int) -> DataFrame:
    """Rows of ``sizes`` with source_size, target and upto: the source's tokens up to and with the row, in the first epoch."""
    targets = materialize(source_targets(sizes, weights, epochs), "targets")
    order = [F.col("source").asc_nulls_last(), F.col("key"), F.col("row")]
    rows = running(sizes, order, "size", "upto")
    # the number of sources is small, but it isn't bounded: Spark chooses the join
    rows = rows.join(targets.withColumnRenamed("source", "s"), rows["source"].eqNullSafe(F.col("s"))).drop("s")
    return rows.withColumn("upto", F.col("upto") - F.col("ahead")).drop("ahead")


def _mix(sizes: DataFrame, weights: tuple[int, ...], epochs: int) -> DataFrame:
    """A row for each copy of each document of some size, with finish, epoch, and whether the mix takes it."""
    queued = _queued(sizes, weights, epochs).filter("size > 0")
    copies = queued.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    copies = copies.withColumn("finish", (F.col("epoch") * F.col("source_size") + F.col("upto")) / F.col("target"))
    order = [F.col("finish"), F.col("key"), F.col("epoch"), F.col("source").asc_nulls_last(), F.col("upto")]
    budget = sizes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    return running(copies, order, "size", "so_far").withColumn("taken", F.col("so_far") <= budget)


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies of each document."""
    sizes = materialize(sizes_of(docs).withColumn("row", F.monotonically_increasing_id()), "sizes")
    first = {c: F.first(c).alias(c) for c in ("doc_id", "size", "source_size", "target")}
    taken = _mix(sizes, weights, epochs).groupBy("row").agg(*first.values(), F.count_if("taken").cast("int").alias("copies")).drop("row")
    targets = source_targets(sizes, weights, epochs).withColumnRenamed("source", "s")
    empty = sizes.filter("size = 0").join(targets, sizes["source"].eqNullSafe(F.col("s"))).select(*first, F.lit(0).alias("copies"))
    return taken.unionByName(empty).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """The mix: the columns and values of ``docs``, a row for each copy taken, range-sorted by virtual finish time."""
    # the documents are written with their numbers: they meet their copies by these alone, which no two rows share
    held = materialize(sizes_of_rows(docs), "documents")
    taken = _mix(held.drop("whole"), weights, epochs).filter("taken").select("row", "finish")
    copies = held.select("row", "whole").join(taken, "row")
    return copies.repartitionByRange(partitions(docs.sparkSession), "finish", "row").sortWithinPartitions("finish", "row").select("whole.*")


def sizes_of_rows(docs: DataFrame) -> DataFrame:
    """``sizes_of`` with the whole row and its number."""
    return sizes_of(docs.select("doc_id", "source", "text", whole(docs).alias("whole")), "whole").withColumn("row", F.monotonically_increasing_id())


#: The same mix in SQL over a table ``documents``: sizes, targets by filling, finish times, and the cut at the total.
ORACLE = r"""
WITH sizes AS (SELECT row_number() OVER () AS rid, doc_id, source, md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS key, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size, (CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS weight FROM sizes GROUP BY source),
filled AS (SELECT *, 3.0::DOUBLE * source_size AS most,
    (sum(source_size) OVER ()::DOUBLE - coalesce(sum(3.0::DOUBLE * source_size) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS share
    FROM per WINDOW before AS (ORDER BY 3.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (SELECT source, source_size, CASE WHEN most <= weight * share THEN most ELSE weight * (SELECT arg_min(share, most / weight) FROM filled WHERE most > weight * share) END AS target FROM filled),
queue AS (SELECT s.*, t.source_size, t.target, sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, s.rid ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
    FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
copies AS (SELECT *, (e * source_size + upto)::DOUBLE / target AS finish FROM queue, range(3) r(e) WHERE size > 0),
mix AS (SELECT *, sum(size) OVER (ORDER BY finish, key, e, source NULLS LAST, upto ROWS UNBOUNDED PRECEDING) AS so_far FROM copies),
taken AS (SELECT rid, count(*) AS n FROM mix WHERE so_far <= (SELECT sum(size) FROM sizes) GROUP BY rid)
SELECT q.doc_id, q.size, q.source_size, q.target, (q.size * coalesce(t.n, 0))::BIGINT AS taken, coalesce(t.n, 0)::INT AS copies FROM queue q LEFT JOIN taken t USING (rid)
"""
