"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

#: A word: what lies between ASCII white space.  ``bytes.split()`` on UTF-8 cuts at exactly these bytes.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows that a worker handles at a time; Spark bounds a batch by bytes, and texts grow when they become Python objects.
BATCH_ROWS = 1000
#: Keys with over 1 / HOT_KEYS of all rows are hot: there are fewer than HOT_KEYS of them, whatever the data.
HOT_KEYS = 4096


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; set here only where it is unset (tests)."""
    conf = spark.sparkContext.getConf()
    folder = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = conf.get("spark.master", "local")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


_written: list[list[str]] = []


def materialize(df: DataFrame, tag: str, keep: bool = False, by: tuple[str, ...] = (), **options: int) -> DataFrame:
    """Write ``df`` to the shared folder, in parts ``by`` columns, and read it back: cuts lineage and survives lost executors.

    ``options`` are the writer's.  ``scratch`` deletes the table, unless it is to ``keep``.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark/{tag}-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **options).partitionBy(*by).parquet(path)
    if _written and not keep:
        _written[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that ``materialize`` wrote within it: for use around what reads and writes them last."""
    _written.append([])
    try:
        yield
    finally:
        for path in _written.pop():
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def slices(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows``."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def frame_slices(frames: Iterator[pd.DataFrame], rows: int = BATCH_ROWS) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for at in range(0, len(frame), rows):
            yield frame.iloc[at : at + rows]


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def whole(docs: DataFrame) -> Column:
    """A row with all its columns as one struct, so that no name made here can meet one of theirs."""
    return F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in docs.columns))


def joined(many: DataFrame, one: DataFrame, on: str, rows: str, total: int) -> DataFrame:
    """Inner join of ``many`` with ``one``, which has a row for each key, and in column ``rows`` how many of ``many`` bear it.

    Hot keys are broadcast: they have over 1 / ``HOT_KEYS`` of the ``total`` rows each, so there are fewer than
    ``HOT_KEYS`` of them.  All other keys are shuffled, and none of them can make a task heavy.
    """
    least = max(1, total // HOT_KEYS)
    hot, rest = one.filter(F.col(rows) > least).drop(rows), one.filter(F.col(rows) <= least).drop(rows)
    at_rest = many.join(F.broadcast(hot.select(on)), on, "left_anti").join(rest, on)
    return many.join(F.broadcast(hot), on).unionByName(at_rest)


def joined_by(many: DataFrame, one: DataFrame, on: str) -> DataFrame:
    """``joined`` where the rows of each key must be counted: only the hot keys, fewer than ``HOT_KEYS``, meet ``one``."""
    often = many.groupBy(on).agg(F.count("*").alias("n"))
    hot = F.broadcast(materialize(often.filter(F.col("n") > max(1, many.count() // HOT_KEYS)).select(on), "hot"))
    at_rest = many.join(hot, on, "left_anti").join(one, on)
    return many.join(F.broadcast(one.join(hot, on, "left_semi")), on).unionByName(at_rest)


def running(df: DataFrame, order: list[Column], value: str, upto: str) -> DataFrame:
    """Adds ``upto``: the sum of ``value`` over all rows up to and with each, in the order of ``order``; written.

    Rows are range-partitioned by the order, which is to be total, so that no key is too heavy for a task.  Each task sums
    its own range; what the ranges before it hold is a row for each partition.
    """
    spark, names = df.sparkSession, df.columns
    n = partitions(spark)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            if not len(batch):
                continue
            own = batch.column(value).to_numpy().cumsum() + done
            done = int(own[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * len(batch), pa.int32()), pa.array(own, pa.int64())], names=[*names, "_part", "_sum"])

    schema = StructType([*df.schema.fields, StructField("_part", IntegerType()), StructField("_sum", LongType())])
    rows = materialize(df.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(sums, schema), "running")
    ends = rows.groupBy("_part").agg(F.max("_sum").alias("_end"))
    # as many rows as shuffle partitions: a bounded table
    before = ends.select("_part", (F.sum("_end").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_end")).alias("_before"))
    return rows.join(F.broadcast(before), "_part").withColumn(upto, F.col("_sum") + F.col("_before")).drop("_part", "_sum", "_before")
