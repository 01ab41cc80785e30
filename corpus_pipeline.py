"""The corpus pipeline: quality rules, near-duplicates, personal data, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept.  ``run`` writes each stage's result to
the shared folder and reads it again, so a lost executor costs a stage's tasks and not the stages before it.  What a
stage wrote for itself is deleted once its result is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm._spark import materialize, scratch
from tidemark.llm.bpe import bpe_round_trip
from tidemark.llm.mixing import mixed
from tidemark.llm.pii import sanitised
from tidemark.llm.quality_rules import kept_documents
from tidemark.llm.queries import BYTE_BPE, vocabulary
from tidemark.llm.simhash import representatives


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return kept_documents(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return representatives(docs)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without personal data and revealing terms."""
    return sanitised(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources by target weights; a document is there once for each copy taken."""
    return mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and hashes of ids and of decoded texts."""
    return bpe_round_trip(docs, vocabulary(BYTE_BPE))


STAGES = [("quality rules", quality), ("near-duplicates", dedup), ("personal data", sanitise), ("mix", mix), ("bpe", encode)]

#: Near-duplicate components and BPE can't be said in SQL; the tests hold ``run`` against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"), keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
