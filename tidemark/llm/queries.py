"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .bpe import bpe_round_trip
from .conversations import conversation_repairs
from .decontamination import ORACLE as HITS_SQL
from .decontamination import contamination
from .lexical import ORACLE as RANKED_SQL
from .lexical import ranked
from .licenses import license_matches
from .media import media_columns
from .mixing import ORACLE as MIX_SQL
from .mixing import mix_sources
from .pii import personal_spans
from .quality_fm import quality_scores
from .quality_rules import oracle as quality_sql
from .quality_rules import quality_rules
from .simhash import near_duplicates
from .token_counts import token_counts
from .token_store import token_store

#: Names of the vocabularies among the public tokenizers.
BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_documents(spark, sf_dir))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_documents(spark, sf_dir))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_spans(_documents(spark, sf_dir))


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store(_documents(spark, sf_dir), vocabulary(WORD_BPE), end=1)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_documents(spark, sf_dir), vocabulary(BYTE_BPE), limit=512)


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(_documents(spark, sf_dir))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_matches(_documents(spark, sf_dir))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_round_trip(_documents(spark, sf_dir), vocabulary(BYTE_BPE))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repairs(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {f.__name__: f for f in (op1_quality_fm, op2_quality_rules, op3_mix_sources, op4_simhash, op5_pii, op6_token_store, op7_token_counts, op8_media, op9_licenses, op10_bpe, op11_decontamination, op12_conversations, op13_lexical)}
ORACLES: dict[str, str] = {"op2_quality_rules": quality_sql(), "op3_mix_sources": MIX_SQL, "op11_decontamination": HITS_SQL, "op13_lexical": RANKED_SQL}
