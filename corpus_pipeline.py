"""The corpus pipeline: documents → language ID → near-dedup → decontamination →
mixing → shards.  Every stage is written as Parquet and read again by the next.

All stages read whole texts, keep the columns of documents (also those named like
columns of the stages' own) and give an empty table for an empty one."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kitman.llm import decontaminate, langid, mixing, sharding, simhash
from kitman.llm.common import save, table

SHARDS = 24


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a language that the corpus itself teaches; the rest goes: null
    texts, texts without a letter, and those of too few known trigrams for their
    length.  Ties go to the first language by name; repeated rows go or stay together."""
    return langid.identified(docs, langid.fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies; empty texts
    are one group; rows that repeat an id go or stay together, rows without one stay."""
    return simhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item.  Empty texts and items match nothing;
    an item at the threshold is contained; repeated rows go or stay together."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every source at equal weight, as many bytes as came in; copies are rows.  Null
    is a source; empty texts are drawn like others; rows of one id draw the same count."""
    return mixing.mix_sources(docs).select(*docs.columns)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shards of nearly equal bytes: the documents' columns, shard and slot.  Null texts
    count as empty, null ids come first, rows equal in text and id are divided if they
    are too many for a shard."""
    return sharding.shard(docs, SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminated),
    ("mix", mixed),
    ("shard", sharded),
]

#: Trained and hashed stages have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
    return save(STAGES[-1][1](spark, docs, sf_dir), f"stage-{STAGES[-1][0]}")
