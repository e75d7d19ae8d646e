"""The corpus pipeline: documents to a mixed, sharded training set.

Each stage is written as Parquet and read again before the next one. All but the last return the columns of
``documents``; the last says where every kept (and, by the mix, perhaps repeated) document goes. Stages carry columns of any
other name along, give no rows for an empty table, and read whole texts of any length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from depchron.llm import decontamination, mixing, neardup, quality, sharding
from depchron.sources.work import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and whose host passes them. A null or empty text fails; a null source is a host; repeated rows each count."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that of the smallest id. Rows with a null id or text stay; of rows that share an id, one."""
    return neardup.keep_first(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is benchmark text. Null texts stay; with an empty benchmark all do."""
    return decontamination.remove_documents(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their weights; a document comes up to twice. Rows without id or words are no part of a mix."""
    return mixing.mixed(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each document of the mix; repeats get places of their own. Null sources are a source."""
    return sharding.shard(docs.select("doc_id", "source", "lang", "n_chars"))


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("mixing to target weights", mixture),
    ("sharding", shards),
]

#: Near-duplicates are found by a seeded sketch, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{k}")
    return docs
