"""A corpus pipeline of five stages over documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs.  All but the last
return the columns of documents; the last adds row_number, position, shard and
slot.  Nulls, empty texts, repeated rows and empty tables have the results that
the operators' modules state: language ID drops null and blank texts and what no
language explains, the other stages keep what they have no evidence against.
Columns of any name pass the first four stages unchanged.  ``run`` deletes a
stage's tables in the shared folder when the next stage is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellumine.llm import decontaminate, langid, mixing, neardup, sharding
from vellumine.llm.storage import collected, delete, written
from vellumine.ship import ship


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that some language explains."""
    ship(spark)
    return langid.accepted_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, and all that have none."""
    ship(spark)
    return neardup.one_of_each_group(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return decontaminate.clean_documents(docs, ship(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the target weights of their sources ask, each at least once."""
    ship(spark)
    return mixing.repeated(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their place in the shuffled shards."""
    ship(spark)
    return sharding.sharded(docs)


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mix),
    ("sharding", shard),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for k, (_, stage) in enumerate(STAGES):
        if k == len(STAGES) - 1:
            return stage(spark, docs, sf_dir)
        with collected() as used:
            docs = written(stage(spark, docs, sf_dir), f"stage{k}")
        delete(spark, [*before, *used[:-1]])
        before = used[-1:]
    return docs
