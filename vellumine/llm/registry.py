"""The queries of this subpackage, each over its whole table, and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship
from . import ann, decontaminate, langid, mixing, neardup, pii, sharding, simple8b, urlfilter, zipwarc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data set."""
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that leak benchmark items."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("t")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal spans of every document."""
    return pii.personal_spans(table(spark, sf_dir, "documents"))


def op3_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document in Simple-8b words."""
    return simple8b.coded(table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of near-duplicate groups."""
    return neardup.near_duplicate_groups(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document."""
    return sharding.sharded(table(spark, sf_dir, "documents")).select("doc_id", "row_number", "position", "shard", "slot")


def op6_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that match the URL of every page."""
    return urlfilter.filtered(table(spark, sf_dir, "pages"))


def op7_zipwarc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages, packed into archives and read back from them."""
    return zipwarc.round_trip(table(spark, sf_dir, "pages"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots of every use of every document."""
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "epoch", "block", "slot", "position")


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest neighbours of every vector."""
    return ann.neighbours(table(spark, sf_dir, "embeddings"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language and code length of every document."""
    return langid.identify(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_pii": op2_pii,
    "op3_simple8b": op3_simple8b,
    "op4_simhash": op4_simhash,
    "op5_sharding": op5_sharding,
    "op6_urlfilter": op6_urlfilter,
    "op7_zipwarc": op7_zipwarc,
    "op8_mixing": op8_mixing,
    "op9_neighbours": op9_neighbours,
    "op10_language": op10_language,
}
ORACLE: dict[str, str] = {
    "op5_sharding": sharding.sharding_sql(),
    "op6_urlfilter": urlfilter.filter_sql(),
    "op7_zipwarc": "SELECT page_id, url, html FROM pages",
    "op8_mixing": mixing.mixing_sql(),
}
