"""Responses of an extraction API: normalisers, JSON loaders and HTTP readers."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .schema import XYWH

ENTITIES_RESPONSE = f"entities array<struct<id: string, type: string, title: string, page: int, bbox: {XYWH}, caption: string, confidence: double, verification_status: string>>"
PAGE_RESPONSE = f"page int, blocks array<struct<text: string, bbox: {XYWH}, confidence: double>>, content string, metadata struct<tables: array<struct<bbox: {XYWH}>>>"
Opener = Callable[[str], bytes]


def _full_page() -> Any:
    return F.struct(*(F.lit(v).alias(n) for n, v in (("x", 0.0), ("y", 0.0), ("width", 1.0), ("height", 1.0))))


def extracted_layer(responses: DataFrame) -> DataFrame:
    """Entities responses (doc_id, entities) as an extracted layer; without a box an entity covers the page."""
    e = responses.select("doc_id", F.posexplode("entities").alias("pos", "e")).select("doc_id", "pos", "e.*")
    return e.withColumn("bbox", F.coalesce("bbox", _full_page()))


def ocr_layer(responses: DataFrame) -> DataFrame:
    """Page responses as an OCR layer; confidence 0.9 if missing."""
    b = responses.select("doc_id", "page", F.posexplode("blocks").alias("pos", "b"))
    name = F.concat(F.lit("ocr-"), F.col("page").cast("string"), F.lit("-"), F.col("pos").cast("string"))
    return b.select("doc_id", "pos", name.alias("id"), "page", "b.text", "b.bbox", F.coalesce("b.confidence", F.lit(0.9)).alias("confidence"), F.lit("pending").alias("verification_status"))


def markdown_layer(responses: DataFrame, model: str = "llamaparse") -> DataFrame:
    """Page responses as a Markdown layer."""
    name = F.concat(F.lit("md-"), F.col("page").cast("string"))
    return responses.select("doc_id", F.lit(0).cast("bigint").alias("pos"), name.alias("id"), "page", "content", F.lit(0.95).alias("confidence"), F.lit(model).alias("model"), F.lit("pending").alias("verification_status"))


def table_layer(responses: DataFrame) -> DataFrame:
    """Table places of page responses as a table layer without text."""
    t = responses.select("doc_id", "page", F.posexplode("metadata.tables").alias("pos", "t"))
    b = F.coalesce("t.bbox", _full_page())
    box = F.struct(b["x"].alias("xmin"), b["y"].alias("ymin"), (b["x"] + b["width"]).alias("xmax"), (b["y"] + b["height"]).alias("ymax"))
    name = F.concat(F.lit("table-"), F.col("page").cast("string"), F.lit("-"), F.col("pos").cast("string"))
    return t.select("doc_id", "pos", name.alias("id"), F.col("page").alias("page_number"), F.lit("").alias("markdown"), box.alias("bbox"), F.lit(0.9).alias("confidence"), F.lit("pending").alias("verification_status"))


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Multi-line JSON files with doc_id, the path of the file."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path).withColumn("doc_id", F.col("_metadata.file_path"))


def load_entities(spark: SparkSession, value: dict[str, Any], doc_id: str = "doc") -> DataFrame:
    """A parsed entities response; ValueError without its list."""
    if not isinstance(value.get("entities"), list):
        raise ValueError("the response has no list of entities")
    return extracted_layer(_one(spark, value, ENTITIES_RESPONSE, doc_id))


def load_page(spark: SparkSession, value: dict[str, Any], doc_id: str = "doc") -> DataFrame:
    """A parsed page response; ValueError without a page number."""
    if isinstance(value.get("page"), bool) or not isinstance(value.get("page"), (int, float)):
        raise ValueError("the response has no page number")
    return _one(spark, value, PAGE_RESPONSE, doc_id)


def _one(spark: SparkSession, value: dict[str, Any], schema: str, doc_id: str) -> DataFrame:
    text = spark.createDataFrame([(doc_id, json.dumps(value))], "doc_id string, raw string")
    return text.select("doc_id", F.from_json("raw", schema).alias("v")).select("doc_id", "v.*")


def open_url(url: str) -> bytes:
    """A GET for JSON; HTTP errors raise."""
    request = urllib.request.Request(url, headers={"accept": "application/json"})
    with urllib.request.urlopen(request, timeout=60) as r:
        return r.read()


def entities_url(base: str, job: str) -> str:
    """Address of a job's entities."""
    return f"{base.rstrip('/')}/api/ocr/jobs/{job}/entities?type=all"


def page_url(base: str, job: str, page: int) -> str:
    """Address of a page of a job."""
    return f"{base.rstrip('/')}/api/ocr/jobs/{job}/pages/{page}"


def fetch_entities(spark: SparkSession, job: str, base: str, opener: Opener = open_url) -> DataFrame:
    """A job's entities, fetched on the driver."""
    return load_entities(spark, json.loads(opener(entities_url(base, job))), job)


def fetch_page(spark: SparkSession, job: str, page: int, base: str, opener: Opener = open_url) -> DataFrame:
    """One page of a job, fetched on the driver."""
    return load_page(spark, json.loads(opener(page_url(base, job, page))), job)


class _Page(InputPartition):
    def __init__(self, page: int) -> None:
        self.page = page


class _PagesReader(DataSourceReader):
    def __init__(self, options: dict[str, str], opener: Opener) -> None:
        self.options, self.opener = options, opener

    def partitions(self) -> list[InputPartition]:
        return [_Page(int(p)) for p in self.options["pages"].split(",")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        raw = self.opener(page_url(self.options["base"], self.options["job"], partition.page))
        yield self.options["job"], partition.page, raw.decode()


class PagesSource(DataSource):
    """``spark.read.format('extraction_pages')``: a task fetches a page.  Options base, job, pages."""

    opener: Opener = staticmethod(open_url)

    @classmethod
    def name(cls) -> str:
        return "extraction_pages"

    def schema(self) -> str:
        return "doc_id string, asked int, raw string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _PagesReader(dict(self.options), type(self).opener)


def fetch_pages(spark: SparkSession, job: str, pages: list[int], base: str, source: type[DataSource] = PagesSource) -> DataFrame:
    """Pages of a job, fetched side by side on the executors, with the place of each in ``pages``."""
    spark.dataSource.register(source)
    raw = spark.read.format(source.name()).options(base=base, job=job, pages=",".join(map(str, pages))).load()
    place = F.array_position(F.array(*(F.lit(p) for p in pages)), F.col("asked"))
    return raw.select("doc_id", place.alias("place"), F.from_json("raw", PAGE_RESPONSE).alias("v")).select("doc_id", "place", "v.*")
