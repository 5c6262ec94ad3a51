"""The driver's tables as canonical entities, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import detect, js
from .schema import BBOX, ENTITY_COLUMNS, OCR_LAYER, make_ord

_TYPES = {"purchase": "currency", "view": "text", "click": "label", "signup": "header", "error": "footnote"}
_STATUS = ("pending", "verified", "flagged", "rejected", "skipped")


def events_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An entity for each event: a user is a document, a day a page."""
    return entities_of_events(spark.read.parquet(f"{sf_dir}/events.parquet"))


def entities_of_events(events: DataFrame) -> DataFrame:
    """Entities of a table or stream of events."""
    n = F.col("event_id")
    kind, status = F.lit("unknown"), F.lit(_STATUS[4])
    for k, v in _TYPES.items():
        kind = F.when(F.col("event_type") == k, v).otherwise(kind)
    for i, v in enumerate(_STATUS[:4]):
        status = F.when(n % 5 == i, v).otherwise(status)
    click = F.col("event_type") == "click"
    x, y = (n % 10) / 10.0, (n % 97) / 100.0
    box = F.struct(x.alias("xmin"), y.alias("ymin"), (x + 0.05).alias("xmax"), (y + 0.01).alias("ymax"))
    out: dict[str, Column] = {
        "doc_id": F.col("user_id"), "id": F.concat(F.lit("e"), n.cast("string")), "type": kind, "text": F.concat("event_type", F.lit(" "), "props"), "value_num": F.when(F.col("event_type") == "purchase", F.col("value")),
        "bbox": box, "page_index": F.dayofmonth("ts") - 1, "table_id": F.when(click, F.concat(F.lit("t"), (n % 7).cast("string"))), "row_index": F.when(click, n % 11), "col_index": F.when(click, n % 3),
        "verified": n % 5 == 1, "verification_status": status, "confidence": (50 + n % 50) / 100.0, "was_corrected": F.lit(False), "source": F.lit("ocr"), "flag_reason": F.when(n % 5 == 2, F.concat(F.lit("reason"), (n % 3).cast("string"))),
        "ord": make_ord(F.lit(0), F.lit(0.0), 0, n),
    }
    return events.select(*(out.get(c, F.lit(None)).cast(t).alias(c) for c, t in ENTITY_COLUMNS.items()))


EVENTS_SQL = """
e AS (SELECT event_id AS n, user_id::VARCHAR AS doc_id, 'e' || event_id AS id,
  CASE event_type WHEN 'purchase' THEN 'currency' WHEN 'view' THEN 'text' WHEN 'click' THEN 'label' WHEN 'signup' THEN 'header' WHEN 'error' THEN 'footnote' ELSE 'unknown' END AS type,
  event_type || ' ' || props AS text, CASE WHEN event_type = 'purchase' THEN value END AS value_num,
  (event_id % 10) / 10.0::DOUBLE AS xmin, (event_id % 97) / 100.0::DOUBLE AS ymin, (day(ts) - 1)::INTEGER AS page_index,
  CASE WHEN event_type = 'click' THEN 't' || (event_id % 7) END AS table_id, CASE WHEN event_type = 'click' THEN (event_id % 11)::INTEGER END AS row_index, CASE WHEN event_type = 'click' THEN (event_id % 3)::INTEGER END AS col_index,
  event_id % 5 = 1 AS verified, CASE event_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'verified' WHEN 2 THEN 'flagged' WHEN 3 THEN 'rejected' ELSE 'skipped' END AS status,
  (50 + event_id % 50) / 100.0::DOUBLE AS confidence, CASE WHEN event_id % 5 = 2 THEN 'reason' || (event_id % 3) END AS flag_reason FROM events)
"""


def line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An OCR block for each line with text of each document, twenty lines a page."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lines = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "text")).where(js.trim(F.col("text")) != "")
    k = F.col("pos")
    box = F.struct(F.lit(0.0).alias("x"), ((k % 20) / 20.0).alias("y"), F.lit(1.0).alias("width"), F.lit(0.05).alias("height"))
    out = {"id": F.concat(F.lit("l"), k.cast("string")), "page": F.floor(k / 20) + 1, "bbox": box, "confidence": (80 + k % 20) / 100.0, "verification_status": F.lit("pending")}
    return lines.select("doc_id", k.cast("bigint").alias("pos"), out["id"].alias("id"), out["page"].cast("int").alias("page"), "text", out["bbox"].alias("bbox"), out["confidence"].alias("confidence"), out["verification_status"].alias("verification_status"))


def line_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type and value of each line and of each word of the documents' lines."""
    lines = line_blocks(spark, sf_dir)
    words = lines.select("doc_id", F.explode(F.split("text", " ", -1)).alias("text")).where("text <> ''").unionByName(lines.select("doc_id", "text"))
    kinds = words.withColumn("t", js.trim(F.col("text"))).withColumn("type", detect.trimmed_type(F.col("t")))
    return kinds.select("doc_id", "text", "type", detect.typed_value(F.col("text"), F.col("type")).alias("value"))


def order_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A Markdown table for each order, a row for each line item."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    price = F.concat(F.lit("$"), F.floor(cents / 100).cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))
    row = F.concat(F.lit("| p"), F.col("l_partkey").cast("string"), F.lit(" | "), price, F.lit(" | "), F.round(F.col("l_discount") * 100).cast("int").cast("string"), F.lit("% | "), F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit(" |"))
    key = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", row.alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(key)), lambda x: x["line"])
    text = F.concat(F.lit("| part | price | discount | shipped |\n|---|---|---|---|\n"), F.array_join(lines, "\n"))
    box = F.struct(F.lit(0.0).alias("xmin"), F.lit(0.0).alias("ymin"), F.lit(1.0).alias("xmax"), F.lit(1.0).alias("ymax"))
    t = items.groupBy("l_orderkey").agg(text.alias("markdown"))
    return t.select(F.col("l_orderkey").cast("string").alias("doc_id"), F.lit(0).cast("bigint").alias("pos"), F.lit("t").alias("id"), F.lit(1).alias("page_number"), "markdown", box.alias("bbox"), F.lit(0.9).alias("confidence"), F.lit("pending").alias("verification_status"))


__all__ = ["BBOX", "EVENTS_SQL", "OCR_LAYER", "events_entities", "line_blocks", "line_types", "order_tables"]
