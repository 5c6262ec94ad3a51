"""Schemas of entities, layers and change logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BBOX = "struct<xmin: double, ymin: double, xmax: double, ymax: double>"
XYWH = "struct<x: double, y: double, width: double, height: double>"
ORD = "struct<page: int, y: double, layer: int, source: bigint, row: int, col: int>"
ENTITY_COLUMNS = {
    "doc_id": "string", "id": "string", "type": "string", "text": "string", "value_num": "double", "value_str": "string", "bbox": BBOX, "page_index": "int",
    "table_id": "string", "row_index": "int", "col_index": "int", "verified": "boolean", "verification_status": "string", "verified_by": "string", "verified_at": "bigint",
    "confidence": "double", "was_corrected": "boolean", "correction_type": "string", "source": "string", "processor_type": "string", "flag_reason": "string", "flagged_by": "string", "flagged_at": "bigint",
    "highlight": "boolean", "selected": "boolean", "extra": "map<string,string>", "data": "map<string,string>", "ord": ORD,
}
ENTITIES = ", ".join(f"{k} {v}" for k, v in ENTITY_COLUMNS.items())
CHANGES = "doc_id string, entity_id string, ord " + ORD + ", page_index int, field string, old_value string, new_value string, seq bigint, timestamp bigint"
#: Attribute name: column and kind.
META = {
    "verified": ("verified", "bool"), "verificationStatus": ("verification_status", "str"), "verifiedBy": ("verified_by", "str"), "verifiedAt": ("verified_at", "num"),
    "confidence": ("confidence", "num"), "wasCorrected": ("was_corrected", "bool"), "correctionType": ("correction_type", "str"), "source": ("source", "str"), "processorType": ("processor_type", "str"),
    "flagReason": ("flag_reason", "str"), "flaggedBy": ("flagged_by", "str"), "flaggedAt": ("flagged_at", "num"), "highlight": ("highlight", "bool"), "selected": ("selected", "bool"),
}
FIELDS = {
    "id": ("id", "str"), "type": ("type", "str"), "text": ("text", "str"), "value": ("value_num", "value"), "bbox": ("bbox", "object"), "pageIndex": ("page_index", "num"),
    "tableId": ("table_id", "str"), "rowIndex": ("row_index", "num"), "colIndex": ("col_index", "num"),
}
TABLE_LAYER = f"doc_id string, pos bigint, id string, page_number int, markdown string, bbox {BBOX}, confidence double, verification_status string, verified_by string, verified_at string, was_corrected boolean"
FIELD_LAYER = f"doc_id string, pos bigint, id string, page_number int, field_label string, suggested_value string, suggested_value_numeric double, verified_value string, confidence double, bounding_box {XYWH}, verification_status string, verified_at string, was_corrected boolean, flag_reason string, flagged_at string, row_index int"
EXTRACTED_LAYER = f"doc_id string, pos bigint, id string, type string, title string, page int, bbox {XYWH}, caption string, confidence double, verification_status string"
OCR_LAYER = f"doc_id string, pos bigint, id string, page int, text string, bbox {XYWH}, confidence double, verification_status string"
MARKDOWN_LAYER = "doc_id string, pos bigint, id string, page int, content string, confidence double, model string, verification_status string"


def columns_of(schema: str) -> dict[str, str]:
    """Names and types of a flat DDL string."""
    out, depth, part = {}, 0, ""
    for c in schema + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            name, kind = part.strip().split(" ", 1)
            out[name], part = kind, ""
        else:
            part += c
    return out


def conformed(df: DataFrame, schema: str) -> DataFrame:
    """The columns of a schema, missing ones as nulls, others dropped."""
    have = set(df.columns)

    def one(n: str, t: str) -> Column:
        if n not in have:
            return F.lit(None).cast(t)
        if t.startswith("struct<"):  # by name
            fields = [part.split(":") for part in t[7:-1].split(",")]
            return F.when(F.col(n).isNotNull(), F.struct(*(F.col(n)[f.strip()].cast(k.strip()).alias(f.strip()) for f, k in fields)))
        return F.col(n).cast(t)

    return df.select(*(one(n, t).alias(n) for n, t in columns_of(schema).items()))


def make_ord(page: Column, y: Column, layer: Column | int, source: Column, row: Column | int = 0, col: Column | int = 0) -> Column:
    """The order key: page, vertical position, layer, place in the input, row and column."""
    as_int = lambda v: (F.lit(v) if isinstance(v, int) else v).cast("int")
    return F.struct(page.cast("int").alias("page"), y.cast("double").alias("y"), as_int(layer).alias("layer"), source.cast("bigint").alias("source"), as_int(row).alias("row"), as_int(col).alias("col"))
