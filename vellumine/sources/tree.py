"""Nested inspector trees, as JSON, flattened to entities.

A node has id, type, page, textContent, bbox, attributes, data and children.
Nodes are visited parents first; documents, pages and nodes without a box are
no entities, but their children are visited.  Spark has no recursive type, so
the walk is an Arrow batch function.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.layers import page_meta
from .schema import BBOX, ENTITY_COLUMNS, make_ord

_WALKED = f"doc_id string, seq bigint, id string, kind string, text string, bbox {BBOX}, page int, confidence double, data string"
TYPES = {"table": "table", "figure": "figure", "ocr-block": "ocr", "footnote": "footnote", "summary": "markdown", "heading": "header", "paragraph": "text", "signature": "text", "form": "text", "list": "text", "header": "header"}


def walk(root: dict[str, Any], include_ocr: bool, confidence: float) -> Iterator[dict[str, Any]]:
    """Entities of a tree, parents first; an excluded OCR block hides what is below it."""
    todo, seq = [root], 0
    while todo:
        n = todo.pop()
        kind, box = n.get("type"), n.get("bbox")
        if kind not in ("document", "page") and box:
            if kind == "ocr-block" and not include_ocr:
                continue
            given = (n.get("attributes") or {}).get("data-confidence")
            sure = float(given) if isinstance(given, (int, float)) and not isinstance(given, bool) else confidence
            edges = {"xmin": float(box["x"]), "ymin": float(box["y"]), "xmax": float(box["x"] + box["width"]), "ymax": float(box["y"] + box["height"])}
            data = n.get("data")
            yield {"seq": seq, "id": n.get("id"), "kind": kind, "text": n.get("textContent") or "", "bbox": edges, "page": n.get("page"), "confidence": sure, "data": None if data is None else json.dumps({k: json.dumps(v) for k, v in data.items()})}
            seq += 1
        todo.extend(reversed(n.get("children") or []))


def tree_entities(trees: DataFrame, include_ocr: bool = True, default_confidence: float = 0.9) -> DataFrame:
    """Entities of trees (doc_id, tree: JSON text), in the order of the walk; a null tree has none."""

    def flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [("doc_id", pa.string()), ("seq", pa.int64()), ("id", pa.string()), ("kind", pa.string()), ("text", pa.string()), ("bbox", pa.struct([(c, pa.float64()) for c in ("xmin", "ymin", "xmax", "ymax")])), ("page", pa.int32()), ("confidence", pa.float64()), ("data", pa.string())]
        for batch in batches:
            rows = [{"doc_id": d, **x} for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if t for x in walk(json.loads(t), include_ocr, default_confidence)]
            yield pa.RecordBatch.from_pylist(rows, pa.schema(fields))

    w = trees.select("doc_id", "tree").mapInArrow(flatten, _WALKED)
    types = F.create_map(*(F.lit(x) for kv in TYPES.items() for x in kv))
    out = {
        "doc_id": F.col("doc_id"), "id": F.col("id"), "type": F.coalesce(F.try_element_at(types, F.col("kind")), F.lit("unknown")), "text": F.col("text"), "bbox": F.col("bbox"), "page_index": F.col("page") - 1,
        "verified": F.lit(False), "verification_status": F.lit("pending"), "confidence": F.col("confidence"), "was_corrected": F.lit(False), "source": F.lit("ocr"), "processor_type": F.lit("ocr"),
        "data": F.from_json("data", "map<string,string>"), "ord": make_ord(F.col("page"), F.lit(0.0), 0, F.col("seq")),
    }
    return w.select(*(out.get(c, F.lit(None)).cast(t).alias(c) for c, t in ENTITY_COLUMNS.items()))


def tree_pages(entities: DataFrame) -> DataFrame:
    """Pages with entities; verified counts the flag, not the status."""
    n = F.col("page_index") + 1
    return page_meta(entities, verified=F.coalesce("verified", F.lit(False))).withColumn("page_number", n).withColumn("id", F.concat(F.lit("page-"), n.cast("string")))


def page_count(trees: DataFrame) -> DataFrame:
    """Columns doc_id, page_count: the greatest page of any node, at least 0."""

    def greatest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = []
            for t in batch.column(1).to_pylist():
                most, todo = 0, [json.loads(t)] if t else []
                while todo:
                    n = todo.pop()
                    most = max(most, n.get("page") or 0)
                    todo.extend(n.get("children") or [])
                counts.append(most)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "page_count": pa.array(counts, pa.int32())})

    return trees.select(F.col("doc_id").cast("string"), "tree").mapInArrow(greatest, "doc_id string, page_count int")
