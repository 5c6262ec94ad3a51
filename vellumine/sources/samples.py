"""Small sample documents and service outputs of our own."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.layers import Compiled, LayerCompiler, Options
from . import adapters, schema

_BOX = {"x": 0.1, "y": 0.2, "width": 0.3, "height": 0.05}


def _corners(x0: float, y0: float, x1: float, y1: float) -> list[dict[str, float]]:
    return [{"x": x0, "y": y0}, {"x": x1, "y": y0}, {"x": x1, "y": y1}, {"x": x0, "y": y1}]


DOCUMENTS: dict[str, dict[str, Any]] = {
    "harvest-report": {
        "metadata": {"fileName": "harvest.pdf", "documentType": "report"},
        "entities": [
            {"id": "tb-1", "type": "table", "title": "Yields", "page": 1, "bbox": _BOX, "confidence": 0.97},
            {"id": "fg-1", "type": "figure", "title": "Rainfall", "caption": "Monthly rain in mm", "page": 2, "bbox": _BOX, "confidence": 0.88},
            {"id": "fn-1", "type": "footnote", "title": "(a) dry weight", "page": 2, "bbox": {**_BOX, "y": 0.95}},
        ],
        "tables": [
            {"id": "tb-1", "page_number": 1, "markdown": "| Crop | Tons | Share |\n|---|---|---|\n| Barley | 1,250 | 62.5% |\n| Oats | 750 | 37.5% |\n| Total | 2,000 | |", "bbox": {"xmin": 0.1, "ymin": 0.2, "xmax": 0.9, "ymax": 0.6}, "confidence": 0.97, "verification_status": "verified", "verified_at": "2024-03-01"},
        ],
    },
    "receipt": {
        "metadata": {"fileName": "receipt.pdf", "documentType": "receipt"},
        "entities": [],
        "tables": [{"id": "items", "page_number": 1, "markdown": "| Item | Price |\n|---|---|\n| Seed | $12.50 |\n| Rake | $30.00 |", "bbox": {"xmin": 0.0, "ymin": 0.3, "xmax": 1.0, "ymax": 0.6}, "confidence": 0.9, "verification_status": "pending"}],
        "fieldEntities": [
            {"id": "f-date", "page_number": 1, "field_label": "Purchase date", "suggested_value": "2024-05-06", "confidence": 0.99, "bounding_box": _BOX, "verification_status": "pending"},
            {"id": "f-total", "page_number": 1, "field_label": "Subtotal", "suggested_value": "$42.50", "suggested_value_numeric": 42.5, "confidence": 0.95, "bounding_box": {**_BOX, "y": 0.7}, "verification_status": "flagged", "flag_reason": "blurred"},
        ],
    },
}

SERVICE_OUTPUT: dict[str, Any] = {
    "textract": {
        "DocumentMetadata": {"Pages": 3},
        "Blocks": [
            {"Id": "p", "BlockType": "PAGE", "Page": 1},
            {"Id": "a", "BlockType": "LINE", "Text": "Net weight", "Confidence": 98.0, "Geometry": {"BoundingBox": {"Left": 0.1, "Top": 0.1, "Width": 0.2, "Height": 0.02}}, "Page": 1},
            {"Id": "b", "BlockType": "WORD", "Text": "12kg", "Geometry": {"BoundingBox": {"Left": 0.5, "Top": 0.1, "Width": 0.1, "Height": 0.02}}},
            {"Id": "t", "BlockType": "TABLE", "Confidence": 90.0, "Geometry": {"BoundingBox": {"Left": 0.0, "Top": 0.4, "Width": 1.0, "Height": 0.3}}, "Page": 2},
            {"Id": "k", "BlockType": "KEY_VALUE_SET", "Geometry": {"BoundingBox": {"Left": 0.0, "Top": 0.4, "Width": 1.0, "Height": 0.3}}},
        ],
    },
    "docai": {
        "text": "Barley 12\nOats 7",
        "pages": [
            {"pageNumber": 1, "lines": [
                {"layout": {"textAnchor": {"textSegments": [{"endIndex": "10"}]}, "boundingPoly": {"normalizedVertices": _corners(0.1, 0.1, 0.4, 0.2)}, "confidence": 0.9}},
                {"layout": {"textAnchor": {"textSegments": []}, "boundingPoly": {"normalizedVertices": [{"x": 0.1, "y": 0.1}]}}},
                {"layout": {"textAnchor": {"textSegments": [{"startIndex": "10", "endIndex": "14"}, {"startIndex": "14", "endIndex": "16"}]}, "boundingPoly": {"normalizedVertices": _corners(0.1, 0.3, 0.4, 0.4)}}},
            ], "tables": [{"layout": {"boundingPoly": {"normalizedVertices": _corners(0.0, 0.5, 1.0, 0.9)}, "confidence": 0.8}}]},
            {"pageNumber": 2, "lines": []},
        ],
    },
    "azure": {
        "pages": [{"pageNumber": 1, "width": 10.0, "height": 20.0, "lines": [{"content": "Oats", "polygon": _corners(1.0, 2.0, 3.0, 4.0)}], "words": [{"content": "Oats", "polygon": _corners(1.0, 2.0, 3.0, 4.0), "confidence": 0.7}, {"content": "x"}]}],
        "tables": [{"boundingRegions": [{"pageNumber": 1, "polygon": _corners(0.0, 10.0, 10.0, 20.0)}], "cells": [{"rowIndex": 0, "columnIndex": 0, "content": "Crop"}, {"rowIndex": 0, "columnIndex": 1, "content": "Tons"}, {"rowIndex": 2, "columnIndex": 1, "content": "7"}]}],
    },
    "pytesseract": {"level": [1, 4, 5, 5], "page_num": [1, 1, 1, 2], "block_num": [0, 1, 1, 1], "par_num": [0, 1, 1, 1], "line_num": [0, 1, 1, 1], "word_num": [0, 0, 1, 2], "left": [0, 10, 10, 60], "top": [0, 20, 20, 20], "width": [100, 80, 40, 30], "height": [200, 10, 10, 10], "conf": [-1, 90, 80, 70], "text": ["", " Oats 7 ", "Oats", "  "]},
    "tesseract_js": {"data": {"text": "Oats 7", "lines": [{"text": "Oats 7", "confidence": 90, "bbox": {"x0": 10, "y0": 20, "x1": 60, "y1": 30}, "words": [{"text": "Oats", "confidence": 95, "bbox": {"x0": 10, "y0": 20, "x1": 40, "y1": 30}}, {"text": "7", "confidence": 60, "bbox": {"x0": 50, "y0": 20, "x1": 60, "y1": 30}}]}]}},
    "unstructured": {"elements": [
        {"type": "Title", "element_id": "u1", "text": "Yields", "metadata": {"page_number": 1, "coordinates": {"points": [[10, 10], [10, 30], [50, 30], [50, 10]], "layout_width": 100, "layout_height": 200}, "detection_class_prob": 0.9}},
        {"type": "Table", "element_id": "u2", "text": "Crop Tons", "metadata": {"page_number": 2, "coordinates": {"points": [[0, 100], [0, 200], [100, 200], [100, 100]], "layout_width": 100, "layout_height": 200}, "text_as_html": "<table><tr><th>Crop</th><th>Tons</th></tr><tr><td><b>Oats</b></td><td> 7 </td></tr></table>"}},
        {"type": "Image", "element_id": "u3", "text": "", "metadata": {"page_number": 2, "coordinates": {"points": [[0, 0], [0, 10], [10, 10], [10, 0]], "layout_width": 100, "layout_height": 200}}},
        {"type": "PageBreak", "element_id": "u4", "text": "", "metadata": {"page_number": 5}},
    ]},
    "docling": {
        "pages": [{"page_no": 1, "width": 100.0, "height": 200.0}],
        "texts": [{"self_ref": "#/texts/0", "label": "text", "text": "Yields", "prov": [{"page_no": 1, "bbox": {"l": 10.0, "t": 180.0, "r": 60.0, "b": 160.0, "coord_origin": "BOTTOMLEFT"}}]}, {"self_ref": "#/texts/1", "label": "page_footer", "text": "1", "prov": [{"page_no": 3, "bbox": {"l": 0.1, "t": 0.2, "r": 0.3, "b": 0.4, "coord_origin": "TOPLEFT"}}]}],
        "tables": [{"self_ref": "#/tables/0", "label": "table", "prov": [{"page_no": 1, "bbox": {"l": 0.0, "t": 100.0, "r": 100.0, "b": 50.0}}], "data": {"table_cells": [[{"text": "Crop"}, {"text": "Tons"}], [{"text": "Oats"}, {"text": "7"}]]}}],
        "figures": [{"self_ref": "#/figures/0", "label": "picture", "caption": "Rain", "prov": [{"page_no": 1, "bbox": {"l": 0.0, "t": 40.0, "r": 50.0, "b": 0.0, "coord_origin": "BOTTOMLEFT"}}]}],
    },
}
READERS = {
    "textract": (adapters.TEXTRACT, adapters.from_textract), "docai": (adapters.DOCAI, adapters.from_docai), "azure": (adapters.AZURE, adapters.from_azure), "unstructured": (adapters.UNSTRUCTURED, adapters.from_unstructured), "docling": (adapters.DOCLING, adapters.from_docling),
    "pytesseract": (adapters.PYTESSERACT, lambda d: adapters.from_pytesseract(d, 100.0, 200.0)), "tesseract_js": (adapters.TESSERACT_JS, lambda d: adapters.from_tesseract_js(d, 100.0, 200.0)),
}
TREE = {
    "id": "root", "type": "document", "page": 1, "children": [
        {"id": "p1", "type": "page", "page": 1, "bbox": _BOX, "children": [
            {"id": "h", "type": "heading", "page": 1, "textContent": "Yields", "bbox": _BOX, "attributes": {"data-confidence": 0.7}, "data": {"level": 1}, "children": []},
            {"id": "o", "type": "ocr-block", "page": 1, "textContent": "Oats", "bbox": {**_BOX, "y": 0.4}, "attributes": {"data-confidence": "0.5"}, "children": [{"id": "s", "type": "stamp", "page": 1, "bbox": _BOX, "attributes": {}, "children": []}]},
        ]},
        {"id": "x", "type": "paragraph", "page": 4, "attributes": {}, "children": [{"id": "t", "type": "table", "page": 2, "textContent": "| a |", "bbox": _BOX, "attributes": {}, "children": []}]},
    ],
}


def service_output(spark: SparkSession, name: str, doc_id: str = "sample") -> DataFrame:
    """A sample as its service's DataFrame."""
    raw = spark.createDataFrame([(doc_id, json.dumps(SERVICE_OUTPUT[name]))], "doc_id string, raw string")
    return raw.select("doc_id", F.from_json("raw", READERS[name][0]).alias("v")).select("doc_id", "v.*")


def adapted(spark: SparkSession, name: str) -> adapters.AdapterResult:
    """A sample through its adapter."""
    return READERS[name][1](service_output(spark, name))


def list_samples() -> list[str]:
    """Names of the sample documents."""
    return list(DOCUMENTS)


def load_sample(spark: SparkSession, name: str, options: Options | None = None) -> Compiled:
    """A compiled sample document; an unknown name is a KeyError."""
    if name not in DOCUMENTS:
        raise KeyError(f"no sample {name!r}; there are {', '.join(DOCUMENTS)}")
    return compile_document_data(spark, DOCUMENTS[name], name, options)


def compile_document_data(spark: SparkSession, data: dict[str, Any], doc_id: str, options: Options | None = None) -> Compiled:
    """A document of tables, fieldEntities and entities, compiled; its pages are not looked at."""
    meta = data.get("metadata") or {}
    c = LayerCompiler(spark, options or Options(file_name=meta.get("fileName"), document_type=meta.get("documentType")))
    for key, ddl, add in (("tables", schema.TABLE_LAYER, LayerCompiler.add_tables), ("fieldEntities", schema.FIELD_LAYER, LayerCompiler.add_entities), ("entities", schema.EXTRACTED_LAYER, LayerCompiler.add_extracted_entities)):
        rows = [{"doc_id": doc_id, "pos": i, **r} for i, r in enumerate(data.get(key) or [])]
        if rows:
            raw = spark.createDataFrame([(json.dumps(r),) for r in rows], "raw string")
            layer = raw.select(F.from_json("raw", ", ".join(f"{k} {t}" for k, t in schema.columns_of(ddl).items())).alias("v")).select("v.*")
            c = add(c, layer)
    return c.compile()
