"""Output of document services as blocks, tables and page counts.

Each function takes a DataFrame with doc_id and the service's nested columns (the
schemas below; read JSON with them, never inferred) and returns blocks (doc_id,
pos, id, page, text, bbox, confidence, type), tables (doc_id, pos, id, page,
markdown, bbox, confidence) and pages (doc_id, page_count).  All built-in
expressions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import js, mdtable

_POINT = "struct<x: double, y: double>"
_LAYOUT = f"struct<textAnchor: struct<textSegments: array<struct<startIndex: string, endIndex: string>>>, boundingPoly: struct<normalizedVertices: array<{_POINT}>>, confidence: double>"
_PROV = "array<struct<page_no: int, bbox: struct<l: double, t: double, r: double, b: double, coord_origin: string>>>"
_LINE_BOX = "struct<x0: double, y0: double, x1: double, y1: double>"
TEXTRACT = "DocumentMetadata struct<Pages: int>, Blocks array<struct<Id: string, BlockType: string, Text: string, Confidence: double, Geometry: struct<BoundingBox: struct<Left: double, Top: double, Width: double, Height: double>>, Page: int>>"
DOCAI = f"text string, pages array<struct<pageNumber: int, lines: array<struct<layout: {_LAYOUT}>>, tables: array<struct<layout: {_LAYOUT}>>>>"
AZURE = f"content string, pages array<struct<pageNumber: int, width: double, height: double, unit: string, lines: array<struct<content: string, polygon: array<{_POINT}>>>, words: array<struct<content: string, polygon: array<{_POINT}>, confidence: double>>>>, tables array<struct<rowCount: int, columnCount: int, boundingRegions: array<struct<pageNumber: int, polygon: array<{_POINT}>>>, cells: array<struct<rowIndex: int, columnIndex: int, content: string>>>>"
PYTESSERACT = ", ".join(f"{c} array<double>" for c in ("level", "page_num", "block_num", "par_num", "line_num", "word_num", "left", "top", "width", "height", "conf")) + ", text array<string>"
TESSERACT_JS = f"data struct<text: string, lines: array<struct<text: string, confidence: double, bbox: {_LINE_BOX}, words: array<struct<text: string, confidence: double, bbox: {_LINE_BOX}>>>>>"
UNSTRUCTURED = "elements array<struct<type: string, element_id: string, text: string, metadata: struct<page_number: int, coordinates: struct<points: array<array<double>>, system: string, layout_width: double, layout_height: double>, detection_class_prob: double, text_as_html: string>>>"
DOCLING = f"pages array<struct<page_no: int, width: double, height: double>>, texts array<struct<self_ref: string, label: string, text: string, prov: {_PROV}>>, tables array<struct<self_ref: string, label: string, prov: {_PROV}, data: struct<table_cells: array<array<struct<text: string>>>>>>, figures array<struct<self_ref: string, label: string, caption: string, prov: {_PROV}>>"


@dataclass(frozen=True)
class AdapterResult:
    """Normalised output of a service."""

    blocks: DataFrame
    tables: DataFrame
    pages: DataFrame


def _box(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), width.cast("double").alias("width"), height.cast("double").alias("height"))


def _around(points: Column, width: Column | float = 1.0, height: Column | float = 1.0) -> Column:
    """The box around at least four points, NULL for fewer."""
    xs, ys = F.transform(points, lambda p: p["x"] / width), F.transform(points, lambda p: p["y"] / height)
    x0, y0 = F.array_min(xs), F.array_min(ys)
    return F.when(F.size(points) >= 4, _box(x0, y0, F.array_max(xs) - x0, F.array_max(ys) - y0))


def _rows(df: DataFrame, page: Column, **columns: Column) -> DataFrame:
    names = ("id", "text", "markdown", "bbox", "confidence", "type")
    return df.select("doc_id", F.col("pos").cast("bigint").alias("pos"), columns["id"].alias("id"), page.cast("int").alias("page"), *(columns[n].alias(n) for n in names[1:] if n in columns))


def _no_tables(docs: DataFrame) -> DataFrame:
    return docs.where(F.lit(False)).select("doc_id", F.lit(0).cast("bigint").alias("pos"), F.lit("").alias("id"), F.lit(0).alias("page"), F.lit("").alias("markdown"), _box(*(F.lit(0.0),) * 4).alias("bbox"), F.lit(0.0).alias("confidence"))


def from_textract(docs: DataFrame) -> AdapterResult:
    """Lines, words and tables; confidence in percent, 100 if missing."""
    b = F.col("b")
    rows = docs.select("doc_id", F.posexplode("Blocks").alias("pos", "b")).where(b["Geometry"]["BoundingBox"].isNotNull())
    g = b["Geometry"]["BoundingBox"]
    common = {"id": b["Id"], "bbox": _box(g["Left"], g["Top"], g["Width"], g["Height"]), "confidence": F.coalesce(b["Confidence"], F.lit(100.0)) / 100}
    page = F.coalesce(b["Page"], F.lit(1))
    blocks = _rows(rows.where(b["BlockType"].isin("LINE", "WORD")), page, text=F.coalesce(b["Text"], F.lit("")), type=F.lower(b["BlockType"]), **common)
    tables = _rows(rows.where(b["BlockType"] == "TABLE"), page, markdown=F.lit(""), **common)
    return AdapterResult(blocks, tables, docs.select("doc_id", F.coalesce("DocumentMetadata.Pages", F.lit(1)).alias("page_count")))


def _index(text: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.coalesce(text, F.lit("0")), r"^\s*([0-9]+)", 1).try_cast("int"), F.lit(0))


def from_docai(docs: DataFrame) -> AdapterResult:
    """Lines and tables, which share one counter, page by page.

    Text offsets count code points, as the service's do, not UTF-16 units.
    """
    page = F.col("p")
    items = F.concat(
        F.transform(F.coalesce(page["lines"], F.array()), lambda x: F.struct(F.lit("line").alias("kind"), x["layout"].alias("layout"))),
        F.transform(F.coalesce(page["tables"], F.array()), lambda x: F.struct(F.lit("table").alias("kind"), x["layout"].alias("layout"))),
    )
    flat = docs.select("doc_id", F.col("text").alias("whole"), F.posexplode("pages").alias("pp", "p")).select("doc_id", "whole", "pp", page["pageNumber"].alias("n"), F.posexplode(items).alias("ip", "i"))
    boxed = flat.withColumn("box", _around(F.col("i.layout.boundingPoly.normalizedVertices"))).where("box is not null")
    keys = boxed.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pp", "ip", "whole", "n", "i", "box"))).alias("all"))
    rows = keys.select("doc_id", F.posexplode("all").alias("pos", "r")).select("doc_id", "pos", "r.*")
    text = F.aggregate(
        F.coalesce(F.col("i.layout.textAnchor.textSegments"), F.array().cast("array<struct<startIndex: string, endIndex: string>>")),
        F.lit(""),
        lambda s, x: F.concat(s, F.substring(F.coalesce(F.col("whole"), F.lit("")), _index(x["startIndex"]) + 1, F.greatest(_index(x["endIndex"]) - _index(x["startIndex"]), F.lit(0)))),
    )
    n = F.coalesce("n", F.lit(1))
    name = F.concat(F.lit("docai-"), F.col("i.kind"), F.lit("-"), F.col("pos").cast("string"))
    common = {"id": name, "bbox": F.col("box"), "confidence": F.coalesce("i.layout.confidence", F.lit(1.0))}
    blocks = _rows(rows.where("i.kind = 'line'"), n, text=js.trim(text), type=F.lit("line"), **common)
    tables = _rows(rows.where("i.kind = 'table'"), n, markdown=F.lit(""), **common)
    return AdapterResult(blocks, tables, docs.select("doc_id", F.when(F.col("pages").isNotNull(), F.size("pages")).otherwise(1).alias("page_count")))


def _grid_markdown(cells: Column) -> Column:
    """Markdown of sparse cells; a row is as long as its last cell, a missing row empty."""
    rows = F.array_max(F.transform(cells, lambda c: c["rowIndex"]))
    row = lambda r: F.filter(cells, lambda c: c["rowIndex"] == r)
    last = lambda r: F.array_max(F.transform(row(r), lambda c: c["columnIndex"]))
    cell = lambda r, k: F.coalesce(F.get(F.transform(F.filter(row(r), lambda c: c["columnIndex"] == k), lambda c: c["content"]), F.size(F.filter(row(r), lambda c: c["columnIndex"] == k)) - 1), F.lit(""))
    line = lambda r: F.when(F.size(row(r)) > 0, F.transform(F.sequence(F.lit(0), last(r)), lambda k: cell(r, k))).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(cells) > 0, mdtable.markdown_of(F.transform(F.sequence(F.lit(0), rows), line))).otherwise("")


def from_azure(docs: DataFrame) -> AdapterResult:
    """Lines, then words, page by page, then tables by their first region; one counter for all."""
    dims = F.map_from_entries(F.transform(F.coalesce("pages", F.array().cast(docs.schema["pages"].dataType)), lambda p: F.struct(p["pageNumber"], F.struct(p["width"].alias("w"), p["height"].alias("h")))))
    page = F.col("p")
    kind = "array<struct<kind: string, text: string, polygon: array<struct<x: double, y: double>>, confidence: double>>"
    lines = F.transform(F.coalesce(page["lines"], F.array()), lambda x: F.struct(F.lit("line").alias("kind"), x["content"].alias("text"), x["polygon"].alias("polygon"), F.lit(1.0).alias("confidence"))).cast(kind)
    words = F.transform(F.coalesce(page["words"], F.array()), lambda x: F.struct(F.lit("word").alias("kind"), x["content"].alias("text"), x["polygon"].alias("polygon"), x["confidence"].alias("confidence"))).cast(kind)
    flat = docs.select("doc_id", F.posexplode("pages").alias("pp", "p")).select("doc_id", "pp", "p", F.posexplode(F.concat(lines, words)).alias("ip", "i"))
    blocks = flat.select("doc_id", F.lit(0).alias("part"), "pp", "ip", page["pageNumber"].alias("n"), F.col("i.kind").alias("kind"), F.col("i.text").alias("text"), _around(F.col("i.polygon"), page["width"], page["height"]).alias("box"), F.col("i.confidence").alias("confidence"))
    t, region = F.col("t"), F.get(F.col("t.boundingRegions"), 0)
    size = F.try_element_at("dims", region["pageNumber"])
    one = F.lit(1.0)
    tables = docs.withColumn("dims", dims).select("doc_id", "dims", F.posexplode("tables").alias("pp", "t")).select(
        "doc_id", F.lit(1).alias("part"), "pp", F.lit(0).alias("ip"), region["pageNumber"].alias("n"), F.lit("table").alias("kind"), _grid_markdown(F.coalesce(t["cells"], F.array().cast("array<struct<rowIndex: int, columnIndex: int, content: string>>"))).alias("text"),
        _around(region["polygon"], F.coalesce(size["w"], one), F.coalesce(size["h"], one)).alias("box"), one.alias("confidence"),
    )
    every = blocks.unionByName(tables).where("box is not null").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("part", "pp", "ip", "n", "kind", "text", "box", "confidence"))).alias("all"))
    rows = every.select("doc_id", F.posexplode("all").alias("pos", "r")).select("doc_id", "pos", "r.*")
    common = {"id": F.concat(F.lit("azure-"), F.col("kind"), F.lit("-"), F.col("pos").cast("string")), "bbox": F.col("box"), "confidence": F.col("confidence")}
    return AdapterResult(
        _rows(rows.where("kind <> 'table'"), F.col("n"), text=F.col("text"), type=F.col("kind"), **common),
        _rows(rows.where("kind = 'table'"), F.col("n"), markdown=F.col("text"), **common),
        docs.select("doc_id", F.when(F.col("pages").isNotNull(), F.size("pages")).otherwise(1).alias("page_count")),
    )


def from_pytesseract(docs: DataFrame, width: Column | float, height: Column | float) -> AdapterResult:
    """Parallel arrays; lines, words and paragraphs with text and confidence."""
    names = [c.split(" ")[0] for c in PYTESSERACT.split(", ")]
    r = F.col("r")
    rows = docs.withColumn("__w", F.lit(width) if isinstance(width, (int, float)) else width).withColumn("__h", F.lit(height) if isinstance(height, (int, float)) else height)
    rows = rows.select("doc_id", "__w", "__h", F.posexplode(F.arrays_zip(*names)).alias("pos", "r")).withColumn("t", js.trim(r["text"]))
    kind = F.when(r["level"] == 4, "line").when(r["level"] == 5, "word").when(r["level"] == 3, "paragraph")
    rows = rows.where((F.col("t") != "") & ~(r["conf"] < 0) & kind.isNotNull())
    w, h = F.col("__w"), F.col("__h")
    name = F.concat_ws("-", F.lit("tess"), *(js.number_text(r[c]) for c in ("page_num", "block_num", "line_num", "word_num")))
    blocks = _rows(rows, r["page_num"], id=name, text=F.col("t"), bbox=_box(r["left"] / w, r["top"] / h, r["width"] / w, r["height"] / h), confidence=r["conf"] / 100, type=kind)
    return AdapterResult(blocks, _no_tables(docs), docs.select("doc_id", F.greatest(F.coalesce(F.array_max("page_num"), F.lit(1.0)), F.lit(1.0)).cast("int").alias("page_count")))


def from_tesseract_js(docs: DataFrame, width: float, height: float, page: int = 1) -> AdapterResult:
    """Each line, then its words; one page."""
    shape = "struct<id: string, type: string, text: string, confidence: double, bbox: struct<x0: double, y0: double, x1: double, y1: double>>"
    line = F.col("l")
    number = F.col("ln").cast("string")
    head = F.struct(F.concat(F.lit("tessjs-line-"), number).alias("id"), F.lit("line").alias("type"), line["text"].alias("text"), line["confidence"].alias("confidence"), line["bbox"].alias("bbox")).cast(shape)
    words = F.transform(F.coalesce(line["words"], F.array()), lambda w, k: F.struct(F.concat(F.lit("tessjs-line-"), number, F.lit("-word-"), k.cast("string")).alias("id"), F.lit("word").alias("type"), w["text"].alias("text"), w["confidence"].alias("confidence"), w["bbox"].alias("bbox")).cast(shape))
    flat = docs.select("doc_id", F.posexplode("data.lines").alias("ln", "l")).select("doc_id", "ln", F.posexplode(F.concat(F.array(head), words)).alias("k", "i"))
    rows = flat.withColumn("pos", F.col("ln").cast("bigint") * (1 << 20) + F.col("k"))
    b = F.col("i.bbox")
    blocks = _rows(rows, F.lit(page), id=F.col("i.id"), text=F.col("i.text"), bbox=_box(b["x0"] / width, b["y0"] / height, (b["x1"] - b["x0"]) / width, (b["y1"] - b["y0"]) / height), confidence=F.col("i.confidence") / 100, type=F.col("i.type"))
    return AdapterResult(blocks, _no_tables(docs), docs.select("doc_id", F.lit(1).alias("page_count")))


def from_unstructured(docs: DataFrame) -> AdapterResult:
    """Elements with coordinates; elements without still count for the pages."""
    e, m = F.col("e"), F.col("e.metadata")
    rows = docs.select("doc_id", F.posexplode("elements").alias("pos", "e"))
    points = F.transform(m["coordinates"]["points"], lambda p: F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y")))
    raw = _around(points)
    w, h = m["coordinates"]["layout_width"], m["coordinates"]["layout_height"]
    rows = rows.withColumn("raw", raw).where("raw is not null")
    b = F.col("raw")
    common = {"id": e["element_id"], "bbox": _box(b["x"] / w, b["y"] / h, b["width"] / w, b["height"] / h), "confidence": F.coalesce(m["detection_class_prob"], F.lit(1.0))}
    page = F.coalesce(m["page_number"], F.lit(1))
    kind = F.when(e["type"].isin("Title", "Header", "NarrativeText", "Text", "ListItem"), "paragraph").when(e["type"].isin("Image", "Figure"), "figure").otherwise("other")
    html = m["text_as_html"]
    markdown = F.when(F.coalesce(html, F.lit("")) != "", mdtable.markdown_of(mdtable.html_rows(html))).otherwise(e["text"])
    table = e["type"].eqNullSafe("Table")
    pages = F.greatest(F.coalesce(F.array_max(F.transform("elements", lambda x: F.coalesce(x["metadata"]["page_number"], F.lit(1)))), F.lit(1)), F.lit(1))
    return AdapterResult(_rows(rows.where(~table), page, text=e["text"], type=kind, **common), _rows(rows.where(table), page, markdown=markdown, **common), docs.select("doc_id", pages.alias("page_count")))


def _flipped(b: Column, w: Column, h: Column) -> Column:
    """A box with its origin at the top left."""
    top = b["coord_origin"].isNotNull() & (b["coord_origin"] != "BOTTOMLEFT")
    return _box(b["l"] / w, F.when(top, b["t"] / h).otherwise(1 - b["t"] / h), (b["r"] - b["l"]) / w, F.when(top, (b["b"] - b["t"]) / h).otherwise((b["t"] - b["b"]) / h))


def from_docling(docs: DataFrame) -> AdapterResult:
    """Texts and figures as blocks, tables from their cell grids; an item on several places counts at each."""
    dims = F.map_from_entries(F.transform(F.coalesce("pages", F.array().cast(docs.schema["pages"].dataType)), lambda p: F.struct(p["page_no"], F.struct(p["width"].alias("w"), p["height"].alias("h")))))
    base = docs.withColumn("dims", dims)
    one = F.lit(1.0)

    def placed(name: str, part: int) -> DataFrame:
        rows = base.select("doc_id", "dims", F.posexplode(name).alias("n", "x")).select("doc_id", "dims", "n", "x", F.posexplode("x.prov").alias("k", "v"))
        size = F.try_element_at("dims", F.col("v.page_no"))
        return rows.withColumn("box", _flipped(F.col("v.bbox"), F.coalesce(size["w"], one), F.coalesce(size["h"], one))).withColumn("pos", F.lit(part).cast("bigint") * (1 << 50) + F.col("n").cast("bigint") * (1 << 20) + F.col("k"))

    page, common = F.col("v.page_no"), {"id": F.col("x.self_ref"), "bbox": F.col("box"), "confidence": one}
    other = F.when(F.col("x.label").isin("footnote", "page_header", "page_footer"), "other").otherwise("paragraph")
    texts = _rows(placed("texts", 0), page, text=F.col("x.text"), type=other, **common)
    figures = _rows(placed("figures", 2), page, text=F.coalesce("x.caption", F.lit("")), type=F.lit("figure"), **common)
    grid = F.transform("x.data.table_cells", lambda r: F.transform(r, lambda c: F.coalesce(c["text"], F.lit(""))))
    tables = _rows(placed("tables", 1), page, markdown=F.coalesce(mdtable.markdown_of(grid), F.lit("")), **common)
    pages = F.array_max(F.concat(*(F.coalesce(F.flatten(F.transform(n, lambda x: F.transform(x["prov"], lambda v: v["page_no"]))), F.array().cast("array<int>")) for n in ("texts", "tables", "figures"))))
    return AdapterResult(texts.unionByName(figures), tables, docs.select("doc_id", F.coalesce(pages, F.lit(1)).alias("page_count")))
