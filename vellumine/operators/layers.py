"""Compiles extraction layers into entities, pages and documents.

A layer is a DataFrame keyed by doc_id with ``pos``, the place of a row in its
input.  Entities keep document order: page, then vertical position, then layer
(tables with their cells, form fields, extracted entities, OCR blocks, Markdown
blocks), then place in the input.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import detect, js, mdtable
from ..sources import schema as S

if TYPE_CHECKING:
    from .entityset import EntitySet


@dataclass(frozen=True)
class Options:
    """What a compilation does; ``file_name`` and ``document_type`` only label documents."""

    include_tables: bool = True
    parse_table_cells: bool = True
    auto_detect_types: bool = True
    file_name: str | None = None
    document_type: str | None = None


@dataclass(frozen=True)
class Compiled:
    """Entities in document order, pages and documents with their counts."""

    entities: DataFrame
    pages: DataFrame
    documents: DataFrame
    version: int = 1

    def query(self) -> EntitySet:
        """The entities as a set to query."""
        from .entityset import EntitySet

        return EntitySet(self.entities, document=self)

    def as_views(self, prefix: str = "") -> None:
        """Temporary views entities, pages and documents for SQL."""
        for name in ("entities", "pages", "documents"):
            getattr(self, name).createOrReplaceTempView(prefix + name)


def _status(df: DataFrame) -> Column:
    return F.coalesce(F.nullif(F.col("verification_status"), F.lit("")), F.lit("pending"))


def _box(c: str) -> Column:
    b = F.col(c)
    return F.struct(b["x"].alias("xmin"), b["y"].alias("ymin"), (b["x"] + b["width"]).alias("xmax"), (b["y"] + b["height"]).alias("ymax"))


def _entities(df: DataFrame, page: str, layer: int, **columns: Column) -> DataFrame:
    """Entity rows with the defaults of missing metadata."""
    defaults = {"verified": F.col("__status") == "verified", "verification_status": F.col("__status"), "was_corrected": F.lit(False), "source": F.lit("ocr"), "page_index": F.col(page) - 1}
    given = defaults | columns
    given.setdefault("ord", S.make_ord(F.col(page), given["bbox"]["ymin"], layer, F.col("pos")))
    given["confidence"] = F.coalesce(given.get("confidence", F.col("confidence")), F.lit(0.0))
    out = {n: given.get(n, F.col(n) if n in ("doc_id", "id") else F.lit(None)) for n in S.ENTITY_COLUMNS}
    return df.withColumn("__status", _status(df)).select(*(out[n].cast(t).alias(n) for n, t in S.ENTITY_COLUMNS.items()))


def table_entities(tables: DataFrame) -> DataFrame:
    """The table layer's containers."""
    t = S.conformed(tables, S.TABLE_LAYER)
    return _entities(
        t, "page_number", 0, type=F.lit("table"), text=F.col("markdown"), bbox=F.col("bbox"), verified_by=F.col("verified_by"), verified_at=js.epoch_ms(F.col("verified_at")),
        was_corrected=F.coalesce("was_corrected", F.lit(False)), ord=S.make_ord(F.col("page_number"), F.col("bbox.ymin"), 0, F.col("pos"), -1, -1),
    )


def cell_entities(tables: DataFrame, auto_detect: bool = True) -> DataFrame:
    """An entity for each cell with text; the boxes are an even grid.

    Outer explodes keep the optimizer from splitting the text again to test for rows.
    """
    t = S.conformed(tables, S.TABLE_LAYER).where(F.col("markdown") != "").withColumn("__rows", mdtable.cell_rows(F.col("markdown")))
    n, most = F.size("__rows"), F.array_max(F.transform("__rows", F.size))
    cells = t.withColumn("__n", n).withColumn("__most", most).select("*", F.posexplode_outer("__rows").alias("__r", "__row")).select("*", F.posexplode_outer("__row").alias("__c", "__text")).where(F.col("__text") != "")
    b, r, c = F.col("bbox"), F.col("__r"), F.col("__c")
    height, width = (b["ymax"] - b["ymin"]) / F.col("__n"), (b["xmax"] - b["xmin"]) / F.col("__most")
    kind = F.when(r == 0, "header").otherwise(detect.trimmed_type(F.col("__text")) if auto_detect else F.lit("table_cell"))
    cells = cells.withColumn("__type", kind).withColumn("__box", F.struct((b["xmin"] + c * width).alias("xmin"), (b["ymin"] + r * height).alias("ymin"), (b["xmin"] + (c + 1) * width).alias("xmax"), (b["ymin"] + (r + 1) * height).alias("ymax")))
    cells = cells.withColumn("__table", F.col("id")).withColumn("id", F.concat("id", F.lit("_r"), r.cast("string"), F.lit("_c"), c.cast("string")))
    return _entities(
        cells, "page_number", 0, type=F.col("__type"), text=F.col("__text"), value_num=detect.typed_value(F.col("__text"), F.col("__type")), bbox=F.col("__box"), table_id=F.col("__table"), row_index=r, col_index=c,
        ord=S.make_ord(F.col("page_number"), F.col("__box.ymin"), 0, F.col("pos"), r, c),
    )


def field_entities(fields: DataFrame, auto_detect: bool = True) -> DataFrame:
    """Form fields; the type comes from the suggested value and the label, the text prefers the verified value."""
    f = S.conformed(fields, S.FIELD_LAYER)
    kind = detect.entity_type(F.col("suggested_value"), F.col("field_label")) if auto_detect else F.lit("text")
    return _entities(
        f, "page_number", 1, type=kind, text=F.coalesce(F.nullif(F.col("verified_value"), F.lit("")), F.col("suggested_value")), value_num=F.col("suggested_value_numeric"), bbox=_box("bounding_box"),
        verified_at=js.epoch_ms(F.col("verified_at")), was_corrected=F.coalesce("was_corrected", F.lit(False)), flag_reason=F.col("flag_reason"), flagged_at=js.epoch_ms(F.col("flagged_at")), row_index=F.col("row_index"),
    )


def extracted_entities(extracted: DataFrame) -> DataFrame:
    """Tables, figures, footnotes and other extracted items; unknown types pass through."""
    e = S.conformed(extracted, S.EXTRACTED_LAYER)
    kind = F.when(F.col("type").isin("summary", "signature"), "text").otherwise(F.coalesce(F.nullif(F.col("type"), F.lit("")), F.lit("unknown")))
    text = F.when(F.coalesce("caption", F.lit("")) != "", F.concat("title", F.lit("\n"), "caption")).otherwise(F.col("title"))
    return _entities(e, "page", 2, type=kind, text=text, bbox=_box("bbox"), confidence=F.coalesce("confidence", F.lit(1.0)))


def ocr_entities(blocks: DataFrame) -> DataFrame:
    """OCR blocks."""
    return _entities(S.conformed(blocks, S.OCR_LAYER), "page", 3, type=F.lit("ocr"), text=F.col("text"), bbox=_box("bbox"))


def markdown_entities(blocks: DataFrame) -> DataFrame:
    """Page Markdown of vision models; covers the page."""
    full = F.struct(F.lit(0.0).alias("xmin"), F.lit(0.0).alias("ymin"), F.lit(1.0).alias("xmax"), F.lit(1.0).alias("ymax"))
    return _entities(S.conformed(blocks, S.MARKDOWN_LAYER), "page", 4, type=F.lit("markdown"), text=F.col("content"), bbox=full, confidence=F.coalesce("confidence", F.lit(1.0)), source=F.lit("ai_correction"), processor_type=F.col("model"))


def counts(verified: Column | None = None) -> list[Column]:
    """Totals, counts by status, mean confidence and score; ``verified`` replaces the test of the status."""
    status = F.col("verification_status")
    total, n = F.count("ord"), F.count_if(status == "verified" if verified is None else verified)
    return [
        F.count("ord").alias("total_entities"), n.alias("verified_count"), F.count_if(status == "flagged").alias("flagged_count"), F.count_if(status == "pending").alias("pending_count"),
        F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("avg_confidence"), F.when(total > 0, n / total).otherwise(0.0).alias("verification_score"),
    ]


def page_meta(entities: DataFrame, pages: DataFrame | None = None, verified: Column | None = None) -> DataFrame:
    """Counts a page; with ``pages`` (doc_id, page_index) pages without entities stay."""
    found = entities.groupBy("doc_id", "page_index").agg(*counts(verified=verified))
    if pages is None:
        return found
    return pages.join(found, ["doc_id", "page_index"], "left").na.fill(0, ["total_entities", "verified_count", "flagged_count", "pending_count"]).na.fill(0.0, ["avg_confidence", "verification_score"])


def document_meta(pages: DataFrame) -> DataFrame:
    """Counts a document, from its pages."""
    n, v = F.sum("total_entities"), F.sum("verified_count")
    return pages.groupBy("doc_id").agg(
        F.count("*").alias("total_pages"), n.alias("total_entities"), v.alias("verified_count"), F.sum("flagged_count").alias("flagged_count"), F.sum("pending_count").alias("pending_count"),
        F.when(n > 0, v / n).otherwise(0.0).alias("verification_score"),
    )


@dataclass(frozen=True)
class LayerCompiler:
    """Immutable builder: every ``add_`` returns a new one."""

    spark: SparkSession
    options: Options = field(default_factory=Options)
    layers: tuple[tuple[str, DataFrame], ...] = ()
    version: int = 1

    def _with(self, kind: str, df: DataFrame) -> LayerCompiler:
        return replace(self, layers=(*self.layers, (kind, df)))

    def add_tables(self, df: DataFrame) -> LayerCompiler:
        """Markdown tables."""
        return self._with("tables", df)

    def add_entities(self, df: DataFrame) -> LayerCompiler:
        """Form fields."""
        return self._with("fields", df)

    def add_extracted_entities(self, df: DataFrame) -> LayerCompiler:
        """Extracted tables, figures, footnotes and so on."""
        return self._with("extracted", df)

    def add_ocr_blocks(self, df: DataFrame) -> LayerCompiler:
        """OCR blocks."""
        return self._with("ocr", df)

    def add_markdown_blocks(self, df: DataFrame) -> LayerCompiler:
        """Markdown of pages."""
        return self._with("markdown", df)

    def add_markdown_page(self, doc_id: str, page: int, content: str, model: str | None = None) -> LayerCompiler:
        """Markdown of one page, given as text."""
        n = sum(k == "markdown" for k, _ in self.layers)
        row = self.spark.createDataFrame([(doc_id, n, f"md_{page}_{n}", page, content, 1.0, model, "pending")], S.MARKDOWN_LAYER)
        return self.add_markdown_blocks(row)

    def reset(self) -> LayerCompiler:
        """No layers, the next version."""
        return replace(self, layers=(), version=self.version + 1)

    def compile(self) -> Compiled:
        """The union of all layers.  Pages of any layer exist, with or without entities."""
        o, spark = self.options, self.spark
        parts: list[DataFrame] = []
        pages: list[DataFrame] = []
        notes: list[DataFrame] = []
        for n, (kind, df) in enumerate(self.layers):
            df = df.withColumn("pos", F.col("pos").cast("bigint") + F.lit(n).cast("bigint") * (1 << 40)) if "pos" in df.columns else df.withColumn("pos", F.lit(n).cast("bigint") * (1 << 40))
            pages.append(df.select("doc_id", (F.col("page_number" if kind in ("tables", "fields") else "page").cast("int") - 1).alias("page_index")))
            if kind == "tables" and o.include_tables:
                parts.append(table_entities(df))
                if o.parse_table_cells:
                    parts.append(cell_entities(df, o.auto_detect_types))
            elif kind == "fields":
                parts.append(field_entities(df, o.auto_detect_types))
            elif kind == "extracted":
                parts.append(extracted_entities(df))
            elif kind == "ocr":
                parts.append(ocr_entities(df))
            elif kind == "markdown":
                parts.append(markdown_entities(df))
                notes.append(df.select("doc_id", (F.col("page").cast("int") - 1).alias("page_index"), "pos", "content"))
        entities = parts[0] if parts else spark.createDataFrame([], S.ENTITIES)
        for p in parts[1:]:
            entities = entities.unionByName(p)
        known = spark.createDataFrame([], "doc_id string, page_index int")
        for p in pages:
            known = known.unionByName(p)
        page_rows = page_meta(entities, known.distinct())
        if notes:
            joined = notes[0]
            for p in notes[1:]:
                joined = joined.unionByName(p)
            text = joined.groupBy("doc_id", "page_index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "content"))), lambda x: x["content"]), "\n\n").alias("markdown"))
            page_rows = page_rows.join(text, ["doc_id", "page_index"], "left")
        else:
            page_rows = page_rows.withColumn("markdown", F.lit(None).cast("string"))
        page_rows = page_rows.withColumn("id", F.concat(F.lit("p_"), F.col("page_index").cast("string"))).withColumn("page_number", F.col("page_index") + 1)
        documents = document_meta(page_rows).withColumn("file_name", F.lit(o.file_name).cast("string")).withColumn("document_type", F.lit(o.document_type).cast("string"))
        return Compiled(entities, page_rows, documents, self.version)


def compile_document(tables: DataFrame, entities: DataFrame | None = None, options: Options | None = None) -> Compiled:
    """Tables and form fields compiled in one call."""
    c = LayerCompiler(tables.sparkSession, options or Options()).add_tables(tables)
    return (c.add_entities(entities) if entities is not None else c).compile()


def adapter_tables_to_source(tables: DataFrame) -> DataFrame:
    """Tables of a vendor adapter as a table layer."""
    b = F.col("bbox")
    box = F.struct(b["x"].alias("xmin"), b["y"].alias("ymin"), (b["x"] + b["width"]).alias("xmax"), (b["y"] + b["height"]).alias("ymax"))
    return tables.select("doc_id", "pos", "id", F.col("page").alias("page_number"), "markdown", box.alias("bbox"), "confidence", F.lit("pending").alias("verification_status"))
