"""Entities as JSON and HTML, built in the JVM."""

from __future__ import annotations

from dataclasses import dataclass
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import js, mdtable

if TYPE_CHECKING:
    from .entityset import EntitySet


@dataclass(frozen=True)
class RenderOptions:
    """What an entity's HTML shows, and the prefix of its classes."""

    include_metadata: bool = True
    show_confidence: bool = True
    show_status: bool = True
    render_tables: bool = True
    class_prefix: str = "vellum"


def entity_html(o: RenderOptions, columns: list[str]) -> Column:
    """HTML of an entity; texts are escaped, ids and values are not."""
    p, lit = o.class_prefix, F.lit
    none = lit("")
    status, confidence = F.coalesce("verification_status", none), F.coalesce("confidence", lit(0.0))
    attrs = (
        F.concat(lit(' data-id="'), F.coalesce("id", none), lit('" data-type="'), F.col("type"), lit('" data-page="'), (F.col("page_index") + 1).cast("string"), lit('" data-confidence="'), js.number_text(confidence), lit('"'))
        if o.include_metadata
        else none
    )
    level = F.when(confidence > 0.9, " high").when(confidence < 0.7, " low").otherwise("")
    badge = F.concat(lit(f'<span class="{p}-badge confidence'), level, lit('">'), js.rounded_percent(confidence), lit("%</span>")) if o.show_confidence else none
    mark = F.concat(lit(f'<span class="{p}-badge status '), status, lit('">'), status, lit("</span>")) if o.show_status else none
    text = F.coalesce("text", none)
    body = F.concat(lit(f'<div class="{p}-text">'), js.escape_html(text), lit("</div>"))
    if o.render_tables:
        body = F.when(F.col("type") == "table", mdtable.table_html(text, p)).otherwise(body)
    shown = F.coalesce(js.number_text(F.col("value_num")), F.col("value_str")) if "value_str" in columns else js.number_text(F.col("value_num"))
    value = F.coalesce(F.concat(lit(f'<span class="{p}-value">'), shown, lit("</span>")), none)
    return F.concat(lit(f'<div class="{p}-entity type-'), F.col("type"), lit(" status-"), status, lit('"'), attrs, lit(f'><div class="{p}-header"><span class="{p}-type">'), F.col("type"), lit("</span>"), badge, mark, value, lit("</div>"), body, lit("</div>"))


def _joined(df: DataFrame, keys: list[str], piece: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__rn", piece))), lambda x: x[piece]), "\n").alias("html"), F.min("__rn").alias("__first"))


def html(s: EntitySet, o: RenderOptions) -> DataFrame:
    """Columns doc_id, html: entities in order, a line each."""
    return _joined(s._ranked().withColumn("__html", entity_html(o, s.df.columns)), ["doc_id"], "__html").drop("__first")


def html_by_page(s: EntitySet, o: RenderOptions) -> DataFrame:
    """Columns doc_id, html: pages in order of first appearance."""
    p = o.class_prefix
    pages = _joined(s._ranked().withColumn("__html", entity_html(o, s.df.columns)), ["doc_id", "page_index"], "__html")
    n = (F.col("page_index") + 1).cast("string")
    wrapped = F.concat(F.lit(f'<div class="{p}-page" data-page="'), n, F.lit(f'"><div class="{p}-page-header">Page '), n, F.lit(f'</div><div class="{p}-page-content">'), F.col("html"), F.lit("</div></div>"))
    return _joined(pages.select("doc_id", F.col("__first").alias("__rn"), wrapped.alias("__html")), ["doc_id"], "__html").drop("__first")


def styles(p: str) -> str:
    """Style rules for the classes above."""
    colours = {"table": "#1e88e5", "currency": "#43a047", "percentage": "#fb8c00", "date": "#8e24aa", "header": "#546e7a", "footnote": "#6d4c41", "figure": "#d81b60"}
    rules = [f".{p}-document{{font-family:sans-serif;margin:1.5em}}", f".{p}-page{{border:1px solid #ddd;margin:0 0 1em}}", f".{p}-page-header{{background:#f4f4f4;padding:.5em 1em}}", f".{p}-entity{{border-left:3px solid #bbb;margin:.5em 0;padding:.5em}}", f".{p}-badge{{font-size:.75em;margin-left:.5em}}", f".{p}-value{{font-family:monospace}}", f".{p}-table{{border-collapse:collapse}}"]
    return "\n".join(rules + [f".{p}-entity.type-{t}{{border-left-color:{c}}}" for t, c in colours.items()])


def html_document(s: EntitySet, o: RenderOptions, title: str) -> DataFrame:
    """Columns doc_id, html: a page for each document."""
    head = f'<!DOCTYPE html>\n<html lang="en"><head><meta charset="utf-8"><title>{title}</title><style>\n{styles(o.class_prefix)}\n</style></head><body><div class="{o.class_prefix}-document">\n'
    return html(s, o).withColumn("html", F.concat(F.lit(head), F.col("html"), F.lit("\n</div></body></html>")))


def json_arrays(s: EntitySet) -> DataFrame:
    """Columns doc_id, json: entities in order, without undefined fields."""
    quoted = F.regexp_extract(F.to_json(F.struct(F.col("value_str").alias("v"))), r'(?s)^\{"v":(.*)\}\z', 1)
    value = F.try_parse_json(F.coalesce(js.number_text(F.col("value_num")), F.when(F.col("value_str").isNotNull(), quoted)))
    box = F.col("bbox")
    meta = F.struct(
        F.col("verified"), F.col("verification_status").alias("verificationStatus"), F.col("verified_by").alias("verifiedBy"), F.col("verified_at").alias("verifiedAt"), F.col("confidence"), F.col("was_corrected").alias("wasCorrected"),
        F.col("correction_type").alias("correctionType"), F.col("source"), F.col("processor_type").alias("processorType"), F.col("flag_reason").alias("flagReason"), F.col("flagged_by").alias("flaggedBy"), F.col("flagged_at").alias("flaggedAt"),
    )
    entity = F.struct("id", "type", "text", value.alias("value"), box.alias("bbox"), meta.alias("meta"), F.col("page_index").alias("pageIndex"), F.col("table_id").alias("tableId"), F.col("row_index").alias("rowIndex"), F.col("col_index").alias("colIndex"))
    one = s._ranked().select("doc_id", "__rn", F.to_json(entity).alias("__json"))
    w = F.array_sort(F.collect_list(F.struct("__rn", "__json")))
    return one.groupBy("doc_id").agg(F.concat(F.lit("["), F.array_join(F.transform(w, lambda x: x["__json"]), ","), F.lit("]")).alias("json"))


__all__ = ["RenderOptions", "entity_html", "html", "html_by_page", "html_document", "json_arrays", "styles"]
