"""Configured queries: selector, filters, sort, statistics, then the limit."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import js
from ..operators.entityset import EntitySet


@dataclass(frozen=True)
class QueryConfig:
    """One query; unset fields don't filter.  ``output`` and ``context`` are accepted and not used."""

    selector: str = "*"
    page_range: tuple[int, int] | None = None
    min_confidence: float | None = None
    status: str | Sequence[str] | None = None
    contains: str | None = None
    pattern: str | None = None
    sort_by: str | None = None
    top_k: int | None = None
    output: Any = None
    context: Any = None


def planned(s: EntitySet, c: QueryConfig) -> EntitySet:
    """The set before the limit."""
    s = s.select(c.selector)
    if c.page_range:
        s = s.filter(F.col("page_index").between(c.page_range[0] - 1, c.page_range[1] - 1))
    if c.min_confidence is not None:
        s = s.filter(f"[confidence>={js.literal_text(float(c.min_confidence))}]")
    if c.status:
        s = s.filter(F.col("verification_status").isin([c.status] if isinstance(c.status, str) else list(c.status)))
    if c.contains:
        s = s.contains(c.contains)
    if c.pattern:
        s = s.matches(c.pattern, ignore_case=True)
    sorts = {"confidence": EntitySet.sort_by_confidence, "position": EntitySet.sort_by_position, "page": lambda x: x.sort_by("page_index")}
    return sorts[c.sort_by](s) if c.sort_by in sorts else s


def query_stats(s: EntitySet, c: QueryConfig, *by: str) -> DataFrame:
    """Statistics of all matches, whatever the limit."""
    return planned(s, c).stats(*by)


def query_items(s: EntitySet, c: QueryConfig) -> DataFrame:
    """The first matches of each document, in the shape of results."""
    found = planned(s, c)
    return (found.take(c.top_k) if c.top_k and c.top_k > 0 else found).items()


def execute_query(s: EntitySet, doc_id: str, c: QueryConfig) -> dict[str, Any]:
    """The response for one document: total, returned, items, stats and the duration in ms."""
    began = time.monotonic()
    one = EntitySet(s.df.where(F.col("doc_id") == doc_id), s.order)
    stats = query_stats(one, c).first()
    items = [{k: v for k, v in r.asDict(True).items() if k != "doc_id"} for r in query_items(one, c).collect()]
    return {"query": c.selector, "documentId": doc_id, "total": stats.total, "returned": len(items), "items": items, "stats": stats.asDict(), "duration": round((time.monotonic() - began) * 1000)}


def format_response(r: dict[str, Any], show_stats: bool = True, max_text: int = 80) -> str:
    """The response as text; long texts are cut at UTF-16 units."""
    lines = [f"Query: {r['query']}", f"Document: {r['documentId']}", f"Results: {r['returned']}/{r['total']} ({r['duration']}ms)", ""]
    for x in r["items"]:
        units = (x["text"] or "").encode("utf-16-le", "surrogatepass")
        text = units[: 2 * max_text].decode("utf-16-le", "replace") + "..." if len(units) > 2 * max_text else x["text"] or ""
        lines += [f"[{x['page']}:{x['id']}] {x['type']} ({js.to_fixed(x['confidence'] * 100, 0)}%)", "  " + text.replace("\n", " ")]
        if x["value"] is not None:
            lines.append(f"  value: {x['value']}")
        lines.append("")
    if show_stats:
        s = r["stats"]
        lines += ["---", f"Stats: {s['verified']} verified, {s['flagged']} flagged, {s['pending']} pending", f"Avg confidence: {js.to_fixed(s['avg_confidence'] * 100, 1)}%"]
    return "\n".join(lines)
