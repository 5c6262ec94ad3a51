"""Selectors on streams of entities.

A selector without index or alternatives is a Column predicate and needs no state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import selector as sel


def select_stream(entities: DataFrame, selector: str) -> DataFrame:
    """The stream's entities that match any branch; positions need whole documents and are refused."""
    branches = sel.parse(selector)
    if branches is None:
        return entities
    if any(b.index is not None for b in branches):
        raise ValueError("a stream has no positions")
    match = F.lit(False)
    for b in branches:
        match = match | F.coalesce(sel.predicate(b.parts, entities.columns), F.lit(False))
    return entities.where(match)
