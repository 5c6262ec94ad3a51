"""Attribute changes as new DataFrames, with a log that can be replayed.

Nothing changes in place: each call returns a set whose rows have the new values
and their own log, an array column, so any number of calls stays one scan and the
log is exploded once, when it is asked for.  The log's values are texts.  Data
and transformations are no logged changes: they leave log and version as they are.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import replace
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..functions import js
from ..plans.selector import Attributes
from ..sources.schema import CHANGES, FIELDS, META

if TYPE_CHECKING:
    from .entityset import EntitySet


def attribute(row: Row, key: str) -> Any:
    """An attribute of a row: metadata, custom metadata, then fields."""
    d = row.asDict()
    if key in META:
        return d.get(META[key][0])
    if key in (d.get("extra") or {}):
        return d["extra"][key]
    if key == "value":
        return d["value_num"] if d.get("value_num") is not None else d.get("value_str")
    return d.get(FIELDS[key][0]) if key in FIELDS else None


def datum(row: Row, key: str) -> Any:
    """A datum of a row, else its metadata."""
    d = row.asDict()
    if key in (d.get("data") or {}):
        return json.loads(d["data"][key])
    return attribute(row, key) if key in META or key in (d.get("extra") or {}) else None


def _text(v: Any) -> str | None:
    return None if v is None else js.literal_text(v if isinstance(v, (bool, str)) else float(v))


def _without(column: str, key: str) -> Column:
    return F.map_filter(column, lambda k, _: k != key)


def _kind(v: Any) -> str:
    return "bool" if isinstance(v, bool) else "str" if isinstance(v, str) else "num"


def _assigned(df: DataFrame, key: str, value: Any) -> dict[str, Column]:
    """The columns that an assignment replaces."""
    if key in META:
        column, kind = META[key]
        v = F.lit(value)
        return {column: v.cast(df.schema[column].dataType) if kind == _kind(value) or value is None else v.cast("string").try_cast(df.schema[column].dataType)}
    if key == "value":
        number = not isinstance(value, (str, bool)) and value is not None
        return {"value_num": F.lit(float(value) if number else None).cast("double"), "value_str": F.lit(None if number else _text(value)).cast("string")}
    if key in ("text", "type"):
        return {key: F.lit(_text(value)).cast("string")}
    old = F.coalesce("extra", F.create_map().cast("map<string,string>"))
    return {"extra": F.map_concat(F.map_filter(old, lambda k, _: k != key), F.create_map(F.lit(key), F.lit(_text(value)).cast("string")))}


def _differs(df: DataFrame, key: str, value: Any) -> Column:
    """Whether the attribute is not identical to the value, type included."""
    a = Attributes(frozenset(df.columns))
    same = a.text(key).eqNullSafe(F.lit(_text(value)))
    kind = META.get(key, FIELDS.get(key, ("", "str")))[1]
    if kind == "value":
        same = same & (F.col("value_str").isNull() if _kind(value) == "num" else F.col("value_num").isNull())
    elif kind in ("bool", "num", "str") and value is not None and key in {**META, **FIELDS} and kind != _kind(value):
        same = F.lit(False)
    return ~same


LOG = "__log"
_ENTRY = "array<struct<field: string, old_value: string, new_value: string, seq: bigint, timestamp: bigint>>"


def log_of(df: DataFrame) -> Column:
    """The rows' log so far."""
    return F.col(LOG) if LOG in df.columns else F.array().cast(_ENTRY)


def changes_of(df: DataFrame) -> DataFrame:
    """One row a change, in the shape of ``CHANGES``."""
    rows = df.select("doc_id", F.col("id").alias("entity_id"), "ord", "page_index", F.explode(log_of(df)).alias("c"))
    return rows.select("doc_id", "entity_id", "ord", "page_index", "c.*")


def _changed(s: EntitySet, df: DataFrame, condition: Column, key: str, new: Column, columns: dict[str, Column], seq: int, timestamp: int) -> DataFrame:
    """Rows that meet the condition get the columns and a line of their log; their old values are those of ``df``."""
    old = Attributes(frozenset(df.columns)).text(key)
    entry = F.struct(F.lit(key).alias("field"), old.alias("old_value"), new.cast("string").alias("new_value"), F.lit(seq).cast("bigint").alias("seq"), F.lit(timestamp).cast("bigint").alias("timestamp"))
    logged = F.when(condition, F.concat(log_of(df), F.array(entry).cast(_ENTRY))).otherwise(log_of(df))
    return df.withColumns({c: F.when(condition, v).otherwise(F.col(c)) if c in df.columns else F.when(condition, v) for c, v in columns.items()} | {LOG: logged})


def set_attributes(s: EntitySet, values: dict[str, Any], timestamp: int = 0) -> EntitySet:
    """Sets attributes of all rows; a row that has the value already is neither changed nor logged."""
    df = s.df
    for i, (key, value) in enumerate(values.items()):
        df = _changed(s, df, _differs(df, key, value), key, F.lit(_text(value)), _assigned(df, key, value), s.next_seq() + i, timestamp)
    return s.changed_to(df)


def remove_attributes(s: EntitySet, keys: list[str], timestamp: int = 0) -> EntitySet:
    """Removes metadata; entity fields are logged and stay."""
    df = s.df
    for i, key in enumerate(keys):
        gone = {META[key][0]: F.lit(None).cast(df.schema[META[key][0]].dataType)} if key in META else {"extra": _without("extra", key)} if "extra" in df.columns else {}
        df = _changed(s, df, Attributes(frozenset(df.columns)).present(key), key, F.lit(None), gone, s.next_seq() + i, timestamp)
    return s.changed_to(df)


def toggle(s: EntitySet, key: str, force: bool | None, timestamp: int = 0) -> EntitySet:
    """Negates a boolean or custom attribute of each row.

    What is missing counts as false, and so do the custom values '', 'false', '0' and 'NaN'.
    """
    if force is not None:
        return set_attributes(s, {key: force}, timestamp)
    if key in FIELDS or key in META and META[key][1] != "bool":
        raise ValueError(f"{key} is no boolean attribute")
    if key in META:
        new = ~F.coalesce(F.col(META[key][0]), F.lit(False))
        return s.changed_to(_changed(s, s.df, F.lit(True), key, new.cast("string"), {META[key][0]: new}, s.next_seq(), timestamp))
    old = F.coalesce("extra", F.create_map().cast("map<string,string>")) if "extra" in s.df.columns else F.create_map().cast("map<string,string>")
    new = F.coalesce(F.try_element_at(old, F.lit(key)).isin("", "false", "0", "NaN"), F.lit(True)).cast("string")
    return s.changed_to(_changed(s, s.df, F.lit(True), key, new, {"extra": F.map_concat(F.map_filter(old, lambda k, _: k != key), F.create_map(F.lit(key), new))}, s.next_seq(), timestamp))


def set_data(s: EntitySet, values: dict[str, Any]) -> EntitySet:
    """Adds data to all rows, as JSON; not logged."""
    new = F.create_map(*(F.lit(x) for k, v in values.items() for x in (k, json.dumps(v))))
    old = F.map_filter(F.coalesce("data", F.create_map().cast("map<string,string>")), lambda k, _: ~k.isin(list(values)))
    return replace(s, df=s.df.withColumn("data", F.map_concat(old, new)))


def apply_changes(entities: DataFrame, changes: DataFrame) -> DataFrame:
    """Entities with the last logged value of each (document, id, field); rows that share an id all change.

    Metadata and the fields text, value and type are set; a null value removes.
    A removed text, value or type stays, and other names become custom metadata.
    """
    last = Window.partitionBy("doc_id", "entity_id", "field").orderBy(F.desc("seq"), F.desc("timestamp"))
    latest = changes.withColumn("__rn", F.row_number().over(last)).where("__rn = 1")
    by_row = latest.groupBy("doc_id", F.col("entity_id").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("field", "new_value"))).alias("__new"))
    df = entities.join(by_row, ["doc_id", "id"], "left")
    value = lambda k: F.try_element_at("__new", F.lit(k))
    has = lambda k: F.coalesce(F.map_contains_key("__new", F.lit(k)), F.lit(False))
    out = {c: F.when(has(k), value(k).try_cast(entities.schema[c].dataType)).otherwise(F.col(c)) for k, (c, _) in META.items() if c in entities.columns}
    for k in ("text", "type"):
        out[k] = F.coalesce(value(k), F.col(k))
    number = js.to_number(value("value"))
    out["value_num"] = F.when(value("value").isNotNull(), number).otherwise(F.col("value_num"))
    if "value_str" in entities.columns:
        out["value_str"] = F.when(value("value").isNotNull(), F.when(number.isNull(), value("value"))).otherwise(F.col("value_str"))
    if "extra" in entities.columns:
        known = [*META, "text", "type", "value"]
        old, new = F.coalesce("extra", F.create_map().cast("map<string,string>")), F.coalesce("__new", F.create_map().cast("map<string,string>"))
        kept = F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k))
        out["extra"] = F.map_concat(kept, F.map_filter(new, lambda k, v: ~k.isin(known) & v.isNotNull()))
    return df.select(*(out.get(c, F.col(c)).alias(c) for c in entities.columns))


def markdown(s: EntitySet, transform: Callable[[Row, dict[str, Any]], dict[str, Any] | None] | None, image_url: str | None, force: bool, options: dict[str, Any]) -> tuple[str, EntitySet]:
    """See ``EntitySet.markdown``; ``transform`` is the caller's client of a vision model."""
    row = s.first()
    if row is None:
        return "", s
    kept = datum(row, "transformation") if "data" in s.df.columns else None
    if kept and not force:
        return kept["markdown"], s
    if not image_url or transform is None:
        return row.text or "", s
    try:
        answer = transform(row, {"image_url": image_url, "entity_type": row.type, **options})
    except Exception:  # the caller's client failed in its own way: the text is the answer
        answer = None
    if not answer or not answer.get("success"):
        return row.text or "", s
    new = F.create_map(F.lit("transformation"), F.lit(json.dumps(answer)))
    this = (F.col("doc_id") == row.doc_id) & (F.col("id") == row.id) & F.col("ord").eqNullSafe(F.struct(*(F.lit(v).alias(k) for k, v in row.ord.asDict().items())).cast(s.df.schema["ord"].dataType))
    old = F.map_filter(F.coalesce("data", F.create_map().cast("map<string,string>")), lambda k, _: k != "transformation")
    return answer["markdown"], replace(s, df=s.df.withColumn("data", F.when(this, F.map_concat(old, new)).otherwise(F.col("data"))))


__all__ = ["CHANGES", "LOG", "apply_changes", "attribute", "changes_of", "datum", "markdown", "remove_attributes", "set_attributes", "set_data", "toggle"]
