"""Types and values of short texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import js

# Possessive, so that no text is read again: what may follow a repetition is never part of it.
CURRENCY = rf"^[$£€¥]?{js.SPACE}*+-?[0-9,]++(?:\.[0-9]*+)?{js.SPACE}*+[万亿千]?\z"
PERCENTAGE = rf"^-?[0-9]++(?:\.[0-9]*+)?{js.SPACE}*+%\z"
DATE = r"^[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}\z|^[0-9]{1,2}[-/][0-9]{1,2}[-/][0-9]{2,4}\z"
NO_NUMBER = js.PY_SPACE + "$£€¥,万亿千%"  # what texts of those kinds have besides digits, points and minus signs


def trimmed_type(t: Column) -> Column:
    """Type of a trimmed text; first and last characters tell which one of the patterns can match (one of plain numbers is a currency)."""
    first = F.substring(t, 1, 1)
    numeric = F.contains(F.lit("$£€¥-,0123456789"), first)
    dated = F.contains(F.lit("0123456789"), first) & (F.contains(t, F.lit("-")) | F.contains(t, F.lit("/")))
    pattern = F.when(F.endswith(t, F.lit("%")), F.when(t.rlike(PERCENTAGE), "percentage")).when(dated, F.when(t.rlike(DATE), "date")).when(t.rlike(CURRENCY), "currency")
    return F.coalesce(F.when(numeric, pattern), F.when(js.shorter(t, 50) & ~F.contains(t, F.lit("\n")), "label").when(t.isNotNull(), "text"))


def entity_type(text: Column, label: Column | None = None) -> Column:
    """Label hints first (total, then date), then patterns (a plain number is currency), then length; NULL for NULL."""
    shaped = js.once(js.trim(text), trimmed_type)
    if label is None:
        return shaped
    low = F.lower(label)
    return F.when(F.contains(low, F.lit("total")), "total").when(F.contains(low, F.lit("date")), "date").otherwise(shaped)


def prefix_number(text: Column) -> Column:
    """The number at the start of a text of which only digits, points and minus signs are kept."""
    kept = F.regexp_replace(text, r"[^0-9.\-]", "")
    return F.regexp_extract(kept, r"^-?(?:[0-9]+\.?[0-9]*|\.[0-9]+)", 0).try_cast("double")


def typed_value(text: Column, kind: Column) -> Column:
    """``numeric_value`` where ``kind`` is the ``trimmed_type`` of the trimmed text (or no numeric kind), so all that is kept is the number."""
    kept = F.translate(text, NO_NUMBER, "")
    return F.when(kind.isin("currency", "number", "percentage"), kept.try_cast("double") / F.when(kind == "percentage", 100.0).otherwise(1.0))


def numeric_value(text: Column, kind: Column) -> Column:
    """Value of a currency, number or percentage; NULL for other kinds."""
    return F.when(kind.isin("currency", "number", "percentage"), prefix_number(text) / F.when(kind == "percentage", 100.0).otherwise(1.0))
