"""The selector language, compiled once on the driver to Column predicates.

    selector := '' | '*' | branch (',' branch)*
    branch   := part+ (':first'|':last'|':even'|':odd'|':eq(N)'|':gt(N)'|':lt(N)')?
    part     := '*' | '.type' | '#id' | '[attr]' | '[attr op literal]' | ':contains(t)' | ':page(n)' | ':pages(a-b)'

``=``, ``^=``, ``$=`` and ``*=`` compare text, ``!=`` text of the parsed literal,
``<``, ``<=``, ``>`` and ``>=`` numbers.  Other characters between parts are
skipped, unknown parts never match, and a branch without parts matches nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import js
from ..sources.schema import FIELDS, META

_INDEX = [(re.compile(p), k) for p, k in ((r":first\Z", "first"), (r":last\Z", "last"), (r":even\Z", "even"), (r":odd\Z", "odd"), (r":eq\(([0-9]+)\)\Z", "eq"), (r":gt\(([0-9]+)\)\Z", "gt"), (r":lt\(([0-9]+)\)\Z", "lt"))]
_WORD = re.compile(r"[A-Za-z0-9_-]")


@dataclass(frozen=True)
class Index:
    """A place in the matches of a branch, counted from 0."""

    kind: str
    n: int = 0


@dataclass(frozen=True)
class Branch:
    """Parts that must all hold, then perhaps an index."""

    parts: tuple[str, ...]
    index: Index | None = None


def split_or(selector: str) -> list[str]:
    """Branches between commas outside brackets and parentheses."""
    out, part, depth = [], "", 0
    for c in selector:
        depth += (c in "[(") - (c in "])")
        if c == "," and depth == 0:
            out.append(part.strip(js.PY_SPACE))
            part = ""
        else:
            part += c
    return [*out, part.strip(js.PY_SPACE)] if part.strip(js.PY_SPACE) else out


def split_parts(selector: str) -> tuple[str, ...]:
    """Parts of a compound selector; an attribute ends at the first bracket."""
    out, i, n = [], 0, len(selector)

    def word(k: int) -> int:
        while k < n and _WORD.match(selector[k]):
            k += 1
        return k

    while i < n:
        c = selector[i]
        j = i + 1
        if c in ".#":
            j = word(j)
            if j > i + 1:
                out.append(selector[i:j])
        elif c == "[":
            close = selector.find("]", j)
            j = n if close < 0 else close + 1
            out.append(selector[i:j])
        elif c == ":":
            j = word(j)
            if j < n and selector[j] == "(":
                depth, j = 1, j + 1
                while j < n and depth:
                    depth += (selector[j] == "(") - (selector[j] == ")")
                    j += 1
            if j > i + 1:
                out.append(selector[i:j])
        elif c == "*":
            out.append("*")
        i = j
    return tuple(out)


def peel_index(selector: str) -> Branch:
    """A branch with its index taken off; only at the very end, after nothing else."""
    for pattern, kind in _INDEX:
        m = pattern.search(selector)
        if m:
            base = selector[: m.start()].strip(js.PY_SPACE) or "*"
            return Branch(split_parts(base), Index(kind, int(m[1]) if m.groups() else 0))
    return Branch(split_parts(selector))


def parse(selector: str | None) -> list[Branch] | None:
    """Branches of a selector; None selects everything."""
    if selector is None or selector in ("", "*"):
        return None
    parts = split_or(selector)
    return [peel_index(selector)] if len(parts) == 1 else [peel_index(p) for p in parts]


@dataclass(frozen=True)
class Attributes:
    """Resolves attribute names to columns: metadata, custom metadata, then entity fields."""

    columns: frozenset[str]

    def _custom(self, key: str) -> Column | None:
        return F.try_element_at("extra", F.lit(key)) if "extra" in self.columns else None

    def _field(self, key: str) -> tuple[Column | None, str]:
        column, kind = META.get(key) or FIELDS.get(key) or ("", "none")
        return (F.col(column), kind) if column in self.columns else (None, "none")

    def text(self, key: str) -> Column:
        """Text of the attribute; NULL where undefined."""
        c, kind = self._field(key)
        shown = F.lit(None).cast("string")
        if c is not None:
            shown = {
                "str": lambda: c, "bool": lambda: c.cast("string"), "num": lambda: js.number_text(c.cast("double")), "object": lambda: F.when(c.isNotNull(), F.lit("[object Object]")),
                "value": lambda: F.coalesce(js.number_text(c), F.col("value_str")) if "value_str" in self.columns else js.number_text(c),
            }[kind]()
        custom = None if key in META else self._custom(key)
        return shown if custom is None else F.coalesce(custom, shown)

    def number(self, key: str) -> Column:
        """Number of the attribute; NULL where undefined or no number."""
        c, kind = self._field(key)
        if c is None and key not in META:
            custom = self._custom(key)
            return F.lit(None).cast("double") if custom is None else js.to_number(custom)
        if c is None:
            return F.lit(None).cast("double")
        if kind == "str":
            return js.to_number(c)
        if kind == "bool":
            return c.cast("int").cast("double")
        if kind == "object":
            return F.lit(None).cast("double")
        if kind == "value" and "value_str" in self.columns:
            return F.when(c.isNotNull(), c).otherwise(js.to_number(F.col("value_str")))
        return c

    def present(self, key: str) -> Column:
        """Whether the attribute is defined."""
        c, kind = self._field(key)
        found = F.lit(False) if c is None else (c.isNotNull() | F.col("value_str").isNotNull() if kind == "value" and "value_str" in self.columns else c.isNotNull())
        custom = None if key in META else self._custom(key)
        return found if custom is None else found | custom.isNotNull()

    def floats(self, key: str) -> bool:
        """Whether the attribute's column may hold NaN."""
        return self._field(key)[1] == "value" or key == "confidence" or self._field(key)[0] is None


def _attribute(content: str, a: Attributes) -> Column:
    m = re.match(r"(\w+)([\^$*]?=)(.+)\Z", content, re.ASCII)
    if m:
        key, op, raw = m.groups()
        c, v = F.coalesce(a.text(key), F.lit("")), F.lit(js.unquoted(raw))
        if op == "=":
            plain = a._field(key)
            return F.col(META.get(key, FIELDS.get(key))[0]) == v if plain[1] == "str" and js.unquoted(raw) != "" and (key in META or "extra" not in a.columns) else c == v
        return {"^=": F.startswith, "$=": F.endswith, "*=": F.contains}[op](c, v)
    m = re.match(r"(\w+)(>=?|<=?|!=)(.+)\Z", content, re.ASCII)
    if m:
        key, op, raw = m.groups()
        v = js.literal(raw)
        if op == "!=":
            return F.coalesce(a.text(key), F.lit("undefined")) != F.lit(js.literal_text(v))
        x, number = a.number(key), js.literal_number(v)
        if number is None:
            return F.lit(False)
        test = {">": x > number, ">=": x >= number, "<": x < number, "<=": x <= number}[op]
        return test & ~F.isnan(x) if a.floats(key) else test
    m = re.match(r"(\w+)\Z", content, re.ASCII)
    return a.present(m[1]) if m else F.lit(False)


def _page(content: str) -> Column | None:
    page = F.col("page_index")
    m = re.match(r"(<=?|>=?)([0-9]+)\Z", content)
    if m:
        n = int(m[2]) - 1
        return {"<": page < n, "<=": page <= n, ">": page > n, ">=": page >= n}[m[1]]
    m = re.match(r"\s*([+-]?[0-9]+)", content)
    return page == int(m[1]) - 1 if m else None


def _part(part: str, a: Attributes) -> Column:
    if part == "*":
        return F.lit(True)
    if part[0] == ".":
        return F.col("type") == part[1:]
    if part[0] == "#":
        return F.col("id") == part[1:]
    if part[0] == "[" and part.endswith("]"):
        return _attribute(part[1:-1], a)
    if part.startswith(":contains(") and part.endswith(")"):
        return F.contains(F.lower("text"), F.lit(js.unquoted(part[10:-1]).lower()))
    if part.startswith(":page(") and part.endswith(")"):
        found = _page(part[6:-1])
        if found is not None:
            return found
    if part.startswith(":pages(") and part.endswith(")"):
        m = re.match(r"([0-9]+)-([0-9]+)\Z", part[7:-1])
        if m:
            return F.col("page_index").between(int(m[1]) - 1, int(m[2]) - 1)
    return F.lit(False)


def predicate(parts: tuple[str, ...], columns: list[str]) -> Column:
    """All parts; NULL counts as no match in a filter."""
    a = Attributes(frozenset(columns))
    return reduce(lambda x, y: x & y, (_part(p, a) for p in parts)) if parts else F.lit(False)


def compound(selector: str, columns: list[str]) -> Column:
    """The predicate of ``filter`` and ``not_``: one compound, in which commas are skipped and indexes never match."""
    return F.lit(True) if selector == "*" else predicate(split_parts(selector), columns)
