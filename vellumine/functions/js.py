"""Text and number conversions with the rules of ECMAScript, as Column expressions.

Missing values are NULL.  All expressions stay in the JVM.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
PY_SPACE = "\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
_PREFIX = re.compile(r"[+-]?(?:Infinity|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)")
_WHOLE = r"[+-]?(?:Infinity|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"


def trim(c: Column) -> Column:
    """Without white space at either end."""
    return F.btrim(c, F.lit(PY_SPACE))


def trimming(c: Column, f: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """``f`` of what trims parts of ``c``: in printable ASCII with line ends, parts of a line are only trimmed of blanks, which is faster."""
    return F.when(c.rlike(r"^[ -~\n]*+\z"), f(lambda x: F.trim(x))).otherwise(f(trim))


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f(c)`` with ``c`` evaluated once, however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def number_text(x: Column) -> Column:
    """The shortest text of a double: no fraction if whole, plain from 1e-6 to 1e21, else with exponent."""
    s = x.cast("string")
    size = F.abs(x)
    whole = F.when(size < 9007199254740992.0, x.cast("bigint").cast("string")).otherwise(s.try_cast("decimal(38,0)").cast("string"))
    plain = F.regexp_replace(s.try_cast("decimal(38,18)").cast("string"), r"0+\z", "")
    power = F.regexp_replace(F.regexp_replace(s, r"\.0E", "e"), r"E", "e")
    power = F.regexp_replace(power, r"e(?=[0-9])", "e+")
    return (
        F.when(F.isnan(x), "NaN")
        .when(size == float("inf"), F.when(x > 0, "Infinity").otherwise("-Infinity"))
        .when(((size >= 9007199254740992.0) | (x == F.floor(x))) & (size < 1e21), whole)
        .when((size >= 1e-6) & (size < 1e21), F.when(F.contains(s, F.lit("E")), plain).otherwise(s))
        .otherwise(power)
    )


def to_number(s: Column) -> Column:
    """The number that a whole text is; NULL where that would be NaN."""
    t = trim(s)
    return (
        F.when(t == "", F.lit(0.0))
        .when(t.rlike(f"^{_WHOLE}\\z"), F.regexp_replace(t, r"^\+", "").try_cast("double"))
        .when(t.rlike(r"^0[xX][0-9a-fA-F]{1,16}\z"), F.conv(F.substring(t, 3, 16), 16, 10).try_cast("double"))
    )


def shorter(c: Column, n: int) -> Column:
    """Whether a text has fewer than ``n`` UTF-16 units; they are counted only where the characters don't tell."""
    size = F.length(c)
    return F.when(size >= n, False).when(size * 2 < n, True).otherwise(utf16_length(c) < n)


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units."""
    return F.length(F.regexp_replace(c, r"[\x{10000}-\x{10FFFF}]", "xx"))


def escape_html(c: Column) -> Column:
    """The five characters that mean something in HTML, as entities."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


_DATES = ("yyyy-MM-dd", "yyyy/M/d", "M/d/yyyy", "MMMM d, yyyy", "MMM d, yyyy", "MMM d yyyy", "MMMM d yyyy", "d MMM yyyy", "d MMMM yyyy", "yyyy-MM", "yyyy")
_TIMES = ("", " HH:mm", " HH:mm:ss")


def epoch_ms(c: Column) -> Column:
    """Milliseconds of a date text; NULL if it is none.

    ISO texts, numeric dates with slashes (month first), English month names in
    either order with or without a time, and mail dates ("Fri, 05 Jan 2024
    10:00:00 GMT").  A date without a zone is one of the session's zone, which
    should be UTC.
    """
    day = r"^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)[a-z]*,? +"
    plain = F.regexp_replace(F.regexp_replace(trim(c), day, ""), r" +(?:GMT|UTC|Z)\z", "")
    iso = F.try_to_timestamp(c)
    other = F.coalesce(*(F.try_to_timestamp(plain, F.lit(d + t)) for d in _DATES for t in _TIMES if not t or len(d) > 7))
    return F.unix_millis(F.when(c.rlike(r"^[0-9]{4}-[0-9]{2}(?:-[0-9]{2})?(?:[T ]|\z)"), F.coalesce(iso, F.try_to_timestamp(c, F.lit("yyyy-MM")))).otherwise(other))


def rounded_percent(x: Column) -> Column:
    """A share as whole percent, half up."""
    return F.format_string("%.0f", x * 100)


def to_fixed(x: float, digits: int) -> str:
    """Rounded half up from the exact binary value."""
    return str(Decimal(x).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def parse_float(s: str) -> float | None:
    """The number that a text begins with."""
    m = _PREFIX.match(s.lstrip(PY_SPACE))
    return None if m is None else float(m[0].replace("Infinity", "inf"))


def unquoted(s: str) -> str:
    """Without one quote at either end."""
    return re.sub(r"^[\"']|[\"']\Z", "", s)


def literal(s: str) -> str | float | bool:
    """A selector's literal: a boolean, a number by prefix, or text without quotes."""
    if s in ("true", "false"):
        return s == "true"
    x = parse_float(s)
    return unquoted(s) if x is None else x


def literal_text(v: str | float | bool) -> str:
    """Text of a literal."""
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, str):
        return v
    if math.isinf(v):
        return "Infinity" if v > 0 else "-Infinity"
    if v == int(v) and abs(v) < 1e21:
        return str(int(v))
    r = repr(v)
    if 1e-6 <= abs(v) < 1e21:
        return format(Decimal(r), "f") if "e" in r else r
    return re.sub(r"e-0*", "e-", re.sub(r"e\+?0*(?=\d)", "e+", r)) if "e" in r else r


def literal_number(v: str | float | bool) -> float | None:
    """Number of a literal; None for NaN."""
    if isinstance(v, bool):
        return float(v)
    if isinstance(v, str):
        t = v.strip(PY_SPACE)
        if t == "":
            return 0.0
        if re.fullmatch(r"0[xX][0-9a-fA-F]+", t):
            return float(int(t, 16))
        return float(t.replace("Infinity", "inf")) if _PREFIX.fullmatch(t) else None
    return v




def java_pattern(pattern: str, ignore_case: bool = False) -> str:
    """An ECMAScript pattern in Java's syntax; syntax that differs is refused."""
    if re.search(r"\\k<|\\u\{|\\c[A-Za-z]|\[\^?\]", pattern):
        raise ValueError(f"unsupported in patterns: {pattern!r}")
    out, i, inside = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            d = pattern[i + 1]
            out.append({"s": SPACE[1:-1] if inside else SPACE, "S": "\\S" if inside else "[^" + SPACE[1:], "v": "\\x0B", "/": "/", "-": "\\-"}.get(d, c + d))
            i += 2
            continue
        if c == "[":
            out.append("\\[" if inside else "[")
            inside = True
        elif c == "]":
            out.append(c)
            inside = False
        elif c == "$" and not inside:
            out.append("\\z")
        elif c == "&" and inside:
            out.append("\\&")
        else:
            out.append(c)
        i += 1
    return ("(?iu)" if ignore_case else "") + "".join(out)
