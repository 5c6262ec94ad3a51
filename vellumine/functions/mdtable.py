"""Two readings of Markdown tables: one for cells, one for rendering.

They differ on purpose.  The cell reading drops what is outside the outer pipes
and skips separators anywhere; the rendering keeps what follows the last pipe
and skips later lines that contain three dashes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import js

SEPARATOR = rf"^\|?{js.SPACE}*[-:]+{js.SPACE}*\|"


Trim = Callable[[Column], Column]


def _lines(markdown: Column, trim: Trim = js.trim) -> Column:
    return F.filter(F.split(markdown, "\n", -1), lambda x: trim(x) != "")


def cell_rows(markdown: Column) -> Column:
    """Array of rows, each an array of trimmed cells; the first is the header."""

    def rows(trim: Trim) -> Column:
        lines = F.filter(F.transform(F.split(markdown, "\n", -1), trim), lambda x: F.contains(x, F.lit("|")) & ~x.rlike(SEPARATOR))
        parts = F.transform(lines, lambda x: F.split(x, r"\|", -1))
        inner = F.transform(parts, lambda p: F.transform(F.slice(p, 2, F.greatest(F.size(p) - 2, F.lit(0))), trim))
        return F.filter(inner, lambda r: F.size(r) > 0)

    return js.trimming(markdown, rows)


def _html_row(line: Column, tag: str, trim: Trim) -> Column:
    cells = F.transform(F.slice(F.split(line, r"\|", -1), 2, F.length(line) + 1), lambda c: F.concat(F.lit(f"<{tag}>"), js.escape_html(trim(c)), F.lit(f"</{tag}>")))
    return F.concat(F.lit("<tr>"), F.array_join(cells, ""), F.lit("</tr>"))


def table_html(markdown: Column, prefix: str) -> Column:
    """An HTML table, or the text itself in ``pre`` if it has no header and body."""
    plain = F.concat(F.lit(f'<pre class="{prefix}-markdown">'), js.escape_html(markdown), F.lit("</pre>"))

    def table(lines: Column, trim: Trim) -> Column:
        head = F.get(lines, 0)
        body = F.filter(F.slice(lines, 2, F.size(lines)), lambda x: ~F.contains(x, F.lit("---")))
        html = F.concat(
            F.lit(f'<table class="{prefix}-table"><thead>'), _html_row(head, "th", trim), F.lit("</thead><tbody>"), F.array_join(F.transform(body, lambda x: _html_row(x, "td", trim)), "\n"), F.lit("</tbody></table>")
        )
        return F.when((F.size(lines) >= 2) & F.contains(head, F.lit("|")), html).otherwise(plain)

    return js.trimming(markdown, lambda trim: js.once(_lines(js.trim(markdown), trim), lambda lines: table(lines, trim)))


def markdown_of(rows: Column) -> Column:
    """A Markdown table of an array of rows of texts; '' for none."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | ", ""), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.array_join(F.transform(F.get(rows, 0), lambda _: F.lit("---")), "|"), F.lit("|"))
    all_lines = F.concat(F.array(line(F.get(rows, 0)), rule), F.transform(F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1))), line))
    return F.when(F.size(rows) > 0, js.trim(F.array_join(all_lines, "\n"))).otherwise("")


def html_rows(html: Column) -> Column:
    """Rows of the cells of an HTML table, tags stripped; ``<t[dh]`` also opens at ``<thead``."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cells = F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh][^>]*>(.*?)</t[dh]>"), F.lit(1)), lambda c: js.trim(F.regexp_replace(c, "<[^>]*>", ""))))
    return F.filter(cells, lambda r: F.size(r) > 0)
