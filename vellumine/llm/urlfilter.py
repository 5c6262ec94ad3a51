"""URL filters indexed by their rarest literal token.

A rule is a pattern over URLs in the common filter-list notation: ``*`` any
characters, ``^`` a separator or the end, a leading ``||`` the start of a host or
of one of its parent domains, a leading or final ``|`` the start or end of the
URL, ``/.../`` a regular expression; a leading ``@@`` makes an exception.
Matching ignores case: rules other than regular expressions are compared with
the URL in lower case, regular expressions with the URL itself, ignoring the
case of ASCII letters.

The tokens of a URL are its longest runs of ASCII letters and digits.  A run of
a rule is one of its tokens if it must be a whole token of every URL that
matches: its neighbours in the pattern are other literal characters, separators
or anchors, not ``*`` or an open end.  Token counts over all URLs are taken once,
each rule is filed under its rarest token, and the join of URL tokens with this
index gives each URL its candidate rules; only those run their expression.
Rules without a token (expressions, among others) are candidates everywhere; one
pass over the URLs runs them all.

A URL is blocked if a rule matches and no exception does.

Defined cases: a null URL matches nothing and is kept; an empty one only meets
rules without a token; equal URLs are matched once and share the result, each row
keeping its id; long URLs are read whole; repeated or empty rules count once or
not at all; null ids are carried; empty tables give empty results; extra columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import col
from .storage import written

RULES = (
    "utm_source=feed", "&ref=x|", "/page=[0-9]*5&/", "||example.org/de/", "||blog.*.example.com^", "|http://m.", "#top|", ".html|",
    "@@||example.com/fr/*.html|", "@@||ththre.example.net^", "||ads.example.com^", "||tracker.example.net^", "/banner/*/img^", "/adserver/", "-advert-", "&popunder=",
    "||doubleclick.example^", "?affiliate_id=", "/pixel.gif?", "||example.net/es/*?page=2", "||ththon.example.org^", "/en/13|", "/en/7?", "||spam.*^", "/wp-login.php", "casino", "@@||casino.example.org/help^", "/^https?:\\/\\/www\\.[a-z]+\\.example\\.com\\/de\\/[0-9]{3}$/", "|https://tionsh.", "^click^",
)
_SEPARATOR = r"(?:[^a-z0-9_.%-]|\z)"
_TOKEN = re.compile(r"[a-z0-9]+")


def _is_regex(rule: str) -> bool:
    return len(rule) > 2 and rule.startswith("/") and rule.endswith("/") and any(c in rule for c in "\\[](){}+$")


def expression(rule: str) -> str:
    """The regular expression of a rule without ``@@``, in the syntax that Java and RE2 share; for URLs in lower case, but those of ``/.../`` for any."""
    if _is_regex(rule):
        return "(?i)" + rule[1:-1]
    body, head, tail = rule.lower(), "", ""
    if body.startswith("||"):
        head, body = r"\A[a-z][a-z0-9+.-]*://(?:[^/?#]*[.@])?", body[2:]
    elif body.startswith("|"):
        head, body = r"\A", body[1:]
    if body.endswith("|"):
        tail, body = r"\z", body[:-1]
    out = "".join(r"(?s:.*)" if c == "*" else _SEPARATOR if c == "^" else c if c.isalnum() or c == "_" else "\\" + c if ord(c) < 128 else c for c in body)
    return head + out + tail


def literal_tokens(rule: str) -> list[str]:
    """Tokens that every URL matching the rule has."""
    if _is_regex(rule):
        return []
    body = rule.lower()
    start = body.startswith("|")
    body = body.lstrip("|") if start else body
    end = body.endswith("|")
    body = body[:-1] if end else body
    out = []
    for m in _TOKEN.finditer(body):
        left = start if m.start() == 0 else body[m.start() - 1] != "*"
        right = end if m.end() == len(body) else body[m.end()] != "*"
        if left and right:
            out.append(m[0])
    return sorted(set(out))


def parsed(rules: Iterable[str | None]) -> list[tuple[int, str, bool, str, list[str]]]:
    """Number, text, whether an exception, expression and tokens of each distinct rule."""
    out = []
    for rule in dict.fromkeys(r.strip() for r in rules if r and r.strip("@ ")):
        exception = rule.startswith("@@")
        body = rule[2:] if exception else rule
        out.append((len(out), rule, exception, expression(body), literal_tokens(body)))
    return out


def _tokens(url: str):
    return F.array_distinct(F.expr(f"regexp_extract_all({url}, '[a-z0-9]+', 0)"))


def matches(urls: DataFrame, rules: Iterable[str | None] = RULES) -> DataFrame:
    """Columns url, blocked, rules (numbers of all rules that match, ascending) for each distinct URL that some rule matches.

    ``urls`` has the column url.
    """
    spark = urls.sparkSession
    known = parsed(rules)
    table = spark.createDataFrame(known, "rule int, text string, exception boolean, expression string, tokens array<string>")
    # Written once: token counts, candidates and rules without a token all read the distinct URLs.
    distinct = written(urls.where("url is not null").select("url").distinct().withColumn("low", F.lower("url")).withColumn("tokens", _tokens("low")), "urls")
    tokens = distinct.select("url", "low", F.explode("tokens").alias("token"))
    small = F.broadcast if len(known) <= 100_000 else (lambda df: df)
    # Only the tokens that rules have are counted: as many rows as rules have tokens.
    wanted = table.select(F.explode("tokens").alias("token")).distinct()
    counts = tokens.join(small(wanted), "token").groupBy("token").count()
    rated = table.select("rule", F.explode("tokens").alias("token")).join(counts, "token", "left")
    index = rated.groupBy("rule").agg(F.min_by("token", F.struct(F.coalesce("count", F.lit(0)), "token")).alias("token")).join(table, "rule").select("token", "rule", "exception", "expression")
    met = tokens.join(small(index), "token").where(F.expr("regexp_like(low, expression)")).select("url", "rule", "exception")
    everywhere = [(n, e, x) for n, _, e, x, own in known if not own]
    if everywhere:
        met = met.unionByName(distinct.select("url", "low").mapInArrow(_everywhere(everywhere), "url string, rule int, exception boolean"))
    return met.groupBy("url").agg((~F.bool_or("exception")).alias("blocked"), F.array_sort(F.collect_set("rule")).alias("rules"))


def _everywhere(rules: list[tuple[int, bool, str]]):
    """A task that runs some rules on every URL, each as one vectorised search of RE2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            url, low = batch.column(0), batch.column(1)
            for number, exception, expression_ in rules:
                hit = pa.compute.match_substring_regex(url if expression_.startswith("(?i)") else low, expression_)
                found = url.filter(hit)
                if len(found):
                    yield pa.RecordBatch.from_arrays([found.cast(pa.string()), pa.array([number] * len(found), pa.int32()), pa.array([exception] * len(found))], ["url", "rule", "exception"])

    return run


def filtered(pages: DataFrame, rules: Iterable[str | None] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Columns page_id, url, blocked, rules, one row for each row of ``pages``."""
    rows = pages.select(col(id_col).alias("page_id"), col(url_col).cast("string").alias("url"))
    joined = rows.join(matches(rows, rules), "url", "left")
    return joined.select("page_id", "url", F.coalesce("blocked", F.lit(False)).alias("blocked"), F.coalesce("rules", F.array().cast("array<int>")).alias("rules"))


def filter_sql(rules: Iterable[str | None] = RULES) -> str:
    """DuckDB SQL for ``filtered`` over pages: every rule's expression on every URL."""
    known = parsed(rules)
    values = ", ".join("({}, {}, '{}')".format(n, str(e).lower(), x.replace("'", "''")) for n, _, e, x, _ in known)
    return f"""
WITH rules(rule, exception, expression) AS (VALUES {values}),
met AS (SELECT page_id, url, rule, exception FROM pages JOIN rules ON regexp_matches(CASE WHEN starts_with(expression, '(?i)') THEN url ELSE lower(url) END, expression))
SELECT p.page_id, p.url, coalesce(NOT bool_or(m.exception), false) AS blocked,
  coalesce(list(m.rule ORDER BY m.rule) FILTER (m.rule IS NOT NULL), []::INTEGER[]) AS rules
FROM pages p LEFT JOIN met m ON p.page_id = m.page_id GROUP BY p.page_id, p.url
"""
