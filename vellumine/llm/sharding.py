"""Reproducible shuffle into shards by a Feistel permutation with cycle walking.

Rows are numbered 0 to n - 1 by id.  A Feistel network over pairs (x div b,
x mod b), with a = ceil(sqrt n) and b = ceil(n / a), permutes 0 to a b - 1;
while the result is n or more it is permuted again, so 0 to n - 1 is permuted.
A row's position follows from its number, n and the seed alone: shard =
position mod shards, slot = position div shards; shard sizes differ by at most
one and slots have no gaps.  ``unpermuted`` computes the row at a position.

Fewer than a of the a b values lie outside, so walks are short; the few steps
allowed below are never exceeded in practice and an excess is an error.

Defined cases: rows with a null id come first; rows with equal ids are ordered
by the hash of their content, and equal rows are interchangeable; an empty table
gives an empty result; a null or empty text is content like any other; extra
columns are carried, and columns named row_number, position, shard or slot are
replaced by the new ones.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import content_hash, numbered

ROUNDS, WALKS = 6, 40
SHARDS, SEED = 64, 20240229
PRIME = (1 << 31) - 1
_MULTIPLIER = 48271


def round_keys(seed: int) -> list[tuple[int, int]]:
    """Multiplier and addend of each round."""
    out, x = [], seed % (PRIME - 1) + 1
    for _ in range(ROUNDS):
        pair = []
        for _ in range(2):
            for _ in range(5):
                x = x * _MULTIPLIER % PRIME
            pair.append(x)
        out.append((pair[0], pair[1]))
    return out


def sides(n: int) -> tuple[int, int]:
    """The smallest near-square a, b with a b at least n."""
    a = max(1, math.isqrt(max(n, 1) - 1) + 1 if n > 1 else 1)
    return a, max(1, -(-n // a))


def noise(x: int, m: int, c: int) -> int:
    """The round function: two multiplications modulo a prime, with a square between."""
    y = ((x % PRIME) * m + c) % PRIME
    y = (y * y + c) % PRIME
    return (y * _MULTIPLIER + m) % PRIME


def permuted(x: int, n: int, seed: int) -> int:
    """The position of row number x."""
    a, b = sides(n)
    while True:
        left, right = divmod(x, b)
        for k, (m, c) in enumerate(round_keys(seed)):
            if k % 2 == 0:
                left = (left + noise(right, m, c)) % a
            else:
                right = (right + noise(left, m, c)) % b
        x = left * b + right
        if x < n:
            return x


def unpermuted(position: int, n: int, seed: int) -> int:
    """The row number at a position."""
    a, b = sides(n)
    x = position
    while True:
        left, right = divmod(x, b)
        for k, (m, c) in reversed(list(enumerate(round_keys(seed)))):
            if k % 2 == 0:
                left = (left - noise(right, m, c)) % a
            else:
                right = (right - noise(left, m, c)) % b
        x = left * b + right
        if x < n:
            return x


def permutation(x: Column, n: int, seed: int) -> Column:
    """``permuted`` as a column expression."""
    a, b = sides(n)
    big = lambda v: F.lit(v).cast("long")

    def f(v: Column, m: Column, c: Column) -> Column:
        y = (v % big(PRIME) * m + c) % big(PRIME)
        z = F.element_at(F.transform(F.array(y), lambda y: (y * y + c) % big(PRIME)), 1)
        return (z * big(_MULTIPLIER) + m) % big(PRIME)

    keys = F.array(*(F.struct(F.lit(k % 2 == 0).alias("even"), big(m).alias("m"), big(c).alias("c")) for k, (m, c) in enumerate(round_keys(seed))))

    def turn(s: Column, k: Column) -> Column:
        left = F.when(k["even"], (s["l"] + f(s["r"], k["m"], k["c"])) % big(a)).otherwise(s["l"])
        right = F.when(k["even"], s["r"]).otherwise((s["r"] + f(s["l"], k["m"], k["c"])) % big(b))
        return F.struct(left.alias("l"), right.alias("r"))

    def once(v: Column) -> Column:
        begin = F.struct(F.floor(v / big(b)).cast("long").alias("l"), (v % big(b)).alias("r")) if n < (1 << 50) else F.struct(((v - v % big(b)) / big(b)).cast("long").alias("l"), (v % big(b)).alias("r"))
        return F.aggregate(keys, begin, turn, lambda s: s["l"] * big(b) + s["r"])

    walk = F.aggregate(F.sequence(F.lit(0), F.lit(WALKS)), F.struct(x.cast("long").alias("x"), F.lit(False).alias("ended")), lambda s, _: F.when(s["ended"], s).otherwise(F.element_at(F.transform(F.array(once(s["x"])), lambda y: F.struct(y.alias("x"), (y < big(n)).alias("ended"))), 1)))
    done = lambda s: F.when(s["ended"], s["x"]).otherwise(F.raise_error(F.lit("the walk is too long")).cast("long"))
    return F.element_at(F.transform(F.array(walk), done), 1)


def sharded(docs: DataFrame, id_col: str = "doc_id", shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``docs`` with row_number, position, shard and slot."""
    docs = docs.drop("row_number", "position", "shard", "slot")
    n = docs.count()
    out = numbered(docs, [id_col], content_hash(docs))
    out = out.withColumn("position", permutation(F.col("row_number"), n, seed))
    return out.withColumn("shard", (F.col("position") % shards).cast("int")).withColumn("slot", F.floor(F.col("position") / shards).cast("long"))


def sharding_sql(shards: int = SHARDS, seed: int = SEED) -> str:
    """DuckDB SQL for ``sharded`` over documents: doc_id, row_number, position, shard, slot."""
    keys = ", ".join(f"({k}, {m}, {c})" for k, (m, c) in enumerate(round_keys(seed)))
    y = lambda v: f"((({v} % {PRIME}) * m + c) % {PRIME})"
    f = lambda v: f"(((({y(v)} * {y(v)} + c) % {PRIME}) * {_MULTIPLIER} + m) % {PRIME})"
    return f"""
WITH RECURSIVE size AS (SELECT count(*) AS n FROM documents),
box AS (SELECT n, greatest(1, ceil(sqrt(n))::BIGINT) AS a, greatest(1, ceil(n / greatest(1, ceil(sqrt(n))))::BIGINT) AS b FROM size),
keys(k, m, c) AS (VALUES {keys}),
walk(doc_id, row_number, l, r, k) AS (
  SELECT doc_id, rn, rn // b, rn % b, 0
  FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id NULLS FIRST) - 1 AS rn FROM documents), box
  UNION ALL
  SELECT doc_id, row_number,
    CASE WHEN w.k % 2 = 0 THEN (l + {f('r')}) % a ELSE l END,
    CASE WHEN w.k % 2 = 0 THEN r ELSE (r + {f('l')}) % b END,
    w.k + 1
  FROM (SELECT doc_id, row_number, l, r, CASE WHEN k = {ROUNDS} THEN 0 ELSE k END AS k FROM walk, box WHERE k < {ROUNDS} OR l * b + r >= n) w
  JOIN keys ON keys.k = w.k, box
)
SELECT doc_id, row_number, l * b + r AS position, ((l * b + r) % {shards})::INTEGER AS shard, (l * b + r) // {shards} AS slot
FROM walk, box WHERE k = {ROUNDS} AND l * b + r < n
"""
