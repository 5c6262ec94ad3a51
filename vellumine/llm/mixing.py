"""Mixing sources to target weights by Pfair scheduling.

The documents of a source, ordered by id, form blocks of ``block`` documents.
Time is cut in slots of one block.  A source of weight w has its j-th block
released at floor(j / w) and due at ceil((j + 1) / w); in every slot the released
block with the earliest deadline goes next (ties: first source in alphabetical
order).  As the weights sum to one, no deadline is missed, so after any number
of slots t each source has been given less than one block more or less than w t.

Releases and deadlines are computed in whole numbers from the weights themselves
(a float is a fraction).  One task simulates the slots, not the documents, and
writes the slots of each source in chunks, so it holds a chunk a source; all
documents find their slots in parallel.

The mix ends when every source has been used up once; a source that is used up
earlier starts over (its ``epoch`` counts up) within the same block, and block
numbers run on, so every block of a repeated source is full, no document is lost
and the shares hold in documents too.  Only a source that is not repeated may
end with a short block.  Without ``weights`` a source of n documents weighs the
whole number nearest to 2^20 n ** temperature.

Defined cases: a null source is the source ''; with ``weights``, sources that
are not named or have no positive weight are left out; null ids come first in
their source and equal ids are ordered by the rows' hash; repeated rows count
as documents; a null or empty text is content like any other; an empty table
gives an empty result; extra columns are carried; ``mixed`` replaces columns
named epoch, block, slot or position, ``repeated`` keeps them.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Mapping
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import col, free, named
from .order import content_hash, numbered
from .storage import written

BLOCK, TEMPERATURE, SCALE = 64, 0.8, 1 << 20
CHUNK, LOCAL = 4096, 1 << 22


def shares(counts: Mapping[str, int], weights: Mapping[str, float] | None, temperature: float = TEMPERATURE) -> dict[str, int]:
    """Whole numbers in the exact proportion of the positive weights of the sources there are."""
    if weights is None:
        return {s: math.floor(n**temperature * SCALE + 0.5) for s, n in counts.items()}
    ratio = {s: Fraction(weights[s]) for s in counts if weights.get(s, 0) > 0}
    scale = math.lcm(*(r.denominator for r in ratio.values()))
    return {s: int(r * scale) for s, r in ratio.items()}


def scheduled(share: Mapping[str, int], blocks: Mapping[str, int]) -> Iterator[tuple[int, str]]:
    """Slot by slot the source that gets it, earliest deadline first among released blocks, until each has had its ``blocks``."""
    names = sorted(share)
    common = math.gcd(*share.values()) if share else 1
    parts = [share[s] // common for s in names]
    total, missing = sum(parts), len(names)
    future: list[tuple[int, int]] = [(0, k) for k in range(len(names))]
    ready: list[tuple[int, int]] = []
    done, needed = [0] * len(names), [blocks[s] for s in names]
    t = 0
    while missing:
        while future and future[0][0] <= t:
            _, k = heapq.heappop(future)
            heapq.heappush(ready, (-(-(done[k] + 1) * total // parts[k]), k))
        due, k = heapq.heappop(ready)
        assert t < due
        yield t, names[k]
        done[k] += 1
        missing -= done[k] == needed[k]
        heapq.heappush(future, (done[k] * total // parts[k], k))
        t += 1


def _simulated(share: Mapping[str, int], blocks: Mapping[str, int]):
    """A task that yields the slots of every source in chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                held: dict[str, list[int]] = {s: [] for s in share}
                number = dict.fromkeys(share, 0)

                def chunk(s: str) -> pa.RecordBatch:
                    row = pa.RecordBatch.from_arrays([pa.array([s], pa.string()), pa.array([number[s]], pa.int64()), pa.array([np.array(held[s], np.int64)], pa.list_(pa.int64()))], ["s", "c", "slots"])  # noqa: B023
                    number[s] += 1  # noqa: B023
                    held[s] = []  # noqa: B023
                    return row

                for t, s in scheduled(share, blocks):
                    held[s].append(t)
                    if len(held[s]) == CHUNK:
                        yield chunk(s)
                for s in share:
                    if held[s]:
                        yield chunk(s)

    return run


def mixed(docs: DataFrame, weights: Mapping[str, float] | None = None, source_col: str = "source", id_col: str = "doc_id", block: int = BLOCK, temperature: float = TEMPERATURE) -> DataFrame:
    """``docs`` with epoch, block, slot and position; a row for each time a document is used."""
    return _placed(docs.drop("epoch", "block", "slot", "position"), ["epoch", "block", "slot", "position"], weights, source_col, id_col, block, temperature)


def repeated(docs: DataFrame, weights: Mapping[str, float] | None = None, source_col: str = "source", id_col: str = "doc_id", block: int = BLOCK, temperature: float = TEMPERATURE) -> DataFrame:
    """The rows of ``mixed`` with the columns of ``docs`` alone, whatever they are called."""
    return _placed(docs, free(docs.columns, "epoch", "block", "slot", "position"), weights, source_col, id_col, block, temperature).select(*named(docs))


def _placed(docs: DataFrame, out: list[str], weights: Mapping[str, float] | None, source_col: str, id_col: str, block: int, temperature: float) -> DataFrame:
    """``docs`` with the four columns ``out``, none of which it has."""
    spark = docs.sparkSession
    s, row, c, first, n, total, x, slots = free([*docs.columns, *out], "__s", "__row", "__c", "__first", "__n", "__total", "__x", "__slots")
    keyed = docs.withColumn(s, F.coalesce(col(source_col).cast("string"), F.lit("")))
    counts = {r[0]: r[1] for r in keyed.groupBy(col(s)).count().collect()}  # a row a source
    share = shares(counts, weights, temperature)
    blocks = {k: -(-counts[k] // block) for k in share}
    chunks = written(spark.range(0, 1, 1, 1).mapInArrow(_simulated(share, blocks), "s string, c long, slots array<long>"), "slots")
    given = {r[0]: r[1] for r in chunks.groupBy("s").agg(F.sum(F.size("slots"))).collect()}
    rows, before = [], 0
    for k in sorted(counts):
        if k in share:  # a source that is not repeated ends with what it has
            rows.append((k, before, counts[k], given[k] * block if given[k] > blocks[k] else counts[k]))
        before += counts[k]
    table = spark.createDataFrame(rows, "s string, first long, n long, total long").toDF(s, first, n, total)
    chunks = chunks.toDF(s, c, slots)
    placed = numbered(keyed, [s, id_col], content_hash(docs), row)
    placed = placed.join(F.broadcast(table) if len(rows) <= 1000 else table, s).withColumn(row, col(row) - col(first))
    last = F.floor((col(total) - 1 - col(row)) / col(n)).cast("long")
    placed = placed.withColumn(out[0], F.explode(F.sequence(F.lit(0).cast("long"), last))).withColumn(x, col(out[0]) * col(n) + col(row))
    placed = placed.withColumn(out[1], F.floor(col(x) / block).cast("long")).withColumn(c, F.floor(col(x) / (block * CHUNK)).cast("long"))
    placed = placed.join(F.broadcast(chunks) if sum(given.values()) <= LOCAL else chunks, [s, c])
    placed = placed.withColumn(out[2], F.element_at(col(slots), (col(out[1]) % CHUNK + 1).cast("int")))
    return placed.withColumn(out[3], col(out[2]) * block + col(x) % block).select(*named(docs), *named(placed, out))


def mixing_sql(block: int = BLOCK, temperature: float = TEMPERATURE) -> str:
    """DuckDB SQL for ``mixed`` over documents: doc_id, source, epoch, block, slot, position."""
    return f"""
WITH RECURSIVE docs AS (SELECT doc_id, coalesce(source, '') AS source FROM documents),
counts AS (SELECT source, count(*) AS n FROM docs GROUP BY source),
shares AS (SELECT source, n, (n + {block} - 1) // {block} AS m, row_number() OVER (ORDER BY source) AS i,
  floor(pow(n, {temperature}) * {SCALE} + 0.5)::HUGEINT AS p FROM counts),
lists AS (SELECT list(p ORDER BY i) AS p, list(m ORDER BY i) AS m, sum(p)::HUGEINT AS h, count(*) AS k FROM shares),
steps(t, done, pick) AS (
  SELECT -1::BIGINT, list_transform(range(1, k + 1), lambda q: 0::HUGEINT), 0::BIGINT FROM lists
  UNION ALL
  SELECT t + 1, list_transform(range(1, k + 1), lambda q: done[q] + CASE WHEN q = best THEN 1 ELSE 0 END), best::BIGINT
  FROM (SELECT t, done, k,
    list_min(list_transform(range(1, k + 1), lambda q: CASE WHEN (done[q] * h) // p[q] <= t + 1
      THEN ((done[q] + 1) * h + p[q] - 1) // p[q] ELSE 4000000000000 END * 1000000 + q)) % 1000000 AS best
    FROM steps, lists WHERE list_sum(list_transform(range(1, k + 1), lambda q: CASE WHEN done[q] < m[q] THEN 1 ELSE 0 END)) > 0)),
slots AS (SELECT pick AS i, t, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS o FROM steps WHERE t >= 0),
given AS (SELECT s.source, s.n, s.i, CASE WHEN count(*) > s.m THEN count(*) * {block} ELSE s.n END AS c
  FROM shares s JOIN slots ON slots.i = s.i GROUP BY s.source, s.n, s.m, s.i),
placed AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS inside FROM docs),
used AS (SELECT doc_id, source, i, n, inside, unnest(range(0, (c - 1 - inside) // n + 1)) AS epoch FROM placed JOIN given USING (source)),
numbered AS (SELECT doc_id, source, i, epoch, epoch * n + inside AS x FROM used)
SELECT doc_id, source, epoch, x // {block} AS block, t AS slot, t * {block} + x % {block} AS position
FROM numbered JOIN slots ON slots.i = numbered.i AND o = x // {block}
"""
