"""Row numbers over a whole table without a single-task sort.

Rows are counted per key, keys are range-partitioned and sorted, and the
counts before each partition are added from a table with one row a partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import col, free, named
from .storage import written


def content_hash(df: DataFrame) -> Column:
    """A hash of all columns of a row; maps and variants by their JSON."""
    plain = [F.to_json(F.struct(c)) if df.schema[n].dataType.typeName() in ("map", "variant") else c for n, c in zip(df.columns, named(df), strict=True)]
    return F.xxhash64(*plain)


def starts(rows: DataFrame) -> DataFrame:
    """For keys k0, k1 and so on, all columns of ``rows``: the keys, n (rows with this key) and start (rows with a smaller key; nulls are smallest).

    The keys' sorted ranges are written to the shared folder, for the bounds of
    ranges may differ from one run of the sort to the next.
    """
    keys = rows.columns
    ascending = [F.col(k).asc_nulls_first() for k in keys]
    counted = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    ranged = written(counted.repartitionByRange(*ascending).sortWithinPartitions(*ascending).withColumn("part", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("part").agg(F.sum("n").alias("sum"))
    before = F.coalesce(F.sum("sum").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.select("part", before.alias("before"))  # a row a partition
    inside = Window.partitionBy("part").orderBy(*ascending).rowsBetween(Window.unboundedPreceding, -1)
    return ranged.join(F.broadcast(offsets), "part").withColumn("start", F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0))).select(*keys, "n", "start")


def numbered(rows: DataFrame, keys: list[str], tie: Column, name: str = "row_number") -> DataFrame:
    """``rows`` with a number from 0 by ``keys``, nulls first; rows with equal keys are ordered by ``tie``.

    Rows equal in both are interchangeable.  ``name`` is no column of ``rows``.
    """
    key, start, same = free([*rows.columns, name], "__key", "__start", "__same")
    numbers = [f"k{i}" for i in range(len(keys))]
    # A struct of nulls is no null, and both sides have one type, nullable: one shuffle serves the window and the join.
    kind = T.StructType([T.StructField(n, rows.schema[k].dataType) for n, k in zip(numbers, keys, strict=True)])
    first = starts(rows.select(*(col(k).alias(n) for n, k in zip(numbers, keys, strict=True)))).select(F.struct(*numbers).cast(kind).alias(key), F.col("start").alias(start))
    keyed = rows.withColumn(key, F.struct(*(col(k).alias(n) for n, k in zip(numbers, keys, strict=True))).cast(kind))
    joined = keyed.withColumn(same, F.row_number().over(Window.partitionBy(col(key)).orderBy(tie)) - 1).join(first, key)
    return joined.withColumn(name, col(start) + col(same)).select(*named(rows), name)
