"""Nearest neighbours of all vectors by stable projections and kd-trees.

Vectors are projected to ``dims`` normal (2-stable) coordinates: the squared
projected distance of two vectors at distance r is r^2 times a chi-square
variable with ``dims`` degrees of freedom.  A kd-tree over the projections is
cut into cells, one task each, and every cell goes on as a kd-tree with leaves.
A query takes leaves in the order of their projected distance and verifies
their vectors, keeping the k best; it stops when a vector at the current k-th
distance would have been met with probability ``certainty``, that is when the
next leaf's squared projected distance is at least d_k^2 times the chi-square
quantile.  Every vector first asks its own cell; the d_k found there bounds which
other cells it is sent to, and those begin with that bound.

The cells' cuts come from at most ``sample`` projected rows, those with the
smallest hash of their id; cuts only shape the tree, all rows are searched.

A cell that more than ``share`` others' vectors ask is copied for as many tasks
as that takes; the others are not.

Defined cases: ids may be whole numbers or of any type that can be ordered; huge
coordinates are scaled for the search; rows with a null id, or a vector that is
null, has a null or non-finite coordinate, or has not the most frequent length,
neither ask nor answer; rows equal in id and vector count once, and a row is never its own
id's neighbour; equal distances are ordered by id; with fewer than k others all
of them are returned; an empty table gives an empty result; extra columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import col
from .order import numbered
from .storage import written

K, DIMS, CERTAINTY, SEED, CELL, LEAF, SAMPLE = 10, 8, 0.96, 7, 8192, 128, 65536
MOST_CELLS, SHARE, QUERIES = 65536, 1 << 16, 8192


def chi_square(x: np.ndarray | float, dims: int) -> np.ndarray | float:
    """Distribution function for an even number of degrees of freedom."""
    half = np.asarray(x) / 2
    term = total = np.ones_like(half)
    for i in range(1, dims // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


def chi_square_quantile(p: float, dims: int) -> float:
    """The x below which the variable is with probability p."""
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square(mid, dims) < p else (lo, mid)
    return hi


def projection(width: int, dims: int, seed: int) -> np.ndarray:
    """The normal matrix."""
    return np.random.default_rng(seed).standard_normal((width, dims)).astype(np.float32)


def cut(points: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Dimension and value of each split, in heap order; each node is halved where it is widest."""
    axis, value = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, np.float32(0))
    groups = [np.arange(len(points))]
    for node in range(len(axis)):
        g = groups[node]
        if len(g):
            p = points[g]
            axis[node] = np.argmax(p.max(axis=0) - p.min(axis=0))
            value[node] = np.median(p[:, axis[node]])
            right = p[:, axis[node]] > value[node]
            groups += [g[~right], g[right]]
        else:
            groups += [g, g]
    return axis, value


def placed(points: np.ndarray, axis: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The leaf of each point."""
    node = np.zeros(len(points), np.int64)
    if not len(axis):
        return node
    rows = np.arange(len(points))
    for _ in range(int(math.log2(len(axis) + 1))):
        node = 2 * node + 1 + (points[rows, axis[node]] > value[node])
    return node - len(axis)


def box_distances(points: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distances from points to boxes."""
    out = np.zeros((len(points), len(low)), np.float32)
    for d in range(points.shape[1]):
        p = points[:, d : d + 1]
        gap = np.maximum(np.maximum(low[None, :, d] - p, p - high[None, :, d]), 0)
        out += gap * gap
    return out


class Cell:
    """The vectors of a cell in a kd-tree of their projections."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, projected: np.ndarray, leaf: int = LEAF) -> None:
        depth = max(0, math.ceil(math.log2(max(1, len(ids)) / leaf)))
        at = placed(projected, *cut(projected, depth))
        order = np.lexsort((ids, at))
        self.ids, self.vectors, p, at = ids[order], vectors[order], projected[order], at[order]
        self.first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(ids) else np.zeros(0, np.int64)
        self.end = np.append(self.first[1:], len(ids))
        self.low = np.minimum.reduceat(p, self.first, axis=0) if len(ids) else p
        self.high = np.maximum.reduceat(p, self.first, axis=0) if len(ids) else p
        norm = (self.vectors**2).sum(axis=1, keepdims=True)
        self.wide = np.concatenate([-2 * self.vectors, norm], axis=1)  # times (q, 1): the squared distance without that of q

    def search(self, ids: np.ndarray, vectors: np.ndarray, projected: np.ndarray, bound: np.ndarray, k: int, quantile: float, wave: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Ids and squared distances of up to k neighbours of each query, none beyond its bound (squared); missing: infinite.

        Each query takes its leaves by their projected distance, ``wave`` at a
        time; the queries that take the same leaf are compared with it at once.
        """
        n, leaves = len(ids), len(self.first)
        best_d, best_i = np.full((n, k), np.inf, np.float32), np.zeros((n, k), self.ids.dtype)
        if not n or not leaves:
            return best_i, best_d
        gap = box_distances(projected, self.low, self.high)
        rank = np.argsort(gap, axis=1, kind="stable")
        sorted_gap = np.take_along_axis(gap, rank, axis=1)
        norm = (vectors**2).sum(axis=1)
        wide = np.concatenate([vectors, np.ones((n, 1), np.float32)], axis=1)
        limit = bound.astype(np.float32).copy()
        live = np.arange(n)
        for r in range(0, leaves, wave):
            live = live[sorted_gap[live, r] < limit[live] * quantile]
            if not len(live):
                break
            row, col_ = np.nonzero(sorted_gap[live, r : r + wave] < (limit[live] * quantile)[:, None])
            query = live[row]
            at = rank[query, r + col_]
            order = np.argsort(at, kind="stable")
            edge = np.flatnonzero(np.concatenate([[True], np.diff(at[order]) != 0]))
            found = []
            for a, b in zip(edge, np.append(edge[1:], len(order)), strict=True):
                q = query[order[a:b]]
                s, e = self.first[at[order[a]]], self.end[at[order[a]]]
                x = wide[q] @ self.wide[s:e].T
                open_ = ~np.isfinite(limit[q])
                if open_.any() and e - s > k:  # no bound yet: the k nearest of the leaf
                    y = x[open_]
                    y[ids[q[open_]][:, None] == self.ids[None, s:e]] = np.inf
                    near = np.argpartition(y, k - 1, axis=1)[:, :k]
                    i, j = np.repeat(q[open_], k), near.ravel()
                    found.append((i, s + j, np.take_along_axis(y, near, axis=1).ravel()))
                    q, x = q[~open_], x[~open_]
                i, j = np.nonzero(x <= (limit[q] - norm[q] * np.float32(1 - 1e-5))[:, None])
                found.append((q[i], s + j, x[i, j]))
            q, j, d = (np.concatenate(c) for c in zip(*found, strict=True))
            own = ids[q] == self.ids[j]
            q, j, d = q[~own], j[~own], np.maximum(d[~own] + norm[q[~own]], 0)
            if not len(q):
                continue
            hit = np.unique(q)
            q, d, i = np.concatenate([q, np.repeat(hit, k)]), np.concatenate([d, best_d[hit].ravel()]), np.concatenate([self.ids[j], best_i[hit].ravel()])
            order = np.lexsort((i, d, q))
            q, d, i = q[order], d[order], i[order]
            place = np.arange(len(q)) - np.repeat(np.flatnonzero(np.diff(q, prepend=-1)), np.unique(q, return_counts=True)[1])
            first = place < k
            best_d[q[first], place[first]], best_i[q[first], place[first]] = d[first], i[first]
            limit[hit] = np.minimum(limit[hit], best_d[hit, k - 1])
        best_d[best_d > bound[:, None]] = np.inf
        return best_i, best_d


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, width) if len(column) else np.zeros((0, width), np.float32)


def _search_task(width: int, dims: int, k: int, quantile: float):
    def task(points: pa.Table, queries: pa.Table) -> pa.Table:
        cell = Cell(points["id"].to_numpy(), _matrix(points["v"], width), _matrix(points["p"], dims))
        ids, out = queries["id"].to_numpy(), []
        vectors, projected, bound = _matrix(queries["v"], width), _matrix(queries["p"], dims), queries["bound"].to_numpy()
        for a in range(0, len(ids), QUERIES):
            b = slice(a, a + QUERIES)
            i, d = cell.search(ids[b], vectors[b], projected[b], bound[b], k, quantile)
            ok = np.isfinite(d)
            bounds = np.concatenate([[0], np.cumsum(ok.sum(axis=1))]).astype(np.int32)
            found = pa.StructArray.from_arrays([pa.array(d[ok].astype(np.float64)), pa.array(i[ok])], ["d", "i"])
            out.append(pa.table({"id": ids[b], "t": queries["t"].to_numpy()[b], "found": pa.ListArray.from_arrays(pa.array(bounds), found), "last": np.where(ok[:, k - 1], d[:, k - 1], np.inf).astype(np.float64)}))
        return pa.concat_tables(out) if out else pa.table({"id": pa.array([], pa.int64()), "t": pa.array([], pa.int64()), "found": pa.array([], pa.list_(pa.struct([("d", pa.float64()), ("i", pa.int64())]))), "last": pa.array([], pa.float64())})

    return task


_FOUND = "id long, t long, found array<struct<d: double, i: long>>, last double"


def _copy(df: DataFrame) -> DataFrame:
    """The same columns under new identities, for joins with the original."""
    return df.select(*(F.col(c).alias(c) for c in df.columns))


def neighbours(rows: DataFrame, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding", dims: int = DIMS, certainty: float = CERTAINTY, seed: int = SEED, sample: int = SAMPLE, cell: int = CELL, share: int = SHARE) -> DataFrame:
    """Columns vec_id, rank (from 1), neighbour_id, distance."""
    spark = rows.sparkSession
    named = rows.select(col(id_col).alias("id"), col(vector_col).cast("array<float>").alias("v")).where("id is not null and v is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < float('infinity'))")
    whole = isinstance(named.schema["id"].dataType, T.IntegralType)
    ids = None
    if not whole:  # other ids are searched under their numbers, which keep their order
        ids = written(numbered(named.select("id").distinct(), ["id"], F.lit(0), "number"), "ids")
        named = named.join(ids, "id").select(F.col("number").alias("id"), "v")
    found = _searched(named.select(F.col("id").cast("long").alias("id"), "v"), k, dims, certainty, seed, sample, cell, share)
    kind = rows.schema[id_col].dataType
    if found is None:
        return spark.createDataFrame([], T.StructType([T.StructField("vec_id", kind), T.StructField("rank", T.IntegerType()), T.StructField("neighbour_id", kind), T.StructField("distance", T.DoubleType())]))
    if ids is None:
        return found.withColumns({c: F.col(c).cast(kind) for c in ("vec_id", "neighbour_id")})
    for c in ("vec_id", "neighbour_id"):
        found = found.join(ids.select(F.col("number").alias(c), F.col("id").alias("own")), c).drop(c).withColumnRenamed("own", c)
    return found.select("vec_id", "rank", "neighbour_id", "distance")


def _searched(usable: DataFrame, k: int, dims: int, certainty: float, seed: int, sample: int, cell: int, share: int) -> DataFrame | None:
    """The neighbours of whole ids, or None if there is no vector."""
    largest = F.array_max(F.transform("v", F.abs))
    sizes = usable.groupBy(F.size("v").alias("w")).agg(F.count("*").alias("n"), F.max(largest).alias("most")).orderBy(F.desc("n"), "w").first()
    if sizes is None:
        return None
    width = sizes.w
    power = max(0, math.frexp(sizes.most)[1] - 40)  # squares of huge coordinates must fit; a power of two changes no digit
    if power:
        usable = usable.withColumn("v", F.transform("v", lambda x: (x.cast("double") * 2.0**-power).cast("float")))
    matrix, quantile = projection(width, dims, seed), chi_square_quantile(certainty, dims)

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def project(x: pa.Array) -> pa.Array:
        p = _matrix(x, width) @ matrix
        return pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, dims, dtype=np.int32)), pa.array(p.ravel()))

    points = written(usable.where(F.size("v") == width).withColumn("t", F.xxhash64("v")).dropDuplicates(["id", "t"]).withColumn("p", project("v")), "vectors")
    n = points.count()
    depth = max(0, math.ceil(math.log2(max(1, n / max(cell, n / MOST_CELLS)))))
    few = points.select("p").orderBy(F.xxhash64("id"), "t").limit(sample).toArrow()["p"]
    axis, value = cut(_matrix(few, dims), depth)

    @F.arrow_udf(T.IntegerType())
    def cell_of(p: pa.Array) -> pa.Array:
        return pa.array(placed(_matrix(p, dims), axis, value).astype(np.int32))

    points = written(points.withColumn("cell", cell_of("p")), "cells")
    spans = points.groupBy("cell").agg(*(F.min(F.col("p")[d]).alias(f"l{d}") for d in range(dims)), *(F.max(F.col("p")[d]).alias(f"h{d}") for d in range(dims))).orderBy("cell").toPandas()  # at most MOST_CELLS rows
    number = spans["cell"].to_numpy(np.int32)
    low, high = (spans[[f"{s}{d}" for d in range(dims)]].to_numpy(np.float32) for s in "lh")
    search = _search_task(width, dims, k, quantile)
    own = points.groupBy("cell").cogroup(_copy(points).withColumn("bound", F.lit(float("inf"))).groupBy("cell")).applyInArrow(search, _FOUND)
    own = written(own, "own")

    @F.arrow_udf(T.ArrayType(T.IntegerType()))
    def others(p: pa.Array, home: pa.Array, bound: pa.Array) -> pa.Array:
        points_, home_, reach = _matrix(p, dims), home.to_numpy(), bound.to_numpy() * quantile
        out, sizes_ = [], []
        for a in range(0, len(home_), 4096):
            b = slice(a, a + 4096)
            ok = (box_distances(points_[b], low, high) < reach[b, None]) & (number[None, :] != home_[b, None])
            out.append(number[np.nonzero(ok)[1]])
            sizes_.append(ok.sum(axis=1))
        bounds = np.concatenate([[0], np.cumsum(np.concatenate(sizes_))]) if sizes_ else np.zeros(1)
        return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(np.concatenate(out) if out else np.zeros(0, np.int32)))

    # Where each vector asks, without the vectors; a cell that many ask answers in several tasks, and only that one is copied.
    asking = points.select("id", "t", "p", "cell").join(own.select("id", "t", F.col("last").alias("bound")), ["id", "t"])
    routes = written(asking.select("id", "t", "bound", F.explode(others("p", "cell", "bound")).alias("to")), "routes")
    copies = written(routes.groupBy("to").agg(F.ceil(F.count("*") / share).cast("int").alias("copies")), "copies")  # at most MOST_CELLS rows
    told = routes.join(F.broadcast(copies), "to").withColumn("salt", F.pmod(F.xxhash64("id", "t"), F.col("copies")).cast("int"))
    sent = told.join(_copy(points).drop("cell"), ["id", "t"]).select("id", "t", "v", "p", "bound", F.col("to").alias("cell"), "salt")
    answering = _copy(points).join(F.broadcast(copies.withColumnRenamed("to", "cell")), "cell").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    away = answering.groupBy("cell", "salt").cogroup(sent.groupBy("cell", "salt")).applyInArrow(search, _FOUND)
    both = own.select("id", "t", "found").unionByName(away.select("id", "t", "found"))
    best = both.groupBy("id", "t").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("found")))), 1, k).alias("best"))
    return best.select(F.col("id").alias("vec_id"), F.posexplode("best").alias("pos", "b")).select("vec_id", (F.col("pos") + 1).alias("rank"), F.col("b.i").alias("neighbour_id"), (F.sqrt("b.d") * 2.0**power).alias("distance"))
