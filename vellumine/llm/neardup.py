"""SimHash near-duplicates by a self-join of binary tries.

Every text gets a 64-bit SimHash of its words (each word weighs the rounded
square root of its count) and a 256-bit SimHash of its three-word shingles.
Two texts are near copies when the first differ in at most ``bits`` bits and
the second in at most ``shingle_bits``; groups are the connected components.

The search is exact.  ``bits`` errors over three segments leave one segment
with at most ``bits // 3``.  Cut into more blocks than that, it has a choice of
blocks without errors, which is the key of a task: each hash goes to one task per
choice.  The more hashes there are the more blocks are cut, so keys widen, tasks
multiply and the expected hashes a task stay below ``group`` (12 keys a hash up to
ten million hashes, 30 up to ninety, 60 up to four hundred).  Each task joins the
binary trie of its hashes with itself: pairs of nodes descend together, differing
bits add up, and a pair is dropped as soon as the segment, or behind the segment
the whole, exceeds its budget.  A pair that several tasks could meet counts in
each, which changes no component.  Tasks return spanning forests, so their output
is linear in the hashes, whatever the number of copies.

Defined cases: a null or empty text is never part of a group; a text without
words is only grouped with equal ones; rows with a null id are neither grouped
nor removed; equal texts are always grouped; rows that repeat both id and text
are one document; an empty table gives an empty result; other columns, whatever
their names, are carried or ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from .columns import col, free, named
from .storage import written

BITS, SHINGLE_BITS, GROUP = 11, 87, 1 << 18
_LANES = np.uint64(0x0101010101010101)
_SEEDS = np.array([0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89], np.uint64)
_WIDE = ["v0", "v1", "v2", "v3"]
_SIGNATURE = T.StructType([T.StructField(x, T.LongType()) for x in ("h", *_WIDE)])
_SEGMENTS = ((0, 21), (21, 21), (42, 22))


def majority(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each run of 64-bit hashes (runs begin at ``first``) the bits set in more than half of it.

    Eight bits are counted at once in the bytes of one word, over at most 255 hashes.
    """
    size = np.diff(np.append(first, len(h)))
    within = np.arange(len(h)) - np.repeat(first, size)
    part = np.flatnonzero(within % 255 == 0)
    whole = np.searchsorted(part, first)
    out = np.zeros(len(first), np.uint64)
    for shift in range(8):
        lanes = np.add.reduceat((h >> np.uint64(shift)) & _LANES, part)
        votes = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), whole, axis=0)
        set_bits = (2 * votes > size[:, None]).astype(np.uint8)
        out |= np.ascontiguousarray(set_bits).view(np.uint64).ravel() << np.uint64(shift)
    return out


def signatures(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whether each text has bytes, its word SimHash, its four words of shingle SimHash; of a text without words, a hash of its bytes."""
    data, offsets = tb.utf8(text)
    n = len(text)
    has, word_hash, shingle_hash = np.zeros(n, bool), np.zeros(n, np.uint64), np.zeros((n, 4), np.uint64)
    for i, j in tb.chunks(offsets):
        low = tb.fold(data[offsets[i] : offsets[j]])
        start, end, doc = tb.word_spans(low, offsets[i : j + 1] - offsets[i])
        with_words = np.zeros(j - i, bool)
        with_words[doc] = True
        for k in np.flatnonzero(~with_words & (np.diff(offsets[i : j + 1]) > 0)) + i:  # only equal to equal ones
            digest = hashlib.blake2b(data[offsets[k] : offsets[k + 1]].tobytes(), digest_size=40).digest()
            word_hash[k], *shingle_hash[k] = np.frombuffer(digest, np.uint64)
            has[k] = True
        if not len(start):
            continue
        h = tb.span_hashes(low, start, end)
        where = np.flatnonzero(np.diff(doc, prepend=-1))
        there = doc[where] + i
        has[there] = True
        key = np.sort((doc.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
        run = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        weight = np.rint(np.sqrt(np.diff(np.append(run, len(key))))).astype(np.int64)
        kept = np.repeat(key[run], weight)
        owner = kept >> np.uint64(40)
        word_hash[there] = majority(tb.mix(kept & np.uint64((1 << 40) - 1)), np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])))
        size = np.diff(np.append(where, len(h)))
        last = np.repeat(where + size - 1, size)
        at = np.arange(len(h))
        s = tb.mix(h + tb.mix(h[np.minimum(at + 1, last)] * np.uint64(3)) * np.uint64(5) + tb.mix(h[np.minimum(at + 2, last)] * np.uint64(7)) * np.uint64(11))
        keep = (at + 2 <= last) | (at == np.repeat(where, size))
        s, first = s[keep], np.searchsorted(np.flatnonzero(keep), where)
        for k in range(4):
            shingle_hash[there, k] = majority(tb.mix(s + _SEEDS[k]), first)
    return has, word_hash, shingle_hash


@F.arrow_udf(_SIGNATURE)
def _sign(text: pa.Array) -> pa.Array:
    has, h, v = signatures(text)
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(x).view(np.int64), mask=~has) for x in (h, *v.T)], ["h", *_WIDE])


def signed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns id, t (hash of the text's bytes), h and v0 to v3 of every row with an id and a text that isn't empty."""
    text = col(text_col).cast("string")
    return docs.where(col(id_col).isNotNull() & (text != "")).select(col(id_col).alias("id"), F.xxhash64(text).alias("t"), _sign(text).alias("s")).select("id", "t", "s.*")


def _subsets(bits: int, blocks: int) -> list[tuple[int, ...]]:
    """The choices of ``blocks - most`` of a segment's blocks, of which one is free of errors when at most ``most`` blocks have any."""
    return list(itertools.combinations(range(blocks), blocks - bits // 3))


def plan(bits: int, rows: int, group: int = GROUP) -> list[tuple[int, list[tuple[int, int]], list[tuple[int, int]]]]:
    """Segment, pieces (start, width) of the key, other pieces of the segment, for each kind of task.

    A segment with at most ``bits // 3`` errors is cut into the fewest blocks
    with which the expected group of ``rows`` hashes has at most ``group``.
    """
    most, (_, width) = bits // 3, _SEGMENTS[0]
    blocks = most + 1
    while blocks < width and rows > group << (width * (blocks - most) // blocks):
        blocks += 1
    out = []
    for s, (start, width) in enumerate(_SEGMENTS):
        cut = [start + width * k // blocks for k in range(blocks + 1)]
        piece = list(zip(cut, np.diff(cut).tolist(), strict=False))
        out += [(s, [piece[k] for k in keys], [piece[k] for k in range(blocks) if k not in keys]) for keys in _subsets(bits, blocks)]
    return out


def _arranged(h: np.ndarray, pieces: list[tuple[int, int]]) -> np.ndarray:
    """Bits reordered by pieces (start, width), which cover all 64."""
    out = np.zeros(len(h), np.uint64)
    for start, width in pieces:
        out = (out << np.uint64(width)) | ((h << np.uint64(start)) >> np.uint64(64 - width)) if width < 64 else h
    return out


def trie_pairs(keys: np.ndarray, depth: int, segment_end: int, most_segment: int, most: int, leaf: int = 48, wave: int = 1 << 18, seen: list[int] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i < j) of sorted distinct 64-bit keys that differ in at most ``most`` bits.

    The first ``depth`` bits are equal in all keys; among the bits before
    ``segment_end`` at most ``most_segment`` may differ, among all at most
    ``most``.  A node is a range of the sorted keys.  Pairs of nodes descend a
    bit at a time, breadth first in waves of bounded size, and are dropped when
    their differing bits exceed the budget, until a pair has few keys; those are
    compared.  ``seen`` collects the numbers of node pairs and comparisons.
    """
    n = len(keys)
    if n < 2:
        return
    zeros = {}
    stack = [(depth, np.array([0]), np.array([n]), np.array([0]), np.array([n]), np.array([0]))]
    while stack:
        d, a0, a1, b0, b1, acc = stack.pop()
        if len(a0) > wave:
            for k in range(0, len(a0), wave):
                stack.append((d, *(x[k : k + wave] for x in (a0, a1, b0, b1, acc))))
            continue
        size = (a1 - a0) * (b1 - b0)
        small = size <= leaf if d < 64 else np.ones(len(size), bool)
        if seen is not None:
            seen += [len(size), int(size[small].sum())]
        if small.any():
            count, p, q, w = size[small], a0[small], b0[small], (b1 - b0)[small]
            ends = np.cumsum(count)
            cuts = [0, *np.searchsorted(ends, np.arange(1 << 20, ends[-1], 1 << 20)).tolist(), len(count)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                if x == y:
                    continue
                c = count[x:y]
                for i, j in _expanded(p[x:y], q[x:y], w[x:y], c):
                    differ = np.bitwise_count(keys[i] ^ keys[j])
                    ok = (differ <= most) & (i < j)
                    if ok.any():
                        yield i[ok], j[ok]
            big = ~small
            a0, a1, b0, b1, acc = a0[big], a1[big], b0[big], b1[big], acc[big]
        if not len(a0):
            continue
        if d not in zeros:
            zeros[d] = np.concatenate([[0], np.cumsum(((keys >> np.uint64(63 - d)) & np.uint64(1)) == 0)])
        z = zeros[d]
        am, bm = a0 + z[a1] - z[a0], b0 + z[b1] - z[b0]
        own = a0 == b0
        parts = [(a0, am, b0, bm, acc, None), (am, a1, bm, b1, acc, None), (a0, am, bm, b1, acc + 1, None), (am, a1, b0, bm, acc + 1, ~own)]
        out = []
        for x0, x1, y0, y1, e, only in parts:
            ok = (x1 > x0) & (y1 > y0) & (e <= (most_segment if d < segment_end else most))
            if only is not None:
                ok &= only
            out.append((x0[ok], x1[ok], y0[ok], y1[ok], e[ok]))
        merged = [np.concatenate(x) for x in zip(*out, strict=True)]
        if len(merged[0]):
            stack.append((d + 1, *merged))


def _expanded(p: np.ndarray, q: np.ndarray, w: np.ndarray, count: np.ndarray, most: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of the two ranges; huge ones in slices."""
    if len(count) == 1 and count[0] > most:
        for k in range(0, int(count[0]), most):
            at = np.arange(k, min(k + most, int(count[0])))
            yield p[0] + at // w[0], q[0] + at % w[0]
        return
    at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    wide = np.repeat(w, count)
    yield np.repeat(p, count) + at // wide, np.repeat(q, count) + at % wide


def _root(parent: np.ndarray, i: np.ndarray) -> np.ndarray:
    while True:
        up = parent[i]
        if np.array_equal(up, i):
            return i
        i = up


def forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest member of each element's component."""
    parent = np.arange(n)
    for i, j in pairs:
        while len(i):
            i, j = _root(parent, i), _root(parent, j)
            lo, hi = np.minimum(i, j), np.maximum(i, j)
            open_ = lo != hi
            i, j = lo[open_], hi[open_]
            np.minimum.at(parent, j, i)
        parent = _root(parent, parent)
    return _root(parent, parent)


def _join_task(kinds: list[tuple[int, list[tuple[int, int]], list[tuple[int, int]]]], bits: int, shingle_bits: int):
    def join(key: tuple, table: pa.Table) -> pa.Table:
        s, own, rest = kinds[key[0].as_py() >> 22]
        depth, width = sum(w for _, w in own), _SEGMENTS[s][1]
        h = table["h"].to_numpy().view(np.uint64)
        k = _arranged(h, [*own, *rest, *(x for t, x in enumerate(_SEGMENTS) if t != s)])
        order = np.argsort(k, kind="stable")
        k, node = k[order], table["node"].to_numpy()[order]
        v = np.column_stack([table[f"v{c}"].to_numpy().view(np.uint64) for c in range(4)])[order]
        run = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        last = np.append(run[1:], len(k))

        def verified() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            def near(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                ok = np.bitwise_count(v[i] ^ v[j]).sum(axis=1) <= shingle_bits
                return i[ok], j[ok]

            same = np.flatnonzero(last - run > 1)
            for x in same:  # equal SimHashes, different shingles
                size = last[x : x + 1] - run[x : x + 1]
                for p, q in _expanded(run[x : x + 1], run[x : x + 1], size, size * size):
                    yield near(p[p < q], q[p < q])
            for i, j in trie_pairs(k[run], depth, width, bits // 3, bits):
                count = (last - run)[i] * (last - run)[j]
                for p, q in _expanded(run[i], run[j], (last - run)[j], count):
                    yield near(p, q)

        top = forest(len(k), verified())
        edge = np.flatnonzero(top != np.arange(len(k)))
        return pa.table({"a": node[edge], "b": node[top[edge]]})

    return join


def edges(nodes: DataFrame, bits: int = BITS, shingle_bits: int = SHINGLE_BITS, group: int = GROUP) -> DataFrame:
    """Edges (a, b) that span the components of ``nodes`` (node, h, v0 to v3)."""
    if bits > 11:
        raise ValueError("at most 11 bits")
    kinds, keys = plan(bits, nodes.count(), group), []
    for x, (_, own, _) in enumerate(kinds):
        key = F.lit(x).cast("long")
        for start, width in own:
            key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned("h", 64 - start - width).bitwiseAND(F.lit((1 << width) - 1)))
        keys.append(F.shiftleft(F.lit(x).cast("long"), 22).bitwiseOR(key.bitwiseAND(F.lit((1 << 22) - 1))))
    return nodes.select(F.explode(F.array(*keys)).alias("g"), "node", "h", *_WIDE).groupBy("g").applyInArrow(_join_task(kinds, bits, shingle_bits), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """Columns node, root (the least node of its component) for every node of ``links`` (a, b).

    Large-star and small-star rounds, each written to the shared folder, until nothing changes.
    """
    now = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        now = written(small.where("a <> b").distinct(), "links")


def _groups(docs: DataFrame, id_col: str, text_col: str, bits: int, shingle_bits: int) -> DataFrame:
    """Columns id, t, first (id and t of the first member) of every member of a group of two rows or more, one row per (id, t)."""
    sigs = written(signed(docs, id_col, text_col), "simhash")
    nodes = written(sigs.select("h", *_WIDE).distinct().withColumn("node", F.xxhash64("h", *_WIDE)), "nodes")
    roots = components(edges(nodes, bits, shingle_bits))
    member = sigs.groupBy("id", "t").agg(F.min(F.xxhash64("h", *_WIDE)).alias("node"), F.count("*").alias("rows"))
    member = member.join(roots, "node", "left").select("id", "t", "rows", F.coalesce("root", "node").alias("g"))
    big = member.groupBy("g").agg(F.sum("rows").alias("n"), F.min(F.struct("id", "t")).alias("first")).where("n > 1")
    return member.join(big, "g").select("id", "t", "first")


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, shingle_bits: int = SHINGLE_BITS) -> DataFrame:
    """Columns group_id (least id of the group), doc_id, is_kept, one row per group and id that is in it.

    An id with several texts has a row for each group that one of them is in.
    See the module for nulls, repeated rows and empty tables.
    """
    g = _groups(docs, id_col, text_col, bits, shingle_bits)
    kept = (F.col("first.id") == F.col("id")) & (F.col("first.t") == F.col("t"))
    return g.groupBy("first", "id").agg(F.max(kept).alias("is_kept")).select(F.col("first.id").alias("group_id"), F.col("id").alias("doc_id"), "is_kept")


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, shingle_bits: int = SHINGLE_BITS) -> DataFrame:
    """``docs`` with only the first document (least id) of each group; other rows and all columns stay.

    Of rows that repeat id and text one stays.  Rows with a null id or text stay.
    """
    key, number, lost_id, lost_t = free(docs.columns, "__hash", "__n", "__lost", "__t")
    lost = _groups(docs, id_col, text_col, bits, shingle_bits).where("first.id <> id or first.t <> t").select(F.col("id").alias(lost_id), F.col("t").alias(lost_t))
    keyed = docs.withColumn(key, F.xxhash64(col(text_col).cast("string")))
    kept = keyed.join(lost, (col(id_col) == col(lost_id)) & (col(key) == col(lost_t)), "left_anti")
    twice = F.row_number().over(Window.partitionBy(col(id_col), col(key)).orderBy(col(key)))
    return kept.withColumn(number, F.when(col(id_col).isNotNull() & (col(text_col).cast("string") != ""), twice).otherwise(1)).where(col(number) == 1).select(*named(docs))
