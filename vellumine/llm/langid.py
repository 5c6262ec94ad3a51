"""Language identification by prediction by partial matching.

Texts are brought to letters: ASCII and Latin-1 capitals become small, and every
run of bytes that are no letters (digits and the words that hold any, marks,
white space) becomes one space.
A tree of byte contexts up to ``order`` bytes is counted for every language.
A byte that its longest counted context has seen costs -log2(n / (N + T)), for
its count n, the context's total N and its number T of distinct bytes; else the
escape -log2(T / (N + T)) is paid and the next shorter context asked, down to
eight bits for a byte never seen.  The counts are frozen after training, so the
cost of a byte is a function of the bytes before it, and a text's code length
under every language is an exact sum, looked up for many bytes at once.

The language is the one with the shortest code.  A text is rejected when no
language explains it: when the codes of its stretches of ``STRETCH`` bytes, each
by the language that codes it best, together exceed those languages' limits a
byte by more than ``slack_bits``, when less than ``least_letters`` of its bytes
other than white space are letters, or when it is null or blank.  (So a text in
two known languages is explained.)  A language's limit is the
mean of the code lengths a byte of held-out labelled texts that it codes best
within ``REJECT_BITS``, plus ``spread`` standard deviations, at most
``REJECT_BITS``, which is below the eight bits of a uniform code; a language with
fewer than ``LEAST_HELD`` such texts has ``REJECT_BITS`` itself.

Training reads every labelled text, whole, and every label is a language.
Executors count each byte with the ``order`` bytes before it, so the driver gets
the distinct ones a language and no texts.  For the limits the texts are parted
in halves by their hash, equal texts together, and each half is held out from a
model of the other: every labelled text is scored once by counts it is not in.
A text of a language whose limit is measured and below ``REJECT_BITS`` is
rejected by that same rule if the other half doesn't explain it; then its counts
are taken out again, for junk would else explain itself.
Contexts seen fewer than ``least`` times in all languages are dropped.  Costs are
kept for the pairs of context and byte that some language has seen, so a model
has pairs x languages numbers.  ``per_language`` bounds the texts of a language
to those with the smallest hash of their id, only when a caller sets it.

Defined cases: null or blank text gives language null, bits null, accepted
false; a text without letters is named after the first language and rejected;
equal code lengths go to the first language in alphabetical order;
rows with a null id or label are scored like any others; repeated rows stay and
count as often as they occur; a label without letters in any text is no language;
without any labelled text every text is rejected; extra columns are carried.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from .columns import col

ORDER, LEAST = 3, 2
REJECT_BITS, SLACK_BITS, SPREAD, LEAST_LETTERS = 7.0, 128.0, 6.0, 0.2
LEAST_HELD, LEAST_SIZE, STRETCH = 8, 64, 128
HELD_IN_MEMORY = 1 << 22  # distinct grams that a task merges before it hands them on
RESULT = T.StructType([T.StructField("lang", T.StringType()), T.StructField("bits", T.DoubleType()), T.StructField("margin", T.DoubleType()), T.StructField("size", T.IntegerType()), T.StructField("accepted", T.BooleanType())])


def normal(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts of letters and single spaces with their offsets; letters and solid bytes of each text before."""
    n = len(offsets) - 1
    if not len(data):
        return data, np.zeros(n + 1, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    low = tb.fold(data)
    w = tb.word_bytes(low)[0]
    begins = offsets[:-1][offsets[:-1] < len(data)]
    digit = np.flatnonzero(low - np.uint8(48) < 10)
    if len(digit):  # a word with digits is no word of a language
        edge = ~w
        edge[begins] = True
        edges = np.append(np.flatnonzero(edge), len(data))
        spoilt = np.searchsorted(edges, digit, "right") - 1
        spoilt = spoilt[np.concatenate([[True], spoilt[1:] != spoilt[:-1]])]
        size = edges[spoilt + 1] - edges[spoilt]
        w[np.arange(size.sum()) + np.repeat(edges[spoilt] - np.cumsum(size) + size, size)] = False
    gap = ~w
    np.copyto(low, 32, where=gap)
    keep = w.copy()
    keep[1:] |= w[:-1]
    keep[begins] = w[begins]
    kept = np.flatnonzero(keep)
    letters, solid = (np.diff(offsets) - np.diff(np.searchsorted(np.flatnonzero(x), offsets)) for x in (gap, data <= 32))
    return low[kept], np.searchsorted(kept, offsets), letters, solid


def totals(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, each with the sum of its counts."""
    if not len(keys):
        return keys, counts
    by = np.argsort(keys, kind="stable")
    keys = keys[by]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts[by], first)


def grams(data: np.ndarray, offsets: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """How often each byte of the texts, or end of one as a zero, stands after which ``order`` bytes.

    A gram is a number with the byte lowest and the bytes before it above, nearest first, zeros
    before the text's start.  Texts have no zero bytes.
    """
    if not 0 <= order <= 7:
        raise ValueError("an order is 0 to 7")
    n, kind = len(offsets) - 1, np.uint32 if order < 4 else np.uint64
    padded = np.zeros(len(data) + n, np.uint8)
    padded[np.arange(len(data)) + np.repeat(np.arange(n), np.diff(offsets))] = data
    key, inside = padded.astype(kind), np.ones(len(padded), bool)
    for d in range(1, order + 1):
        inside[:d] = False
        inside[d:] &= padded[:-d] > 0
        before = np.zeros(len(padded), kind)
        before[d:] = padded[:-d]
        before[~inside] = 0
        key |= before << kind(8 * d)
    keys, counts = np.unique(key[key > 0], return_counts=True)
    return keys.astype(np.uint64), counts.astype(np.int64)


class Model:
    """Context tree of all languages together, with the cost of the bytes that each context has seen."""

    def __init__(self, texts: dict[str, list[str | bytes]], order: int = ORDER, least: int = LEAST) -> None:
        counts = {}
        for x, ts in texts.items():
            parts = [t if isinstance(t, bytes) else t.encode() for t in ts if t]
            counts[x] = grams(np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)]), order)
        self._grown(counts, order, least)

    @classmethod
    def counted(cls, counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int = ORDER, least: int = LEAST) -> Model:
        """A model of the distinct ``grams`` of each language and their counts."""
        model = cls.__new__(cls)
        model._grown(counts, order, least)
        return model

    def _grown(self, counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int, least: int) -> None:
        self.languages, self.order = sorted(counts), order
        self.limits = dict.fromkeys(self.languages, REJECT_BITS)
        if not counts:
            return
        keys, weights = [counts[x][0] for x in self.languages], [counts[x][1] for x in self.languages]
        part = lambda x, d: (x >> np.uint64(8 * d)).astype(np.uint8)
        seen = np.zeros(256, bool)
        for x in keys:
            seen[part(x, 0)] = True
        seen[0] = False
        self.code = np.zeros(256, np.int32)  # 0: never seen, and what stands before and after each text
        self.code[seen] = np.arange(1, seen.sum() + 1)
        m = self.width = int(seen.sum()) + 1
        rows = [self.code[part(x, 0)].astype(np.int64) for x in keys]
        self.child, self.parent = np.full((1, m), -1, np.int32), np.full(1, -1, np.int32)
        self.pair = np.full((1, m), -1, np.int32)
        self.cost, self.escape = np.zeros((0, len(rows)), np.float64), np.zeros((0, len(rows)), np.float64)
        nodes = [np.zeros(len(x), np.int64) for x in rows]
        self._priced(rows, nodes, weights, 0)
        self.level = [0]  # the first node of each depth
        for d in range(1, order + 1):
            before = [self.code[part(x, d)].astype(np.int64) for x in keys]
            key = [np.where((n >= 0) & (b > 0), n * m + b, -1) for n, b in zip(nodes, before, strict=True)]
            known, number = totals(np.concatenate([x[x >= 0] for x in key]), np.concatenate([w[x >= 0] for x, w in zip(key, weights, strict=True)]))
            known = known[number >= least]
            first = len(self.child)
            self.level.append(first)
            self.child[known // m, known % m] = np.arange(first, first + len(known), dtype=np.int32)
            self.child = np.concatenate([self.child, np.full((len(known), m), -1, np.int32)])
            self.pair = np.concatenate([self.pair, np.full((len(known), m), -1, np.int32)])
            self.parent = np.concatenate([self.parent, (known // m).astype(np.int32)])
            nodes = [np.where(x >= 0, self.child[np.maximum(x, 0) // m, np.maximum(x, 0) % m], -1) for x in key]
            self._priced(rows, nodes, weights, first)
        self.cost, self.escape = self.cost.astype(np.float32), self.escape.astype(np.float32)

    def _priced(self, rows: list[np.ndarray], nodes: list[np.ndarray], weights: list[np.ndarray], first: int) -> None:
        """Adds the costs of the nodes from ``first`` on, whose parents have theirs."""
        m, n = self.width, len(self.child) - first
        keys = [totals((at * m + x)[(at >= 0) & (x > 0)], w[(at >= 0) & (x > 0)]) for x, at, w in zip(rows, nodes, weights, strict=True)]
        seen = np.unique(np.concatenate([k for k, _ in keys]))
        node, byte = seen // m, seen % m
        count = np.zeros((len(seen), len(rows)))
        for j, (k, c) in enumerate(keys):
            count[np.searchsorted(seen, k), j] = c
        total, kinds = np.zeros((n, len(rows))), np.zeros((n, len(rows)))
        np.add.at(total, node - first, count)
        np.add.at(kinds, node - first, count > 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(total == 0, 0.0, -np.log2(kinds / (total + kinds)))
            own = -np.log2(count / (total + kinds)[node - first])
        above = self.cost[self.pair[self.parent[node], byte]] if first else np.full(count.shape, 8.0)
        self.pair[node, byte] = np.arange(len(self.cost), len(self.cost) + len(seen), dtype=np.int32)
        self.cost = np.concatenate([self.cost, np.where(count > 0, own, escape[node - first] + above)])
        self.escape = np.concatenate([self.escape, escape])

    def lengths(self, data: np.ndarray, offsets: np.ndarray, step: int | None = None) -> np.ndarray:
        """Code length in bits of each text under each language."""
        return self.coded(data, offsets, offsets, step)

    def coded(self, data: np.ndarray, offsets: np.ndarray, cuts: np.ndarray, step: int | None = None) -> np.ndarray:
        """Code lengths under each language of the stretches between cuts, among which are the texts' offsets."""
        k, m, n, order = len(self.languages), self.width, len(data), self.order
        step = step or 1 << 16
        out = np.zeros((len(cuts) - 1, k))
        child, pair, level, costs = self._flat()
        for a in range(0, n, step):
            b = min(a + step, n)
            low = max(0, a - order)
            sym = np.zeros(order + b - a, np.int64)  # zeros before the first text
            sym[order - (a - low) :] = self.code[data[low:b]]
            t0, t1 = np.searchsorted(offsets, a - order, "right"), np.searchsorted(offsets, b, "left")
            begins = np.unique(offsets[max(0, t0 - 1) : t1])
            node = np.zeros(b - a, np.int64)  # times the width
            for d in range(1, order + 1):
                nxt = child.take(node + sym[order - d : order - d + b - a])
                early = (begins[:, None] + np.arange(d) - a).ravel()  # less than d bytes of the text are before
                nxt[early[(early >= 0) & (early < b - a)]] = -1
                ok = nxt >= 0
                if d > 1:
                    ok &= node >= level[d - 1]  # else a shorter context was the longest
                np.copyto(node, nxt, where=ok)
            x = sym[order:]
            at = pair.take(node + x)
            miss = np.flatnonzero(at < 0)
            at[miss] = 0
            left, x, up, missed = np.arange(len(miss)), x[miss], node[miss] // m, np.zeros((len(miss), k), np.float32)
            while len(left):  # an escape for each context that has not seen the byte
                missed[left] += self.escape[up]
                up = self.parent[up]
                missed[left[up < 0]] += 8
                left, x, up = left[up >= 0], x[up >= 0], up[up >= 0]
                here = pair[up.astype(np.int64) * m + x]
                missed[left[here >= 0]] += self.cost[here[here >= 0]]
                left, x, up = left[here < 0], x[here < 0], up[here < 0]
            c0, c1 = np.searchsorted(cuts, a, "right") - 1, np.searchsorted(cuts, b, "left")
            starts = np.clip(cuts[c0:c1], a, b) - a
            full = np.flatnonzero(np.diff(np.append(starts, b - a)) > 0)
            for j in range(k):
                per = costs[j].take(at)
                per[miss] = missed[:, j]
                out[c0 + full, j] += np.add.reduceat(per, starts[full])
        return out

    def _flat(self) -> tuple[np.ndarray, np.ndarray, list[int], np.ndarray]:
        """Children times the width and pairs, both by node times width plus byte; the first node of each depth, times the width; a row of costs a language."""
        if "flat" not in self.__dict__:
            child = self.child.ravel().astype(np.int64)
            child[child >= 0] *= self.width
            self.flat = child, self.pair.ravel().astype(np.int64), [x * self.width for x in self.level], np.ascontiguousarray(self.cost.T, np.float64)
        return self.flat

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "flat"}

    def udf(self, slack_bits: float = SLACK_BITS, least_letters: float = LEAST_LETTERS):
        """A column function from text to ``RESULT``."""
        limit = np.array([self.limits[x] for x in self.languages] or [0.0])

        def score(text: pa.Array) -> pa.Array:
            data, offsets = tb.utf8(text)
            n = len(offsets) - 1
            total, size, excess = np.zeros((n, max(1, len(self.languages)))), np.zeros(n, np.int32), np.zeros(n)
            letters, solid = np.zeros(n, np.int64), np.zeros(n, np.int64)
            for i, j in tb.chunks(offsets):
                low, ends, letters[i:j], solid[i:j] = normal(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                size[i:j] = np.diff(ends)
                if self.languages and len(low):
                    count = -(-size[i:j] // STRETCH)  # an empty text has no stretch
                    owner = np.repeat(np.arange(j - i), count)
                    within = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
                    cuts = np.append(ends[owner] + within * STRETCH, len(low))
                    bits = self.coded(low, ends, cuts)
                    best = bits.argmin(axis=1)
                    over = bits[np.arange(len(best)), best] - limit[best] * np.diff(cuts)
                    excess[i:j] = np.bincount(owner, over, j - i)
                    for x in range(bits.shape[1]):
                        total[i:j, x] = np.bincount(owner, bits[:, x], j - i)
            blank = solid == 0 if self.languages else np.ones(n, bool)
            best = total.argmin(axis=1)
            bits = total[np.arange(n), best]
            second = np.partition(total, 1, axis=1)[:, 1] - bits if total.shape[1] > 1 else np.zeros(n)
            accepted = ~blank & (letters > 0) & (letters >= least_letters * solid) & (excess <= slack_bits)
            names = np.array(self.languages or [""], object)[best]
            return pa.StructArray.from_arrays([pa.array(names, pa.string(), mask=blank), pa.array(bits, mask=blank), pa.array(second, mask=blank), pa.array(size, mask=blank), pa.array(accepted)], ["lang", "bits", "margin", "size", "accepted"])

        return F.arrow_udf(score, RESULT)


def counted(keyed: DataFrame, order: int) -> dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]:
    """The ``grams`` of the texts ``t`` of each label ``l`` and half ``f``, counted on the executors."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        merged = lambda: {k: [totals(*map(np.concatenate, zip(*v, strict=True)))] for k, v in held.items()}
        pending = 0
        for batch in batches:
            label = batch.column(0).dictionary_encode()
            group = label.indices.to_numpy().astype(np.int64) * 2 + batch.column(1).to_numpy()
            by = np.argsort(group, kind="stable")
            cuts = np.append(np.flatnonzero(np.diff(group[by], prepend=-1)), len(by))
            for a, b in zip(cuts, cuts[1:], strict=False):
                data, offsets = tb.utf8(batch.column(2).take(pa.array(by[a:b])))
                own = held.setdefault((label.dictionary[int(group[by[a]]) // 2].as_py(), int(group[by[a]]) % 2), [])
                for i, j in tb.chunks(offsets):
                    own.append(grams(*normal(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])[:2], order))
                    pending += len(own[-1][0])
            if pending > HELD_IN_MEMORY:
                held = merged()
                pending = sum(len(v[0][0]) for v in held.values())
                if pending > HELD_IN_MEMORY // 2:
                    yield from handed(held)
                    held, pending = {}, 0
        yield from handed(merged())

    def handed(held: dict[tuple[str, int], list[tuple[np.ndarray, np.ndarray]]]) -> Iterator[pa.RecordBatch]:
        for (label, half), [(keys, counts)] in held.items():
            for a in range(0, len(keys), 1 << 16):
                n = len(keys[a : a + (1 << 16)])
                yield pa.RecordBatch.from_arrays([pa.array([label] * n, pa.string()), pa.array(np.full(n, half, np.int32)), pa.array(keys[a : a + n].view(np.int64)), pa.array(counts[a : a + n])], ["l", "f", "g", "c"])

    found = keyed.select("l", "f", "t").mapInArrow(count, "l string, f int, g long, c long").groupBy("l", "f", "g").agg(F.sum("c").alias("c")).toArrow().combine_chunks()
    if not found.num_rows:
        return {}
    label = found["l"].combine_chunks().dictionary_encode()
    group = label.indices.to_numpy().astype(np.int64) * 2 + found["f"].to_numpy()
    keys, counts = found["g"].to_numpy().view(np.uint64), found["c"].to_numpy()
    by = np.lexsort((keys, group))
    cuts = np.append(np.flatnonzero(np.diff(group[by], prepend=-1)), len(by))
    return {(label.dictionary[int(group[by[a]]) // 2].as_py(), int(group[by[a]]) % 2): (keys[by[a:b]], counts[by[a:b]]) for a, b in zip(cuts, cuts[1:], strict=False)}


def train(docs: DataFrame, label_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", per_language: int | None = None, order: int = ORDER, least: int = LEAST, spread: float = SPREAD) -> Model:
    """A model of all labelled rows of ``docs`` with its limits; the driver gets the distinct grams of each language."""
    keyed = docs.select(col(label_col).cast("string").alias("l"), col(id_col).alias("i"), col(text_col).cast("string").alias("t")).where("l is not null and trim(l) <> '' and t is not null")
    if per_language is not None:
        keyed = keyed.withColumn("r", F.row_number().over(Window.partitionBy("l").orderBy(F.xxhash64("i"), "i", "t"))).where(F.col("r") <= per_language)
    keyed = keyed.select("l", F.pmod(F.xxhash64("t"), F.lit(2)).cast("int").alias("f"), "t")
    counts = counted(keyed, order)
    halves = [Model.counted({x: v for (x, half), v in counts.items() if half == f}, order, least) for f in (0, 1)]

    def held() -> Column:
        """The result of a text under the model of the half that it is not in."""
        own = [halves[1 - f].udf()(F.when(F.col("f") == f, F.col("t"))) for f in (0, 1)]
        return F.when(F.col("f") == 0, own[0]).otherwise(own[1])

    limits: dict[str, float] = {}
    rate = F.expr(f"CASE WHEN s.lang = l AND s.size >= {LEAST_SIZE} AND s.bits <= {REJECT_BITS} * s.size THEN s.bits / s.size END")  # a filter would score twice
    rates = keyed.select("l", held().alias("s")).select("l", rate.alias("r")).groupBy("l").agg(F.count("r").alias("n"), F.avg("r").alias("mean"), F.stddev_pop("r").alias("sd"))
    for r in rates.collect() if counts else []:  # a row a language
        if r.n >= LEAST_HELD:
            limits[r.l] = min(REJECT_BITS, r.mean + spread * r.sd)
    judged = [x for x in limits if limits[x] < REJECT_BITS]
    out: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}
    if judged:
        for m in halves:
            m.limits |= {x: limits[x] for x in m.languages if x in limits}
        out = counted(keyed.where(F.col("l").isin(judged)).withColumn("s", held()).where("not s.accepted"), order)
    whole = {}
    for x in sorted({x for x, _ in counts}):
        parts = [v for f in (0, 1) if (v := counts.get((x, f)))] + [(k, -c) for f in (0, 1) if (x, f) in out for k, c in [out[x, f]]]
        keys, left = totals(*map(np.concatenate, zip(*parts, strict=True)))
        whole[x] = keys[left > 0], left[left > 0]
    model = Model.counted(whole, order, least)
    model.limits |= limits
    return model


def scored(text: Column, model: Model, slack_bits: float = SLACK_BITS) -> Column:
    """The struct (lang, bits, margin, size, accepted) of a text."""
    return model.udf(slack_bits)(text)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """Columns doc_id, label, detected, bits, margin, accepted, one row for each row of ``docs``."""
    model = train(docs, label_col, text_col, id_col)
    s = docs.select(col(id_col).alias("doc_id"), col(label_col).alias("label"), scored(col(text_col).cast("string"), model).alias("s"))
    return s.select("doc_id", "label", F.col("s.lang").alias("detected"), "s.bits", "s.margin", "s.accepted")


def accepted_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """``docs`` without the rows that are rejected; all columns stay as they are."""
    model = train(docs, label_col, text_col, id_col)
    return docs.where(scored(col(text_col).cast("string"), model)["accepted"])
