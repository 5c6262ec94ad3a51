"""Token ids in Simple-8b words.

A word has a selector in its upper 4 bits and 60 bits of payload, the first id
lowest.  Selector 1 stands for 120 zeros, 2 to 15 for 60, 30, 20, 15, 12, 10, 8,
7, 6, 5, 4, 3, 2 and 1 ids of 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30 and 60
bits.  Selector 0 is the escape: the next word is one id of any 64 bits.  The
ids of a text are cut into blocks of 128; a block begins with a word, and the
words before each block are listed, so blocks are coded and decoded
independently and side by side.  In each place the selector that takes the most
ids is used; the last word of a block may be short.

Defined cases: a null or empty text gives no ids, no words and no offsets;
a null id is carried; repeated rows stay; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textbytes as tb
from .tokens import Tokenizer, texts_of

BLOCK = 128
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
COUNTS = np.array([1, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([64, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])


_SMALL = np.zeros(1 << 18, np.uint8)
for _w in sorted(set(WIDTHS[1:].tolist()), reverse=True):
    _SMALL[: 1 << min(_w, 18)] = _w


def _widths(ids: np.ndarray) -> np.ndarray:
    """Least payload width of each id; 61 for those that need the escape."""
    if not ids.size or (ids.min() >= 0 and ids.max() < len(_SMALL)):
        return _SMALL[ids]
    out = np.full(ids.shape, 61, np.uint8)
    for w in sorted(set(WIDTHS[1:].tolist()), reverse=True):
        out[(ids >= 0) & (ids < 1 << w)] = w
    return out


def encode(ids: np.ndarray, bounds: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, their bounds per text, offsets of blocks within their text, and their bounds per text."""
    ids = ids.astype(np.int64)
    size = np.diff(bounds)
    per = -(-size // block)
    block_bounds = np.concatenate([[0], np.cumsum(per)])
    nb = int(block_bounds[-1])
    if not nb:
        z = np.zeros(len(bounds), np.int64)
        return np.zeros(0, np.uint64), z, np.zeros(0, np.int32), z
    text = np.repeat(np.arange(len(size)), per)
    begin = bounds[:-1][text] + (np.arange(nb) - block_bounds[:-1][text]) * block
    length = np.minimum(block, bounds[1:][text] - begin)
    wide = block + 120
    inside = np.arange(block)[None, :] < length[:, None]
    padded = np.zeros((nb, wide), np.int64)
    padded[:, :block][inside] = ids
    width = np.zeros((nb, wide), np.uint8)
    width[:, :block][inside] = _widths(ids)
    best = np.zeros((nb, block), np.uint8)
    most, reach = width, 1
    for s in range(15, 0, -1):
        c = int(COUNTS[s])
        while reach < c:
            step = min(reach, c - reach)
            most = np.maximum(most[:, : most.shape[1] - step], most[:, step:])
            reach += step
        fits = most[:, :block] <= WIDTHS[s]
        best[fits] = s
    at = np.zeros(nb, np.int64)
    live = np.arange(nb)
    made_block, made_at, made_sel, made_turn = [], [], [], []
    turn = 0
    while len(live):
        s = best[live, at[live]]
        made_block.append(live)
        made_at.append(at[live])
        made_sel.append(s)
        made_turn.append(np.full(len(live), turn))
        at[live] += COUNTS[s]
        live = live[at[live] < length[live]]
        turn += 1
    b, p, s, t = (np.concatenate(x) for x in (made_block, made_at, made_sel, made_turn))
    order = np.argsort(b * (block + 1) + t, kind="stable")
    b, p, s = b[order], p[order], s[order]
    words_each = 1 + (s == 0)
    place = np.cumsum(words_each) - words_each
    words = np.zeros(int(words_each.sum()), np.uint64)
    flat = padded.ravel().view(np.uint64)
    for k in np.unique(s).tolist():
        i = np.flatnonzero(s == k)
        base = b[i] * wide + p[i]
        if k == 0:
            words[place[i] + 1] = flat[base]
            continue
        value = np.full(len(i), np.uint64(k) << np.uint64(60))
        if WIDTHS[k]:
            for c in range(COUNTS[k]):
                value |= flat[base + c] << np.uint64(c * WIDTHS[k])
        words[place[i]] = value
    word_count = np.bincount(b, words_each, nb).astype(np.int64)
    before = np.concatenate([[0], np.cumsum(word_count)])
    word_bounds = before[block_bounds]
    offsets = (before[:-1] - word_bounds[:-1][text]).astype(np.int32)
    return words, word_bounds, offsets, block_bounds


def decode(words: np.ndarray, offsets: np.ndarray, n: int, block: int = BLOCK) -> np.ndarray:
    """The n ids of one text, from its words and block offsets."""
    words = np.asarray(words, np.uint64)
    if not n:
        return np.zeros(0, np.int64)
    s = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for k in np.flatnonzero(s == 0).tolist():
        if not raw[k]:
            raw[k + 1] = True
    count = np.where(raw, 0, COUNTS[s])
    owner = np.searchsorted(offsets, np.arange(len(words)), "right") - 1
    total = np.cumsum(count) - count
    within = total - total[offsets[owner]]
    room = np.minimum(block, n - owner * block) - within
    count = np.minimum(count, room)
    at = np.repeat(np.arange(len(words)), count)
    k = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count)
    width = WIDTHS[s[at]].astype(np.uint64)
    escape = s[at] == 0
    shift = np.where(escape, 0, k.astype(np.uint64) * width).astype(np.uint64)
    mask = np.where(escape, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << np.where(escape, 0, width).astype(np.uint64)) - np.uint64(1))
    source = words[np.where(escape, np.minimum(at + 1, len(words) - 1), at)]
    return ((source >> shift) & mask).view(np.int64)


def coded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, block: int = BLOCK) -> DataFrame:
    """Columns doc_id, n_tokens, words (little-endian 64-bit words), offsets (words before each block)."""
    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = Tokenizer(vocabulary)
        for batch in batches:
            _, offsets = tb.utf8(batch.column(1))
            for i, j in tb.chunks(offsets):
                part = batch.slice(i, j - i)
                ids, bounds = tokenizer.encode(texts_of(part.column(1)))
                words, word_bounds, starts, start_bounds = encode(ids, bounds, block)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(np.diff(bounds)),
                        pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer((word_bounds * 8).astype(np.int64)), pa.py_buffer(words.astype("<u8"))]).cast(pa.binary()),
                        pa.ListArray.from_arrays(pa.array(start_bounds.astype(np.int32)), pa.array(starts)),
                    ],
                    ["doc_id", "n_tokens", "words", "offsets"],
                )

    fields = [T.StructField("doc_id", kept.schema["doc_id"].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("words", T.BinaryType()), T.StructField("offsets", T.ArrayType(T.IntegerType()))]
    return kept.mapInArrow(emit, T.StructType(fields))
