"""Vectorised views of Arrow string columns: bytes, words and word hashes.

A word is a longest run of ASCII letters, digits and non-ASCII characters that
are no punctuation, space or symbol (the blocks of general punctuation to
symbols, U+2000 to U+2BFF, Latin-1 signs, CJK and full-width punctuation, emoji);
in scripts written without spaces (Han, kana, Thai, Lao, Khmer, Myanmar) every
character is a word.  Letters are folded to lower case (ASCII and Latin-1).
Every function takes whole texts; nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORD = np.zeros(256, bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[128:] = True
_P, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15 | 1), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, and where each text starts and the last ends."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts that together have about ``most`` bytes; a longer text is alone."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def fold(data: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and for the two-byte letters U+00C0 to U+00DE."""
    out = data + ((data - np.uint8(65)) < 26).view(np.uint8) * np.uint8(32)  # comparisons are faster than a table
    if len(out) > 1:
        upper = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
        out[upper] += 32
    return out


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits look independent."""
    h = h ^ (h >> np.uint64(30))
    h = h * _M1
    h ^= h >> np.uint64(27)
    h *= _M2
    h ^= h >> np.uint64(31)
    return h


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; equal bytes have equal hashes wherever they are."""
    n = len(data) + 1
    if len(_powers[0]) < n:
        size = max(n, 1 << 21)
        for k, p in enumerate((_P, _PINV)):
            x = np.full(size, p, np.uint64)
            x[0] = 1
            _powers[k] = np.cumprod(x)
    c = np.zeros(n, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers[0][: n - 1], out=c[1:])
    return mix((c[end] - c[start]) * _powers[1][start])


def word_bytes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which bytes belong to words; first bytes and lengths of the characters that are words by themselves."""
    w = ((data | np.uint8(32)) - np.uint8(97) < 26) | (data - np.uint8(48) < 10) | (data >= 128)
    at = np.flatnonzero((data == 0xC2) | (data - np.uint8(0xE0) < 10) | (data == 0xEF) | (data == 0xF0))
    if not len(at):
        return w, at, at
    end = len(data) - 1
    a, b, c = data[at], data[np.minimum(at + 1, end)], data[np.minimum(at + 2, end)]
    size = np.where(a < 0xE0, 2, np.where(a < 0xF0, 3, 4))
    wide = (b == 0xBC) & ((c < 0x90) | (c >= 0x9A) & (c <= 0xA0) | (c >= 0xBB)) | (b == 0xBD) & ((c == 0x80) | (c >= 0x9B) & (c <= 0xA5)) | (b == 0xBB) & (c == 0xBF) | (b == 0xBF) | (b == 0xB8)
    mark = (
        (a == 0xC2) & (b != 0xAA) & (b != 0xB5) & (b != 0xBA) | (a == 0xE2) & (b < 0xB0) | (a == 0xE3) & (b == 0x80) & ((c < 0x85) | (c > 0x87))
        | (a == 0xEF) & wide | (a == 0xF0) & (b == 0x9F)
    )
    for k in range(4):
        w[np.minimum(at[mark & (size > k)] + k, end)] = False
    single = ~mark & ((a >= 0xE3) & (a <= 0xE9) | (a == 0xF0) & (b >= 0xA0) & (b < 0xB0) | (a == 0xE0) & (b >= 0xB8) & (b <= 0xBB) | (a == 0xE1) & ((b >= 0x80) & (b <= 0x82) | (b == 0x9E) | (b == 0x9F)))
    return w, at[single], size[single]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text number of each word, in order."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, z
    w, at, size = word_bytes(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    edge[at] = True
    edge[np.minimum(at + size, n)] = True
    gap = np.ones(n + 1, bool)
    gap[1:] = ~w
    start = np.flatnonzero(w & (gap[:n] | edge[:n]))
    gap[:n] = ~w
    gap[n] = True
    end = np.flatnonzero(w & (gap[1:] | edge[1:])) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1
