"""Byte-pair token ids of whole columns, by a vocabulary of ranks.

Texts are cut into pieces as the pattern of the public rank files does, with
array operations over code points: contractions; letters, digits or other marks
with at most one space before; white space, of which the last before a piece
stays apart.  Each distinct piece is merged once and remembered in a
direct-mapped table; a hit costs one look-up.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import regex

from . import textbytes as tb

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SPACE, _LETTER, _DIGIT, _OTHER, _UNKNOWN = 0, 1, 2, 3, 255
_CLASSES = (regex.compile(r"\s"), regex.compile(r"\p{L}"), regex.compile(r"\p{N}"))


class Tokenizer:
    """Ids of texts under one rank file; ``slots`` is the size of the table of pieces."""

    def __init__(self, path: str, slots: int = 1 << 20, most_ids: int = 1 << 24) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.kind = np.full(0x110000, _UNKNOWN, np.uint8)
        self.slots, self.most_ids = slots, most_ids
        self._clear()

    def _clear(self) -> None:
        self.tag = np.zeros(self.slots, np.uint64)
        self.where = np.zeros(self.slots, np.int64)
        self.count = np.zeros(self.slots, np.int32)
        self.ids, self.used = np.zeros(1 << 16, np.int32), 0

    def _kinds(self, code: np.ndarray) -> np.ndarray:
        kind = self.kind[code]
        if (kind == _UNKNOWN).any():
            for c in np.unique(code[kind == _UNKNOWN]).tolist():
                x = chr(c)
                self.kind[c] = next((k for k, p in enumerate(_CLASSES) if p.match(x)), _OTHER)
            kind = self.kind[code]
        return kind

    def pieces(self, code: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where pieces begin, given code points and a mask of the first of each text."""
        n = len(code)
        kind = self._kinds(code)
        begin = first.copy()
        begin[1:] |= kind[1:] != kind[:-1]
        begin[0] = True
        space = kind == _SPACE
        tail = np.zeros(n, bool)  # the last of a run of white space that something in the text follows
        tail[:-1] = space[:-1] & ~space[1:] & ~first[1:]
        begin[tail] = True
        lone = np.flatnonzero(tail & (code == 32))
        begin[lone + 1] = False  # the space belongs to the piece after it
        quote = np.flatnonzero((code == 39) & begin)
        if len(quote):
            pad = np.concatenate([code, np.zeros(4, code.dtype)])
            edge = np.concatenate([first, np.ones(4, bool)])
            for size, what in ((2, "s"), (2, "t"), (3, "re"), (3, "ve"), (2, "m"), (3, "ll"), (2, "d")):
                ok = np.ones(len(quote), bool)
                for k, c in enumerate(what, 1):
                    ok &= (pad[quote + k] == ord(c)) & ~edge[quote + k]
                hit = quote[ok]
                for k in range(1, size):
                    begin[hit + k] = False
                after = hit + size
                inside = after < n
                begin[after[inside]] = True
        return np.flatnonzero(begin)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and where each text's begin (and the last end)."""
        sizes = np.array([len(t) for t in texts], np.int64)
        joined = "".join(texts)
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(code)
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        first = np.zeros(n, bool)
        first[bounds[:-1][bounds[:-1] < n]] = True
        start = self.pieces(code, first)
        end = np.append(start[1:], n)
        h = tb.span_hashes(code, start, end)
        h[h == 0] = 1
        if self.used > self.most_ids:
            self._clear()
        slot = (h & np.uint64(self.slots - 1)).astype(np.int64)
        where, count = self.where[slot], self.count[slot]
        miss = np.flatnonzero(self.tag[slot] != h)
        if len(miss):
            new, one, back = np.unique(h[miss], return_index=True, return_inverse=True)
            one = miss[one]
            made = [self.bpe.encode_ordinary(joined[a:b]) for a, b in zip(start[one].tolist(), end[one].tolist(), strict=True)]
            size = np.array([len(m) for m in made], np.int64)
            at = self.used + np.concatenate([[0], np.cumsum(size)[:-1]])
            flat = np.fromiter((x for m in made for x in m), np.int32, int(size.sum()))
            if self.used + len(flat) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.zeros(len(self.ids) + len(flat), np.int32)])
            self.ids[self.used : self.used + len(flat)] = flat
            self.used += len(flat)
            s = (new & np.uint64(self.slots - 1)).astype(np.int64)
            self.tag[s], self.where[s], self.count[s] = new, at, size
            where[miss], count[miss] = at[back], size[back]
        total = np.concatenate([[0], np.cumsum(count, dtype=np.int64)])
        ids = self.ids[np.arange(total[-1]) + np.repeat(where - total[:-1], count)]
        return ids, total[np.searchsorted(start, bounds)]


def texts_of(column: pa.Array) -> list[str]:
    """Texts, with empty ones for nulls."""
    return [t or "" for t in column.to_pylist()]
