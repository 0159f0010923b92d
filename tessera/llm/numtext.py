"""Vectorised text measures over Arrow string columns.

The texts of a record batch are one UTF-8 buffer with offsets; words, lines and their
64-bit hashes come from whole-array numpy steps, in slices of about a megabyte, so a
worker's memory does not grow with the batch.  White space is ``[\\x20\\x09-\\x0D]``.
Hashes are prefix sums of byte times odd-base power modulo 2**64, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
_pow = {"f": np.ones(1, U), "i": np.ones(1, U)}

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow["f"]) < n:
        size = max(n, SLICE_BYTES + 1)
        for key, base in (("f", _BASE), ("i", _INV)):
            step = np.full(size, base, U)
            step[0] = 1
            _pow[key] = np.multiply.accumulate(step)
    return _pow["f"][:n], _pow["i"][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def prefix(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of value * base**i and the inverse powers, for ``span_hash``."""
    fwd, inv = _powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, U)
    np.cumsum((values.astype(U) + U(1)) * fwd[: len(values)], out=sums[1:])
    return sums, inv


def span_hash(pre: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    sums, inv = pre
    return mix64((sums[end] - sums[start]) * inv[start] + (end - start).astype(U))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    off = np.frombuffer(off, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def slices(off: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``size`` bytes, or of one row that is longer."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Texts:
    """Words and lines of the texts in one slice of a batch."""

    def __init__(self, data: np.ndarray, off: np.ndarray, lower: bool = False):
        self.data = LOWER[data] if lower else data
        self.off, self.n = off - off[0], len(off) - 1
        self.pre = prefix(self.data)
        self.solid = ~SPACE[data]
        self.seen = self.total(self.solid)

    @staticmethod
    def total(mask: np.ndarray) -> np.ndarray:
        out = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=out[1:])
        return out

    def per_text(self, mask: np.ndarray) -> np.ndarray:
        c = self.total(mask)
        return c[self.off[1:]] - c[self.off[:-1]]

    def owner(self, pos: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.off, pos, "right") - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text number of every word."""
        s = self.solid
        edge = np.zeros(len(s) + 1, bool)
        edge[self.off] = True
        first, last = s.copy(), s.copy()
        first[1:] &= ~s[:-1] | edge[1:-1]
        last[:-1] &= ~s[1:] | edge[1:-1]
        start = np.flatnonzero(first)
        return start, np.flatnonzero(last) + 1, self.owner(start)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and text number of every line (split at \\n; every text has one)."""
        cut = np.flatnonzero(self.data == 10)
        start = np.concatenate([self.off[:-1], cut + 1])
        end = np.concatenate([cut, self.off[1:]])
        doc = np.concatenate([np.arange(self.n), self.owner(cut)])
        doc_end = np.concatenate([self.owner(cut), np.arange(self.n)])
        a, b = np.lexsort((start, doc)), np.lexsort((end, doc_end))
        return start[a], end[b], doc[a]


def windows(hashes: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Index and hash of every run of ``k`` consecutive items within one text."""
    if len(hashes) < k:
        return np.zeros(0, np.int64), np.zeros(0, U)
    at = np.flatnonzero(doc[k - 1:] == doc[: len(doc) - k + 1])
    return at, span_hash(prefix(hashes), at, at + k)


def repeated(doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item: does its hash occur again in its text; is it not the first one."""
    if not len(hashes):
        return np.zeros(0, bool), np.zeros(0, bool)
    key = mix64(hashes + doc.astype(U) * U(0xD6E8FEB86659FD93))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    again, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
    again[order[1:]] = same
    again[order[:-1]] |= same
    later[order[1:]] = same
    return again, later


def shingle_sets(t: Texts, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hash of every distinct k-word shingle, sorted by both; a text of
    fewer words (but one at least) has its whole sequence as one shingle."""
    start, end, doc = t.words()
    wh = span_hash(t.pre, start, end)
    at, sh = windows(wh, doc, k)
    count = np.bincount(doc, minlength=t.n) if len(doc) else np.zeros(t.n, np.int64)
    few = np.flatnonzero((count > 0) & (count < k))
    first = np.concatenate([[0], np.cumsum(count)])
    short = span_hash(prefix(wh), first[few], first[few + 1]) if len(few) else np.zeros(0, U)
    doc = doc[at]
    if len(few):
        doc, sh = np.concatenate([doc, few]), np.concatenate([sh, short])
        order = np.argsort(doc, kind="stable")
        doc, sh = doc[order], sh[order]
    edge = np.searchsorted(doc, np.arange(t.n + 1)).tolist()
    for i, j in zip(edge[:-1], edge[1:], strict=True):  # short sorts of one key beat a sort by two
        sh[i:j].sort()
    new = np.ones(len(sh), bool)
    new[1:] = (sh[1:] != sh[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], sh[new]
