"""Repeated byte strings across documents by merging Burrows-Wheeler transforms.

A byte goes if a ``length``-byte string over it also starts in a document of smaller id.

1. Documents become blocks of about a megabyte (written once, compressed).  ``bundle`` blocks
   are a row, so the exchanges have a row for each bundle and bucket; tasks read block by block.
2. Every window of ``length`` bytes has a minimizer: the least hash of its ``seed``-byte
   strings.  Equal windows have equal minimizers, so hash buckets of minimizers split the
   windows of the corpus into independent sets.  Minimizers that occur in one document
   only are ruled out first, by 32-bit remainders and one answer bit each.  The same
   exchange counts the distinct strings of a minimizer: one with more than ``hot_strings``
   (a phrase that very many documents hold between different neighbours) is dealt anew,
   each of its windows by the hash of its own bytes, so equal windows still meet.
3. Runs of windows with a shared minimizer travel to its bucket as strings with the least
   document that holds them (equal strings once).  Strings that are alone with their
   minimizer share no window with others; a bucket takes the rest
   in parts by minimizer, splits a part into shards, builds each shard's Burrows-Wheeler transform, and merges the
   transforms by iterative interleave refinement: round t stably deals the interleave by the symbols of
   the transforms, which sorts all suffixes by t symbols without comparing texts.  The
   round in which neighbours part is their common prefix + 1; after ``length`` rounds the
   intervals that have not parted are the repeated windows, and each gets its least document.
   A suffix alone in its interval stays alone, so a round deals only the others (``merge`` is
   the same refinement of the whole interleave).
4. The answers go back to the blocks, which mark and remove the covered bytes.

Only bounded sets meet in a task: a block, or a bucket of minimizers of at most ``hot_strings``
each, to which a string contributes one entry per block however often it occurs.  Hashes choose candidates; equality of windows is
decided on bytes by the merge (equal strings are pooled by 64-bit hashes before it).

Edge cases: null and empty texts have no bytes and keep none; rows of equal id do not
remove each other's bytes; a null id counts as the smallest; long texts are processed in
slices of a block each, a text longer than a block is a block; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.numtext import SLICE_BYTES, U, buffers, prefix, slices, span_hash
from tessera.llm.tables import staged

LOWEST = -(1 << 63)
CHUNK = 1 << 14


@dataclass(frozen=True)
class Repeats:
    """``bucket_bytes`` of text per bucket on average, merged in parts of about ``part_bytes``
    by ``shards`` transforms each; up to ``hot_strings`` distinct strings with one minimizer
    stay together; ``bundle`` blocks travel together."""
    length: int = 50
    seed: int = 28
    bucket_bytes: int = 16 << 20
    hot_strings: int = 1 << 14
    shards: int = 4
    part_bytes: int = 1 << 18
    bundle: int = 8
    run: int = 200


@cache
def _codec() -> tuple:
    """One per worker: making a compressor costs more than a short text."""
    import zstandard
    return zstandard.ZstdCompressor(level=2), zstandard.ZstdDecompressor()


def _pack(raw: bytes) -> bytes:
    return _codec()[0].compress(raw)


def _unpack(raw: bytes) -> bytes:
    return _codec()[1].decompress(raw)


def blocks(docs: DataFrame, p: Repeats) -> DataFrame:
    """(bundle, ids, lens, data): the documents in compressed blocks, ``bundle`` of them to a row."""
    schema = pa.schema([("bundle", pa.string()), ("ids", pa.list_(pa.list_(pa.int64()))),
                        ("lens", pa.list_(pa.list_(pa.int64()))), ("data", pa.list_(pa.binary()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, part, size, held = 0, TaskContext.get().partitionId(), 0, []

        def row() -> pa.RecordBatch:
            ids, lens, data = zip(*held, strict=True)
            return pa.RecordBatch.from_pydict({"bundle": [f"{part}-{n}"], "ids": [ids], "lens": [lens], "data": [data]},
                                              schema=schema)

        for b in batches:
            data, off = buffers(b.column("text"))
            for i, j in slices(off):
                held.append((b.column("doc_id").slice(i, j - i).to_pylist(), np.diff(off[i:j + 1]).tolist(),
                             _pack(data[off[i]:off[j]].tobytes())))
                size += int(off[j] - off[i])
                if len(held) == p.bundle or size >= p.bundle * SLICE_BYTES:
                    yield row()
                    n, size, held = n + 1, 0, []
        if held:
            yield row()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "bundle string, ids array<array<long>>, lens array<array<long>>, data array<binary>")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


def _blocks_of(row: dict, p: Repeats) -> Iterator[Block]:
    for ids, lens, data in zip(row["ids"], row["lens"], row["data"], strict=True):
        yield Block(ids, lens, data, p)


def _by_bucket(bucket: np.ndarray) -> tuple[np.ndarray, list[int], list[int], list[int]]:
    """Order by bucket, and of each bucket its number, begin and end there."""
    by = np.argsort(bucket, kind="stable")
    of = bucket[by]
    cut = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else by
    return by, of[cut].tolist(), cut.tolist(), [*cut[1:].tolist(), len(of)][:len(cut)]


def _least(pre: tuple[np.ndarray, np.ndarray], i: int, j: int, p: Repeats) -> np.ndarray:
    """The minimizers of the windows that start at ``i`` to ``j - 1``."""
    width, wide = 1, p.length - p.seed + 1
    at = np.arange(i, j + wide - 1)
    low = span_hash(pre, at, at + p.seed)
    while 2 * width <= wide:
        low, width = np.minimum(low[:-width], low[width:]), 2 * width
    return np.minimum(low[:width - wide], low[wide - width:]) if width < wide else low


class Block:
    """The windows of a block in runs of equal minimizer."""

    def __init__(self, ids: list, lens: list, data: bytes, p: Repeats):
        self.data = np.frombuffer(_unpack(data), np.uint8)
        self.off = np.concatenate([[0], np.cumsum(np.array(lens, np.int64))]).astype(np.int64)
        self.ids = np.array([LOWEST if i is None else i for i in ids], np.int64)
        self.pre, n = prefix(self.data), len(self.data)
        if n < p.length:
            self.start = self.count = self.doc = np.zeros(0, np.int64)
            self.least = np.zeros(0, U)
            return
        low = np.empty(n - p.length + 1, U)
        for i in range(0, len(low), CHUNK):  # pieces that fit a processor's cache
            j = min(i + CHUNK, len(low))
            low[i:j] = _least(self.pre, i, j, p)
        new = np.concatenate([[True], low[1:] != low[:-1]])
        for edge in (self.off[:-1], np.maximum(self.off[1:] - p.length + 1, self.off[:-1])):
            new[edge[edge < len(low)]] = True  # a document's start, its first window that is not whole
        first = np.flatnonzero(new)
        size = np.diff(np.concatenate([first, [len(low)]]))
        doc = np.searchsorted(self.off, first, "right") - 1
        ok = first + p.length <= self.off[doc + 1]
        first, size, doc = first[ok], size[ok], doc[ok]
        parts = -(-size // p.run)  # very long runs (one letter repeated) in pieces
        step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        self.start = np.repeat(first, parts) + step * p.run
        self.count = np.minimum(np.repeat(size, parts) - step * p.run, p.run)
        self.doc, self.least = np.repeat(doc, parts), low[self.start]

    def minimizers(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct minimizers by bucket, and their buckets."""
        h = np.sort(self.least)
        h = h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h
        b = (h % U(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.int64)
        by = np.argsort(b, kind="stable")
        return h[by], b[by]

    def spread(self, h: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """For every minimizer of ``h``: if two documents here have it, and how many
        distinct strings here do."""
        if not len(h):
            return np.zeros(0, bool), np.zeros(0, np.int64)
        key = span_hash(self.pre, self.start, self.start + self.count + length - 1)
        order = np.lexsort((key, self.least))
        low, key, doc = self.least[order], key[order], self.doc[order]
        head = np.concatenate([[True], low[1:] != low[:-1]])
        again = np.concatenate([[False], key[1:] == key[:-1]]) & ~head
        cut = np.flatnonzero(head)
        at = np.searchsorted(low[cut], h)
        two = np.minimum.reduceat(doc, cut) != np.maximum.reduceat(doc, cut)
        return two[at], np.add.reduceat((~again).astype(np.int64), cut)[at]

    def strings(self, shared: np.ndarray, hot: np.ndarray, buckets: int, p: Repeats) -> tuple[np.ndarray, ...]:
        """Runs whose minimizer is in ``shared`` (sorted), those of ``hot`` ones in single
        windows: start, windows, document and string number of each, and per string its
        bucket, start, length and least document."""
        run = np.flatnonzero(_among(self.least, shared))
        single = _among(self.least[run], hot)
        parts = np.where(single, self.count[run], 1)
        step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        run, single = np.repeat(run, parts), np.repeat(single, parts)
        start, count, of_doc = self.start[run] + step, np.where(single, 1, self.count[run]), self.doc[run]
        key = span_hash(self.pre, start, start + count + p.length - 1)
        deal = np.where(single, key, self.least[run])
        _, first, of = np.unique(key, return_index=True, return_inverse=True)
        doc = np.full(len(first), np.iinfo(np.int64).max)
        np.minimum.at(doc, of, self.ids[of_doc])
        bucket = (deal[first] % U(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        rank = np.empty(len(by), np.int64)
        rank[by] = np.arange(len(by))
        first = first[by]
        return (start, count, of_doc, rank[of]), (bucket[by], start[first], count[first] + p.length - 1, doc[by])


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which ``values`` are in ``known`` (sorted)."""
    if not len(known):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


def transform(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Burrows-Wheeler transform (0: end mark) of sorted strings, and the suffix order as
    positions in their concatenation, an end mark after each."""
    text = np.frombuffer(b"\0".join([*strings, b""]), np.uint8).astype(np.int64) + 1
    text[np.cumsum([len(s) + 1 for s in strings]) - 1] = 0
    n, key, at = len(text), text, np.arange(len(text))
    for width, more, low in ((1, 1, 0), (2, 2, 0), (4, 3, 9)):  # seven symbols, none after an end mark
        after = np.zeros(n, np.int64)
        after[:-width] = key[width:] >> low
        key = (key << 9 * more) | np.where(key & 511, after, 0)
    order = np.argsort(key)
    key = key[order]
    head = np.concatenate([[True], key[1:] != key[:-1]])
    ended = np.flatnonzero((key & 511) == 0)
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, at, 0))
    pos = order[ended]  # equal ones in the order of their strings
    order[ended] = pos = pos[np.argsort(rank[pos] * n + pos)]
    rank[pos], head[ended] = ended, True
    open_, t = np.flatnonzero(~(head & np.append(head[1:], True))), 7
    open_ = open_[(key[open_] & 511) != 0]
    while len(open_):  # suffixes that are alone with their first t symbols stay in place
        pos = order[open_]
        by = rank[pos] * n + rank[pos + t]
        o = np.argsort(by)
        by, pos = by[o], pos[o]
        head = np.concatenate([[True], by[1:] != by[:-1]])
        order[open_], rank[pos] = pos, open_[np.maximum.accumulate(np.where(head, at[:len(by)], 0))]
        open_, t = open_[~(head & np.append(head[1:], True))], 2 * t
    return np.where(order == 0, 0, text[order - 1]), order


def merge(bwts: list[np.ndarray], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Interleave of the transforms' suffixes sorted by their first ``rounds`` symbols, and
    the common prefix of each suffix with the one before (``rounds``: as much at least)."""
    sizes = [len(b) for b in bwts]
    flat = np.concatenate(bwts)
    _, codes = np.unique(flat, return_inverse=True)
    codes = codes.astype(np.uint8 if codes.max() < 256 else np.uint16)
    z = np.repeat(np.arange(len(bwts), dtype=np.uint8), sizes)
    block, common = np.zeros(len(z), np.int32), np.full(len(z), rounds, np.int32)
    common[:1] = 0
    sym = np.empty(len(z), codes.dtype)
    for t in range(1, rounds + 1):
        sym[np.argsort(z, kind="stable")] = codes
        order = np.argsort(sym, kind="stable")
        z, s, b = z[order], sym[order], block[order]
        apart = (s[1:] != s[:-1]) | (b[1:] != b[:-1])
        fresh = common[1:]
        fresh[apart & (fresh == rounds)] = t - 1
        block[0] = 0
        np.cumsum(apart, out=block[1:])
    return z, common


def unparted(bwts: list[np.ndarray], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """The intervals of ``merge`` that have not parted after ``rounds``: their suffixes as
    rows of the transforms one after the other, and where each interval begins.  A suffix
    that is alone in its interval stays so when symbols are put before it, so every round
    deals only the intervals of two or more."""
    flat = np.concatenate(bwts)
    known = np.bincount(flat, minlength=257) > 0
    codes = (np.cumsum(known) - 1)[flat].astype(np.uint8 if known.sum() <= 256 else np.uint16)
    before, base = np.empty(len(flat), np.int32), 0  # row of the suffix that is longer by one symbol
    for b in bwts:
        before[base + np.argsort(codes[base:base + len(b)], kind="stable")] = np.arange(base, base + len(b))
        base += len(b)
    rows, interval = np.arange(len(flat), dtype=np.int32), np.zeros(len(flat), np.int32)
    head = np.zeros(len(flat), bool)
    for _ in range(rounds):
        sym = codes[rows]
        order = np.argsort(sym, kind="stable")
        sym = sym[order]
        whole = int(np.searchsorted(sym, 1))  # an end mark: no longer suffix of this string
        sym, order = sym[whole:], order[whole:]
        rows, interval = before[rows[order]], interval[order]
        head = np.ones(len(rows) + 1, bool)
        head[1:-1] = (sym[1:] != sym[:-1]) | (interval[1:] != interval[:-1])
        stay = np.flatnonzero(~(head[:-1] & head[1:]))
        head = head[stay]
        rows, interval = rows[stay], np.cumsum(head, dtype=np.int32)
    return rows, np.flatnonzero(head)


def least_documents(strings: list[bytes], docs: np.ndarray, p: Repeats) -> np.ndarray:
    """For every window of every string, one string after the other, the least document
    whose strings hold it."""
    cuts = np.linspace(0, len(strings), min(p.shards, len(strings)) + 1).astype(int)
    bwts, orders, starts, names, size = [], [], [], [], np.array([len(s) for s in strings])
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        by = sorted(range(a, b), key=strings.__getitem__)
        bwt, order = transform([strings[i] for i in by])
        starts.append(np.cumsum(size[by] + 1) - size[by] - 1 + sum(map(len, bwts)))
        orders.append(order + sum(map(len, bwts)))
        bwts.append(bwt)
        names.append(by)
    rows, heads = unparted(bwts, p.length)
    count = size - p.length + 1
    first, out = np.cumsum(count) - count, np.repeat(docs, count)
    if len(rows):
        at, base = np.concatenate(orders)[rows], np.concatenate(starts)
        k = np.searchsorted(base, at, "right") - 1
        owner = np.concatenate(names).astype(np.int64)[k]
        low = np.minimum.reduceat(docs[owner], heads)
        out[first[owner] + at - base[k]] = np.repeat(low, np.diff(np.append(heads, len(rows))))
    return out


def _least_of(strings: list[bytes], p: Repeats) -> np.ndarray:
    """The minimizer of every string."""
    size = np.array([len(s) for s in strings])
    out = np.empty(len(strings), U)
    for i, j in slices(np.concatenate([[0], np.cumsum(size)])):
        text, end = np.frombuffer(b"".join(strings[i:j]), np.uint8), np.cumsum(size[i:j])
        at = np.arange(len(text) - p.seed + 1)
        low = span_hash(prefix(text), at, at + p.seed)
        past = (end[:-1, None] - np.arange(1, p.seed)).ravel()  # these would reach into the next string
        low[past] = np.iinfo(U).max
        out[i:j] = np.minimum.reduceat(low, end - size[i:j])
    return out


def least_of_all(strings: list[bytes], docs: np.ndarray, p: Repeats) -> np.ndarray:
    """``least_documents`` of a bucket: strings that are alone with their minimizer share no
    window, and the others are merged in parts by minimizer."""
    _, of, n = np.unique(_least_of(strings, p), return_inverse=True, return_counts=True)
    count = np.array([len(s) for s in strings]) - p.length + 1
    first, out = np.cumsum(count) - count, np.repeat(docs, count)
    more = np.flatnonzero(n[of] > 1)
    more = more[np.argsort(of[more], kind="stable")]
    total = np.concatenate([[0], np.cumsum(count[more] + p.length - 1)])
    edge = np.flatnonzero(np.diff(of[more], prepend=-1))
    part = total[edge] // p.part_bytes  # a part begins with a minimizer
    cuts = [*edge[np.flatnonzero(np.diff(part, prepend=-1))].tolist(), len(more)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        k = more[a:b]
        low, c = least_documents([strings[i] for i in k], docs[k], p), count[k]
        out[np.repeat(first[k] - np.cumsum(c) + c, c) + np.arange(len(low))] = low
    return out


def _shared(blocked: DataFrame, buckets: int, p: Repeats) -> DataFrame:
    """(bundle, bucket, shared, hot): bits of the bundle's minimizers of the bucket, block by
    block, and the places among them of those with more than ``hot_strings`` in the corpus."""
    schema = pa.schema([("bucket", pa.int32()), ("bundle", pa.string()), ("h", pa.binary()),
                        ("two", pa.binary()), ("many", pa.binary())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            found = []
            for k in _blocks_of(r, p):
                h, at = k.minimizers(buckets)
                found.append((at, (h >> U(32)).astype("<u4"), *k.spread(h, p.length)))
            at, low, two, many = (np.concatenate(x) for x in zip(*found, strict=True))
            by, bucket, cut, end = _by_bucket(at)
            low, two, many = low[by], two[by], many[by].astype("<u4")
            yield pa.RecordBatch.from_pydict(
                {"bucket": bucket, "bundle": [r["bundle"]] * len(cut),
                 "h": [_pack(np.diff(low[i:j], prepend=low.dtype.type(0)).tobytes()) for i, j in zip(cut, end, strict=True)],
                 "two": [np.packbits(two[i:j]).tobytes() for i, j in zip(cut, end, strict=True)],
                 "many": [_pack(many[i:j].tobytes()) for i, j in zip(cut, end, strict=True)]}, schema=schema)

    def answer(t: pa.Table) -> pa.Table:
        h = [np.cumsum(np.frombuffer(_unpack(x), "<u4"), dtype="<u4") for x in t["h"].to_pylist()]
        many = np.concatenate([np.frombuffer(_unpack(x), "<u4") for x in t["many"].to_pylist()])
        _, of, n = np.unique(np.concatenate(h), return_inverse=True, return_counts=True)
        cut = np.cumsum([len(x) for x in h])[:-1]
        again = np.split(n[of] > 1, cut)
        much = np.split((np.bincount(of, weights=many) > p.hot_strings)[of], cut)
        bits = [np.packbits(a | np.unpackbits(np.frombuffer(w, np.uint8), count=len(a)).astype(bool)).tobytes()
                for a, w in zip(again, t["two"].to_pylist(), strict=True)]
        return pa.table({"bundle": t["bundle"].cast(pa.string()), "bucket": t["bucket"], "shared": pa.array(bits, pa.binary()),
                         "hot": pa.array([np.flatnonzero(x) for x in much], pa.list_(pa.int32()))})

    return (blocked.mapInArrow(send, "bucket int, bundle string, h binary, two binary, many binary")
            .repartitionById(buckets, "bucket").groupBy("bucket")
            .applyInArrow(answer, "bundle string, bucket int, shared binary, hot array<int>"))


class Parts:
    """Arrays of a bundle by bucket, taken block by block."""

    def __init__(self, of: dict[int, np.ndarray]):
        self.of, self.at = of, dict.fromkeys(of, 0)

    def take(self, bucket: np.ndarray, size: np.ndarray | None = None) -> np.ndarray:
        """The next ``size`` values (one) for every entry of ``bucket`` (sorted)."""
        cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else bucket
        n = np.diff(np.append(cut, len(bucket))) if size is None else np.add.reduceat(size, cut) if len(cut) else cut
        out = [np.zeros(0, np.int64)]
        for b, m in zip(bucket[cut].tolist(), n.tolist(), strict=True):
            i = self.at[b]
            out.append(self.of[b][i:i + m])
            self.at[b] = i + m
        return np.concatenate(out)


def _shared_of(answers: list) -> Parts:
    """Of every minimizer: 0 in one document only, 1 shared, 2 or 3 hot."""
    of = {}
    for a in answers:
        x = np.unpackbits(np.frombuffer(a["shared"], np.uint8))
        x[np.array(a["hot"], np.int64)] |= 2
        of[a["bucket"]] = x
    return Parts(of)


def _strings_of(block: Block, shared: Parts, buckets: int, p: Repeats) -> tuple:
    h, at = block.minimizers(buckets)
    x = shared.take(at)
    return block.strings(np.sort(h[(x & 1) > 0]), np.sort(h[x > 1]), buckets, p)


def repeats(docs: DataFrame, p: Repeats = Repeats()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row of ``docs``."""
    blocked = staged(blocks(docs, p), "blocks")
    total = blocked.select(F.sum(F.aggregate(F.flatten("lens"), F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    buckets = max(12, total // p.bucket_bytes)
    answers = _shared(blocked, buckets, p).groupBy("bundle").agg(
        F.collect_list(F.struct("bucket", "shared", "hot")).alias("answers"))  # bounded by the bundle's minimizers
    asked = staged(answers, "shared")
    full = blocked.join(asked, "bundle", "left")
    schema = pa.schema([("bucket", pa.int32()), ("bundle", pa.string()), ("text", pa.binary()),
                        ("size", pa.binary()), ("doc", pa.binary())])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            shared, raw, found, base = _shared_of(r["answers"] or []), [], [], 0
            for k in _blocks_of(r, p):
                _, (bucket, s, n, doc) = _strings_of(k, shared, buckets, p)
                raw.append(k.data.tobytes())
                found.append((bucket, s + base, n, doc))
                base += len(k.data)
            raw = b"".join(raw)
            bucket, s, n, doc = (np.concatenate(x) for x in zip(*found, strict=True))
            by, bucket, cut, end = _by_bucket(bucket)
            s, n, doc = s[by], n[by].astype("<i8"), doc[by].astype("<i8")
            yield pa.RecordBatch.from_pydict(
                {"bucket": bucket, "bundle": [r["bundle"]] * len(cut),
                 "text": [_pack(b"".join([raw[x:x + y] for x, y in zip(s[i:j].tolist(), n[i:j].tolist(), strict=True)]))
                          for i, j in zip(cut, end, strict=True)],
                 "size": [_pack(n[i:j].tobytes()) for i, j in zip(cut, end, strict=True)],
                 "doc": [_pack(doc[i:j].tobytes()) for i, j in zip(cut, end, strict=True)]}, schema=schema)

    def settle(t: pa.Table) -> pa.Table:
        of: dict[bytes, int] = {}
        docs_, rows = [], []
        for text, size, doc in zip(*(t[c] for c in ("text", "size", "doc")), strict=True):
            text, at, mine = _unpack(text.as_py()), 0, []
            for n, d in zip(np.frombuffer(_unpack(size.as_py()), "<i8").tolist(),
                            np.frombuffer(_unpack(doc.as_py()), "<i8").tolist(), strict=True):
                k = of.setdefault(text[at:at + n], len(of))
                at += n
                if k == len(docs_):
                    docs_.append(d)
                elif d < docs_[k]:
                    docs_[k] = d
                mine.append(k)
            rows.append(np.array(mine, np.int32))
        names = list(of)
        low = least_of_all(names, np.array(docs_, np.int64), p)
        count = np.array([len(s) for s in names]) - p.length + 1
        first, out = np.cumsum(count) - count, []
        for k in rows:
            c = count[k]
            out.append(_pack(low[np.repeat(first[k] - np.cumsum(c) + c, c) + np.arange(c.sum())].astype("<i8").tobytes()))
        return pa.table({"bundle": t["bundle"].cast(pa.string()), "bucket": t["bucket"], "low": pa.array(out, pa.binary())})

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            shared = _shared_of(r["answers"] or [])
            lows = Parts({x["bucket"]: np.frombuffer(_unpack(x["low"]), "<i8") for x in r["lows"] or []})
            for k, ids in zip(_blocks_of(r, p), r["ids"], strict=True):
                gone = np.zeros(len(k.data) + 1, np.int64)
                (start, size, of_doc, of), (bucket, _, n, _) = _strings_of(k, shared, buckets, p)
                if len(start):
                    low = lows.take(bucket, n - p.length + 1)
                    first = np.cumsum(n - p.length + 1) - (n - p.length + 1)
                    step = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                    hit = low[np.repeat(first[of], size) + step] < np.repeat(k.ids[of_doc], size)
                    at = (np.repeat(start, size) + step)[hit]
                    gone = np.bincount(at, minlength=len(gone)) - np.bincount(at + p.length, minlength=len(gone))
                gone = np.cumsum(gone)[:-1] > 0
                head = gone.copy()
                head[1:] &= ~gone[:-1]
                edge = k.off[:-1][k.off[:-1] < len(gone)]
                head[edge] = gone[edge]
                cg, ch = (np.concatenate([[0], np.cumsum(x)]) for x in (gone, head))
                kept = [k.data[i:j][~gone[i:j]].tobytes() for i, j in zip(k.off[:-1], k.off[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(np.diff(k.off)), pa.array(np.diff(cg[k.off])),
                     pa.array(np.diff(ch[k.off])), pa.array([hashlib.sha256(x).hexdigest() for x in kept]),
                     pa.array(kept, pa.binary())],
                    names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    sent = full.mapInArrow(send, "bucket int, bundle string, text binary, size binary, doc binary")
    settled = staged(sent.repartitionById(buckets, "bucket").groupBy("bucket")  # a task for each bucket
                     .applyInArrow(settle, "bundle string, bucket int, low binary")
                     .groupBy("bundle").agg(F.collect_list(F.struct("bucket", "low")).alias("lows")), "least")
    return full.join(settled, "bundle", "left").mapInArrow(
        remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
