"""Importance resampling of documents toward a target distribution.

Features of a text are all runs of one to ``max_n`` words, hashed into ``buckets``.  The
counts of all documents and of all target texts give each bucket a gain, an array of
``buckets`` numbers that the scoring tasks hold.  A document's weight is the sum of the
gains of its features; with Gumbel noise from a hash of its id added, the highest scores
are a draw without replacement in proportion to the weights.

The cut-off is found by weighted median of medians.  Every group of at most ``group_rows``
remaining keys reports its median and its size; the median of these, weighted by the
sizes, has at least a quarter of the remaining keys on each side, so that every round
discards a guaranteed share until the pivot is the cut-off key itself.  Only medians reach
the driver, one for ``group_rows`` keys.  The winners alone are sorted, by ranges.

Keys are unique (score, doc_id, feature count, row number), so ties need no special case.

Edge cases: a null or empty text has no features and weight 0; a null id is hashed as an
empty string and comes after all ids of its score; equal scores go by smaller id, repeated
rows are separate documents; texts are read in blocks, whatever their length; an empty
table gives no rows, an empty target table gives its buckets no counts; extra columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.numtext import buffers
from tessera.llm.tables import numbered, staged

#: A-Z become lower case; every byte outside 0-9, a-z and the multi-byte range is a space
WORDS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
              for b in range(256))
KEY = ["score", "id", "n_features", "row"]
NO_ID = (1 << 63) - 1


@dataclass(frozen=True)
class Resampling:
    buckets: int = 10_000
    max_n: int = 3
    min_words: int = 20
    percent: int = 5
    seed: int = 42
    group_rows: int = 1 << 18
    block: int = 1 << 20


def feature_hashes(text: bytes, p: Resampling) -> Iterator[tuple[int, np.ndarray]]:
    """(new words, crc32 of every run of 1 to ``max_n`` words that ends in them) by block.

    crc32 continues from the hash of the words before, so that no run is ever built."""
    text = text.translate(WORDS)
    at, tail = 0, []
    while at < len(text):
        end = text.find(b" ", at + p.block)
        end = len(text) if end < 0 else end
        words = tail + text[at:end].split()
        at = end
        spaced = [b" " + w for w in words]
        run, out = list(map(crc32, words)), []
        for n in range(p.max_n):
            if n:
                run = list(map(crc32, spaced[n:], run))
            out += run[max(len(tail) - n, 0):]
        new = len(words) - len(tail)
        tail = words[max(len(words) - p.max_n + 1, 0):]
        yield new, np.array(out, np.int64)


def _texts(b: pa.RecordBatch) -> Iterator[bytes]:
    data, off = buffers(b.column("text"))
    for i in range(len(off) - 1):
        yield data[off[i]:off[i + 1]].tobytes()


def bucket_counts(texts: DataFrame, p: Resampling) -> np.ndarray:
    """Features of the whole table by bucket: every task sums its texts first."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(p.buckets, np.int64)
        for b in batches:
            for text in _texts(b):
                for _, h in feature_hashes(text, p):
                    n += np.bincount(h % p.buckets, minlength=p.buckets)
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(n[used])], names=["bucket", "n"])

    rows = (texts.select("text").mapInArrow(run, "bucket long, n long")
            .groupBy("bucket").agg(F.sum("n").alias("n")).collect())
    total = np.zeros(p.buckets, np.int64)
    for r in rows:
        total[r.bucket] = r.n
    return total


def gains(all_counts: np.ndarray, target: np.ndarray, p: Resampling) -> np.ndarray:
    s_all, t_all = int(all_counts.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((float(t + 1) * (s_all + p.buckets))
                                                / (float(s + 1) * (t_all + p.buckets))))
                     for s, t in zip(all_counts.tolist(), target.tolist(), strict=True)], np.int64)


def scored(docs: DataFrame, gain: np.ndarray, p: Resampling) -> DataFrame:
    """Every row with n_words, n_features, weight and score, and a ``row`` number of its own."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in _texts(b):
                words = features = weight = 0
                for new, h in feature_hashes(text, p):
                    words, features = words + new, features + len(h)
                    weight += int(gain[h % p.buckets].sum())
                rows.append((words, features, weight))
            got = np.array(rows, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(got[:, i]) for i in range(3))],
                                             names=["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_words long, n_features long, weight long")
    drawn = F.sha2(F.concat(F.lit(f"{p.seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(drawn, 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / 4294967296.0)))
    return staged(out.withColumn("score", F.col("weight") + noise.cast("long"))
                  .withColumn("id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)))
                  .withColumn("row", F.monotonically_increasing_id()), "scored")


def before(key: tuple[int, ...]) -> Column:
    """Rows that come strictly before ``key``: higher score first, then smaller values."""
    out, same = F.lit(False), F.lit(True)
    for i, (name, v) in enumerate(zip(KEY, key, strict=True)):
        c = F.col(name)
        out = out | (same & ((c > v) if i == 0 else (c < v)))
        same = same & (c == v)
    return out


def _in_order(cols: list[np.ndarray]) -> np.ndarray:
    return np.lexsort((*reversed(cols[1:]), -cols[0]))


def medians(keys: DataFrame, group_rows: int) -> DataFrame:
    """One row (key, size) for every group of at most ``group_rows`` keys of a partition."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def median() -> pa.RecordBatch:
            cols = [np.concatenate(c) for c in zip(*held, strict=True)]
            m = _in_order(cols)[(n - 1) // 2]
            return pa.RecordBatch.from_arrays([*(pa.array([int(c[m])]) for c in cols), pa.array([n])],
                                              names=[*KEY, "size"])

        for b in batches:
            for at in range(0, b.num_rows, group_rows):
                part = b.slice(at, group_rows)
                if n and n + part.num_rows > group_rows:
                    yield median()
                    held, n = [], 0
                held.append([part.column(k).to_numpy(zero_copy_only=False) for k in KEY])
                n += part.num_rows
        if n:
            yield median()

    return keys.select(*KEY).mapInArrow(run, ", ".join(f"{k} long" for k in [*KEY, "size"]))


def weighted_median(rows: list[tuple[int, ...]]) -> tuple[int, ...]:
    """The first median, in key order, up to which half of all remaining keys are counted."""
    rows = sorted(rows, key=lambda r: (-r[0], *r[1:4]))
    half, seen = sum(r[4] for r in rows), 0
    for r in rows:
        seen += r[4]
        if 2 * seen >= half:
            return tuple(r[:4])
    raise ValueError("no keys remain")


def cutoff(keys: DataFrame, want: int, group_rows: int) -> tuple[int, ...]:
    """The key at place ``want`` (from 1).  Remaining keys are rewritten when a round has
    left half of what was last written, so that all rounds read a few times the keys."""
    written, size = staged(keys.select(*KEY), "keys"), None
    rest = written
    while True:
        found = [tuple(r) for r in medians(rest, group_rows).collect()]
        left = sum(r[4] for r in found)
        size = size or left
        pivot = weighted_median(found)
        ahead = rest.filter(before(pivot)).count()
        if ahead + 1 == want:
            return pivot
        if ahead >= want:
            rest, left = rest.filter(before(pivot)), ahead
        else:
            is_pivot = F.col("row") == pivot[-1]
            rest, left, want = rest.filter(~before(pivot) & ~is_pivot), left - ahead - 1, want - ahead - 1
        if 2 * left <= size:
            rest, size = staged(rest, "keys"), left


def resample(docs: DataFrame, target: DataFrame, p: Resampling = Resampling()) -> DataFrame:
    """Every document with n_words, n_features, weight, score and its ``rank`` among the
    drawn ones (from 1; null if it is not drawn).  ``percent`` of the documents with at
    least ``min_words`` words are drawn."""
    gain = gains(bucket_counts(docs, p), bucket_counts(target, p), p)
    all_rows = scored(docs, gain, p)
    fit = all_rows.filter(F.col("n_words") >= p.min_words)
    want = p.percent * fit.count() // 100
    cols = ["doc_id", "n_words", "n_features", "weight", "score"]
    if not want:
        return all_rows.select(*cols, F.lit(None).cast("long").alias("rank"))
    last = cutoff(fit, want, p.group_rows)
    won = (F.col("n_words") >= p.min_words) & (before(last) | (F.col("row") == last[-1]))
    ranked = numbered(all_rows.filter(won), [F.desc("score"), *KEY[1:]], "rank")
    return (ranked.select(*cols, (F.col("rank") + 1).alias("rank"))
            .unionByName(all_rows.filter(~won).select(*cols, F.lit(None).cast("long").alias("rank"))))
