"""Topic model (M3): online variational Bayes for LDA with the topics as a table.

The steps and defaults are those of Spark ML's online optimizer (mini-batches of 0.05 of the
documents, ``tau0`` 1024, ``kappa`` 0.51, 1 / k priors, document prior optimized).  There the
vocabulary and the k x vocabulary topics are arrays on the driver and in every task; here they
are a table, so the vocabulary may grow with the corpus.  A term's weight is its starting value,
which its hash gives anywhere, shrunk by a factor common to all, plus a common amount, plus
what documents said about it: only the last is kept, for terms of drawn documents.

Documents are packed into bags: blocks of up to ``BAG_TERMS`` terms with the list of their
distinct ones.  The documents of coming mini-batches are set apart in blocks of their own.  Lists of
terms travel as bytes, a row for each block and bucket of terms by hash; there are so many buckets
that a task looks up about ``BUCKET_TERMS`` of all blocks at once.  An iteration asks a bucket what was said about
the terms of its blocks, brings the answers to the blocks, runs the documents' variational steps
there and adds what they say about a term bucket by bucket.  Only k numbers reach the driver.

A document is drawn, and starts, by a hash of its row, a term by a hash of itself, so the
result does not depend on partitions (but for the order of sums); equal rows are drawn together.
Documents without terms count in the corpus size only and get a distribution of zeros.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import batches_by_bytes, ensure_checkpoint_dir

BAG_TERMS = 1 << 19
BUCKET_TERMS = 1 << 17
BATCH_TERMS = 1 << 16  # of a block of a mini-batch: few documents are many steps
SLICES, SLICE_TERMS = 4, 1 << 21  # a large bag is transformed in so many parts, of so many terms at least
CELLS = 1 << 17  # (term of a document, topic) pairs that a task works on at once: they fit its cache
SHAPE = 100  # of the gamma distribution of starting values, their mean is 1
U = np.uint64


def _staged(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """A query's shuffle files go when it ends, not when the driver's garbage is collected: the
    steps of a fit are read from their tables, never from an earlier shuffle."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _uniform(h: np.ndarray, i: int) -> np.ndarray:
    """The i-th number in (0, 1] of every hash."""
    x = _mix(_mix(h.view(U) + U(0x9E3779B97F4A7C15 * (i + 1) % (1 << 64))))
    return ((x >> U(11)).astype(np.float64) + 1) / (1 << 53)


def _gamma(h: np.ndarray, k: int, seed: int) -> np.ndarray:
    """k values of mean 1 from the gamma distribution of ``SHAPE`` for every hash, by
    Marsaglia and Tsang's rejection from a normal value (one in thousands is drawn again)."""
    h = _mix(np.asarray(h, np.int64).view(U) ^ U(seed % (1 << 64)))
    d, out = SHAPE - 1 / 3, np.zeros((len(h), k))
    for j in range(k):
        open_, i = np.arange(len(h)), j
        while len(open_):
            a, b, u = (_uniform(h[open_], 3 * i + x) for x in range(3))
            x = np.sqrt(-2 * np.log(a)) * np.cos(2 * np.pi * b)
            v = (1 + x / math.sqrt(9 * d)) ** 3
            good = (v > 0) & (np.log(u) < 0.5 * x * x + d - d * v + d * np.log(np.maximum(v, 1e-300)))
            out[open_[good], j] = d * v[good] / SHAPE
            open_, i = open_[~good], i + k
    return out


def digamma(x: np.ndarray) -> np.ndarray:
    y, u = x + 6, x * (x + 5)
    z = 1 / (y * y)  # the last term is the sum of 1 / (x + i) for i below 6
    return (np.log(y) - 0.5 / y - z * (1 / 12 - z * (1 / 120 - z * (1 / 252 - z / 240)))
            - (2 * x + 5) * (3 * u * u + 20 * u + 24) / (u * (u + 4) * (u + 6)))


def trigamma(x: np.ndarray) -> np.ndarray:
    y = x + 6
    z = 1 / (y * y)
    return (1 / y + z / 2 + z / y * (1 / 6 - z * (1 / 30 - z * (1 / 42 - z / 30)))
            + sum(1 / (x + i) ** 2 for i in range(6)))


def _expectation(x: np.ndarray) -> np.ndarray:
    """E[log p] of Dirichlet rows."""
    d = digamma(np.concatenate([x, x.sum(-1, keepdims=True)], -1))
    return d[..., :-1] - d[..., -1:]


def infer(beta: np.ndarray, count: np.ndarray, start: np.ndarray, alpha: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Variational steps of documents: ``beta`` (documents, topics, terms) and ``count`` (documents,
    terms), with zeros after a document's last term.  Returns gamma and the counts over the terms' norms."""
    gamma, theta = start.copy(), np.exp(_expectation(start))
    b, c, g, t = beta, count, gamma, theta.copy()
    rows, live = np.arange(len(c)), np.ones(len(c), bool)
    while len(rows):
        p = np.matmul(t[:, None, :], b)[:, 0] + 1e-100
        new = np.matmul(b, np.divide(c, p, out=p)[:, :, None])[:, :, 0] * t + alpha
        go = np.abs(new - g).mean(1) > 1e-3
        g, t = new, np.exp(_expectation(new))
        stop = live & ~go
        if stop.any():  # a document that has come to rest keeps its values
            gamma[rows[stop]], theta[rows[stop]], live = g[stop], t[stop], live & go
            if live.sum() < 0.75 * len(live):
                rows, b, c, g, t = (x[live] for x in (rows, b, c, g, t))
                live = np.ones(len(rows), bool)
    return gamma, count / (np.matmul(theta[:, None, :], beta)[:, 0] + 1e-100)


def _whole(a) -> pa.ListArray:
    """One row that holds the whole array."""
    return pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)


def _packed(*arrays: np.ndarray) -> list[pa.Array]:
    """One row of each: whole numbers from 0 on, in the bytes that the largest needs, deflated."""
    kinds = [np.min_scalar_type(a.max(initial=0)) for a in arrays]
    return [pa.array([bytes([d.itemsize]) + zlib.compress(a.astype(d).tobytes(), 1)], pa.binary())
            for a, d in zip(arrays, kinds, strict=True)]


def _unpacked(x: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(x[1:]), f"u{x[0]}").astype(np.int64)


def _parts(words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words begin and end, and their bytes."""
    off = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1].astype(np.int64)
    text = words.buffers()[2]
    return off, np.frombuffer(text, np.uint8) if text is not None else np.zeros(0, np.uint8)


def _boxed(off: np.ndarray, text: np.ndarray, lo: int, hi: int) -> bytes:
    """Words lo to hi as bytes: how wide and how many the lengths are, the lengths, the words."""
    length = np.diff(off[lo:hi + 1])
    kind = np.min_scalar_type(length.max(initial=0))
    return bytes([kind.itemsize]) + int(hi - lo).to_bytes(4, "little") + length.astype(kind).tobytes() + text[off[lo]:off[hi]].tobytes()


def _unboxed(boxes: list[bytes]) -> tuple[pa.StringArray, np.ndarray]:
    """The words of all boxes and how many each has."""
    n, length, text = [], [np.zeros(1, np.int64)], []
    for x in boxes:
        n.append(int.from_bytes(x[1:5], "little"))
        end = 5 + x[0] * n[-1]
        length.append(np.frombuffer(x[5:end], f"u{x[0]}").astype(np.int64))
        text.append(x[end:])
    off = np.cumsum(np.concatenate(length)).astype(np.int32)
    return pa.StringArray.from_buffers(len(off) - 1, pa.py_buffer(off.tobytes()), pa.py_buffer(b"".join(text))), np.array(n, np.int64)


P1, P2, P3, P4, P5 = map(U, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotated(x: np.ndarray, n: int) -> np.ndarray:
    return (x << U(n)) | (x >> U(64 - n))


def hashes(words: pa.StringArray) -> np.ndarray:
    """``xxhash64`` of every word as Spark has it, by words of equal length."""
    off, text = _parts(words)
    length = np.diff(off)
    order, out, seed = np.argsort(length, kind="stable"), np.zeros(len(length), U), np.array([42], U)
    for mine in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else ():
        n = int(length[mine[0]])
        b = text[off[mine][:, None] + np.arange(n)]
        eights = np.ascontiguousarray(b[:, :n // 8 * 8]).view("<u8")
        if n < 32:
            h, at = np.repeat(seed + P5, len(mine)), 0
        else:
            v = [np.repeat(x, len(mine)) for x in (seed + P1 + P2, seed + P2, seed, seed - P1)]
            at = n // 32 * 4
            for i in range(at):
                v[i % 4] = _rotated(v[i % 4] + eights[:, i] * P2, 31) * P1
            h = sum(_rotated(x, r) for x, r in zip(v, (1, 7, 12, 18), strict=True))
            for x in v:
                h = (h ^ (_rotated(x * P2, 31) * P1)) * P1 + P4
        h = h + U(n)
        for i in range(at, n // 8):
            h = _rotated(h ^ (_rotated(eights[:, i] * P2, 31) * P1), 27) * P1 + P4
        at = n // 8 * 8
        if n - at >= 4:
            h = _rotated(h ^ (np.ascontiguousarray(b[:, at:at + 4]).view("<u4")[:, 0].astype(U) * P1), 23) * P2 + P3
            at += 4
        for i in range(at, n):
            h = _rotated(h ^ (b[:, i].astype(U) * P5), 11) * P1
        h = (h ^ (h >> U(33))) * P2
        h = (h ^ (h >> U(29))) * P3
        out[mine] = h ^ (h >> U(32))
    return out.view(np.int64)


def _dealt(words: pa.StringArray, start: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of words by bucket, the buckets there are, and where each begins and the last ends."""
    bucket = (start.view(U) % U(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    own, first = np.unique(bucket[order], return_index=True)
    return order, own, np.append(first, len(order))


DOCS = "hash array<long>, size array<int>, at binary, count binary"


def bags(df: DataFrame, keys: list[str], tokens: str) -> DataFrame:
    """(block, keys, hash, size, at, count, n, terms): bags of words of the rows in blocks of n
    distinct terms; every term, no vocabulary on the driver."""
    batches_by_bytes(df.sparkSession)
    key = df.select(F.struct(*keys).alias("k")).schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            toks = batch.column("tokens")
            length = np.asarray(toks.value_lengths().fill_null(0), np.int64)
            end, i = np.cumsum(length), 0
            while i < len(length):
                j = max(i + 1, int(np.searchsorted(end, (end[i - 1] if i else 0) + BAG_TERMS, "right")))
                words, of = toks.slice(i, j - i).flatten(), np.repeat(np.arange(j - i), length[i:j])
                if words.null_count:
                    words, of = words.drop_null(), of[np.asarray(words.is_valid())]
                words = words.dictionary_encode()
                v = max(len(words.dictionary), 1)
                pair, count = np.unique(of * v + np.asarray(words.indices, np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part << 32 | n]), _whole(batch.column("keys").slice(i, j - i)),
                     _whole(batch.column("hash").slice(i, j - i)),
                     _whole(pa.array(np.bincount(pair // v, minlength=j - i).astype(np.int32))),
                     *_packed(pair % v, count), pa.array([len(words.dictionary)], pa.int32()),
                     pa.array([_boxed(*_parts(words.dictionary.cast(pa.string())), 0, len(words.dictionary))], pa.binary())],
                    names=["block", "keys", "hash", "size", "at", "count", "n", "terms"])
                i, n = j, n + 1

    rows = df.select(F.struct(*keys).alias("keys"), F.xxhash64(*keys, tokens).alias("hash"), F.col(tokens).alias("tokens"))
    return _staged(rows.mapInArrow(run, f"block long, keys array<{key}>, {DOCS}, n int, terms binary"), "bags")


def _docs(rows: pa.RecordBatch | pa.Table, i: int = 0) -> tuple[np.ndarray, ...]:
    """``DOCS`` of a block as arrays."""
    return (*(np.asarray(rows[c][i].values) for c in ("hash", "size")), *(_unpacked(rows[c][i].as_py()) for c in ("at", "count")))


def _drawn(bag: DataFrame, iterations: range, share: float, seed: int) -> DataFrame:
    """(iteration, block, DOCS, terms): the mini-batches in blocks of their own, documents drawn by
    their hash; staged by iteration."""
    def block(kept: list, part: int, n: int, iteration: int) -> pa.RecordBatch:
        words = pa.concat_arrays([x[4] for x in kept]).dictionary_encode()
        shift = np.cumsum([0, *(len(x[4]) for x in kept)])
        at = np.asarray(words.indices, np.int64)[np.concatenate([x[2] + s for x, s in zip(kept, shift, strict=False)])]
        h, size, count = (np.concatenate([x[c] for x in kept]) for c in (0, 1, 3))
        return pa.RecordBatch.from_arrays(
            [pa.array([iteration], pa.int32()), pa.array([part << 32 | n]), _whole(h), _whole(size),
             *_packed(at, count), pa.array([_boxed(*_parts(words.dictionary), 0, len(words.dictionary))], pa.binary())],
            names=["iteration", "block", "hash", "size", "at", "count", "terms"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, part, kept = 0, TaskContext.get().partitionId(), {i: [] for i in iterations}
        for batch in batches:
            for r in range(batch.num_rows):
                (h, size, at, count), words = _docs(batch, r), None
                chance = _mix(h.view(U) + U(seed % (1 << 64)))
                for i, mine in kept.items():
                    take = (_uniform(chance, i) <= share) & (size > 0)
                    if take.any():
                        pairs = np.repeat(take, size)
                        used, place = np.unique(at[pairs], return_inverse=True)
                        words = words or _unboxed([batch["terms"][r].as_py()])[0]
                        mine.append((h[take], size[take], place, count[pairs], words.take(pa.array(used))))
                        if sum(len(x[2]) for x in mine) >= BATCH_TERMS:
                            yield block(mine, part, n, i)
                            n, kept[i] = n + 1, []
        for i, mine in kept.items():
            if mine:
                yield block(mine, part, n, i)
                n += 1

    return _staged(bag.select("hash", "size", "at", "count", "terms").mapInArrow(
        run, f"iteration int, block long, {DOCS}, terms binary"), "drawn", ("iteration",))


def _asked(bag: DataFrame, buckets: int) -> DataFrame:
    """(bucket, block, words): the terms of every block by bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                words, _ = _unboxed([batch["terms"][r].as_py()])
                order, own, edge = _dealt(words, hashes(words), buckets)
                off, text = _parts(words.take(pa.array(order)))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own.astype(np.int32)), pa.array([batch["block"][r].as_py()] * len(own), pa.int64()),
                     pa.array([_boxed(off, text, i, j) for i, j in zip(edge, edge[1:], strict=False)], pa.binary())],
                    names=["bucket", "block", "words"])

    return bag.select("block", "terms").mapInArrow(run, "bucket int, block long, words binary")


def _nothing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "bucket int, words binary, stat binary, scale double")


def _added(rows: pa.Table, k: int) -> tuple[pa.StringArray, np.ndarray]:
    """The distinct words of rows (words, stat, scale) and the sums over them; no stat: zeros."""
    boxes, stats, scale = ([x.as_py() for x in rows[c]] for c in ("words", "stat", "scale"))
    words, n = _unboxed(boxes)
    words = words.dictionary_encode()
    stats = [np.frombuffer(x).reshape(-1, k) * f if x else np.zeros((m, k)) for x, f, m in zip(stats, scale, n, strict=True)]
    stat, at = np.concatenate([np.zeros((0, k)), *stats]), np.asarray(words.indices, np.int64)
    return words.dictionary, np.stack([np.bincount(at, stat[:, t], len(words.dictionary)) for t in range(k)], 1)


def _with_said(bag: DataFrame, said: DataFrame, buckets: int, k: int, run: Callable, schema: str) -> DataFrame:
    """``run`` over the blocks of ``bag``, each with a table (bucket, hit, said) of its terms in the
    buckets: which of them ``said`` has, and the sums of those."""
    def answer(asked: pa.Table, said: pa.Table) -> pa.Table:
        owner, bucket, hit, out = [], [], [], []
        if asked.num_rows and said.num_rows:
            vocabulary, sums = _added(said, k)
            words, n = _unboxed([x.as_py() for x in asked["words"]])
            place = np.asarray(pc.fill_null(pc.index_in(words, value_set=vocabulary), -1), np.int64)
            edge = np.cumsum([0, *n])
            for r, (i, j) in enumerate(zip(edge, edge[1:], strict=False)):
                mine = place[i:j]
                if (mine >= 0).any():
                    owner.append(asked["block"][r].as_py())
                    bucket.append(asked["bucket"][r].as_py())
                    hit.append(np.packbits(mine >= 0).tobytes())
                    out.append(sums[mine[mine >= 0]].tobytes())
        return pa.table([pa.array(owner, pa.int64()), pa.array(bucket, pa.int32()), pa.array(hit, pa.binary()), pa.array(out, pa.binary())],
                        names=["owner", "bucket", "hit", "said"])

    found = _asked(bag, buckets).groupBy("bucket").cogroup(said.groupBy("bucket")).applyInArrow(
        answer, "owner long, bucket int, hit binary, said binary")
    # as many partitions as given: adaptive execution would join them by their few bytes
    parts = int(bag.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return bag.repartition(parts, "block").groupBy("block").cogroup(
        found.repartition(parts, "owner").groupBy("owner")).applyInArrow(run, schema)


def _found(words: pa.StringArray, start: np.ndarray, found: pa.Table, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``words`` that were found, and what was said of them (flat)."""
    order, own, edge = _dealt(words, start, buckets)
    place, said = [np.zeros(0, np.int64)], [np.zeros(0)]
    for r in range(found.num_rows):
        b = np.searchsorted(own, found["bucket"][r].as_py())
        mine = order[edge[b]:edge[b + 1]]
        hit = np.unpackbits(np.frombuffer(found["hit"][r].as_py(), np.uint8), count=len(mine)).astype(bool)
        place.append(mine[hit])
        said.append(np.frombuffer(found["said"][r].as_py()))
    return np.concatenate(place), np.concatenate(said)


def _steps(hashes, size, at, count, beta, alpha, seed) -> Iterator[tuple]:
    """``infer`` over a block, so many documents of like size at once that their terms fit ``CELLS``.
    Gives documents, their gamma, the places of their terms in the block and the counts over norms."""
    first, order, k, i = np.cumsum(size) - size, np.argsort(-size, kind="stable"), len(alpha), 0
    while i < len(order):
        docs = order[i:i + max(1, int(CELLS // (k * size[order[i]])))]
        n = size[docs].astype(np.int64)
        of = np.repeat(np.arange(len(docs)), n)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        pairs = first[docs][of] + nth
        b, c = np.zeros((len(docs), k, n[0])), np.zeros((len(docs), n[0]))
        b[of, :, nth], c[of, nth] = beta[at[pairs]], count[pairs]
        gamma, ratio = infer(b, c, _gamma(hashes[docs], k, seed), alpha)
        yield docs, gamma, pairs, ratio[of, nth]
        i += len(docs)


@dataclass(frozen=True)
class Weights:
    """A term's weights by topic: ``shrunk`` times its starting value, ``same``, and what was said."""
    totals: np.ndarray
    shrunk: float
    same: float
    seed: int

    def of(self, start: np.ndarray, place: np.ndarray, said: np.ndarray) -> np.ndarray:
        w = self.shrunk * _gamma(start, len(self.totals), ~self.seed) + self.same
        w[place] += said.reshape(-1, len(self.totals))
        return w

    def beta(self, start: np.ndarray, place: np.ndarray, said: np.ndarray) -> np.ndarray:
        """exp E[log beta] of the terms of a block."""
        return np.exp(digamma(self.of(start, place, said)) - digamma(self.totals))


@dataclass(frozen=True)
class TopicModel:
    """``bag`` it was fitted on; ``said`` (bucket, words, stat, scale): sums over terms, to be
    multiplied, for each iteration and bucket; the common part of the weights and the prior
    ``alpha`` of the documents by topic."""
    bag: DataFrame
    said: DataFrame
    buckets: int
    weights: Weights
    alpha: np.ndarray

    def _known(self) -> DataFrame:
        """``said`` with all terms."""
        every = _asked(self.bag, self.buckets).select("bucket", "words", F.lit(None).cast("binary").alias("stat"), F.lit(1.0).alias("scale"))
        return self.said.unionByName(every)

    def terms(self) -> DataFrame:
        """(term, weight array<double>) of the whole vocabulary."""
        weights, k = self.weights, len(self.alpha)

        def run(rows: pa.Table) -> pa.Table:
            words, sums = _added(rows, k)
            w = weights.of(hashes(words), np.arange(len(words)), sums)
            return pa.table([words, pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * k, pa.int32()), w.ravel())],
                            names=["term", "weight"])

        return self._known().groupBy("bucket").applyInArrow(run, "term string, weight array<double>")

    def transform(self, bag: DataFrame) -> DataFrame:
        """The keys of every document and its ``topicDistribution``; terms unknown to the model
        do not count."""
        weights, alpha, buckets, k = self.weights, self.alpha, self.buckets, len(self.alpha)
        key, same = bag.schema["keys"].dataType.elementType, bag is self.bag

        def run(rows: pa.Table, found: pa.Table) -> pa.Table:
            h, size, at, count = _docs(rows)
            words, _ = _unboxed([rows["terms"][0].as_py()])
            start = hashes(words)
            place, said = _found(words, start, found, buckets)
            beta, known = weights.beta(start, place, said), np.full(len(start), same)
            known[place] = True
            mine = known[at]
            of = np.repeat(np.arange(len(size)), size)[mine]
            size, at, count = np.bincount(of, minlength=len(h)), at[mine], count[mine]
            full, out = np.flatnonzero(size), np.zeros((len(h), k))
            for docs, gamma, _, _ in _steps(h[full], size[full], at, count, beta, alpha, weights.seed):
                out[full[docs]] = gamma / gamma.sum(1, keepdims=True)
            return pa.Table.from_arrays(
                [*rows["keys"][0].values.flatten(), pa.ListArray.from_arrays(pa.array(np.arange(len(h) + 1) * k, pa.int32()), out.ravel())],
                names=[*key.names, "topicDistribution"])

        types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in key.fields)
        said, schema = self.said if same else self._known(), f"{types}, topicDistribution array<double>"
        parts = min(SLICES, -(-(bag.agg(F.sum("n")).first()[0] or 0) // SLICE_TERMS))
        if parts <= 1:
            return _with_said(bag, said, buckets, k, run, schema)
        # one after another, so that what is shuffled for a part is gone when the next begins
        with _shuffles_dropped(bag.sparkSession):
            done = [_staged(_with_said(bag.filter(F.pmod(F.xxhash64("block"), F.lit(parts)) == i), said, buckets, k, run, schema), "topics")
                    for i in range(parts)]
        return reduce(DataFrame.unionByName, done)


def _next_alpha(alpha: np.ndarray, logphat: np.ndarray, n: float, rho: float) -> np.ndarray:
    """A weighted Newton step of the documents' prior (Huang: maximum likelihood of Dirichlet)."""
    grad = n * (logphat - _expectation(alpha))
    c, q = n * trigamma(alpha.sum()), -n * trigamma(alpha)
    step = -(grad - (grad / q).sum() / (1 / c + (1 / q).sum())) / q
    return alpha + rho * step if (alpha + rho * step > 0).all() else alpha


def fit(bag: DataFrame, k: int, max_iter: int, seed: int = 1, share: float = 0.05, tau0: float = 1024.0,
        kappa: float = 0.51) -> TopicModel:
    """Online LDA over bags (see ``bags``)."""
    with _shuffles_dropped(bag.sparkSession):
        return _fit(bag, k, max_iter, seed, share, tau0, kappa)


def _learner(weights: Weights, alpha: np.ndarray, buckets: int, seed: int) -> Callable:
    k = len(alpha)

    def learn(rows: pa.Table, found: pa.Table) -> pa.Table:
        h, size, at, count = _docs(rows)
        words, _ = _unboxed([rows["terms"][0].as_py()])
        start = hashes(words)
        beta, logp = weights.beta(start, *_found(words, start, found, buckets)), np.zeros((len(h), k))
        stat, norms = np.zeros((len(start), k)), np.zeros(len(at))
        for own, gamma, pairs, ratio in _steps(h, size, at, count, beta, alpha, seed):
            logp[own], norms[pairs] = _expectation(gamma), ratio
        for t in range(k):
            stat[:, t] = np.bincount(at, np.repeat(np.exp(logp[:, t]), size) * norms, len(start))
        order, own, edge = _dealt(words, start, buckets)
        off, text = _parts(words.take(pa.array(order)))
        stat, cuts = (stat * beta)[order], [*zip(edge, edge[1:], strict=False)]
        # last a row of no bucket: sums over the documents and their number
        return pa.table(
            [pa.array([*own, -1], pa.int32()), pa.array([*(_boxed(off, text, i, j) for i, j in cuts), None], pa.binary()),
             pa.array([*(stat[i:j].tobytes() for i, j in cuts), None], pa.binary()), pa.array(np.ones(len(own) + 1)),
             pa.array([None] * len(own) + [[*logp.sum(0), float(len(size))]], pa.list_(pa.float64()))],
            names=["bucket", "words", "stat", "scale", "total"])

    return learn


SAID = "bucket int, words binary, stat binary, scale double, total array<double>"


def _adder(k: int) -> Callable:
    def add(rows: pa.Table) -> pa.Table:
        bucket = rows["bucket"][0].as_py()
        if bucket < 0:
            words, stat, total = None, None, np.sum([x.as_py() for x in rows["total"]], 0)
        else:
            terms, sums = _added(rows, k)
            words, stat, total = _boxed(*_parts(terms), 0, len(terms)), sums.tobytes(), sums.sum(0)
        return pa.table([pa.array([bucket], pa.int32()), pa.array([words], pa.binary()), pa.array([stat], pa.binary()),
                         pa.array([1.0]), pa.array([[*total]], pa.list_(pa.float64()))],
                        names=["bucket", "words", "stat", "scale", "total"])

    return add


def fit(bag: DataFrame, k: int, max_iter: int, seed: int = 1, share: float = 0.05, tau0: float = 1024.0,
        kappa: float = 0.51) -> TopicModel:
    """Online LDA over bags (see ``bags``)."""
    with _shuffles_dropped(bag.sparkSession):
        return _fit(bag, k, max_iter, seed, share, tau0, kappa)


def _fit(bag: DataFrame, k: int, max_iter: int, seed: int, share: float, tau0: float, kappa: float) -> TopicModel:
    def begin(rows: pa.Table) -> pa.Table:
        words = pc.unique(_unboxed([x.as_py() for x in rows["words"]])[0])
        return pa.table([pa.array([len(words)]), pa.array([[*_gamma(hashes(words), k, ~seed).sum(0)]])], names=["n", "w"])

    spark = bag.sparkSession
    docs, listed = (x or 0 for x in bag.agg(F.sum(F.size("size")), F.sum("n")).first())
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-listed // BUCKET_TERMS))
    sums = _asked(bag, buckets).groupBy("bucket").applyInArrow(begin, "n long, w array<double>")
    n_terms, *first = (x or 0 for x in sums.agg(F.sum("n"), *[F.sum(F.col("w")[i]) for i in range(k)]).first())
    said, alpha, eta = [], np.full(k, 1.0 / k), 1.0 / k  # said: tables and factors of them
    weights = Weights(np.array(first, float), 1.0, 0.0, seed)

    def all_said() -> DataFrame:
        out = _nothing(spark)
        for df, scale in said:
            out = out.unionByName(df.select("bucket", "words", "stat", F.lit(float(scale)).alias("scale")))
        return out

    ahead = max(1, int(1 / share))  # iterations whose documents are set apart at once: as many as there are, on the average
    for iteration in range(1, max_iter + 1):
        if (iteration - 1) % ahead == 0:
            drawn = _drawn(bag, range(iteration, min(iteration + ahead, max_iter + 1)), share, seed)
        batch = drawn.filter(F.col("iteration") == iteration).drop("iteration")
        learned = _with_said(batch, all_said(), buckets, k, _learner(weights, alpha, buckets, seed + iteration), SAID)
        found = _staged(learned.groupBy("bucket").applyInArrow(_adder(k), SAID), "stats")
        heard = found.filter(F.col("bucket") < 0).select("total").first()
        if heard is None:  # nothing drawn
            continue
        rho, n = (tau0 + iteration) ** -kappa, heard[0][k]
        scale, new = rho * docs / math.ceil(share * docs), found.filter(F.col("bucket") >= 0)
        heard_sum = scale * np.array(new.agg(*[F.sum(F.col("total")[i]) for i in range(k)]).first(), float)
        said = [(df, x * (1 - rho)) for df, x in said] + [(new, scale)]
        shrunk, same = weights.shrunk * (1 - rho), weights.same * (1 - rho) + rho * eta
        weights = Weights(weights.totals * (1 - rho) + rho * eta * n_terms + heard_sum, shrunk, same, seed)
        alpha = _next_alpha(alpha, np.array(heard[0][:k]) / n, n, rho)
    return TopicModel(bag, all_said(), buckets, weights, alpha)
