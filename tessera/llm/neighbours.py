"""Approximate nearest neighbours by stable projections and a kd-tree.

Unit vectors are projected to ``dims`` dimensions by a Gaussian (2-stable) matrix: the
squared projected distance of two points is their squared distance times a chi-square
variable of ``dims`` degrees of freedom.  A query takes projected neighbours in growing
order and verifies each by its cosine.  It stops when the next projected distance is so
large that a point nearer than the worst of the neighbours found would come this late with
a chance of at most 1 - ``confidence``.

The kd-tree has two parts.  Its upper part is fitted on a bounded sample (``sample_rows``
points with the smallest hashes) and cuts the space into at most ``cells`` cells; every
point is indexed, in its cell.  A cell is held in chunks of about ``chunk_rows`` points; a
task that meets a chunk builds the lower part over it, with leaves of ``leaf_rows``.  Queries first
search the cell they lie in, which bounds the distance of their neighbours, and then only
the cells whose box the stopping test does not exclude.  Queries come in blocks, so a task
holds one chunk and one block.

Equal vectors are one point with their smallest ids, as many as an answer can use, so that
copies of a vector, however many, neither crowd a cell nor repeat a search.

Edge cases: vectors that are null, empty or zero or hold null or non-finite components take
no part, nor do null ids; vectors are compared with vectors of their length; repeated rows
of one id and vector count once, and a query never finds its own id; equal scores go by
smaller id; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.tables import staged

SAME = 1e-12  # squared distances below are rounding; points of equal direction are all verified


@dataclass(frozen=True)
class Search:
    k: int = 5
    every: int = 50
    dims: int = 12
    confidence: float = 0.97
    cells: int = 1024
    sample_rows: int = 16_384
    chunk_rows: int = 8192
    query_rows: int = 2048
    leaf_rows: int = 64
    verify_rows: int = 128
    seed: int = 13


def chi_square(x: float, dims: int) -> float:
    """Distribution function of chi-square; ``dims`` is even."""
    term, total = 1.0, 1.0
    for i in range(1, dims // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def stop_ratio(p: Search) -> float:
    """The squared projected distance, in squared distances of the worst neighbour found,
    from which on the search may stop."""
    lo, hi = 0.0, 1.0
    while chi_square(hi, p.dims) < p.confidence:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi_square(mid, p.dims) < p.confidence else (lo, mid)
    return hi


def projection(width: int, p: Search) -> np.ndarray:
    return np.random.default_rng([p.seed, width]).standard_normal((width, p.dims))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(-1, width)


def scaled(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors times a power of two, which rounds nothing and keeps squares finite; norms."""
    v = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])
    return v, np.sqrt(np.einsum("ij,ij->i", v, v))


def projected(column: pa.Array, width: int, p: Search) -> np.ndarray:
    v, norm = scaled(matrix(column, width))
    return (v / norm[:, None]) @ projection(width, p)


def by_width(b: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, int]]:
    widths = b.column("width").to_numpy()
    for w in np.unique(widths):
        yield b.take(pa.array(np.flatnonzero(widths == w))), int(w)


# -- the upper tree: nodes in heap order, axis < 0 at a cell ---------------------------------

@dataclass(frozen=True)
class Upper:
    axis: np.ndarray
    at: np.ndarray

    def cell(self, points: np.ndarray) -> np.ndarray:
        node = np.zeros(len(points), np.int64)
        for _ in range(len(self.axis).bit_length()):
            axis = self.axis[node]
            inner = axis >= 0
            if not inner.any():
                break
            value = points[np.arange(len(points)), np.maximum(axis, 0)]
            node = np.where(inner, 2 * node + 1 + (value > self.at[node]), node)
        return node


def fit_upper(sample: np.ndarray, cells: int) -> Upper:
    """Median cuts of the widest axis, ``cells`` cells of equal shares of the sample."""
    depth = max(cells - 1, 0).bit_length()
    axis, at = np.full((2 << depth) - 1, -1, np.int64), np.zeros((2 << depth) - 1)
    todo = [(0, sample, 0)]
    while todo:
        node, pts, d = todo.pop()
        if d == depth or len(pts) < 2:
            continue
        a = int(np.argmax(np.ptp(pts, axis=0)))
        cut = float(np.median(pts[:, a]))
        right = pts[:, a] > cut
        if not right.any():
            continue
        axis[node], at[node] = a, cut
        todo += [(2 * node + 1, pts[~right], d + 1), (2 * node + 2, pts[right], d + 1)]
    return Upper(axis, at)


# -- the lower tree: points in leaf order with the boxes of the leaves -----------------------

class Lower:
    """kd-tree over one chunk: every cut is at the middle point of the widest axis, so that
    leaves are of equal size even where coordinates are equal."""

    def __init__(self, points: np.ndarray, leaf_rows: int) -> None:
        self.order = np.arange(len(points))
        todo, starts = [(0, len(points))], []
        while todo:
            lo, hi = todo.pop()
            if hi - lo <= leaf_rows:
                starts.append((lo, hi))
                continue
            own = self.order[lo:hi]
            axis = int(np.argmax(np.ptp(points[own], axis=0)))
            mid = (hi - lo) // 2
            self.order[lo:hi] = own[np.argpartition(points[own, axis], mid)]
            todo += [(lo, lo + mid), (lo + mid, hi)]
        self.leaves = np.array(sorted(starts))
        self.points = points[self.order]
        first = self.leaves[:, 0]
        self.low = np.minimum.reduceat(self.points, first, axis=0)
        self.high = np.maximum.reduceat(self.points, first, axis=0)

    def nearer(self, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of points and their squared projected distances, in growing order: points
        of opened leaves wait until no closed leaf can hold a nearer one."""
        gap = box_gap(q, self.low, self.high)
        rank = np.argsort(gap, kind="stable")
        held_at, held = np.zeros(0, np.int64), np.zeros(0)
        n, step = 0, 4
        while n < len(rank) or len(held):
            fresh = rank[n:n + step]
            n, step = n + len(fresh), min(2 * step, 64)
            if len(fresh):
                at = np.concatenate([np.arange(*self.leaves[j]) for j in fresh])
                diff = self.points[at] - q
                held_at = np.concatenate([held_at, at])
                held = np.concatenate([held, np.einsum("ij,ij->i", diff, diff)])
            sure = held <= (gap[rank[n]] if n < len(rank) else np.inf)
            go = np.flatnonzero(sure)
            go = go[np.argsort(held[go], kind="stable")]
            yield self.order[held_at[go]], held[go]
            held_at, held = held_at[~sure], held[~sure]


class Chunk:
    """The points of one chunk: vectors, norms, ids and the kd-tree of their projections."""

    def __init__(self, vecs: pa.Array, ids: list[list[int]], width: int, p: Search) -> None:
        self.vectors, self.norms = scaled(matrix(vecs, width))
        self.ids = ids
        self.first = np.array([x[0] for x in ids])
        self.copies = np.array([len(x) for x in ids])
        self.tree = Lower((self.vectors / self.norms[:, None]) @ projection(width, p), p.leaf_rows)


def box_gap(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    gap = np.maximum(np.maximum(low - q, q - high), 0.0)
    return np.einsum("ij,ij->i", gap, gap)


def search_chunk(chunk: Chunk, query: np.ndarray, norm: float, proj: np.ndarray, bound: float, ratio: float,
                 p: Search) -> tuple[np.ndarray, np.ndarray]:
    """Places and cosines of the verified points that may hold one of the k + 1 best ids.

    ``bound`` is the squared distance of the worst neighbour known from elsewhere."""
    got_at, got = np.zeros(0, np.int64), np.zeros(0)
    for at, far in chunk.tree.nearer(proj):
        for i in range(0, len(at), p.verify_rows):
            if far[i] > ratio * bound + SAME:
                return got_at, got
            new = at[i:i + p.verify_rows]
            cosine = np.einsum("ij,j->i", chunk.vectors[new], query) / (chunk.norms[new] * norm)
            got_at, got = np.concatenate([got_at, new]), np.concatenate([got, cosine])
            best = np.lexsort((chunk.first[got_at], -got))[:p.k + 1]
            got_at, got = got_at[best], got[best]
            enough = int(np.searchsorted(np.cumsum(chunk.copies[got_at]), p.k + 1))
            if enough < len(got):
                bound = min(bound, max(2 - 2 * float(got[enough]), 0.0))
    return got_at, got


# -- tables ----------------------------------------------------------------------------------

def points(vectors: DataFrame, column: str, p: Search) -> DataFrame:
    """Distinct vectors: (point, width, vec, ids, h)."""
    v = F.col(column)
    fit = (v.isNotNull() & F.col("vec_id").isNotNull() & F.exists(v, lambda x: x != 0)
           & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    rows = vectors.filter(F.coalesce(fit, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"), v.alias("vec"))
    # the smallest k + 1 ids suffice; the limit of the rank is applied before the shuffle too
    first = (rows.distinct().withColumn("rank", F.row_number().over(Window.partitionBy("vec").orderBy("vec_id")))
             .filter(F.col("rank") <= p.k + 1)
             .groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")))
    return staged(first.select(F.monotonically_increasing_id().alias("point"), F.size("vec").alias("width"), "vec",
                               "ids", F.xxhash64("vec").alias("h")), "points")


def queries_of(vectors: DataFrame, column: str, pts: DataFrame, p: Search) -> DataFrame:
    """(query_id, point): every stated query with its point."""
    asked = vectors.filter(F.pmod(F.col("vec_id"), F.lit(p.every)) == 0).select(
        F.col("vec_id").cast("long").alias("query_id"), F.col(column).alias("vec")).distinct()
    return staged(asked.join(pts.select("vec", "point"), "vec").select("query_id", "point"), "queries")


def upper_trees(pts: DataFrame, p: Search) -> dict[int, Upper]:
    """One upper tree per vector length, from the points with the smallest hashes."""
    n = {r.width: r.n for r in pts.groupBy("width").agg(F.count("*").alias("n")).collect()}
    out = {}
    for w, rows in n.items():
        picked = (pts.filter(F.col("width") == w).orderBy("h", "point").limit(p.sample_rows)
                  .mapInArrow(lambda bs, w=w: _projected(bs, w, p), "proj array<double>").collect())
        sample = np.array([r.proj for r in picked]).reshape(-1, p.dims)
        out[w] = fit_upper(sample, min(p.cells, -(-rows // p.chunk_rows)))
    return out


def _lists(a: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(np.arange(0, a.size + 1, a.shape[1] or 1, dtype=np.int32), pa.array(a.ravel()))


def _projected(batches: Iterator[pa.RecordBatch], width: int, p: Search) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([_lists(projected(b.column("vec"), width, p))], names=["proj"])


def placed(pts: DataFrame, trees: dict[int, Upper], p: Search) -> DataFrame:
    """Points with their cell, and the chunk of the cell by hash: cells of many points are
    split, so that a chunk stays near ``chunk_rows`` wherever the points lie."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, w in by_width(batch):
                proj = projected(b.column("vec"), w, p)
                yield pa.RecordBatch.from_arrays([b.column("point"), pa.array(trees[w].cell(proj)), _lists(proj)],
                                                 names=["point", "cell", "proj"])

    at = staged(pts.select("point", "width", "vec").mapInArrow(run, "point long, cell long, proj array<double>"), "cells")
    full = pts.join(at, "point")
    sizes = full.groupBy("width", "cell").agg(F.ceil(F.count("*") / p.chunk_rows).cast("long").alias("chunks"))
    return staged(full.join(sizes, ["width", "cell"])
                  .withColumn("chunk", F.pmod(F.xxhash64("point"), F.col("chunks")).cast("long")).drop("h"),
                  "placed")


def search(visits: DataFrame, index: DataFrame, p: Search) -> DataFrame:
    """``visits`` (query, qvec, bound, width, cell) to (query, vec_ids, score).

    A chunk meets the queries of its cell in blocks of about ``query_rows``."""
    ratio, of = stop_ratio(p), ["width", "cell"]
    load = visits.groupBy(*of).agg(F.ceil(F.count("*") / p.query_rows).cast("long").alias("blocks"))
    load = staged(load.join(index.select(*of, "chunks").distinct(), of), "load")
    to = F.lit(0).cast("long")
    asked = (visits.join(load, of).withColumn("block", F.pmod(F.xxhash64("query"), F.col("blocks")))
             .withColumn("chunk", F.explode(F.sequence(to, F.col("chunks") - 1))))
    held = (index.drop("chunks").join(load.drop("chunks"), of)
            .withColumn("block", F.explode(F.sequence(to, F.col("blocks") - 1))))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _found([], [], [])
        w = left.column("width")[0].as_py()
        chunk = Chunk(right.column("vec").combine_chunks(), right.column("ids").to_pylist(), w, p)
        qs, norms = scaled(matrix(left.column("qvec").combine_chunks(), w))
        projs = (qs / norms[:, None]) @ projection(w, p)
        bounds = left.column("bound").to_pylist()
        out: tuple[list, list, list] = ([], [], [])
        for i, name in enumerate(left.column("query").to_pylist()):
            limit = math.inf if bounds[i] is None else bounds[i]
            at, score = search_chunk(chunk, qs[i], norms[i], projs[i], limit, ratio, p)
            out[0].extend([name] * len(at))
            out[1].extend(chunk.ids[j] for j in at)
            out[2].extend(score.tolist())
        return _found(*out)

    on = ["width", "cell", "chunk", "block"]
    return (asked.select(*on, "query", "qvec", "bound").groupBy(*on)
            .cogroup(held.select(*on, "vec", "ids").groupBy(*on))
            .applyInArrow(run, "query long, vec_ids array<long>, score double"))


def _found(query: list, ids: list, score: list) -> pa.Table:
    return pa.table([pa.array(query, pa.int64()), pa.array(ids, pa.list_(pa.int64())), pa.array(score, pa.float64())],
                    names=["query", "vec_ids", "score"])


def best(found: DataFrame, p: Search) -> DataFrame:
    """The k + 1 best ids of every query point: (query, vec_id, score)."""
    ids = found.select("query", "score", F.explode("vec_ids").alias("vec_id"))
    by = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return ids.withColumn("place", F.row_number().over(by)).filter(F.col("place") <= p.k + 1)


def visits_after(home: DataFrame, asked: DataFrame, boxes: list, p: Search) -> DataFrame:
    """The cells, apart from a query's own, whose boxes the stopping test leaves.  ``boxes``
    has a row for each cell, of which there are at most ``cells`` for a vector length."""
    ratio = stop_ratio(p)
    arrays = {}
    for w in {b.width for b in boxes}:
        own = [b for b in boxes if b.width == w]
        arrays[w] = (np.array([b.cell for b in own]), np.array([b.low for b in own]), np.array([b.high for b in own]))
    bound = (home.groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("worst"))
             .filter(F.col("n") > p.k).select("query", F.greatest(2 - 2 * F.col("worst"), F.lit(0.0)).alias("bound")))
    known = asked.join(bound, "query", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take, cells = [], []
            for i, (w, cell, proj, limit) in enumerate(zip(*(b.column(c).to_pylist() for c in (
                    "width", "cell", "proj", "bound")), strict=True)):
                of, low, high = arrays[w]
                go = of != cell
                if limit is not None:
                    go &= box_gap(np.array(proj), low, high) <= ratio * limit + SAME
                take.append(np.full(int(go.sum()), i))
                cells.append(of[go])
            if take:
                rows = b.take(pa.array(np.concatenate(take)))
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(c) for c in ("query", "qvec", "bound", "width")), pa.array(np.concatenate(cells))],
                    names=["query", "qvec", "bound", "width", "cell"])

    kind = asked.schema["qvec"].dataType.simpleString()
    return known.select("query", "qvec", "width", "cell", "proj", "bound").mapInArrow(
        run, f"query long, qvec {kind}, bound double, width int, cell long")


def nearest(vectors: DataFrame, column: str = "embedding", p: Search = Search()) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every query, the rows whose
    id ``every`` divides; score is the cosine in double precision."""
    pts = points(vectors, column, p)
    stated = queries_of(vectors, column, pts, p)
    index = placed(pts, upper_trees(pts, p), p)
    asked = staged(index.join(stated.select("point").distinct(), "point").select(
        F.col("point").alias("query"), F.col("vec").alias("qvec"), "width", "cell", "proj"), "asked")
    axes = range(p.dims)
    boxes = index.groupBy("width", "cell").agg(
        F.array(*[F.min(F.col("proj")[i]) for i in axes]).alias("low"),
        F.array(*[F.max(F.col("proj")[i]) for i in axes]).alias("high")).collect()
    own = asked.withColumn("bound", F.lit(None).cast("double"))
    home = staged(best(search(own, index, p), p), "home")
    rest = staged(visits_after(home, asked, boxes, p), "visits")
    ids = home.select("query", F.array("vec_id").alias("vec_ids"), "score").unionByName(search(rest, index, p))
    top = best(ids, p).join(stated.withColumnRenamed("point", "query"), "query").filter(
        F.col("vec_id") != F.col("query_id"))
    by = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return (top.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= p.k)
            .select("query_id", "rank", "vec_id", "score"))
