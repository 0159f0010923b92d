"""Block matrices of many graphs: products, sums and matrix polynomials.

A matrix is a table (graph_id, bi, bj, x): block row, block column and the
``block`` x ``block`` doubles of that block as binary; blocks of zeros need no row.  Spark
joins blocks on the inner index, multiplies them batch by batch and adds the partial
products by their target block.  A task holds one record batch of blocks, bounded by
bytes, and one unfinished sum: never a whole graph, so neither the number of nodes nor
one large graph among many small ones is limited by the memory of a task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.spectral import cheby_coeff
from tessera.session import batches_by_bytes, materialize

G = "graph_id"


def _doubles(col: pa.Array, width: int) -> np.ndarray:
    """Equal-sized binary values as rows of doubles, without a copy."""
    if len(col) == 0:
        return np.zeros((0, width))
    data = np.frombuffer(col.buffers()[2], dtype="<f8")
    offset = "<i8" if pa.types.is_large_binary(col.type) else "<i4"
    start = np.frombuffer(col.buffers()[1], dtype=offset)[col.offset] // 8
    return data[start:start + len(col) * width].reshape(len(col), width)


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows, dtype="<f8")
    offsets = np.arange(len(rows) + 1, dtype="<i4") * (rows.shape[1] * 8)
    return pa.Array.from_buffers(pa.binary(), len(rows),
                                 [None, pa.py_buffer(offsets), pa.py_buffer(rows)])


def _schema(df: DataFrame, keys: list[str], extra: str) -> str:
    return ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys) + f", {extra}"


def _starts(batch: pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Row numbers at which a new key begins, in a batch sorted by its keys."""
    new = np.zeros(batch.num_rows, dtype=bool)
    new[0] = True
    for k in keys:
        c = batch.column(k)
        new[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
    return np.flatnonzero(new)


def _pieces(batches: Iterator[pa.RecordBatch], keys: list[str],
            runs: int = 256) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches cut so that none has over ``runs`` runs of equal keys, with the runs' starts."""
    for b in batches:
        if b.num_rows == 0:
            continue
        starts = _starts(b, keys)
        for at in range(0, len(starts), runs):
            part = starts[at:at + runs]
            end = starts[at + runs] if at + runs < len(starts) else b.num_rows
            yield b.slice(part[0], end - part[0]), part - part[0]


def _sums(df: DataFrame, keys: list[str],
          read: Callable[[pa.RecordBatch, np.ndarray], np.ndarray]) -> DataFrame:
    """Rows of equal keys added up to one (keys, x).  ``read(batch, starts)`` gives the sums
    of a batch's runs; the last run waits for the next batch."""
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, open_sum = None, None
        for b, starts in _pieces(batches, keys):
            sums = read(b, starts)
            heads = b.select(keys).take(pa.array(starts))
            first = heads.slice(0, 1)
            if open_key is not None:
                if open_key.equals(first):
                    sums[0] += open_sum
                else:
                    yield pa.RecordBatch.from_arrays(
                        [*open_key.columns, _binary(open_sum[None, :])], [*keys, "x"])
            if len(starts) > 1:
                done = heads.slice(0, len(starts) - 1)
                yield pa.RecordBatch.from_arrays([*done.columns, _binary(sums[:-1])], [*keys, "x"])
            open_key, open_sum = heads.slice(len(starts) - 1, 1), sums[-1].copy()
        if open_key is not None:
            yield pa.RecordBatch.from_arrays(
                [*open_key.columns, _binary(open_sum[None, :])], [*keys, "x"])

    return (df.repartition(*keys).sortWithinPartitions(*keys)
            .mapInArrow(fold, _schema(df, keys, "x binary")))


def add(df: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Σ w·x of the rows (keys, w, x) with equal keys; x holds ``width`` doubles."""
    def read(b, starts):
        rows = _doubles(b.column("x"), width) * b.column("w").to_numpy()[:, None]
        return np.add.reduceat(rows, starts, axis=0)

    return _sums(df.select(*keys, "w", "x"), keys, read)


def from_entries(entries: DataFrame, block: int) -> DataFrame:
    """Entries (graph_id, i, j, v) as blocks; entries of one place add up."""
    keys = [G, "bi", "bj"]
    placed = entries.select(
        G, F.floor(F.col("i") / block).cast("int").alias("bi"),
        F.floor(F.col("j") / block).cast("int").alias("bj"),
        ((F.col("i") % block) * block + F.col("j") % block).cast("int").alias("at"),
        F.col("v").cast("double").alias("v"))

    def read(b, starts):
        run = np.zeros(b.num_rows, dtype=np.int64)
        run[starts[1:]] = 1
        out = np.zeros((len(starts), block * block))
        np.add.at(out, (np.cumsum(run), b.column("at").to_numpy()), b.column("v").to_numpy())
        return out

    return _sums(placed, keys, read)


def multiply(a: DataFrame, b: DataFrame, block: int) -> DataFrame:
    """Partial products (graph_id, bi, bj, x) of two block matrices; ``add`` sums them."""
    left = a.select(G, "bi", F.col("bj").alias("_m"), F.col("x").alias("_l"))
    right = b.select(G, F.col("bi").alias("_m"), "bj", F.col("x").alias("_r"))
    pairs = left.join(right, [G, "_m"]).select(G, "bi", "bj", "_l", "_r")

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            x = _doubles(t.column("_l"), block * block).reshape(-1, block, block)
            y = _doubles(t.column("_r"), block * block).reshape(-1, block, block)
            z = np.matmul(x, y).reshape(len(x), block * block)
            yield pa.RecordBatch.from_arrays(
                [t.column(G), t.column("bi"), t.column("bj"), _binary(z)], [G, "bi", "bj", "x"])

    return pairs.mapInArrow(product, _schema(pairs, [G, "bi", "bj"], "x binary"))


def polynomial(entries: DataFrame, nodes: DataFrame, coeff: DataFrame, order: int,
               block: int) -> DataFrame:
    """Σ_k c_k T_k(M) of the matrix M of ``entries`` (½ c_0, as for signals), with the three-term
    recurrence T_k = 2 M T_(k-1) - T_(k-2).  ``coeff`` is (graph_id, filter, k, c); output
    (graph_id, filter, bi, bj, x).  Every term is written once: two later steps read it."""
    keys = [G, "bi", "bj"]
    one = nodes.select(G, F.col("node").alias("i"), F.col("node").alias("j"), F.lit(1.0).alias("v"))
    terms = [from_entries(one, block)]
    if order > 0:
        m = materialize(from_entries(entries, block))
        terms.append(m)
    for _ in range(2, order + 1):
        parts = (multiply(m, terms[-1], block).withColumn("w", F.lit(2.0))
                 .unionByName(terms[-2].withColumn("w", F.lit(-1.0))))
        terms.append(materialize(add(parts, keys, block * block)))
    every = None
    for k, t in enumerate(terms):
        t = t.withColumn("k", F.lit(k))
        every = t if every is None else every.unionByName(t)
    w = F.when(F.col("k") == 0, F.col("c") / 2.0).otherwise(F.col("c")).alias("w")
    weighted = every.join(coeff, [G, "k"]).select(G, "filter", "bi", "bj", w, "x")
    return add(weighted, [G, "filter", "bi", "bj"], block * block)


def _graph_wavelets(rows: DataFrame, nodes: DataFrame, graphs: DataFrame, taus: list[float], order: int,
                    tolerance: float, kernel: str, lmax: str, pad: float, from_weights: bool,
                    max_nodes: int = 2000) -> DataFrame:
    """``wavelets`` of packed rows (graph_id, i, row of (j, w)): very many graphs of at most
    ``max_nodes`` nodes (guarded).  The rows are dealt by graph once, and a task forms and
    multiplies one graph's matrices after another; no term is written."""
    spark = nodes.sparkSession
    batches_by_bytes(spark)
    coeff = cheby_coeff(graphs, taus, m=order, kernel=kernel, lmax=lmax)
    listed = coeff.groupBy(G).agg(F.array_sort(F.collect_list(F.struct("filter", "k", "c"))).alias("_c")).select(
        G, F.transform("_c", lambda x: x["c"]).alias("cs"))
    size = nodes.groupBy(G).agg((F.max("node") + 1).cast("int").alias("n"))
    head = (graphs.select(G, ((F.col(lmax) + F.lit(pad)) / 2.0).alias("a")).join(listed, G).join(size, G)
            .withColumn("i", F.lit(-1)).withColumn("js", F.lit(None).cast("array<int>"))
            .withColumn("ws", F.lit(None).cast("array<double>")))
    packed = rows.select(G, "i", F.transform("row", lambda e: e["j"]).alias("js"),
                         F.transform("row", lambda e: e["w"]).alias("ws"))
    every = (head.unionByName(packed, allowMissingColumns=True).select(G, "i", "js", "ws", "a", "cs", "n")
             .repartition(G).sortWithinPartitions(G, "i"))
    scales = np.array([float(t) for t in taus])

    def matrices(lap: np.ndarray, a: float, cs: np.ndarray) -> Iterator[np.ndarray]:
        if from_weights:
            lap = np.diag(lap.sum(axis=1)) - lap
        old, cur = np.eye(len(lap)), lap / a - np.eye(len(lap))
        out = [c[0] / 2 * old for c in cs]
        for k in range(1, order + 1):
            if k > 1:
                old, cur = cur, 2.0 * (m @ cur) - old
            else:
                m = cur
            for f, c in enumerate(cs):
                out[f] += c[k] * cur
        yield from out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = lap = a = cs = None

        def done() -> Iterator[pa.RecordBatch]:
            for f, p in enumerate(matrices(lap, a, cs)):
                x = np.where(p >= tolerance, p, 0.0)
                i, j = np.nonzero(x)
                yield pa.RecordBatch.from_arrays(
                    [pa.repeat(key, len(i)), pa.repeat(pa.scalar(f, pa.int32()), len(i)), pa.repeat(pa.scalar(scales[f]), len(i)),
                     pa.array(i.astype("int32")), pa.array(j.astype("int32")), pa.array(x[i, j] / np.abs(x).sum(axis=1)[i])],
                    names=[G, "filter", "t", "i", "j", "val"])

        for b in batches:
            at = b.column("i").to_numpy()
            js, ws = b.column("js"), b.column("ws")
            end = np.cumsum(np.nan_to_num(pc.list_value_length(js).to_numpy(zero_copy_only=False))).astype(int)
            j, w = js.flatten().to_numpy(), ws.flatten().to_numpy()
            for r in range(b.num_rows):
                if at[r] < 0:
                    if key is not None:
                        yield from done()
                    key, a, n = (b.column(c)[r] for c in (G, "a", "n"))
                    n, a = n.as_py(), a.as_py()
                    if n > max_nodes:
                        raise ValueError(f"graph with {n} nodes is above the dense guard {max_nodes}")
                    cs, lap = np.array(b.column("cs")[r].as_py()).reshape(len(scales), order + 1), np.zeros((n, n))
                else:
                    part = slice(end[r - 1] if r else 0, end[r])
                    lap[at[r], j[part]] = w[part]
        if key is not None:
            yield from done()

    return every.mapInArrow(run, _schema(rows, [G], "filter int, t double, i int, j int, val double"))


def wavelets(lap: DataFrame, nodes: DataFrame, graphs: DataFrame, taus: list[float],
             order: int = 3, tolerance: float = 0.0, kernel: str = "heat", lmax: str = "lmax",
             pad: float = 1e-5, from_weights: bool = False, block: int = 64) -> DataFrame:
    """Wavelet matrices of every graph, the same rows as
    ``spectral.wavelets``, by block products.

    A wavelet matrix is the polynomial p(L) itself.  As joins of entries a Chebyshev step of
    a dense graph of n nodes emits n³ rows; blocks of side b emit (n/b)³, and each is a dense
    product.  Entries below ``tolerance`` and zeros go, rows are divided by their absolute
    sum.  With ``from_weights`` the first argument is the weight table (graph_id, src, dst,
    w) and the combinatorial Laplacian D - W is formed in the blocks.  ``nodes`` holds the
    numbers 0 to n-1 of each graph.  Output (graph_id, filter, t, i, j, val).

    A table (graph_id, i, row) of packed rows stands for very many small graphs, one matrix
    of which a task holds as a whole."""
    if "row" in lap.columns:
        return _graph_wavelets(lap, nodes, graphs, taus, order, tolerance, kernel, lmax, pad, from_weights)
    spark = nodes.sparkSession
    batches_by_bytes(spark)
    if from_weights:
        wt = lap.select(G, F.col("src").alias("i"), F.col("dst").alias("j"), F.col("w").alias("v"))
        deg = wt.groupBy(G, "i").agg(F.sum("v").alias("v")).select(G, "i", F.col("i").alias("j"), "v")
        lap = wt.withColumn("v", -F.col("v")).unionByName(deg)
    a = graphs.select(G, ((F.col(lmax) + F.lit(pad)) / 2.0).alias("_a"))
    scaled = lap.join(a, G).select(G, "i", "j", (F.col("v") / F.col("_a")).alias("v"))
    diag = (nodes.join(a, G).select(G, F.col("node").alias("i"), F.col("node").alias("j"),
                                    F.lit(-1.0).alias("v")))
    coeff = cheby_coeff(graphs, taus, m=order, kernel=kernel, lmax=lmax).select(G, "filter", "k", "c")
    p = materialize(polynomial(scaled.unionByName(diag), nodes, coeff, order, block))

    def kept(col: pa.Array) -> np.ndarray:
        x = _doubles(col, block * block).reshape(-1, block, block)
        return np.where(x >= tolerance, x, 0.0)

    def row_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(G), b.column("filter"), b.column("bi"),
                 _binary(np.abs(kept(b.column("x"))).sum(axis=2))], [G, "filter", "bi", "x"])

    rows = [G, "filter", "bi"]
    sums = add(p.mapInArrow(row_sums, _schema(p, rows, "x binary")).withColumn("w", F.lit(1.0)),
               rows, block).withColumnRenamed("x", "s")
    scales = np.array([float(t) for t in taus])

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, s = kept(b.column("x")), _doubles(b.column("s"), block)
            n, i, j = np.nonzero(x)
            at = b.select([G, "filter", "bi", "bj"]).take(pa.array(n))
            f = at.column("filter").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [at.column(G), at.column("filter"), pa.array(scales[f]),
                 pa.array((at.column("bi").to_numpy() * block + i).astype("int32")),
                 pa.array((at.column("bj").to_numpy() * block + j).astype("int32")),
                 pa.array(x[n, i, j] / s[n, i])], [G, "filter", "t", "i", "j", "val"])

    return (p.join(sums, rows).select(G, "filter", "bi", "bj", "x", "s")
            .mapInArrow(entries, _schema(p, [G, "filter"], "t double, i int, j int, val double")))
