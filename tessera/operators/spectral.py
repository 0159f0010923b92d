"""Spectral filters and wavelets on many graphs at once.

Polynomial (Chebyshev) filtering is the scalable path: order m costs m sparse products
(one join + aggregation each) over the Laplacian entries of all graphs together.
Coefficients are closed-form expressions over ``sequence`` arrays (no join, no UDF).
Operators that need an eigen-decomposition (spectrum, exact filtering, Fourier
transforms, resistance distance) run a dense solver per graph in a grouped pandas
function — one group is one graph, bounded by the node count (guarded).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.kernels import KERNELS
from tessera.operators import graph as gr
from tessera.session import materialize

G = "graph_id"


# ---------------------------------------------------------------- coefficients
def cheby_coeff(graphs: DataFrame, taus: list[float], m: int = 30, n_grid: int | None = None,
                kernel: str = "heat", lmax: str = "lmax") -> DataFrame:
    """K5: Chebyshev coefficients on [0, lmax] of each filter t of the bank, per graph:
    ``c_o = 2/N Σ_n g(a1 cos(π(n+½)/N) + a2) cos(π o (n+½)/N)``, a1 = a2 = lmax/2.
    Output (graph_id, filter, t, k, c)."""
    N = n_grid or m + 1
    g = KERNELS[kernel]
    bank = F.array(*[F.struct(F.lit(i).alias("f"), F.lit(float(t)).alias("t"))
                     for i, t in enumerate(taus)])
    half = F.col(lmax) / 2.0
    rows = (graphs.select(G, lmax, F.explode(bank).alias("_b"))
            .select(G, lmax, F.col("_b.f").alias("filter"), F.col("_b.t").alias("t"),
                    F.explode(F.sequence(F.lit(0), F.lit(m))).alias("k")))

    def term(acc, n):
        theta = F.lit(math.pi) * (n + F.lit(0.5)) / F.lit(N)
        return acc + g(half * F.cos(theta) + half, F.col(lmax), F.col("t")) * \
            F.cos(F.lit(math.pi) * F.col("k") * (n + F.lit(0.5)) / F.lit(N))

    c = F.lit(2.0 / N) * F.aggregate(F.sequence(F.lit(0), F.lit(N - 1)), F.lit(0.0), term)
    return rows.select(G, "filter", "t", "k", c.alias("c"))


def rect_coeff(graphs: DataFrame, b_lo, b_hi, order: int = 30,
               lmax: str = "lmax") -> DataFrame:
    """K13 coefficients of the ideal band-pass [b_lo, b_hi] (numbers or columns of
    ``graphs``; arccos bounds), in the ½c0 convention of ``cheby_filter``:
    c0 = 2(b1 - b2)/π, ck = 2/(kπ)(sin k b1 - sin k b2)."""
    lo = b_lo if isinstance(b_lo, Column) else F.lit(float(b_lo))
    hi = b_hi if isinstance(b_hi, Column) else F.lit(float(b_hi))
    b1 = F.acos(F.lit(2.0) * lo / F.col(lmax) - 1.0)
    b2 = F.acos(F.lit(2.0) * hi / F.col(lmax) - 1.0)
    k = F.col("k")
    c = F.when(k == 0, F.lit(2.0) * (b1 - b2) / F.lit(math.pi)).otherwise(
        F.lit(2.0) / (k * F.lit(math.pi)) * (F.sin(k * b1) - F.sin(k * b2)))
    return (graphs.select(G, lmax, F.explode(F.sequence(F.lit(0), F.lit(order))).alias("k"))
            .select(G, F.lit(0).alias("filter"), "k", c.alias("c")))


def jackson_cheby_coeff(bounds: DataFrame, m: int, a: str = "a", b: str = "b",
                        lmin: str = "lmin", lmax: str = "lmax") -> DataFrame:
    """Chebyshev series (ch) of the indicator of [a, b] on [lmin, lmax] and the same
    series with Jackson damping (jch).  In the angle t of x = cos(t) the indicator covers
    [t(b), t(a)]; the damping factors of degree n = m + 2 are
    ((n - k) sin(q) cos(kq) + cos(q) sin(kq)) / (n sin(q)) with q = pi / n.
    Rows whose interval leaves the range fail in the job that reads them."""
    def angle(edge: str) -> Column:
        inside = F.col(edge).between(F.col(lmin), F.col(lmax)) & (F.col(lmin) < F.col(lmax))
        at = (2 * F.col(edge) - F.col(lmin) - F.col(lmax)) / (F.col(lmax) - F.col(lmin))
        return F.when(inside, F.acos(at)).otherwise(
            F.raise_error(F.lit("band edge outside the range of eigenvalues")).cast("double"))

    k, n = F.col("i"), m + 2
    q = math.pi / n
    low, high = angle(b), angle(a)
    series = F.when(k == 0, (high - low) * (2 / math.pi)).otherwise(
        (F.sin(k * high) - F.sin(k * low)) / k * (2 / math.pi))
    damping = ((n - k) * math.sin(q) * F.cos(k * q) + math.cos(q) * F.sin(k * q)) / (n * math.sin(q))
    rows = bounds.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(m))))
    return rows.select(*bounds.columns, "i", series.alias("ch"), (series * damping).alias("jch"))


# ---------------------------------------------------------------- polynomial filtering
def _shift(x: DataFrame, factor: float | Column, keys: list[str]) -> DataFrame:
    return x.select(G, "node", *keys, (F.col("val") * factor).alias("val"))


def cheby_terms(lap: DataFrame, signal: DataFrame, graphs: DataFrame, order: int,
                lmax: str = "lmax", pad: float = 1e-5, keys: tuple[str, ...] = ("signal",)):
    """Chebyshev terms T0..T_order of the scaled Laplacian applied to ``signal``
    (graph_id, node, *keys, val): a1 = a2 = (lmax + pad)/2,
    T1 = (L s - a2 s)/a1, Tk = 2/a1 (L - a2 I) T(k-1) - T(k-2).
    Each term is one sparse product; the shift terms are unioned before the sum so that
    isolated nodes keep their rows.  Yields (k, DataFrame)."""
    keys = list(keys)
    half = graphs.select(G, ((F.col(lmax) + F.lit(pad)) / 2.0).alias("_a"))
    lap = lap.join(half, G)

    def step(t_cur: DataFrame, scale: float, t_old: DataFrame | None) -> DataFrame:
        # scale/a · (L·t - a·t) - t_old
        lt = gr.spmv(lap.select(G, "i", "j", (F.col("v") * F.lit(scale) / F.col("_a")).alias("v")),
                     t_cur, keys=tuple(keys))
        sh = _shift(t_cur, -F.lit(scale), keys)
        parts = lt.unionByName(sh)
        if t_old is not None:
            parts = parts.unionByName(_shift(t_old, F.lit(-1.0), keys))
        return parts.groupBy(G, "node", *keys).agg(F.sum("val").alias("val"))

    # T_k reads T_(k-1) and T_(k-2): as plain lineage the plan tree would grow like the
    # Fibonacci numbers.  Each term is checkpointed (reliably, to the shared folder), so
    # every term is a leaf for the next ones and the plans stay small.
    t0 = materialize(signal.select(G, "node", *keys, "val"))
    yield 0, t0
    if order < 1:
        return
    t1 = materialize(step(t0, 1.0, None))
    yield 1, t1
    old, cur = t0, t1
    for k in range(2, order + 1):
        new = materialize(step(cur, 2.0, old))
        yield k, new
        old, cur = cur, new


def cheby_filter(lap: DataFrame, signal: DataFrame, graphs: DataFrame, coeff: DataFrame,
                 lmax: str = "lmax", pad: float = 1e-5, keys: tuple[str, ...] = ("signal",)) -> DataFrame:
    """K6/K7: r_f = ½ c_f0 T0 + Σ_k c_fk T_k for every filter f of ``coeff``
    (graph_id, filter, k, c); needs at least two coefficients.
    Output (graph_id, node, *keys, filter, val)."""
    keys = list(keys)
    order = coeff.agg(F.max("k")).first()[0]
    if order is None or order < 1:
        raise TypeError("cheby_filter needs coefficients of two orders at least")
    parts = None
    for k, t in cheby_terms(lap, signal, graphs, order, lmax, pad, tuple(keys)):
        ck = coeff.filter(F.col("k") == k).select(G, "filter", F.col("c"))
        w = F.col("c") * (F.lit(0.5) if k == 0 else F.lit(1.0))
        term = t.join(ck, G).select(G, "node", *keys, "filter", (w * F.col("val")).alias("val"))
        parts = term if parts is None else parts.unionByName(term)
    return parts.groupBy(G, "node", *keys, "filter").agg(F.sum("val").alias("val"))


def identity_signal(nodes: DataFrame) -> DataFrame:
    """One delta signal per node: (graph_id, node, signal=node, val=1)."""
    return nodes.select(G, "node", F.col("node").alias("signal"), F.lit(1.0).alias("val"))


def delta_signal(nodes: DataFrame, at: int) -> DataFrame:
    """K10 input: a single delta at node ``at`` in every graph."""
    return (nodes.filter(F.col("node") == at)
            .select(G, "node", F.lit(at).alias("signal"), F.lit(1.0).alias("val")))


def synthesize(analysis: DataFrame, keys: tuple[str, ...] = ("signal",)) -> DataFrame:
    """K8: sum the outputs of filter i applied to feature i over the features
    (``analysis`` rows carry feature = filter)."""
    return analysis.groupBy(G, "node", *keys).agg(F.sum("val").alias("val"))


# ---------------------------------------------------------------- wavelets
def scale_list(scale: int | Column) -> list[float] | Column:
    """The pairs (-1/d, 1/d) for d = scale, scale - 1, ..., 1; for a column, an array."""
    if isinstance(scale, Column):
        steps = F.sequence(scale.cast("int"), F.lit(1), F.lit(-1))
        return F.flatten(F.transform(steps, lambda d: F.array(F.lit(-1.0) / d, F.lit(1.0) / d)))
    return [sign / d for d in range(scale, 0, -1) for sign in (-1.0, 1.0)]


def wavelets(lap: DataFrame, nodes: DataFrame, graphs: DataFrame, taus: list[float],
             order: int = 3, tolerance: float = 0.0, kernel: str = "heat",
             lmax: str = "lmax") -> DataFrame:
    """Wavelet matrix of each graph and each scale t: the Chebyshev
    filter applied to every delta (rows = nodes, columns = delta positions), entries
    below ``tolerance`` (and zeros) dropped, rows L1-normalized.
    Output (graph_id, filter, t, i, j, val)."""
    coeff = cheby_coeff(graphs, taus, m=order, kernel=kernel, lmax=lmax)
    frame = cheby_filter(lap, identity_signal(nodes), graphs, coeff.drop("t"), lmax=lmax)
    kept = frame.filter((F.col("val") >= F.lit(tolerance)) & (F.col("val") != 0))
    w = Window.partitionBy(G, "filter", "node")
    norm = kept.withColumn("val", F.col("val") / F.sum(F.abs("val")).over(w))
    tmap = F.array(*[F.lit(float(t)) for t in taus])
    return norm.select(G, "filter", F.get(tmap, F.col("filter")).alias("t"),
                       F.col("node").alias("i"), F.col("signal").alias("j"), "val")


def rejected_graphs(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Graphs that have nodes but no edge (lmax would be 0, so no wavelet transform
    exists); kept as a rejects table instead of being skipped silently."""
    return nodes.select(G).distinct().join(edges.select(G).distinct(), G, "left_anti")


def density(matrix: DataFrame, nodes: DataFrame, n_filters: int = 1) -> DataFrame:
    """Share of non-zero entries of every graph and filter, percent rounded to 2; 0
    where there are none."""
    n = nodes.groupBy(G).agg(F.count(F.lit(1)).alias("_n"))
    every = n.withColumn("filter", F.explode(F.sequence(F.lit(0), F.lit(n_filters - 1))))
    nnz = matrix.filter(F.col("val") != 0).groupBy(G, "filter").agg(F.count(F.lit(1)).alias("_z"))
    share = F.round(F.lit(100.0) * F.coalesce("_z", F.lit(0)) / (F.col("_n") ** 2), 2)
    return every.join(nnz, [G, "filter"], "left").select(G, "filter", share.alias("density"))


def frame_bounds(graphs: DataFrame, taus: list[float], n_points: int = 1000, kernel: str = "heat",
                 lmax: str = "lmax", xmin: float = 0.0) -> DataFrame:
    """Min and max over an even grid of ``n_points`` on [xmin, lmax] of Σ_i g_i(x)²."""
    g = KERNELS[kernel]
    x = F.lit(xmin) + (F.col(lmax) - F.lit(xmin)) * F.col("_p") / F.lit(max(n_points - 1, 1))
    s = None
    for t in taus:
        v = g(x, F.col(lmax), F.lit(float(t)))
        s = v * v if s is None else s + v * v
    grid = graphs.select(G, lmax, F.explode(F.sequence(F.lit(0), F.lit(n_points - 1))).alias("_p"))
    return grid.groupBy(G).agg(F.min(s).alias("a"), F.max(s).alias("b"))


def evaluate_bank(freqs: DataFrame, taus: list[float], kernel: str = "heat", x: str = "x",
                  lmax: str = "lmax") -> DataFrame:
    """K1: value of every filter of the bank at every frequency (``stack`` of columns)."""
    g = KERNELS[kernel]
    bank = F.array(*[F.struct(F.lit(i).alias("filter"), g(F.col(x), F.col(lmax), F.lit(float(t))).alias("g"))
                     for i, t in enumerate(taus)])
    return freqs.select("*", F.explode(bank).alias("_b")).select(
        *freqs.columns, F.col("_b.filter").alias("filter"), F.col("_b.g").alias("g"))


# ---------------------------------------------------------------- dense per-graph spectra
def spectrum(lap: DataFrame, nodes: DataFrame, max_nodes: int = 2000) -> DataFrame:
    """Eigenvalues (ascending, the smallest set to 0) and eigenvectors of every
    graph's L: (graph_id, k, lam, node, u).  One dense solve per graph in a grouped
    pandas function; a graph is bounded by ``max_nodes`` (guard)."""
    import numpy as np
    import pandas as pd

    n = nodes.groupBy(G).agg(F.max("node").alias("_nmax"))
    rows = (lap.join(n, G).select(G, "i", "j", "v", "_nmax")
            .unionByName(n.select(G, F.lit(-1).alias("i"), F.lit(-1).alias("j"),
                                  F.lit(0.0).alias("v"), "_nmax")))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        size = int(pdf["_nmax"].iloc[0]) + 1
        if size > max_nodes:
            raise ValueError(f"graph with {size} nodes is above the dense guard {max_nodes}")
        m = np.zeros((size, size))
        e = pdf[pdf["i"] >= 0]
        np.add.at(m, (e["i"].to_numpy(), e["j"].to_numpy()), e["v"].to_numpy())
        lam, u = np.linalg.eigh((m + m.T) / 2.0)
        lam[0] = 0.0
        kk, nn = np.meshgrid(np.arange(size), np.arange(size), indexing="ij")
        return pd.DataFrame({G: pdf[G].iloc[0], "k": kk.ravel().astype("int32"),
                             "lam": np.repeat(lam, size), "node": nn.ravel().astype("int32"),
                             "u": u.T.ravel()})

    return rows.groupBy(G).applyInPandas(
        solve, schema=f"{G} {nodes.schema[G].dataType.simpleString()}, k int, lam double, node int, u double")


def coherence(spec: DataFrame) -> DataFrame:
    """mu = max |U| per graph."""
    return spec.groupBy(G).agg(F.max(F.abs("u")).alias("mu"))


def gft(spec: DataFrame, signal: DataFrame) -> DataFrame:
    """s_hat[k] = Σ_node U[node,k] s[node]  -> (graph_id, k, val)."""
    return (spec.join(signal, [G, "node"]).groupBy(G, "k")
            .agg(F.sum(F.col("u") * F.col("val")).alias("val")))


def igft(spec: DataFrame, s_hat: DataFrame) -> DataFrame:
    """s[node] = Σ_k U[node,k] s_hat[k]  -> (graph_id, node, val)."""
    return (spec.join(s_hat, [G, "k"]).groupBy(G, "node")
            .agg(F.sum(F.col("u") * F.col("val")).alias("val")))


def modulate(spec: DataFrame, signal: DataFrame, k: int, nodes: DataFrame) -> DataFrame:
    """F · U[:,k] · sqrt(N)."""
    n = nodes.groupBy(G).agg(F.count(F.lit(1)).alias("_n"))
    uk = spec.filter(F.col("k") == k).select(G, "node", "u")
    return (signal.join(uk, [G, "node"]).join(n, G)
            .select(G, "node", (F.col("val") * F.col("u") * F.sqrt("_n")).alias("val")))


def exact_filter(spec: DataFrame, signal: DataFrame, graphs: DataFrame, taus: list[float],
                 kernel: str = "heat", lmax: str = "lmax") -> DataFrame:
    """K9: U g(Λ) U^T s for every filter (graph_id, node, filter, val)."""
    g = KERNELS[kernel]
    sh = gft(spec, signal)
    lam = spec.select(G, "k", "lam").distinct().join(graphs.select(G, lmax), G)
    bank = evaluate_bank(lam, taus, kernel, x="lam", lmax=lmax)
    scaled = sh.join(bank, [G, "k"]).select(G, "k", "filter", (F.col("val") * F.col("g")).alias("val"))
    return (spec.join(scaled, [G, "k"]).groupBy(G, "node", "filter")
            .agg(F.sum(F.col("u") * F.col("val")).alias("val")))


def frame_bounds_eigenvalues(spec: DataFrame, graphs: DataFrame, taus: list[float],
                             kernel: str = "heat", lmax: str = "lmax") -> DataFrame:
    """K11 (``use_eigenvalues``): min and max of Σ_i g_i(λ)² over the eigenvalues."""
    lam = spec.select(G, "k", "lam").distinct().join(graphs.select(G, lmax), G)
    bank = evaluate_bank(lam, taus, kernel, x="lam", lmax=lmax)
    s = bank.groupBy(G, "k").agg(F.sum(F.col("g") ** 2).alias("_s"))
    return s.groupBy(G).agg(F.min("_s").alias("a"), F.max("_s").alias("b"))


def kernel_norms(spec: DataFrame, graphs: DataFrame, taus: list[float], kernel: str = "heat",
                 lmax: str = "lmax") -> DataFrame:
    """K4: L2 norm of each kernel over the eigenvalues (the ``normalize=True`` divisor)."""
    lam = spec.select(G, "k", "lam").distinct().join(graphs.select(G, lmax), G)
    bank = evaluate_bank(lam, taus, kernel, x="lam", lmax=lmax)
    return bank.groupBy(G, "filter").agg(F.sqrt(F.sum(F.col("g") ** 2)).alias("norm"))


def resistance_distance(spec: DataFrame, pairs: DataFrame, eps: float = 1e-10) -> DataFrame:
    """For requested pairs (graph_id, a, b): Σ_k (u_ak - u_bk)² / λ_k over λ_k > eps
    (= P_aa + P_bb - P_ab - P_ba with P the pseudo-inverse of L)."""
    s = spec.filter(F.col("lam") > F.lit(eps))
    ua = s.select(G, "k", "lam", F.col("node").alias("a"), F.col("u").alias("ua"))
    ub = s.select(G, "k", F.col("node").alias("b"), F.col("u").alias("ub"))
    return (pairs.join(ua, [G, "a"]).join(ub, [G, "k", "b"])
            .groupBy(G, "a", "b").agg(F.sum((F.col("ua") - F.col("ub")) ** 2 / F.col("lam")).alias("r")))
