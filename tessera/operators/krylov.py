"""Krylov methods on many graphs at once: largest eigenvalue (G10), functions of the
Laplacian applied to signals (K9), kernel norms (K4) and resistance distances (G22),
without an eigen-solver.

The Lanczos recurrence is three terms on tables: one sparse product of L with the current
basis vectors of all graphs and signals (a join and an aggregation), summed with the two
vectors before in the same shuffle, and one aggregate for the new coefficients.  A basis
vector is a table (graph_id, signal, node, val); only its coefficients, two numbers for a
graph, signal and step, are ever folded into a row.  The tridiagonal matrix of a signal has
as many rows as there were steps, some tens, whatever the size of the graph.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import graph as gr
from tessera.operators import spectral as sp
from tessera.session import materialize

G = "graph_id"
KEY = [G, "signal"]
#: a coefficient below this share of the vector it comes from is rounding: the space is whole
DONE = 1e-7


def lanczos(lap: DataFrame, signal: DataFrame) -> Iterator[tuple[int, DataFrame, DataFrame]]:
    """Steps k = 0, 1, ... of the recurrence started at ``signal`` (graph_id, signal, node,
    val): (k, basis vectors, coefficients (graph_id, signal, alpha, beta, norm)), norm being
    that of the start.  Ends when the spaces of all signals are whole."""
    lap = materialize(lap.select(G, "i", "j", "v"))
    norm = signal.groupBy(*KEY).agg(F.sqrt(F.sum(F.col("val") ** 2)).alias("norm")).filter(F.col("norm") > 0)
    norm = materialize(norm)
    now = materialize(signal.join(norm, KEY).select(*KEY, "node", (F.col("val") / F.col("norm")).alias("val")))
    before = None
    k = 0
    while True:
        zero = F.lit(0.0)
        parts = [gr.spmv(lap, now, keys=("signal",)).select(*KEY, "node", F.col("val").alias("w"), zero.alias("v")),
                 now.select(*KEY, "node", zero.alias("w"), F.col("val").alias("v"))]
        if before is not None:
            parts.append(before.select(*KEY, "node", (-F.col("val")).alias("w"), zero.alias("v")))
        both = materialize(reduce(DataFrame.unionByName, parts).groupBy(*KEY, "node").agg(
            F.sum("w").alias("w"), F.sum("v").alias("v")))
        alpha = both.groupBy(*KEY).agg(F.sum(F.col("w") * F.col("v")).alias("alpha"), F.sum(F.col("w") ** 2).alias("_w"))
        rest = both.join(alpha, KEY).withColumn("u", F.col("w") - F.col("alpha") * F.col("v"))
        beta = F.sqrt(F.sum(F.col("u") ** 2))
        coef = rest.groupBy(*KEY).agg(F.first("alpha").alias("alpha"), F.first("_w").alias("_w"), beta.alias("beta"))
        coef = materialize(coef.join(norm, KEY).select(
            *KEY, "alpha", F.when(F.col("beta") > DONE * F.sqrt("_w"), F.col("beta")).otherwise(zero).alias("beta"),
            "norm"))
        yield k, now, coef
        live = coef.filter(F.col("beta") > 0)
        if live.isEmpty():
            return
        step = both.join(live, KEY)
        before = step.select(*KEY, "node", (F.col("v") * F.col("beta")).alias("val"))
        now = materialize(step.select(*KEY, "node", ((F.col("w") - F.col("alpha") * F.col("v")) / F.col("beta")).alias("val")))
        k += 1


def _tridiagonal(coefs: list[DataFrame], of: Callable, schema: str) -> DataFrame:
    """``of`` (alphas, betas, norm) on the coefficients of every graph and signal that has a
    norm, one row of a few tens of numbers each."""
    rows = reduce(DataFrame.unionByName, [c.withColumn("k", F.lit(k)) for k, c in enumerate(coefs)])
    packed = rows.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("k", "alpha", "beta"))).alias("t"),
                                    F.max("norm").alias("norm")).filter(F.col("norm").isNotNull())
    small = F.udf(lambda t, n: of([x.alpha for x in t], [x.beta for x in t], n), schema)
    return packed.select(*KEY, small("t", "norm").alias("out"))


def _eigen(alpha: list[float], beta: list[float]):
    import numpy as np
    off = beta[:len(alpha) - 1]
    return np.linalg.eigh(np.diag(alpha) + np.diag(off, 1) + np.diag(off, -1))


def _top(alpha: list[float], beta: list[float], norm: float) -> tuple[float, float]:
    """Largest Ritz value and the norm of its residual: an eigenvalue lies that near."""
    lam, s = _eigen(alpha, beta)
    return float(lam[-1]), float(beta[len(alpha) - 1] * abs(s[-1, -1]))


def lmax_lanczos(lap: DataFrame, nodes: DataFrame, tol: float = 5e-3, margin: float = 1.01,
                 check_every: int = 4) -> DataFrame:
    """The largest Ritz value of every graph once its residual is at most ``tol`` of it,
    times ``margin``: (graph_id, lmax, ritz, residual).

    A Ritz value never exceeds the largest eigenvalue, and an eigenvalue lies within the
    residual of it, so with the margin above the tolerance ``lmax`` bounds the spectrum from
    above and by at most ``margin``.  The start is a hash of the node, so that it has a part
    in every eigenvector.  Graphs without entries get 0."""
    h = F.pmod(F.xxhash64("node"), F.lit(2_000_003)) / 1_000_001.5 - 1.0
    start = nodes.select(G, F.lit(0).alias("signal"), "node", h.alias("val"))
    coefs, found = [], None
    for k, _, coef in lanczos(lap, start):
        coefs.append(coef)
        if (k + 1) % check_every == 0:
            found = materialize(_ritz(coefs))
            if found.filter(F.col("residual") > tol * F.col("ritz")).isEmpty():
                break
    else:
        found = _ritz(coefs) if coefs else None
    every = nodes.select(G).distinct()
    out = every.join(found, G, "left") if found is not None else every.withColumns(
        {"ritz": F.lit(0.0), "residual": F.lit(0.0)})
    ritz = F.greatest(F.coalesce("ritz", F.lit(0.0)), F.lit(0.0))
    return out.select(G, (ritz * F.lit(margin)).alias("lmax"), ritz.alias("ritz"),
                      F.coalesce("residual", F.lit(0.0)).alias("residual"))


def _ritz(coefs: list[DataFrame]) -> DataFrame:
    return _tridiagonal(coefs, _top, "ritz double, residual double").select(G, "out.*")


#: the kernels of ``functions.kernels`` as functions of numbers
NUMBERS = {
    "heat": lambda x, lmax, t: math.exp(-t * x / lmax),
    "self_defined": lambda x, lmax, t: ((x + 1) / (lmax + 1) if t < 0 else (lmax + 1) / (x + 1))
    * math.exp(-t * (x + 1) / (lmax + 1)),
}


def heat_steps(taus: list[float], tol: float) -> int:
    """Steps after which heat filtering errs by at most ``tol`` of the signal's norm.

    A polynomial of degree m - 1 is exact after m steps, so the error is at most twice the
    best polynomial's, and that is at most the rest of the Chebyshev series of exp(-t x) on
    [0, 1].  The rest is summed from the series' own bound, (t/4)^k / k! * 2 exp(|t|)."""
    worst = max(map(abs, taus), default=0.0)
    m = 1
    while 4 * math.exp(worst) * sum((worst / 4) ** k / math.factorial(k) for k in range(m, m + 60)) > tol:
        m += 1
    return m


def krylov_filter(lap: DataFrame, signal: DataFrame, graphs: DataFrame, taus: list[float], tol: float = 1e-9,
                  kernel: str = "heat", lmax: str = "lmax") -> DataFrame:
    """K9: g(L) s for every filter of the bank: (graph_id, signal, node, filter, val), off by
    at most ``tol`` times the norm of s (for the heat kernel, and a spectrum in [0, lmax];
    other kernels run until the space is whole)."""
    steps = heat_steps(taus, tol) if kernel == "heat" else None
    basis, coefs = [], []
    for k, v, coef in lanczos(lap, signal):
        basis.append(v.withColumn("k", F.lit(k)))
        coefs.append(coef)
        if steps is not None and k + 1 >= steps:
            break
    top = graphs.select(G, F.col(lmax).alias("_l"))
    coefs[0] = coefs[0].join(top, G).withColumn("norm", F.struct("norm", "_l")).drop("_l")
    coefs[1:] = [c.withColumn("norm", F.lit(None).cast(coefs[0].schema["norm"].dataType)) for c in coefs[1:]]
    g = NUMBERS[kernel]

    def weights(alpha: list[float], beta: list[float], norm) -> list[tuple[int, int, float]]:
        lam, s = _eigen(alpha, beta)
        out = []
        for f, t in enumerate(taus):
            c = s @ ([g(float(x), norm["_l"], t) for x in lam] * s[0]) * norm["norm"]
            out += [(f, k, float(x)) for k, x in enumerate(c)]
        return out

    w = _tridiagonal(coefs, weights, "array<struct<filter:int,k:int,c:double>>")
    w = w.select(*KEY, F.inline("out"))
    vectors = reduce(DataFrame.unionByName, basis)
    return (vectors.join(w, [*KEY, "k"]).groupBy(*KEY, "node", "filter")
            .agg(F.sum(F.col("c") * F.col("val")).alias("val")))


def kernel_norms(lap: DataFrame, nodes: DataFrame, graphs: DataFrame, taus: list[float], tol: float = 1e-9,
                 lmax: str = "lmax") -> DataFrame:
    """K4: sqrt(sum of g(lambda)^2) of the heat kernels.  The sum is the trace of g(L)^2, and
    the square of a heat kernel is the kernel of twice the time, so that the norm is the sum
    of the diagonal of that filter on the delta signals: (graph_id, filter, norm)."""
    deltas = sp.identity_signal(nodes)
    out = krylov_filter(lap, deltas, graphs, [2 * t for t in taus], tol, lmax=lmax)
    return (out.filter(F.col("node") == F.col("signal")).groupBy(G, "filter")
            .agg(F.sqrt(F.sum("val")).alias("norm")))


def normalized(filtered: DataFrame, norms: DataFrame) -> DataFrame:
    """K4 applied: outputs of filters divided by the norm of their kernel."""
    return (filtered.join(norms, [G, "filter"])
            .withColumn("val", F.col("val") / F.col("norm")).drop("norm"))


def solve_laplacian(lap: DataFrame, rhs: DataFrame, tol: float = 1e-9) -> DataFrame:
    """L x = b for all graphs and signals at once by conjugate gradients, scaled by the
    diagonal of L: ``rhs`` (graph_id, signal, node, val) to (graph_id, signal, node, val).

    ``rhs`` has a row for every node of its component and sums to 0 there; x is one of the
    solutions that differ by a constant.  A round is one sparse product and two aggregates;
    it ends when every residual is at most ``tol`` of its right side (a system of n nodes
    takes at most n rounds, well-connected graphs take few)."""
    zero = F.lit(0.0)
    lap = materialize(lap.select(G, "i", "j", "v"))
    d = lap.filter(F.col("i") == F.col("j")).select(G, F.col("i").alias("node"), F.col("v").alias("d"))
    state = materialize(rhs.join(d, [G, "node"]).select(*KEY, "node", "d", zero.alias("x"), F.col("val").alias("r"),
                                                        (F.col("val") / F.col("d")).alias("p")))
    goal = materialize(state.groupBy(*KEY).agg((F.sum(F.col("r") ** 2) * tol ** 2).alias("goal")))
    solved = []
    while True:
        q = gr.spmv(lap, state.select(*KEY, "node", F.col("p").alias("val")), keys=("signal",))
        both = materialize(state.join(q.withColumnRenamed("val", "q"), [*KEY, "node"], "left")
                           .withColumn("q", F.coalesce("q", zero)))
        along = both.groupBy(*KEY).agg(F.sum(F.col("p") * F.col("q")).alias("pq"),
                                       F.sum(F.col("r") ** 2 / F.col("d")).alias("rz"))
        a = F.coalesce(F.try_divide("rz", "pq"), zero)
        moved = both.join(along, KEY).select(*KEY, "node", "d", "p", "rz", (F.col("x") + a * F.col("p")).alias("x"),
                                             (F.col("r") - a * F.col("q")).alias("r"))
        now = moved.groupBy(*KEY).agg(F.sum(F.col("r") ** 2 / F.col("d")).alias("rz2"), F.sum(F.col("r") ** 2).alias("rr"))
        now = now.join(goal, KEY).select(*KEY, "rz2", (F.col("rr") <= F.col("goal")).alias("done"))
        b = F.coalesce(F.try_divide("rz2", "rz"), zero)
        moved = materialize(moved.join(now, KEY).select(
            *KEY, "node", "d", "x", "r", "done", (F.col("r") / F.col("d") + b * F.col("p")).alias("p")))
        # what is solved leaves: going on would only stir its rounding
        solved.append(moved.filter("done").select(*KEY, "node", F.col("x").alias("val")))
        state = moved.filter(~F.col("done")).drop("done")
        if state.isEmpty():
            return reduce(DataFrame.unionByName, solved)


def resistance_distance(edges: DataFrame, nodes: DataFrame, pairs: DataFrame, tol: float = 1e-9) -> DataFrame:
    """P_aa + P_bb - P_ab - P_ba, P the pseudo-inverse of the combinatorial Laplacian,
    for the ``pairs`` (graph_id, a, b): (graph_id, a, b, r).

    A column of P is the solution for a delta less its share of the component, shifted to sum
    0 there.  A column is solved once for each node that occurs in a pair; a node without
    edges has a column of zeros."""
    comp = materialize(gr.components(edges.filter(F.col("w") != 0), nodes))
    asked = pairs.select(G, F.col("a").alias("signal")).unionByName(
        pairs.select(G, F.col("b").alias("signal"))).distinct()
    size = comp.groupBy(G, "component").agg(F.count("*").alias("n"))
    own = comp.select(G, F.col("node").alias("signal"), "component")
    rhs = (asked.join(own, [G, "signal"]).join(size, [G, "component"]).filter(F.col("n") > 1)
           .join(comp, [G, "component"])
           .select(G, "signal", "node", ((F.col("node") == F.col("signal")).cast("double") - 1 / F.col("n")).alias("val")))
    x = solve_laplacian(gr.laplacian(edges, nodes), rhs, tol)
    mean = x.groupBy(*KEY).agg(F.avg("val").alias("m"))
    column = materialize(x.join(mean, KEY).select(*KEY, "node", (F.col("val") - F.col("m")).alias("val")))
    out = pairs.select(G, "a", "b")
    for name, s, n in (("aa", "a", "a"), ("bb", "b", "b"), ("ab", "a", "b"), ("ba", "b", "a")):
        at = column.select(F.col(G).alias("_g"), F.col("signal").alias("_s"), F.col("node").alias("_n"),
                           F.col("val").alias(name))
        out = out.join(at, (F.col(G) == F.col("_g")) & (F.col(s) == F.col("_s")) & (F.col(n) == F.col("_n")),
                       "left").drop("_g", "_s", "_n")
    p = {c: F.coalesce(c, F.lit(0.0)) for c in ("aa", "bb", "ab", "ba")}
    return out.select(G, "a", "b", (p["aa"] + p["bb"] - p["ab"] - p["ba"]).alias("r"))
