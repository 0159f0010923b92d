"""Krylov operators against dense solutions of small graphs."""

import math

import numpy as np

from tessera.operators import graph as gr
from tessera.operators import krylov as kr


def graphs_of(spark):
    """A path (small gap at the top), two equal cliques (a double top), a weighted random
    graph, a star, and one without edges."""
    r = np.random.default_rng(5)
    path = {(i, i + 1): 1.0 for i in range(39)}
    cliques = {(a + o, b + o): 1.0 for o in (0, 6) for a in range(6) for b in range(a)}
    some = {(a, b): float(r.random()) for a in range(25) for b in range(a) if r.random() < 0.3}
    star = {(0, i): 2.0 for i in range(1, 9)}
    size = {1: 40, 2: 12, 3: 25, 4: 9, 5: 3}
    edges = [(g, a, b, w) for g, es in ((1, path), (2, cliques), (3, some), (4, star)) for (x, y), w in es.items()
             for a, b in ((x, y), (y, x))]
    e = spark.createDataFrame(edges, "graph_id long, src int, dst int, w double")
    nodes = spark.createDataFrame([(g, i) for g, n in size.items() for i in range(n)], "graph_id long, node int")
    dense = {}
    for g, n in size.items():
        m = np.zeros((n, n))
        for h, a, b, w in edges:
            if h == g:
                m[a, b] -= w
                m[a, a] += w
        dense[g] = m
    return e, nodes, dense


def test_lanczos_bounds_the_largest_eigenvalue(spark):
    e, nodes, dense = graphs_of(spark)
    got = {r.graph_id: r for r in kr.lmax_lanczos(gr.laplacian(e, nodes), nodes).collect()}
    assert set(got) == set(dense)
    for g, m in dense.items():
        true = float(np.linalg.eigvalsh(m)[-1]) if m.any() else 0.0
        assert true - 1e-9 <= got[g].lmax <= true * 1.01 + got[g].residual + 1e-9
        assert got[g].ritz <= true + 1e-9


def test_filter_errs_by_less_than_stated(spark):
    e, nodes, dense = graphs_of(spark)
    lap = gr.laplacian(e, nodes)
    graphs = gr.lmax_bound(e, nodes).filter("lmax > 0")
    top = {r.graph_id: r.lmax for r in graphs.collect()}
    s = nodes.selectExpr("graph_id", "0 AS signal", "node", "cast(1 + node % 3 AS double) AS val")
    taus = [-1.0, 1.0]
    for tol in (1e-4,):
        got = {(r.graph_id, r.node, r.filter): r.val for r in kr.krylov_filter(lap, s, graphs, taus, tol).collect()}
        for g, m in dense.items():
            if g not in top:
                continue
            lam, u = np.linalg.eigh(m)
            x = 1.0 + np.arange(len(m)) % 3
            for f, t in enumerate(taus):
                want = u @ (np.exp(-t * lam / top[g]) * (u.T @ x))
                off = np.array([got[g, i, f] for i in range(len(m))]) - want
                assert np.linalg.norm(off) <= tol * np.linalg.norm(x) + 1e-11
    assert kr.heat_steps([1.0], 1e-2) < kr.heat_steps([1.0], 1e-8)


def test_kernel_norms_are_those_over_the_spectrum(spark):
    e, nodes, dense = graphs_of(spark)
    graphs = gr.lmax_bound(e, nodes).filter("lmax > 0")
    top = {r.graph_id: r.lmax for r in graphs.collect()}
    taus = [-1.0, 2.0]
    got = {(r.graph_id, r.filter): r.norm
           for r in kr.kernel_norms(gr.laplacian(e, nodes), nodes, graphs, taus, tol=1e-5).collect()}
    for g, limit in top.items():
        lam = np.linalg.eigvalsh(dense[g])
        for f, t in enumerate(taus):
            assert math.isclose(got[g, f], math.sqrt(float((np.exp(-t * lam / limit) ** 2).sum())), rel_tol=1e-4)


def test_resistance_of_all_pairs(spark):
    e, nodes, dense = graphs_of(spark)
    e, nodes = (t.filter("graph_id IN (2, 4, 5)") for t in (e, nodes))
    pairs = nodes.withColumnRenamed("node", "a").join(nodes.withColumnRenamed("node", "b"), "graph_id")
    got = {(r.graph_id, r.a, r.b): r.r for r in kr.resistance_distance(e, nodes, pairs, 1e-10).collect()}
    for g in (2, 4, 5):
        p = np.linalg.pinv(dense[g])
        for a in range(len(p)):
            for b in range(len(p)):
                assert abs(got[g, a, b] - (p[a, a] + p[b, b] - p[a, b] - p[b, a])) <= 1e-6
