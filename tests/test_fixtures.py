"""Small hand fixtures (FIXTURES.md §3) and identities of the operators."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions import ranking as rk
from tessera.operators import features as ft
from tessera.operators import graph as gr
from tessera.operators import hypergraph as hg
from tessera.operators import sessions as ss
from tessera.operators import spectral as sp


def _dense(rows, n, i="i", j="j", v="w"):
    m = np.zeros((n, n))
    for r in rows:
        m[r[i], r[j]] += r[v]
    return m


def _edges(spark, mat, graph_id=0):
    rows = [(graph_id, i, j, float(w)) for i, row in enumerate(mat) for j, w in enumerate(row) if w != 0]
    return spark.createDataFrame(rows, "graph_id int, src int, dst int, w double")


def _nodes(spark, n, graph_id=0):
    return spark.createDataFrame([(graph_id, i) for i in range(n)], "graph_id int, node int")


# ------------------------------------------------------------------ sessions
def test_session_gap_strict(spark):
    # 7-day gap in seconds: 0 and 604800 stay together, 1209601 starts a new session
    df = spark.createDataFrame([(1, 0, 0), (1, 604800, 1), (1, 1209601, 2)], "u long, t long, id long")
    out = ss.sessionize(df, "u", "t", 604800, bucket=3600, tiebreak=["id"]).orderBy("t").collect()
    assert [r.session_no for r in out] == [0, 0, 1]
    assert [r.pos for r in out] == [0, 1, 0]
    assert [r.list_size for r in out] == [2, 2, 1]


@pytest.mark.parametrize("bucket", [1, 7, 50, 100])
def test_bucketed_equals_window_form(spark, bucket):
    rng = np.random.default_rng(3)
    rows = []
    for u in range(5):
        t = 0
        for k in range(60):
            t += int(rng.choice([1, 3, 20, 150, 400]))
            rows.append((u, t, k))
    df = spark.createDataFrame(rows, "u long, t long, id long")
    a = ss.sessionize(df, "u", "t", 100, bucket=bucket, tiebreak=["id"])
    b = ss.sessionize_window(df, "u", "t", 100)
    got = {(r.u, r.t): r.session_no for r in a.collect()}
    want = {(r.u, r.t): r.group_id for r in b.collect()}
    assert got == want


def test_history_list(spark):
    df = spark.createDataFrame([([5, 5, 7, 5, 9],)], "a array<int>")
    r = df.select(ss.history_list(F.col("a"), 2).alias("k2"), ss.history_list(F.col("a"), 5).alias("k5")).first()
    assert r.k2 == [7, 9]
    assert r.k5 == [-1, -1, 5, 7, 9]


# ------------------------------------------------------------------ hypergraph
def _toy_sessions(spark):
    rows = [(0, 1, 0, 0, 1), (0, 1, 0, 1, 2), (0, 1, 0, 2, 2), (0, 1, 0, 3, 3),
            (0, 2, 0, 0, 2), (0, 2, 0, 1, 4)]
    return spark.createDataFrame(rows, "graph_id int, geek_id long, session_no int, pos int, node int")


def test_hypergraph_views(spark):
    long = _toy_sessions(spark)
    inc1 = hg.session_incidence(long, "graph_id", ["geek_id", "session_no"], "node")
    nodes = hg.dense_nodes(inc1, 5)
    dv = {r.node: r.dv for r in hg.vertex_degree(inc1, nodes).collect()}
    assert dv == {0: 0, 1: 1, 2: 2, 3: 1, 4: 1}
    assert sorted(r.de for r in hg.edge_degree(inc1).collect()) == [2, 3]
    a1 = _dense(hg.adjacency(inc1).collect(), 5)
    t = 1 / 3
    want = np.zeros((5, 5))
    for i, j in [(1, 1), (1, 2), (1, 3), (2, 3), (3, 3)]:
        want[i, j] = want[j, i] = t
    want[2, 2] = 5 / 6
    want[2, 4] = want[4, 2] = want[4, 4] = 0.5
    assert np.allclose(a1, want)
    assert np.allclose(a1.sum(axis=1), [dv[i] for i in range(5)])   # row sums = degrees
    pairs = ss.consecutive_pairs(long, ["geek_id", "session_no"], "pos", "node")
    a2 = _dense(hg.adjacency(hg.successor_incidence(pairs)).collect(), 5)
    want2 = np.zeros((5, 5))
    want2[2, 2] = 4 / 3
    for i, j in [(2, 3), (2, 4), (3, 3), (3, 4), (4, 4)]:
        want2[i, j] = want2[j, i] = 1 / 3
    assert np.allclose(a2, want2)


# ------------------------------------------------------------------ metrics
def test_ranking_metrics(spark):
    df = spark.createDataFrame([([3, 1, 4, 1], [1, 5, 4])], "rec array<int>, tru array<int>")
    r = df.select(*rk.all_metrics(F.col("rec"), F.col("tru"))).first()
    assert r.hit is True
    assert r.ap == pytest.approx(0.638889, abs=1e-6)
    assert r.precision == pytest.approx(0.75)
    assert r.recall == pytest.approx(1.0)
    assert r.f1 == pytest.approx(0.857143, abs=1e-6)
    assert r.rr == pytest.approx(0.5)
    assert r.dcg == pytest.approx(1.561606, abs=1e-6)
    assert r.ndcg == pytest.approx(0.732829, abs=1e-6)


def test_metrics_no_hit(spark):
    df = spark.createDataFrame([([7, 8], [1, 2])], "rec array<int>, tru array<int>")
    r = df.select(*rk.all_metrics(F.col("rec"), F.col("tru"))).first()
    assert (r.hit, r.ap, r.precision, r.f1, r.rr, r.ndcg) == (False, 0.0, 0.0, 0.0, 0.0, 0.0)


# ------------------------------------------------------------------ graph utilities
W3 = [[0, 3, 0], [3, 1, 6], [4, 2, 3]]


@pytest.mark.parametrize("method,want", [
    ("average", [[0, 3, 2], [3, 1, 4], [2, 4, 3]]),
    ("maximum", [[0, 3, 4], [3, 1, 6], [4, 6, 3]]),
    ("fill", [[0, 3, 4], [3, 1, 4], [4, 4, 3]]),
    ("tril", [[0, 3, 4], [3, 1, 2], [4, 2, 3]]),
    ("triu", [[0, 3, 0], [3, 1, 6], [0, 6, 3]]),
])
def test_symmetrize(spark, method, want):
    out = gr.symmetrize(_edges(spark, W3), method).collect()
    assert np.allclose(_dense(out, 3, "src", "dst"), want)


def test_weight_checks(spark):
    e = _edges(spark, [[0, 1], [2, 3]])
    r = gr.check_weights(e, _nodes(spark, 2)).first()
    assert (r.has_inf_val, r.has_nan_value, r.is_not_square, r.diag_is_not_zero) == (False, False, False, True)


def test_rescale_center(spark):
    x = [[1, 6], [2, 5], [3, 4]]            # rows = dimensions, columns = points
    rows = [(p, d, float(x[d][p])) for d in range(3) for p in range(2)]
    df = spark.createDataFrame(rows, "p int, dim int, val double")
    out = {(r.dim, r.p): r.val for r in gr.rescale_center(df, "p").collect()}
    want = [[-1, 1], [-0.6, 0.6], [-0.2, 0.2]]
    for d in range(3):
        for p in range(2):
            assert out[(d, p)] == pytest.approx(want[d][p])


def test_log_scales(spark):
    b = spark.createDataFrame([(0, 1.0, 10.0)], "graph_id int, lmin double, lmax double")
    got = [r.scale for r in gr.log_scales(b, 3).orderBy("k").collect()]
    assert got == pytest.approx([2.0, 0.4472136, 0.1], abs=1e-7)


def test_distances(spark):
    pts = spark.createDataFrame([(i, [float(i)]) for i in range(3)], "id int, v array<double>")
    refs = spark.createDataFrame([(i, [float(i)]) for i in range(3)], "rid int, rv array<double>")
    d = {(r.id, r.rid): r.dist for r in gr.distances_to(pts, refs, "v", "rid", "rv").collect()}
    assert np.allclose([[d[(i, j)] for j in range(3)] for i in range(3)], [[0, 1, 2], [1, 0, 1], [2, 1, 0]])


def test_laplacian_identities(spark):
    rng = np.random.default_rng(0)
    m = rng.random((6, 6)) * (rng.random((6, 6)) > 0.4)
    m = np.triu(m, 1)
    m = m + m.T
    e, nodes = _edges(spark, m), _nodes(spark, 6)
    lap = gr.laplacian(e, nodes).collect()
    L = _dense(lap, 6, v="v")
    assert np.allclose(L, np.diag(m.sum(1)) - m)
    assert np.allclose(L @ np.ones(6), 0)                       # L·1 = 0
    dop = gr.differential_operator(e, nodes)
    sig = spark.createDataFrame([(0, i, float(i * i)) for i in range(6)], "graph_id int, node int, val double")
    back = {r.node: r.val for r in gr.div(dop, gr.grad(dop, sig), nodes).collect()}
    assert np.allclose([back[i] for i in range(6)], L @ np.arange(6.0) ** 2)   # div(grad s) = L s
    nl = _dense(gr.laplacian(e, nodes, "normalized").collect(), 6, v="v")
    d = m.sum(1) ** -0.5
    assert np.allclose(nl, np.eye(6) - d[:, None] * m * d[None, :])
    lm = gr.lmax_exact(gr.laplacian(e, nodes), nodes).first().lmax
    assert lm == pytest.approx(np.linalg.eigvalsh(L)[-1] * 1.01)
    lp = gr.lmax_power(gr.laplacian(e, nodes), nodes, tol=1e-6).first().lmax
    assert lp == pytest.approx(np.linalg.eigvalsh(L)[-1] * 1.01, rel=1e-3)


def test_laplacian_of_tiny_weights_is_complete(spark):
    m = np.array([[0, 1e-13, 0], [1e-13, 0, 2e-13], [0, 2e-13, 0]])
    e, nodes = _edges(spark, m), _nodes(spark, 3)
    got = _dense(gr.laplacian(e, nodes).collect(), 3, v="v")
    assert np.allclose(got * 1e13, (np.diag(m.sum(1)) - m) * 1e13)


def test_lmax_power_ends_at_the_top_and_keeps_empty_graphs(spark):
    m = np.zeros((30, 30))
    for i in range(29):          # a path: the top eigenvalues lie close together
        m[i, i + 1] = m[i + 1, i] = 1
    e = _edges(spark, m)
    nodes = _nodes(spark, 30).union(spark.createDataFrame([(1, 0), (1, 1)], "graph_id int, node int"))
    lap = gr.laplacian(e, nodes)
    got = {r.graph_id: r.lmax for r in gr.lmax_power(lap, nodes).collect()}
    true = np.linalg.eigvalsh(np.diag(m.sum(1)) - m)[-1]
    assert got[1] == 0 and true <= got[0] <= 2 * m.sum(1).max()


def test_partitioned_sink_splits_a_hot_value(spark):
    import os
    import uuid

    from tessera.session import ensure_checkpoint_dir
    from tessera.sources import io
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/hot-{uuid.uuid4().hex}"
    df = spark.range(20000).withColumn("k", F.when(F.col("id") % 10 == 0, 1).otherwise(0))
    conf = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        io.write_partitioned(df, path, "k")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", conf)
    local = path.removeprefix("file:")
    assert len([f for f in os.listdir(f"{local}/k=0") if f.endswith(".parquet")]) > 2
    assert spark.read.parquet(path).count() == 20000


def test_components_and_connectivity(spark):
    m = np.zeros((6, 6))
    for a, b in [(0, 1), (1, 2), (3, 4)]:
        m[a, b] = m[b, a] = 1
    e, nodes = _edges(spark, m), _nodes(spark, 6)
    comp = {r.node: r.component for r in gr.components(e, nodes).collect()}
    assert comp == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3, 5: 5}
    assert gr.is_connected(e, nodes).first().connected is False
    ring = np.roll(np.eye(4), 1, axis=1)     # directed cycle: strongly connected
    assert gr.is_connected(_edges(spark, ring), _nodes(spark, 4), directed=True).first().connected


# ------------------------------------------------------------------ spectral
def test_heat_cheby_coefficients(spark):
    g = spark.createDataFrame([(0, 4.0), (1, 17.0)], "graph_id int, lmax double")
    c = sp.cheby_coeff(g, [1.0, -1.0], m=3).collect()
    got = {(r.graph_id, r.t, r.k): r.c for r in c}
    for gid in (0, 1):   # independent of lmax
        assert [got[(gid, 1.0, k)] for k in range(4)] == pytest.approx(
            [1.290071, -0.312842, 0.038704, -0.003199], abs=1e-6)
        assert [got[(gid, -1.0, k)] for k in range(4)] == pytest.approx(
            [3.506775, 0.850392, 0.105208, 0.008695], abs=1e-6)


def test_path_wavelets(spark):
    m = np.array([[0, 1, 0], [1, 0, 1], [0, 1, 0]], dtype=float)
    e, nodes = _edges(spark, m), _nodes(spark, 3)
    lap = gr.laplacian(e, nodes)
    graphs = gr.lmax_bound(e, nodes)                   # 2 · max dw = 4
    w = sp.wavelets(lap, nodes, graphs, [-1.0, 1.0], order=3).collect()
    fwd = _dense([r for r in w if r.t == 1.0], 3, v="val")
    inv = _dense([r for r in w if r.t == -1.0], 3, v="val")
    assert fwd[0] == pytest.approx([0.801633, 0.175811, 0.022555], abs=1e-6)
    assert fwd[1] == pytest.approx([0.175811, 0.648378, 0.175811], abs=1e-6)
    assert inv[0] == pytest.approx([0.967999, 0, 0.032001], abs=1e-6)
    assert inv[1] == pytest.approx([0, 1, 0], abs=1e-6)
    assert np.allclose(np.abs(fwd).sum(1), 1)           # rows L1-normalized


def test_fourier_roundtrip_and_exact_filter(spark):
    rng = np.random.default_rng(1)
    m = np.triu(rng.random((5, 5)), 1)
    m = m + m.T
    e, nodes = _edges(spark, m), _nodes(spark, 5)
    lap = gr.laplacian(e, nodes)
    spec = sp.spectrum(lap, nodes)
    s = spark.createDataFrame([(0, i, float(i + 1)) for i in range(5)], "graph_id int, node int, val double")
    back = {r.node: r.val for r in sp.igft(spec, sp.gft(spec, s)).collect()}
    assert np.allclose([back[i] for i in range(5)], np.arange(1, 6))
    graphs = gr.lmax_bound(e, nodes)
    lmax = graphs.first().lmax
    ex = {r.node: r.val for r in sp.exact_filter(spec, s, graphs, [1.0]).collect()}
    L = np.diag(m.sum(1)) - m
    lam, u = np.linalg.eigh(L)
    want = u @ np.diag(np.exp(-lam / lmax)) @ u.T @ np.arange(1, 6)
    assert np.allclose([ex[i] for i in range(5)], want)


def test_scale_list():
    assert sp.scale_list(1) == [-1.0, 1.0]
    assert sp.scale_list(3) == [-1 / 3, 1 / 3, -0.5, 0.5, -1.0, 1.0]


# ------------------------------------------------------------------ ML
def test_silhouette_matches_hand_formula(spark):
    pts = spark.createDataFrame([([1.0], 0), ([2.0], 0), ([4.0], 0), ([9.0], 1)], "v array<double>, c int")
    s = ft.silhouette_table(pts, "v", "c").first().silhouette
    assert s == pytest.approx(0.652714, abs=1e-6)


def test_string_index_order(spark):
    train = spark.createDataFrame([("b",), ("a",), ("c",), ("c",)], "x string")
    test = spark.createDataFrame([("c",), ("a",), ("b",), ("z",), (None,)], "x string")
    model = ft.string_index(train, ["x"])
    got = [r.x_idx for r in model.transform(test).collect()]
    assert got == [0.0, 1.0, 2.0, 3.0, 3.0]


def test_block_wavelets_equal_join_wavelets(spark):
    from tessera.operators import blocks as bm
    rng = np.random.default_rng(7)
    rows = []
    for g in range(3):
        m = np.triu(rng.random((8, 8)) * (rng.random((8, 8)) > 0.5))
        m = m + m.T
        rows += [(g, i, j, float(m[i, j])) for i in range(8) for j in range(8) if m[i, j] != 0]
    e = spark.createDataFrame(rows, "graph_id long, src int, dst int, w double")
    nodes = hg.dense_nodes(e, 8)
    lap = gr.laplacian(e, nodes)
    graphs = gr.lmax_bound(e, nodes)
    a = {(r.graph_id, r.filter, r.i, r.j): r.val
         for r in sp.wavelets(lap, nodes, graphs, [-1.0, 1.0]).collect()}
    b = {(r.graph_id, r.filter, r.i, r.j): r.val
         for r in bm.wavelets(lap, nodes, graphs, [-1.0, 1.0], block=3).collect()}
    c = {(r.graph_id, r.filter, r.i, r.j): r.val
         for r in bm.wavelets(e, nodes, graphs, [-1.0, 1.0], from_weights=True).collect()}
    assert a.keys() == b.keys() == c.keys()
    assert all(abs(a[k] - b[k]) < 1e-9 and abs(a[k] - c[k]) < 1e-9 for k in a)


def test_block_wavelets_of_a_large_graph(spark):
    """More nodes than the former dense form took, many blocks, text keys, one small graph."""
    from tessera.operators import blocks as bm
    n = 2_100
    ring = spark.range(n).select(F.lit("ring").alias("graph_id"), F.col("id").cast("int").alias("src"),
                                 ((F.col("id") + 1) % n).cast("int").alias("dst"))
    small = spark.createDataFrame([("two", 0, 1)], "graph_id string, src int, dst int")
    one = ring.unionByName(small)
    e = (one.unionByName(one.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst")))
         .withColumn("w", F.lit(1.0)))
    nodes = e.select("graph_id", F.col("src").alias("node")).distinct()
    graphs = spark.createDataFrame([("ring", 4.0), ("two", 2.0)], "graph_id string, lmax double")
    w = bm.wavelets(e, nodes, graphs, [-1.0, 1.0], order=3, from_weights=True, block=128)
    rows = {(r.graph_id, r["filter"], r.i, r.j): r.val for r in w.filter("i in (0, 1)").collect()}

    def dense(lap, lmax, t):
        a = (lmax + 1e-5) / 2
        m = lap / a - np.eye(len(lap))
        terms = [np.eye(len(lap)), m, 2 * m @ m - np.eye(len(lap))]
        terms.append(2 * m @ terms[2] - m)
        th = np.pi * (np.arange(4) + 0.5) / 4
        g = np.exp(-t * (lmax / 2 * np.cos(th) + lmax / 2) / lmax)
        c = [0.5 * (g * np.cos(k * th)).sum() for k in range(4)]
        r = 0.5 * c[0] * terms[0] + sum(c[k] * terms[k] for k in range(1, 4))
        r = np.where(r >= 0, r, 0.0)
        return r / np.abs(r).sum(axis=1, keepdims=True)

    size = 40  # a shorter ring has the same rows, order 3 reaches three steps
    lap = 2 * np.eye(size) - np.roll(np.eye(size), 1, axis=0) - np.roll(np.eye(size), -1, axis=0)
    for f, t in enumerate([-1.0, 1.0]):
        ring_row, two = dense(lap, 4.0, t)[0], dense(np.array([[1.0, -1], [-1, 1]]), 2.0, t)
        for j in (0, 1, 2, 3, n - 1, n - 2, n - 3):
            want = ring_row[j if j < 4 else j - n]
            assert abs(rows.get(("ring", f, 0, j), 0.0) - want) < 1e-9
        assert all(abs(rows.get(("two", f, i, j), 0.0) - two[i, j]) < 1e-9 for i in (0, 1) for j in (0, 1))


def test_label_dedupe_and_rejects(spark):
    from tessera.operators import prep
    log = spark.createDataFrame([(1, 10), (2, 11)], "geek_id long, job_id long")
    person = spark.createDataFrame([(1, 0), (1, 0), (2, 1)], "geek_id long, pc int")
    job = spark.createDataFrame([(10, 5), (11, 6)], "job_id long, jc int")
    assert prep.label_with_classes(log, person, job, ["geek_id"], ["job_id"]).count() == 3
    assert prep.label_with_classes(log, person, job, ["geek_id"], ["job_id"], dedupe=True).count() == 2
    e = _edges(spark, [[0, 1], [1, 0]])
    nodes = _nodes(spark, 2).unionByName(_nodes(spark, 2, graph_id=1))
    assert [r.graph_id for r in sp.rejected_graphs(e, nodes).collect()] == [1]


def test_history_modes_differ_only_in_history(spark):
    from tessera.operators import samples as smp
    rows = []
    for g_sess, (uid, items) in enumerate([(1, list(range(40))), (2, [5] * 35), (3, list(range(30, 70)))]):
        rows += [(0, uid, 0, p, 40 if uid != 2 else 35, it) for p, it in enumerate(items)]
    long = spark.createDataFrame(rows, "first_person_class int, geek_id long, session_no int, pos int, "
                                       "list_size int, job_class int")
    g = smp.class_graphs(long, 30, materialize_long=False)
    header = smp.sample_header(g, 20)
    ti = smp.target_items(g, 20)
    last = {(r.geek_id, r.i) for r in smp.history_rows(g, ti, header, "last").collect()}
    # the class's last session is (3, 0): other samples get all its items, itself its prefix
    assert {i for (u, i) in last if u == 1} == set(range(30, 70))
    assert {i for (u, i) in last if u == 3} == set(range(30, 50))


def test_collect_sessions_chunks_long_sessions(spark):
    df = spark.createDataFrame([(1, t, t) for t in range(25)], "u long, t long, id long")
    long = ss.sessionize(df, "u", "t", 10, bucket=5, tiebreak=["id"])
    rows = ss.collect_sessions(long, "u", "t", ["id"], tiebreak=["id"], chunk=10).orderBy("chunk_no").collect()
    assert [r.id_list for r in rows] == [list(range(10)), list(range(10, 20)), list(range(20, 25))]
    assert {r.list_size for r in rows} == {25}


def test_frame_bounds_on_eigenvalues(spark):
    m = np.array([[0, 1, 0], [1, 0, 1], [0, 1, 0]], dtype=float)
    e, nodes = _edges(spark, m), _nodes(spark, 3)
    lap = gr.laplacian(e, nodes)
    spec = sp.spectrum(lap, nodes)
    graphs = gr.lmax_bound(e, nodes)
    r = sp.frame_bounds_eigenvalues(spec, graphs, [-1.0, 1.0]).first()
    lam = np.linalg.eigvalsh(np.diag(m.sum(1)) - m)
    lam[0] = 0.0
    s = np.exp(lam / 4) ** 2 + np.exp(-lam / 4) ** 2
    assert (r.a, r.b) == pytest.approx((s.min(), s.max()))
    assert sp.coherence(spec).first().mu == pytest.approx(np.abs(np.linalg.eigh(np.diag(m.sum(1)) - m)[1]).max())


def test_tie_safe_sql_rewrite():
    from tessera.plans.registry import tie_safe_sql
    sql = "SELECT ROUND(SUM(a / (b + 1)), 6) AS x, ROUND(y, 4) AS y, ROUND(f(ROUND(z, 6), 2), 6) FROM t"
    assert tie_safe_sql(sql) == ("SELECT ROUND((SUM(a / (b + 1))) + 1e-09, 6) AS x, ROUND(y, 4) AS y, "
                                 "ROUND((f(ROUND((z) + 1e-09, 6), 2)) + 1e-09, 6) FROM t")


@pytest.mark.parametrize("bucket", [5, 50, 100])
def test_session_flags_equal_window_form(spark, bucket):
    rng = np.random.default_rng(11)
    rows, k = [], 0
    for u in range(4):
        t = 0
        for _ in range(50):
            t += int(rng.choice([1, 7, 60, 150, 500]))
            rows.append((u, t, k))
            k += 1
    df = spark.createDataFrame(rows, "u long, t long, id long")
    cols = ["u", "t", "prev_time", "time_diff", "new_record", "group_id"]
    a = {tuple(r) for r in ss.session_flags(df, "u", "t", 100, bucket=bucket, tiebreak=["id"]).select(*cols).collect()}
    b = {tuple(r) for r in ss.sessionize_window(df, "u", "t", 100).select(*cols).collect()}
    assert a == b


def test_every_term_is_counted(spark):
    from tessera.operators import features as ft
    df = spark.createDataFrame([(1, ["a", "b", "a"]), (2, ["c"])], "id long, tok array<string>")
    assert {tuple(r) for r in ft.term_counts(df, "id", "tok").collect()} == {(1, "a", 2.0), (1, "b", 1.0), (2, "c", 1.0)}


def test_long_path_in_few_rounds(spark, monkeypatch):
    import random

    from tessera.operators import graph as gr
    ids = list(range(10_000))
    random.Random(1).shuffle(ids)
    edges = [(1, i, i + 1, 1.0) for i in range(9_999)] + [(2, a, b, 1.0) for a, b in zip(ids, ids[1:], strict=False)]
    e = spark.createDataFrame(edges, "graph_id int, src int, dst int, w double")
    n = spark.createDataFrame([(g, i) for g in (1, 2, 3) for i in range(10_000)], "graph_id int, node int")
    calls, real = [], gr.materialize
    monkeypatch.setattr(gr, "materialize", lambda df: calls.append(1) or real(df))
    got = gr.components(e, n).groupBy("graph_id").agg({"component": "max"}).collect()
    assert {tuple(r) for r in got} == {(1, 0), (2, 0), (3, 9_999)}
    assert len(calls) - 2 <= 20, len(calls)


def test_density_keeps_graphs_without_entries(spark):
    from tessera.operators import spectral as sp
    m = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.0), (1, 1, 2.0)], "graph_id long, filter int, val double")
    n = spark.createDataFrame([(g, i) for g in (1, 2) for i in range(2)], "graph_id long, node int")
    got = {(r.graph_id, r.filter): r.density for r in sp.density(m, n, 2).collect()}
    assert got == {(1, 0): 25.0, (1, 1): 25.0, (2, 0): 0.0, (2, 1): 0.0}


def test_sample_rows_keep_light_edges(spark):
    """The cut of rounding residues is relative to the class weight."""
    from tessera.operators import samples as sa
    header = spark.createDataFrame([(7, 1, 3)], "geek_id long, session_no long, graph_id int")
    adj = spark.createDataFrame([(3, 0, 1, 1e-13), (3, 1, 0, 1.0), (3, 1, 1, 0.3)], "graph_id int, i int, j int, w double")
    delta = spark.createDataFrame([(7, 1, 1, 0, -0.25), (7, 1, 1, 1, -0.1), (7, 1, 1, 1, -0.1), (7, 1, 1, 1, -0.1)],
                                  "geek_id long, session_no long, i int, j int, w double")
    got = {(r.i, r.j): r.w for r in sa.sample_adjacency(header, adj, delta, 3).collect()}
    assert got == {(0, 1): 1e-13, (1, 0): 0.75}
    some = spark.createDataFrame([(7, 1, 0)], "geek_id long, session_no long, i int")
    assert {(r.i, r.j) for r in sa.sample_adjacency(header, adj, delta, rows=some).collect()} == {(0, 1)}


def test_calendar_prunes_the_folders_of_the_log(spark):
    from tessera.plans.catalog import QUERIES
    plan = QUERIES["p2_partitioned_split"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    scans = [x for x in plan.split("PartitionFilters: ")[1:] if "dynamicpruning" in x.split("PushedFilters")[0]]
    assert len(scans) == 2, plan


def test_exact_lmax_keeps_graphs_without_entries(spark):
    from tessera.operators import graph as gr
    big = 1 << 40
    e = spark.createDataFrame([(big, 0, 1, 1.0), (big, 1, 0, 1.0)], "graph_id long, src int, dst int, w double")
    n = spark.createDataFrame([(g, i) for g in (big, 2) for i in range(2)], "graph_id long, node int")
    got = {r.graph_id: r.lmax for r in gr.lmax_exact(gr.laplacian(e, n), n).collect()}
    assert abs(got[big] - 2.02) < 1e-9 and got[2] == 0.0


def test_large_bucket_spreads_over_tasks(spark):
    """One user with a third of all events in one hour: same sessions, bounded slices."""
    hour = 3_600_000_000
    hot = spark.range(20_000).select(F.lit(1).cast("long").alias("u"),
                                     (F.col("id") * F.col("id") % hour + 5 * hour).alias("t"),
                                     F.col("id").alias("e"))
    rest = spark.range(20_000, 60_000).select((F.col("id") % 97 + 2).alias("u"),
                                              (F.col("id") * 7_919 % (30 * hour)).alias("t"),
                                              F.col("id").alias("e"))
    log = hot.unionByName(rest).withColumn("c", F.col("e") % 7)
    args = dict(key="u", time_col="t", gap=hour, tiebreak=["e"], session_cols=["c"])
    want = ss.sessionize(log, **args)
    got = ss.sessionize_split(log, split_rows=500, **args)
    assert got.columns == want.columns
    assert got.exceptAll(want).isEmpty() and got.count() == want.count()
    few = ss.sessionize_split(log, split_rows=500, broadcast_rows=0, **args)  # the shuffle way
    assert few.exceptAll(want).isEmpty() and few.count() == want.count()
    none = ss.sessionize_split(log, split_rows=10**6, **args)
    assert none.exceptAll(want).isEmpty() and none.count() == want.count()
    assert ss.sessionize_split(log.limit(0), **args).count() == 0
    # as on a large log: no side is small enough to be broadcast, no partitions are merged
    small = {"spark.sql.adaptive.coalescePartitions.enabled": "false",
             "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        # the largest position keeps the numbering in the plan
        shares = [r.n for r in got.filter("u = 1").withColumn("p", F.spark_partition_id())
                  .groupBy("p").agg(F.count("*").alias("n"), F.max("pos")).collect()]
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(shares) == 20_000 and max(shares) < 8_000


def test_relation_store_folders(spark, tmp_path):
    """Folders depend on classes and buckets, not on sessions; a session reads one folder."""
    import os

    from tessera.sources import io
    rows = (spark.range(3_000).select(
        (F.col("id") % 3).cast("int").alias("person_class"), F.col("id").cast("int").alias("session_no"),
        F.lit(0).alias("id"), F.lit(4).alias("pred_job"), F.col("id").alias("unix_time"),
        F.to_date(F.lit("2020-01-01")).alias("date"), F.col("id").alias("job_id"),
        F.col("id").alias("geek_id")))
    path = str(tmp_path / "rel")
    io.write_relations(rows, path, buckets=8)
    folders = [d for d, sub, _ in os.walk(path) if "session_bucket=" in os.path.basename(d)]
    assert len(folders) == 3 * 8
    back = io.read_relations(spark, path, buckets=8)
    assert back.select(rows.columns).exceptAll(rows).isEmpty() and back.count() == 3_000
    one = io.read_relations(spark, path, person_class=1, session_no=1_000, buckets=8)
    assert [r.geek_id for r in one.collect()] == [1_000]
    assert "PartitionFilters: [isnotnull(person_class" in \
        one._jdf.queryExecution().executedPlan().toString()


def test_numbering_without_a_window_over_a_graph(spark):
    """Edge numbers and renumbered nodes over several ranges, with a repeated node."""
    n = 9_000
    ring = spark.range(n).select(F.lit(7).alias("graph_id"), F.col("id").cast("int").alias("src"),
                                 ((F.col("id") + 1) % n).cast("int").alias("dst"))
    e = (ring.unionByName(ring.select("graph_id", F.col("dst").alias("src"), F.col("src").alias("dst")))
         .withColumn("w", F.lit(1.0)))
    got = [(r.e, r.v_in, r.v_out) for r in gr.edge_list(e).orderBy("e").collect()]
    pairs = sorted({(max(a, (a + 1) % n), min(a, (a + 1) % n)) for a in range(n)})
    assert got == [(k, a, b) for k, (a, b) in enumerate(pairs)]
    keep = spark.range(1_000, 8_000).select(F.lit(7).alias("graph_id"), F.col("id").cast("int").alias("node"))
    sub = gr.subgraph(e, keep.unionByName(keep.filter("node < 1010")))
    assert {(r.src, r.dst) for r in sub.collect()} == (
        {(a, a + 1) for a in range(6_999)} | {(a + 1, a) for a in range(6_999)})
    assert sub.count() == 2 * 6_999
    plan = gr.edge_list(e)._jdf.queryExecution().executedPlan().toString()
    assert "row_number() windowspecdefinition(graph_id" in plan and ", _ob#" in plan


def test_triangles_with_negative_weights(spark):
    e = spark.createDataFrame([(0, 0, 1, -2.0), (0, 1, 0, 3.0), (0, 1, 1, -1.0), (0, 2, 0, -4.0)],
                              "graph_id int, src int, dst int, w double")
    got = {(r.method, r.src, r.dst): r.w for r in gr.symmetrize_by(e, ["tril", "triu"]).collect()}
    assert got == {("tril", 1, 0): 3.0, ("tril", 0, 1): 3.0, ("tril", 1, 1): -1.0, ("triu", 1, 1): -1.0}


def test_view1_corrections_are_rows_of_the_target(spark):
    """A target's row is formed from its members alone; no sum over pairs of members."""
    from tessera.operators import samples as sa
    ti = spark.createDataFrame([(7, 1, 0, True, 3, 2), (7, 1, 4, True, 3, 2), (7, 1, 9, False, 3, 2), (8, 0, 5, False, 1, 0)],
                               "geek_id long, session_no long, node int, in_q boolean, n_f long, n_q long")
    delta, _ = sa.view1_delta(ti)
    assert delta.columns == ["geek_id", "session_no", "i", "changed"] and sa.changed_rows(delta) is delta
    got = {(r.geek_id, r.i): r.changed for r in delta.collect()}
    both, one = pytest.approx(1 / 2 - 1 / 3), pytest.approx(-1 / 3)
    assert got == {(7, 0): {0: both, 4: both, 9: one}, (7, 4): {0: both, 4: both, 9: one},
                   (7, 9): {0: one, 4: one, 9: one}, (8, 5): {5: -1.0}}


def test_overlay_joins_class_rows_last(spark):
    """Further columns stay with their row, and no exchange lies above the class rows."""
    from tessera.operators import samples as sa
    wanted = spark.createDataFrame([(7, 1, 3, 0, 5)], "geek_id long, session_no long, graph_id int, i int, dv long")
    base = sa.class_rows(spark.createDataFrame([(3, 0, 1, 1.0)], "graph_id int, i int, j int, w double"))
    delta = spark.createDataFrame([(7, 1, 0, 1, -0.25)], "geek_id long, session_no long, i int, j int, w double")
    out = sa.overlay(wanted, base, sa.changed_rows(delta))
    assert [(r.dv, r.row[0].w) for r in out.collect()] == [(5, 0.75)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner") < plan.index("Join LeftOuter")


def test_wavelets_of_packed_rows(spark):
    from tessera.operators import blocks as bm
    e = _edges(spark, [[0.5, 1, 0, 0], [1, 0, 2, 0], [0, 2, 0, 0], [0, 0, 0, 0]]).unionByName(
        _edges(spark, [[0, 3], [3, 1]], graph_id=1))
    nodes = _nodes(spark, 4).unionByName(_nodes(spark, 2, graph_id=1))
    top = gr.lmax_bound(e, nodes)
    rows = e.groupBy("graph_id", F.col("src").alias("i")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("dst").alias("j"), "w"))).alias("row"))
    want, got = ({(r.graph_id, r.filter, r.t, r.i, r.j): r.val for r in bm.wavelets(
        x, nodes, top, [-1.0, 1.0], from_weights=True, block=3).collect()} for x in (e, rows))
    assert got == pytest.approx(want) and len(got) > 20


def test_person_profile_fits_read_no_source_again(spark, tmp_path, monkeypatch):
    import datetime
    from tessera.plans import profiles
    path = str(tmp_path / "snapshots")
    spark.createDataFrame(
        [(i, datetime.date(2020, 1 + 5 * (i % 2), 1 + i), ["a", "b"][:1 + i % 2], i, 1.0 * i, i % 3, 2.0 * i, "xy"[i % 2]) for i in range(12)],
        "geek_id long, date date, tokens array<string>, n_lines long, total_price double, nation int, acctbal double, segment string",
    ).write.parquet(path)
    monkeypatch.setattr(profiles, "person_snapshots", lambda t: spark.read.parquet(path))
    seen, fit = [], ft.fit_apply

    def watched(stages, train, *others):
        seen.append(train._jdf.queryExecution().executedPlan().toString())
        return fit(stages, train, *others)

    monkeypatch.setattr(ft, "fit_apply", watched)
    assert profiles.person_profile(spark, "unused", k=2, topics=2, max_iter=1).count() == 12
    assert len(seen) == 1 and "parquet" not in seen[0]


def test_online_topics_are_those_of_the_plain_steps(spark):
    """Two iterations over all documents against a loop over documents and terms."""
    from tessera.operators import topics as tp
    texts = ["a b b c", "c d d", None, "", "a a a e", "f g c", "a b b c", "e"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").select(
        "doc_id", F.split("text", " ").alias("tok"))
    bag = ft.bag_of_words(docs.repartition(3), ["doc_id"], "tok")
    model = tp.fit(bag, 2, 2, seed=3, share=1.0, tau0=1.0)
    assert model.terms().count() == 8  # the empty string is a term of the empty text

    hashes = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64("doc_id", F.col("tok")).alias("h")).collect()}
    words = {i: ([] if t is None else t.split(" ")) for i, t in enumerate(texts)}
    vocab = sorted({w for x in words.values() for w in x})
    start = {r.term: r.h for r in spark.createDataFrame([(w,) for w in vocab], "term string").select(
        "term", F.xxhash64("term").alias("h")).collect()}
    lam = tp._gamma(np.array([start[w] for w in vocab]), 2, ~3)
    alpha = np.full(2, 0.5)

    def steps(i, beta, alpha, seed):
        g = tp._gamma(np.array([hashes[i]]), 2, seed)[0]
        ids = [vocab.index(w) for w in words[i]]
        while True:
            t = np.exp(tp._expectation(g))
            new = alpha + sum(t * beta[w] / (t * beta[w]).sum() for w in ids)
            g, moved = new, np.abs(new - g).mean()
            if moved <= 1e-3:
                return g, ids

    for it in (1, 2):
        beta, stat, logp = np.exp(tp.digamma(lam) - tp.digamma(lam.sum(0))), np.zeros_like(lam), []
        for i in (i for i in words if words[i]):
            g, ids = steps(i, beta, alpha, 3 + it)
            logp.append(tp._expectation(g))
            for w in ids:
                phi = np.exp(logp[-1]) * beta[w]
                stat[w] += phi / phi.sum()
        rho = (1 + it) ** -0.51
        lam = lam * (1 - rho) + rho * (stat + 0.5)
        alpha = tp._next_alpha(alpha, np.mean(logp, 0), len(logp), rho)
    got = {r.term: r.weight for r in model.terms().collect()}
    assert np.array([got[w] for w in vocab]) == pytest.approx(lam, rel=1e-6)
    assert model.alpha == pytest.approx(alpha, rel=1e-6)

    dist = {r.doc_id: r.topicDistribution for r in model.transform(bag).collect()}
    beta = np.exp(tp.digamma(lam) - tp.digamma(lam.sum(0)))
    for i in words:
        g = steps(i, beta, alpha, 3)[0] if words[i] else np.zeros(2)
        assert dist[i] == pytest.approx(g / max(g.sum(), 1e-300), rel=1e-6)
    assert tp.digamma(np.array([1.0, 0.1])) == pytest.approx([-0.5772156649, -10.4237549404])
    assert tp.trigamma(np.array([1.0, 0.1])) == pytest.approx([1.6449340668, 101.4332991508])
    other = ft.bag_of_words(spark.createDataFrame([(1, ["a", "new"]), (2, ["new"])], "doc_id long, tok array<string>"), ["doc_id"], "tok")
    rest = {r.doc_id: r.topicDistribution for r in model.transform(other).collect()}
    assert sum(rest[1]) == pytest.approx(1) and rest[2] == [0, 0]


def test_fits_bound_the_rows_of_a_task(spark, monkeypatch):
    """A shuffle of few bytes is few partitions, whatever the rows weigh as objects."""
    monkeypatch.setattr(ft, "TASK_ROWS", 1000)
    df = spark.range(20_000).select("id", F.sin("id").alias("a"), F.cos("id").alias("b")).repartition(1)
    stages = [ft.assemble(["a", "b"]), ft.scaler(), ft.kmeans(2)]
    _, (tr, te) = ft.fit_apply(stages, df, df.limit(10))
    sizes = [r["count"] for r in tr.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) >= 20 and max(sizes) <= 1500 and sum(sizes) == 20_000
    assert te.count() == 10
    few = df.limit(500)
    assert ft.bounded_tasks(few) is few


def test_topics_gather_no_block_as_objects(spark):
    """What was said of a block's terms comes sorted by block, not as lists of all blocks of a task."""
    from tessera.operators import topics as tp
    docs = spark.createDataFrame([(i, [f"w{j}" for j in range(i % 7)] + [None]) for i in range(40)], "doc_id long, tok array<string>")
    bag = ft.bag_of_words(docs.repartition(4), ["doc_id"], "tok")
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    model = tp.fit(bag, 2, 2, share=0.5)
    assert spark.conf.get(key, None) == before
    out = model.transform(bag)
    assert "collect_list" not in out._jdf.queryExecution().executedPlan().toString()
    dist = {r.doc_id: sum(r.topicDistribution) for r in out.collect()}
    assert dist == pytest.approx({i: min(i % 7, 1) for i in range(40)})


def test_weighted_fits_are_those_of_repeated_rows(spark):
    rows = [("b", 3, [0.0, 1.0]), ("a", 2, [0.5, 1.5]), ("a", 1, [9.0, 7.0]), (None, 9, [9.5, 8.0]), ("c", 1, [0.2, 1.0])]
    df = spark.createDataFrame(rows, "x string, n int, v array<double>").withColumn("features", ft.as_vector("v", "features"))
    each = df.withColumn("again", F.explode(F.array_repeat(F.lit(0), F.col("n")))).drop("again")
    one, two = (m.labelsArray for m in (ft.string_index(df, ["x"], weight="n"), ft.string_index(each, ["x"])))
    assert [*map(list, one)] == [*map(list, two)] == [["a", "b", "c"]]
    (m1, (tr, te)), (m2, (tr2,)) = (ft.fit_apply([ft.scaler(), ft.kmeans(2)], x, *o, **k) for x, o, k in (
        (df, [df.limit(2)], {"weight": "n"}), (each, [], {})))
    assert te.count() == 2
    assert list(m1.stages[0].std) == pytest.approx(list(m2.stages[0].std))
    c1, c2 = (sorted(map(list, m.stages[1].clusterCenters())) for m in (m1, m2))
    assert c1[0] == pytest.approx(c2[0]) and c1[1] == pytest.approx(c2[1])
    assert ft.silhouette(tr, "scaled", "prediction", weight="n") == pytest.approx(ft.silhouette(tr2, "scaled", "prediction"))


def test_job_profile_fits_on_jobs(spark, tmp_path, monkeypatch):
    """Fits and predictions see a job once a split, however many days it has."""
    import datetime
    from tessera.plans import profiles
    day = lambda i: None if i is None else datetime.datetime(2020, 1, 1) + datetime.timedelta(days=i)
    days = {1: [*range(30), 0, 1, None], 2: [5, 5, 200, 201], 3: [None], 4: [7], None: [1], 8: [9]}
    spark.createDataFrame([(j, day(i)) for j, x in days.items() for i in x], "l_partkey long, l_shipdate timestamp").write.parquet(
        f"{tmp_path}/lineitem.parquet")
    parts = [(j, f"t{j % 2}", f"Brand#{j}", j, 10.0 * j) for j in (1, 2, 3, 4, 4, 7)]
    spark.createDataFrame(parts, "p_partkey long, p_type string, p_brand string, p_size int, p_retailprice double").write.parquet(
        f"{tmp_path}/part.parquet")
    seen, fit = [], ft.fit_apply

    def watched(stages, train, *others, **kw):
        seen.extend(x.count() for x in (train, *others))
        return fit(stages, train, *others, **kw)

    monkeypatch.setattr(ft, "fit_apply", watched)
    out, sil, _ = profiles.job_profile(spark, str(tmp_path), k=2)
    got = sorted((r.job_id, (r.date - datetime.date(2020, 1, 1)).days, r.split) for r in out.collect())
    assert got == sorted([(1, i, "train") for i in range(30)] + [(2, 5, "train"), (2, 200, "test"), (2, 201, "test")]
                         + [(4, 7, "train")] * 2)
    assert seen == [4, 1] and -1 <= sil <= 1


def test_topic_words_travel_as_bytes(spark, monkeypatch):
    from tessera.operators import topics as tp
    words = ["", "a", "é", "abcd", "abcdefgh", "x" * 31, "x" * 32, "yz" * 50, "漢" * 40] + ["w" * (i % 70) + str(i) for i in range(300)]
    array = pa.array(["before", *words]).slice(1)
    want = [r.h for r in spark.createDataFrame([*enumerate(words)], "i int, w string").orderBy("i").select(F.xxhash64("w").alias("h")).collect()]
    assert tp.hashes(array).tolist() == want
    back, n = tp._unboxed([tp._boxed(*tp._parts(array), i, j) for i, j in ((0, 5), (5, 5), (5, len(words)))])
    assert back.to_pylist() == words and n.tolist() == [5, 0, len(words) - 5]

    docs = spark.createDataFrame([(i, words[i % 7:i * 3]) for i in range(60)], "doc_id long, tok array<string>")
    bag = ft.bag_of_words(docs.repartition(5), ["doc_id"], "tok")
    assert dict(bag.dtypes)["terms"] == "binary"
    model = tp.fit(bag, 3, 3, share=0.4)
    assert sorted(r.term for r in model.terms().collect()) == sorted({w for i in range(60) for w in words[i % 7:i * 3]})
    whole = {r.doc_id: r.topicDistribution for r in model.transform(bag).collect()}
    monkeypatch.setattr(tp, "SLICE_TERMS", 1)
    parts = {r.doc_id: r.topicDistribution for r in model.transform(bag).collect()}
    assert len(parts) == 60 and all(parts[i] == pytest.approx(whole[i]) for i in whole)
