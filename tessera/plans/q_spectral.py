"""Registered queries: spectral kernels, Chebyshev filters and wavelets (K1-K20) and
the spectrum-based operators (G17-G20, G22)."""

from pyspark.sql import functions as F

from tessera.functions import kernels as kn
from tessera.operators import graph as gr
from tessera.operators import blocks as bm
from tessera.operators import spectral as sp
from tessera.plans.common import r6
from tessera.plans.q_graph import nodes_of, ug
from tessera.plans.registry import register
from tessera.plans.sqlparts import LAP, UG, cheby_combine_sql, cheby_terms_sql, heat_coeff_sql

TAUS = [-1.0, 1.0]


def _graph(spark, sf):
    """Class graphs with their Laplacian, node table and bound lmax (read once)."""
    from tessera.session import materialize
    e = materialize(ug(spark, sf))
    nodes = nodes_of(e)
    lap = materialize(gr.laplacian(e, nodes))
    graphs = gr.lmax_bound(e, nodes)
    return e, nodes, lap, graphs


def _dw_signal(e, nodes):
    return gr.degrees(e, nodes).select("graph_id", "node", F.lit(0).alias("signal"),
                                       F.col("dw").alias("val"))


@register("k1_k2_k3_filter_bank", f"""WITH {LAP}
SELECT d.graph_id, d.node, f.filter, ROUND(exp(-f.t * d.dw / g.lmax), 6) AS heat,
  ROUND(CASE WHEN f.t < 0 THEN (d.dw + 1) / (g.lmax + 1) * exp(-f.t * (d.dw + 1) / (g.lmax + 1))
        ELSE (g.lmax + 1) / (d.dw + 1) * exp(-f.t * (d.dw + 1) / (g.lmax + 1)) END, 6) AS self_def
FROM dwt d JOIN gl g USING (graph_id), (VALUES (0, -1.0), (1, 1.0), (2, 2.0)) f(filter, t)""")
def k1_k2_k3_filter_bank(spark, sf):
    """Both kernels of a three-filter bank evaluated at every node's weighted degree."""
    e = ug(spark, sf)
    nodes = nodes_of(e)
    freqs = gr.degrees(e, nodes).join(gr.lmax_bound(e, nodes), "graph_id").select(
        "graph_id", "node", F.col("dw").alias("x"), "lmax")
    taus = [-1.0, 1.0, 2.0]
    h = sp.evaluate_bank(freqs, taus, "heat").select("graph_id", "node", "filter", r6("g").alias("heat"))
    s = sp.evaluate_bank(freqs, taus, "self_defined").select("graph_id", "node", "filter",
                                                            r6("g").alias("self_def"))
    return h.join(s, ["graph_id", "node", "filter"])


@register("k5_cheby_coeff", f"""WITH {LAP}, {heat_coeff_sql([-1.0, 1.0, 2.0], 30)}
SELECT graph_id, filter, k, ROUND(c, 6) + 0.0 AS c FROM cf""")
def k5_cheby_coeff(spark, sf):
    e = ug(spark, sf)
    graphs = gr.lmax_bound(e, nodes_of(e))
    c = sp.cheby_coeff(graphs, [-1.0, 1.0, 2.0], m=30)
    return c.select("graph_id", "filter", "k", (r6("c") + F.lit(0.0)).alias("c"))


_SIG = "sig AS (SELECT graph_id, node, 0 AS signal, dw AS val FROM dwt)"


@register("k6_k7_k8_cheby_filter", f"""WITH {LAP}, {heat_coeff_sql(TAUS, 3)}, {_SIG},
{cheby_terms_sql('sig', 3)},
{cheby_combine_sql(3)}
SELECT graph_id, node, filter, ROUND(val, 6) AS val FROM r
UNION ALL
SELECT graph_id, node, -1, ROUND(SUM(val), 6) FROM r GROUP BY 1, 2""")
def k6_k7_k8_cheby_filter(spark, sf):
    """Analysis (filters t=-1, 1, order 3) of the weighted-degree signal, and the
    synthesis of the two outputs (filter = -1)."""
    e, nodes, lap, graphs = _graph(spark, sf)
    coeff = sp.cheby_coeff(graphs, TAUS, m=3).drop("t")
    ana = sp.cheby_filter(lap, _dw_signal(e, nodes), graphs, coeff)
    syn = sp.synthesize(ana).withColumn("filter", F.lit(-1))
    out = ana.unionByName(syn.select(*ana.columns))
    return out.select("graph_id", "node", "filter", r6("val").alias("val"))


@register("k10_localize", f"""WITH {LAP}, {heat_coeff_sql([1.0], 3)},
sig AS (SELECT graph_id, node, 0 AS signal, 1.0 AS val FROM nodes WHERE node = 0),
{cheby_terms_sql('sig', 3)},
{cheby_combine_sql(3)}
SELECT r.graph_id, r.node, ROUND(sqrt((SELECT COUNT(*) FROM nodes n WHERE n.graph_id = r.graph_id))
  * r.val, 6) AS val FROM r""")
def k10_localize(spark, sf):
    """Heat kernel (t=1, order 3) localized at node 0: sqrt(N) · filter(delta_0)."""
    e, nodes, lap, graphs = _graph(spark, sf)
    coeff = sp.cheby_coeff(graphs, [1.0], m=3).drop("t")
    r = sp.cheby_filter(lap, sp.delta_signal(nodes, 0), graphs, coeff)
    n = nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("_n"))
    return r.join(n, "graph_id").select("graph_id", "node", r6(F.sqrt("_n") * F.col("val")).alias("val"))


@register("k11_frame_bounds", f"""WITH {LAP},
x AS (SELECT g.graph_id, g.lmax, g.lmax * p.range / 999.0 AS x FROM gl g, range(1000) p)
SELECT graph_id, ROUND(MIN(s), 6) AS a, ROUND(MAX(s), 6) AS b FROM
  (SELECT graph_id, pow(exp(x / lmax), 2) + pow(exp(-x / lmax), 2) AS s FROM x) GROUP BY 1""")
def k11_frame_bounds(spark, sf):
    e = ug(spark, sf)
    fb = sp.frame_bounds(gr.lmax_bound(e, nodes_of(e)), TAUS, 1000)
    return fb.select("graph_id", r6("a").alias("a"), r6("b").alias("b"))


_RECT_ORDER = 10


def _rect_sql():
    return f"""WITH {LAP},
rc AS (SELECT g.graph_id, 0 AS filter, CAST(k.range AS INTEGER) AS k,
  CASE WHEN k.range = 0 THEN 2.0 * (acos(2.0 * (g.lmax / 4) / g.lmax - 1)
                                    - acos(2.0 * (g.lmax / 2) / g.lmax - 1)) / pi()
       ELSE 2.0 / (k.range * pi()) * (sin(k.range * acos(2.0 * (g.lmax / 4) / g.lmax - 1))
                                      - sin(k.range * acos(2.0 * (g.lmax / 2) / g.lmax - 1))) END AS c
  FROM gl g, range({_RECT_ORDER + 1}) k),
{_SIG},
{cheby_terms_sql('sig', _RECT_ORDER, a_expr='(g.lmax / 2)')},
{cheby_combine_sql(_RECT_ORDER, coeff='rc')}
SELECT graph_id, node, ROUND(val, 6) AS val FROM r"""


@register("k13_cheby_rect", _rect_sql())
def k13_cheby_rect(spark, sf):
    """Ideal band-pass [lmax/4, lmax/2] by Chebyshev (order 10) of the weighted-degree
    signal of every class graph."""
    e, nodes, lap, graphs = _graph(spark, sf)
    coeff = sp.rect_coeff(graphs, F.col("lmax") / 4, F.col("lmax") / 2, order=_RECT_ORDER)
    r = sp.cheby_filter(lap, _dw_signal(e, nodes), graphs, coeff, pad=0.0)
    return r.select("graph_id", "node", r6("val").alias("val"))


@register("k14_jackson_coeff", f"""WITH {LAP},
b AS (SELECT graph_id, lmax / 4 AS a, lmax / 2 AS b, 0.0 AS lmin, lmax FROM gl),
s AS (SELECT *, (lmax - lmin) / 2 AS a1, (lmax + lmin) / 2 AS a2 FROM b),
f AS (SELECT graph_id, acos((a - a2) / a1) AS f0, acos((b - a2) / a1) AS f1 FROM s),
c AS (SELECT graph_id, CAST(i.range AS INTEGER) AS i,
  CASE WHEN i.range = 0 THEN 2 / pi() * (f0 - f1)
       ELSE 2.0 / (pi() * i.range) * (sin(i.range * f0) - sin(i.range * f1)) END AS ch,
  (1 / sin(pi() / 12)) * ((1 - i.range / 12.0) * sin(pi() / 12) * cos(i.range * pi() / 12)
    + (1 / 12.0) * cos(pi() / 12) * sin(i.range * pi() / 12)) AS jk
  FROM f, range(11) i)
SELECT graph_id, i, ROUND(ch, 6) + 0.0 AS ch, ROUND(ch * jk, 6) + 0.0 AS jch FROM c""")
def k14_jackson_coeff(spark, sf):
    e = ug(spark, sf)
    b = gr.lmax_bound(e, nodes_of(e)).select(
        "graph_id", (F.col("lmax") / 4).alias("a"), (F.col("lmax") / 2).alias("b"),
        F.lit(0.0).alias("lmin"), "lmax")
    j = sp.jackson_cheby_coeff(b, 10)
    return j.select("graph_id", "i", (r6("ch") + F.lit(0.0)).alias("ch"),
                    (r6("jch") + F.lit(0.0)).alias("jch"))


@register("k15_canonical_dual", f"""WITH {LAP},
v AS (SELECT d.graph_id, d.node, f.filter, exp(-f.t * d.dw / g.lmax) AS g FROM dwt d
      JOIN gl g USING (graph_id), (VALUES (0, -1.0), (1, 1.0), (2, 2.0)) f(filter, t))
SELECT graph_id, node, filter, ROUND(g / SUM(g * g) OVER (PARTITION BY graph_id, node), 6) AS dual
FROM v""")
def k15_canonical_dual(spark, sf):
    e = ug(spark, sf)
    nodes = nodes_of(e)
    freqs = gr.degrees(e, nodes).join(gr.lmax_bound(e, nodes), "graph_id").select(
        "graph_id", "node", F.col("dw").alias("x"), "lmax")
    taus = [-1.0, 1.0, 2.0]
    vals = F.array(*[kn.heat(F.col("x"), F.col("lmax"), t) for t in taus])
    d = freqs.select("graph_id", "node", F.posexplode(kn.canonical_dual(vals)).alias("filter", "dual"))
    return d.select("graph_id", "node", "filter", r6("dual").alias("dual"))


_WAVE_SQL = f"""{LAP}, {heat_coeff_sql(TAUS, 3)},
sig AS (SELECT graph_id, node, node AS signal, 1.0 AS val FROM nodes),
{cheby_terms_sql('sig', 3)},
{cheby_combine_sql(3)},
kept AS (SELECT * FROM r WHERE val >= 0.0 AND val <> 0),
wv AS (SELECT graph_id, filter, node AS i, signal AS j,
         val / SUM(abs(val)) OVER (PARTITION BY graph_id, filter, node) AS val FROM kept)"""


def _wavelets(spark, sf):
    e, nodes, lap, graphs = _graph(spark, sf)
    return bm.wavelets(lap, nodes, graphs, TAUS, order=3, tolerance=0.0), nodes


@register("k12_k16_k17_k20_wavelets", f"""WITH {_WAVE_SQL}
SELECT graph_id, filter, i, j, ROUND(val, 6) AS val FROM wv""")
def k12_k16_k17_k20_wavelets(spark, sf):
    """Forward (t=-1) and inverse (t=+1) wavelet matrices of every class graph: order-3
    Chebyshev frame of all deltas, negatives dropped, rows L1-normalized."""
    w, _ = _wavelets(spark, sf)
    return w.select("graph_id", "filter", "i", "j", r6("val").alias("val"))


@register("k18_density", f"""WITH {_WAVE_SQL}
SELECT graph_id, filter, ROUND(100.0 * COUNT(*) / pow({100}, 2), 2) AS density FROM wv
GROUP BY 1, 2""")
def k18_density(spark, sf):
    w, nodes = _wavelets(spark, sf)
    return sp.density(w, nodes, len(TAUS)).select("graph_id", "filter", "density")


@register("k19_scale_list", """WITH g AS (SELECT DISTINCT user_id % 4 + 1 AS s FROM events),
d AS (SELECT s, UNNEST(range(s, 0, -1)) AS d, generate_subscripts(range(s, 0, -1), 1) AS p FROM g)
SELECT s, CAST(2 * p - 2 AS INTEGER) AS idx, -1.0 / d AS scale FROM d
UNION ALL SELECT s, CAST(2 * p - 1 AS INTEGER), 1.0 / d FROM d""")
def k19_scale_list(spark, sf):
    """Scale lists of the wavelet transform for scale counts 1..4 seen in the data."""
    from tessera.plans.common import td
    s = td(spark, sf).table("events").select((F.col("user_id") % 4 + 1).alias("s")).distinct()
    return s.select("s", F.posexplode(sp.scale_list(F.col("s"))).alias("idx", "scale"))


# ---------------------------------------------------------------- spectrum-based (rows-only)
def _spec(spark, sf):
    from tessera.session import materialize
    e, nodes, lap, graphs = _graph(spark, sf)
    return e, nodes, graphs, materialize(sp.spectrum(lap, nodes))


@register("g17_spectrum")
def g17_spectrum(spark, sf):
    """Eigenvalues of every class graph's Laplacian and its coherence mu = max |U|
    (grouped dense solver): rows-only."""
    _, _, _, spec = _spec(spark, sf)
    return spec.select("graph_id", "k", "lam").distinct().join(sp.coherence(spec), "graph_id")


@register("g18_g19_fourier_roundtrip", f"""WITH {LAP}
SELECT graph_id, node, ROUND(dw, 4) + 0.0 AS val FROM dwt""")
def g18_g19_fourier_roundtrip(spark, sf):
    """igft(gft(s)) on the weighted-degree signal: must give s back (checked against the
    signal itself)."""
    e, nodes, _, spec = _spec(spark, sf)
    s = gr.degrees(e, nodes).select("graph_id", "node", F.col("dw").alias("val"))
    back = sp.igft(spec, sp.gft(spec, s))
    return back.select("graph_id", "node", (F.round("val", 4) + F.lit(0.0)).alias("val"))


@register("k11_frame_bounds_eigenvalues")
def k11_frame_bounds_eigenvalues(spark, sf):
    """Frame bounds of the heat bank over each class graph's eigenvalues: rows-only."""
    _, _, graphs, spec = _spec(spark, sf)
    return sp.frame_bounds_eigenvalues(spec, graphs, TAUS)


@register("g20_modulate")
def g20_modulate(spark, sf):
    e, nodes, _, spec = _spec(spark, sf)
    s = gr.degrees(e, nodes).select("graph_id", "node", F.col("dw").alias("val"))
    return sp.modulate(spec, s, 1, nodes)


@register("g22_resistance_distance")
def g22_resistance_distance(spark, sf):
    """Resistance distance between consecutive node pairs of every class graph."""
    e, nodes, _, spec = _spec(spark, sf)
    pairs = nodes.filter(F.col("node") > 0).select("graph_id", (F.col("node") - 1).alias("a"),
                                                  F.col("node").alias("b"))
    return sp.resistance_distance(spec, pairs)


@register("k4_k9_exact_filter")
def k4_k9_exact_filter(spark, sf):
    """Exact filtering U g(Λ) U^T s and the kernel norms over the eigenvalues."""
    e, nodes, graphs, spec = _spec(spark, sf)
    s = gr.degrees(e, nodes).select("graph_id", "node", F.col("dw").alias("val"))
    ex = sp.exact_filter(spec, s, graphs, TAUS)
    norms = sp.kernel_norms(spec, graphs, TAUS)
    return ex.join(norms, ["graph_id", "filter"])


# ---------------------------------------------------------------- Krylov
from tessera.operators import krylov as kr  # noqa: E402

_EXACT_SQL = f"""{LAP}, {heat_coeff_sql(TAUS, 12)},
sig AS (SELECT graph_id, node, 0 AS signal, dw AS val FROM dwt),
{cheby_terms_sql('sig', 12, a_expr='(g.lmax / 2)')},
{cheby_combine_sql(12)}"""


@register("k9_krylov_filter", f"""WITH {_EXACT_SQL}
SELECT graph_id, node, filter, ROUND(val, 5) AS val FROM r""")
def k9_krylov_filter(spark, sf):
    """g(L) s of the weighted degrees with a stated error (1e-10 of the signal's norm), no
    eigen-decomposition; the oracle is a Chebyshev series of order 12."""
    e, nodes, lap, graphs = _graph(spark, sf)
    s = gr.degrees(e, nodes).select("graph_id", F.lit(0).alias("signal"), "node", F.col("dw").alias("val"))
    out = kr.krylov_filter(lap, s, graphs, TAUS, tol=1e-10)
    return out.select("graph_id", "node", "filter", F.round("val", 5).alias("val"))


@register("k4_normalized_filter", f"""WITH {LAP}, {heat_coeff_sql(TAUS, 12)}, {heat_coeff_sql([2 * t for t in TAUS], 12, 'c2')},
sig AS (SELECT graph_id, node, 0 AS signal, dw AS val FROM dwt),
{cheby_terms_sql('sig', 12, a_expr='(g.lmax / 2)')}, {cheby_combine_sql(12)},
ds AS (SELECT graph_id, node, node AS signal, 1.0 AS val FROM nodes),
{cheby_terms_sql('ds', 12, prefix='u', a_expr='(g.lmax / 2)')}, {cheby_combine_sql(12, coeff='c2', prefix='u', name='q')},
nm AS (SELECT graph_id, filter, sqrt(SUM(val)) AS norm FROM q WHERE node = signal GROUP BY 1, 2)
SELECT r.graph_id, r.node, r.filter, ROUND(r.val / nm.norm, 5) AS val
FROM r JOIN nm ON nm.graph_id = r.graph_id AND nm.filter = r.filter""")
def k4_normalized_filter(spark, sf):
    """Filtering with kernels divided by their norm over the spectrum: the norm is a trace."""
    e, nodes, lap, graphs = _graph(spark, sf)
    s = gr.degrees(e, nodes).select("graph_id", F.lit(0).alias("signal"), "node", F.col("dw").alias("val"))
    out = kr.normalized(kr.krylov_filter(lap, s, graphs, TAUS, tol=1e-10),
                        kr.kernel_norms(lap, nodes, graphs, TAUS, tol=1e-10))
    return out.select("graph_id", "node", "filter", F.round("val", 5).alias("val"))


@register("g10_lmax_lanczos", f"""WITH {LAP}
SELECT graph_id, TRUE AS bounded FROM gl""")
def g10_lmax_lanczos(spark, sf):
    """Largest eigenvalue of every class graph by the Lanczos recurrence.  The oracle holds
    what SQL can say: one row a graph, between the Rayleigh quotient of the best delta (the
    greatest diagonal entry) and 1.01 times the bound 2 max(dw)."""
    e, nodes, lap, graphs = _graph(spark, sf)
    diagonal = lap.filter(F.col("i") == F.col("j")).groupBy("graph_id").agg(F.max("v").alias("d"))
    got = kr.lmax_lanczos(lap, nodes).join(graphs.withColumnRenamed("lmax", "top"), "graph_id").join(
        diagonal, "graph_id", "left")
    ok = (F.col("lmax") >= F.coalesce("d", F.lit(0.0))) & (F.col("lmax") <= 1.01 * F.col("top"))
    return got.select("graph_id", (ok & (F.col("residual") <= 5e-3 * F.col("ritz"))).alias("bounded"))


@register("g22_resistance_foster", f"""WITH RECURSIVE {UG},
un AS (SELECT graph_id, src, dst FROM ug WHERE src <> dst),
reach AS (SELECT graph_id, node AS root, node FROM nodes
  UNION SELECT r.graph_id, r.root, u.dst FROM reach r JOIN un u ON u.graph_id = r.graph_id AND u.src = r.node),
low AS (SELECT graph_id, node, MIN(root) AS root FROM reach GROUP BY 1, 2)
SELECT graph_id, ROUND(CAST(COUNT(*) - COUNT(DISTINCT root) AS DOUBLE), 4) AS total FROM low GROUP BY 1
HAVING COUNT(*) > COUNT(DISTINCT root)""")
def g22_resistance_foster(spark, sf):
    """Resistance distance of every edge of every class graph, by conjugate gradients.  The
    check is Foster's theorem: weights times resistances add up to nodes less components."""
    e, nodes, _, _ = _graph(spark, sf)
    pairs = e.filter(F.col("src") < F.col("dst")).select("graph_id", F.col("src").alias("a"), F.col("dst").alias("b"), "w")
    r = kr.resistance_distance(e, nodes, pairs).join(pairs, ["graph_id", "a", "b"])
    return r.groupBy("graph_id").agg(F.round(F.sum(F.col("r") * F.col("w")), 4).alias("total"))


# ---------------------------------------------------------------- wavelet layer
from tessera.operators import hypergraph as hg  # noqa: E402
from tessera.operators import recommend as rc  # noqa: E402
from tessera.operators import sessions as ss  # noqa: E402
from tessera.plans.common import sessions_long, td  # noqa: E402
from tessera.plans.sqlparts import TWO_VIEWS, P as _P  # noqa: E402

_LAYER_SQL = """xe AS (SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS node,
  COUNT(*) * 1.0 AS c, AVG(value) AS v, COUNT(DISTINCT user_id) * 1.0 AS u FROM events GROUP BY 1),
x AS (SELECT node, 0 AS f, c AS x FROM xe UNION ALL SELECT node, 1, v FROM xe
      UNION ALL SELECT node, 2, u FROM xe),
wt AS (SELECT f.range AS f, o.range AS o, cos(f.range + 2 * o.range) / (1 + f.range) AS w
       FROM range(3) f, range(4) o),
th AS (SELECT range AS node, 1 + ((range % 5) - 2) / 20.0 AS theta FROM range({k})),
xw AS (SELECT x.node, wt.o, SUM(x.x * wt.w) AS y FROM x JOIN wt USING (f) GROUP BY 1, 2),
z AS (SELECT p.graph_id, p.i AS k, xw.o, SUM(p.val * xw.y) AS z FROM wv p
      JOIN xw ON xw.node = p.j WHERE p.filter = 1 GROUP BY 1, 2, 3),
lay AS (SELECT p.graph_id, p.i AS node, CAST(z.o AS INTEGER) AS o, SUM(p.val * z.z * th.theta) AS val
        FROM wv p JOIN z ON z.graph_id = p.graph_id AND z.k = p.j JOIN th ON th.node = z.k
        WHERE p.filter = 0 GROUP BY 1, 2, 3)""".format(k=_P.k_job)


def _layer_inputs(spark, sf):
    ev = td(spark, sf).table("events").select(
        F.get_json_object("props", "$.k").cast("int").alias("node"), "value", "user_id")
    xe = ev.groupBy("node").agg(F.count(F.lit(1)).cast("double").alias("c"),
                                F.avg("value").alias("v"),
                                F.count_distinct("user_id").cast("double").alias("u"))
    x = xe.select("node", F.explode(F.array(
        F.struct(F.lit(0).alias("f"), F.col("c").alias("x")),
        F.struct(F.lit(1).alias("f"), F.col("v").alias("x")),
        F.struct(F.lit(2).alias("f"), F.col("u").alias("x")))).alias("_s")).select("node", "_s.*")
    one = spark.range(1)
    w = (one.select(F.explode(F.sequence(F.lit(0), F.lit(2))).alias("f"))
         .select("f", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("o"))
         .select("f", "o", (F.cos(F.col("f") + 2 * F.col("o")) / (F.col("f") + 1)).alias("w")))
    theta = spark.range(_P.k_job).select(F.col("id").cast("int").alias("node"),
                                         (F.lit(1.0) + ((F.col("id") % 5) - 2) / 20.0).alias("theta"))
    return x, w, theta


def _two_view_graphs(spark, sf):
    """Both class hypergraph views, graph key = class * 2 + view."""
    from tessera.session import materialize
    long = sessions_long(spark, sf)
    a1 = hg.adjacency(hg.session_incidence(long, "first_person_class", ["geek_id", "session_no"],
                                           "job_class"))
    pairs = ss.consecutive_pairs(long.withColumnRenamed("first_person_class", "graph_id"),
                                 ["geek_id", "session_no"], "pos", "job_class")
    a2 = hg.adjacency(hg.successor_incidence(pairs))
    e = (a1.select((F.col("graph_id") * 2).alias("graph_id"), F.col("i").alias("src"),
                   F.col("j").alias("dst"), "w")
         .unionByName(a2.select((F.col("graph_id") * 2 + 1).alias("graph_id"), F.col("i").alias("src"),
                                F.col("j").alias("dst"), "w")))
    e = materialize(e)
    nodes = nodes_of(e)
    lap = materialize(gr.laplacian(e, nodes))
    return e, nodes, lap, gr.lmax_bound(e, nodes)


def _layer(spark, sf):
    e, nodes, lap, graphs = _two_view_graphs(spark, sf)
    w = bm.wavelets(lap, nodes, graphs, TAUS, order=3)
    phi = w.filter(F.col("filter") == 0).select("graph_id", "i", "j", "val")
    phi_inv = w.filter(F.col("filter") == 1).select("graph_id", "i", "j", "val")
    x, wt, theta = _layer_inputs(spark, sf)
    return rc.wavelet_conv(phi, phi_inv, x, wt, theta)


_TWO_WAVE = f"""{TWO_VIEWS}, {heat_coeff_sql(TAUS, 3)},
sig AS (SELECT graph_id, node, node AS signal, 1.0 AS val FROM nodes),
{cheby_terms_sql('sig', 3)},
{cheby_combine_sql(3)},
kept AS (SELECT * FROM r WHERE val >= 0.0 AND val <> 0),
wv AS (SELECT graph_id, filter, node AS i, signal AS j,
         val / SUM(abs(val)) OVER (PARTITION BY graph_id, filter, node) AS val FROM kept)"""


@register("r1_wavelet_layer", f"""WITH {_TWO_WAVE}, {_LAYER_SQL}
SELECT graph_id, node, o, ROUND(val, 6) AS val FROM lay""")
def r1_wavelet_layer(spark, sf):
    """Wavelet layer Φ·diag(θ)·Φ⁻¹·(X·W) on both views of every class: node features
    from the log, rule-given weights W and θ."""
    return _layer(spark, sf).select("graph_id", "node", "o", r6("val").alias("val"))


@register("r2_two_view_fusion", f"""WITH {_TWO_WAVE}, {_LAYER_SQL}
SELECT CAST(graph_id // 2 AS INTEGER) AS graph_id, node, o, ROUND(SUM(val), 6) AS val FROM lay
GROUP BY 1, 2, 3""")
def r2_two_view_fusion(spark, sf):
    """Sum of the two views' layer outputs per class."""
    out = _layer(spark, sf).withColumn("graph_id", (F.col("graph_id") / 2).cast("int"))
    return rc.fuse_views(out).select("graph_id", "node", "o", r6("val").alias("val"))


# ---------------------------------------------------------------- per-sample wavelets
from tessera.operators import samples as smp  # noqa: E402
from tessera.plans.sqlparts import SAMPLE_GRAPHS  # noqa: E402


def sample_graph_rows(spark, sf):
    """Both views of every leave-one-out sample as packed rows (graph_id, i, row); the graph key
    is the text geek_id:session_no:view, so that no two samples share one.  Only the store is
    written: the class rows once and the changes of the samples."""
    from tessera.session import materialize
    g = smp.class_graphs(sessions_long(spark, sf), _P.list_cnt)
    header = smp.sample_header(g, _P.top_k)
    ti = smp.target_items(g, _P.top_k)
    parts = []
    for view, inc, (delta, _) in ((1, g.inc1, smp.view1_delta(ti)),
                                  (2, g.inc2, smp.view2_delta(g, smp.removed_pairs(g, _P.top_k)))):
        rows = smp.overlay(smp.all_rows(header, _P.k_job), materialize(smp.class_rows(hg.adjacency(inc))),
                           materialize(smp.changed_rows(delta)))
        key = F.concat_ws(":", "geek_id", "session_no", F.lit(view))
        parts.append(rows.select(key.alias("graph_id"), "i", "row"))
    return parts[0].unionByName(parts[1])


@register("k20_sample_wavelets", f"""WITH {SAMPLE_GRAPHS}, {heat_coeff_sql(TAUS, 3)},
sig AS (SELECT graph_id, node, node AS signal, 1.0 AS val FROM nodes),
{cheby_terms_sql('sig', 3)},
{cheby_combine_sql(3)},
kept AS (SELECT * FROM r WHERE val >= 0.0 AND val <> 0),
wv AS (SELECT graph_id, filter, node AS i, signal AS j,
         val / SUM(abs(val)) OVER (PARTITION BY graph_id, filter, node) AS val FROM kept)
SELECT CAST(split_part(graph_id, ':', 1) AS BIGINT) AS geek_id, CAST(split_part(graph_id, ':', 2) AS BIGINT) AS session_no,
  CAST(split_part(graph_id, ':', 3) AS INTEGER) AS view, filter, i, j, ROUND(val, 6) AS val FROM wv""")
def k20_sample_wavelets(spark, sf):
    """Forward (t=-1) and inverse (t=+1) wavelets of both graphs of every sample (the
    transform the original runs per sample before the network), a graph at a time."""
    rows = sample_graph_rows(spark, sf)
    nodes = nodes_of(rows)
    e = rows.select("graph_id", F.col("i").alias("src"), F.inline("row").alias("dst", "w"))
    w = bm.wavelets(rows, nodes, gr.lmax_bound(e, nodes), TAUS, order=3, from_weights=True)
    part = F.split("graph_id", ":")
    return w.select(part[0].cast("long").alias("geek_id"), part[1].cast("long").alias("session_no"),
                    part[2].cast("int").alias("view"), "filter", "i", "j", r6("val").alias("val"))
