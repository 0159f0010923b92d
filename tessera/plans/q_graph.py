"""Registered queries: graph signal operators on the class graphs."""

from pyspark.sql import functions as F

from tessera.operators import graph as gr
from tessera.operators import hypergraph as hg
from tessera.operators import sessions as ss
from tessera.params import TESTDATA_PARAMS as P
from tessera.plans.common import class_adjacency, r6, sessions_long, td
from tessera.plans.registry import register
from tessera.plans.sqlparts import DG, UG


def ug(spark, sf):
    """Undirected test graphs: the class adjacency."""
    a = class_adjacency(spark, sf)
    return a.select("graph_id", F.col("i").alias("src"), F.col("j").alias("dst"), "w")


def dg(spark, sf):
    """Directed test graphs: sessions holding each (item, next item) pair, per class."""
    long = sessions_long(spark, sf).withColumnRenamed("first_person_class", "graph_id")
    pairs = ss.consecutive_pairs(long, ["geek_id", "session_no"], "pos", "job_class")
    return (pairs.select("graph_id", "geek_id", "session_no", "src", "dst").distinct()
            .groupBy("graph_id", "src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w")))


def nodes_of(edges):
    return hg.dense_nodes(edges, P.k_job)


@register("g1_g2_checks", f"""WITH {DG},
bad AS (SELECT DISTINCT graph_id FROM dg WHERE src NOT IN (SELECT node FROM dnodes)
        OR dst NOT IN (SELECT node FROM dnodes))
SELECT n.graph_id, CAST(COUNT(d.w) AS BIGINT) AS n_edges,
  COALESCE(bool_or(isinf(d.w)), false) AS has_inf_val,
  COALESCE(bool_or(isnan(d.w)), false) AS has_nan_value,
  n.graph_id IN (SELECT graph_id FROM bad) AS is_not_square,
  COALESCE(bool_or(d.src = d.dst AND d.w <> 0), false) AS diag_is_not_zero
FROM (SELECT DISTINCT graph_id FROM dnodes) n LEFT JOIN dg d USING (graph_id)
GROUP BY n.graph_id""")
def g1_g2_checks(spark, sf):
    e = gr.build(dg(spark, sf))
    nodes = nodes_of(e)
    n = e.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n_edges"))
    return gr.check_weights(e, nodes).join(n, "graph_id", "left").select(
        "graph_id", F.coalesce("n_edges", F.lit(0)).alias("n_edges"), "has_inf_val",
        "has_nan_value", "is_not_square", "diag_is_not_zero")


@register("g3_g4_directed_ne", f"""WITH {DG}, {UG[UG.index('memb AS'):]},
t AS (SELECT 'dg' AS kind, * FROM dg UNION ALL SELECT 'ug', * FROM ug),
tt AS (SELECT COALESCE(a.kind, b.kind) AS kind, COALESCE(a.graph_id, b.graph_id) AS graph_id,
         abs(COALESCE(a.w, 0) - COALESCE(b.w, 0)) > 1e-9 AS diff
       FROM t a FULL JOIN t b ON a.kind = b.kind AND a.graph_id = b.graph_id
         AND a.src = b.dst AND a.dst = b.src),
d AS (SELECT kind, graph_id, bool_or(diff) AS directed FROM tt GROUP BY 1, 2),
c AS (SELECT kind, graph_id, COUNT(*) AS n_all, COUNT(*) FILTER (WHERE src >= dst) AS n_low
      FROM t GROUP BY 1, 2)
SELECT kind, graph_id, directed,
  CAST(CASE WHEN directed THEN n_all ELSE n_low END AS BIGINT) AS ne
FROM d JOIN c USING (kind, graph_id)""")
def g3_g4_directed_ne(spark, sf):
    out = []
    for kind, e in (("dg", dg(spark, sf)), ("ug", ug(spark, sf))):
        out.append(gr.edge_count(e, tol=1e-9).withColumn("kind", F.lit(kind)))
    return out[0].unionByName(out[1]).select("kind", "graph_id", "directed", "ne")


@register("g5_edge_list", f"""WITH {UG}
SELECT graph_id, CAST(ROW_NUMBER() OVER (PARTITION BY graph_id ORDER BY src, dst) - 1 AS INTEGER) AS e,
  src AS v_in, dst AS v_out, ROUND(w, 6) AS weight FROM ug WHERE src >= dst""")
def g5_edge_list(spark, sf):
    el = gr.edge_list(ug(spark, sf))
    return el.select("graph_id", "e", "v_in", "v_out", r6("weight").alias("weight"))


@register("g6_g7_g8_degrees", f"""WITH {DG},
a AS (SELECT graph_id, src AS node, COUNT(*) FILTER (WHERE w > 0) AS d, SUM(w) AS dw FROM dg
      GROUP BY 1, 2)
SELECT n.graph_id, n.node, CAST(COALESCE(a.d, 0) AS BIGINT) AS d, COALESCE(a.dw, 0.0) AS dw
FROM dnodes n LEFT JOIN a USING (graph_id, node)""")
def g6_g7_g8_degrees(spark, sf):
    e = dg(spark, sf)
    return gr.degrees(e, nodes_of(e))


@register("g9_laplacian_combinatorial", f"""WITH {UG},
p AS (SELECT graph_id, src AS i, dst AS j, -w AS v FROM ug
      UNION ALL SELECT graph_id, src, src, SUM(w) FROM ug GROUP BY 1, 2)
SELECT graph_id, i, j, ROUND(SUM(v), 6) AS v FROM p GROUP BY 1, 2, 3 HAVING abs(SUM(v)) > 1e-12""")
def g9_laplacian_combinatorial(spark, sf):
    e = ug(spark, sf)
    return gr.laplacian(e, nodes_of(e)).select("graph_id", "i", "j", r6("v").alias("v"))


@register("g9_laplacian_normalized", f"""WITH {UG},
dw AS (SELECT n.graph_id, n.node, COALESCE(SUM(u.w), 0) AS dw FROM nodes n
       LEFT JOIN ug u ON u.graph_id = n.graph_id AND u.src = n.node GROUP BY 1, 2),
r AS (SELECT graph_id, node, CASE WHEN dw > 0 THEN pow(dw, -0.5) END AS r FROM dw),
p AS (SELECT u.graph_id, u.src AS i, u.dst AS j, -a.r * u.w * b.r AS v FROM ug u
        JOIN r a ON a.graph_id = u.graph_id AND a.node = u.src
        JOIN r b ON b.graph_id = u.graph_id AND b.node = u.dst
      UNION ALL SELECT graph_id, node, node, 1.0 FROM nodes)
SELECT graph_id, i, j, ROUND(SUM(v), 6) AS v FROM p GROUP BY 1, 2, 3
HAVING abs(SUM(v)) > 1e-12""")
def g9_laplacian_normalized(spark, sf):
    """Normalized Laplacian (entries such as -1/128 sit on a rounding tie; r6 and the
    oracle rewrite both nudge by 1e-9)."""
    e = ug(spark, sf)
    return gr.laplacian(e, nodes_of(e), "normalized").select("graph_id", "i", "j", r6("v").alias("v"))


@register("g9_laplacian_directed", f"""WITH {DG},
p AS (SELECT graph_id, src AS i, dst AS j, -0.5 * w AS v FROM dg
      UNION ALL SELECT graph_id, dst, src, -0.5 * w FROM dg
      UNION ALL SELECT graph_id, src, src, 0.5 * w FROM dg
      UNION ALL SELECT graph_id, dst, dst, 0.5 * w FROM dg)
SELECT graph_id, i, j, ROUND(SUM(v), 6) AS v FROM p GROUP BY 1, 2, 3 HAVING abs(SUM(v)) > 1e-12""")
def g9_laplacian_directed(spark, sf):
    e = dg(spark, sf)
    return gr.laplacian(e, nodes_of(e), directed=True).select("graph_id", "i", "j", r6("v").alias("v"))


@register("g10_lmax_bound", f"""WITH {UG}
SELECT graph_id, ROUND(2.0 * MAX(dw), 6) AS lmax FROM
  (SELECT graph_id, src, SUM(w) AS dw FROM ug GROUP BY 1, 2) GROUP BY 1""")
def g10_lmax_bound(spark, sf):
    e = ug(spark, sf)
    return gr.lmax_bound(e, nodes_of(e)).select("graph_id", r6("lmax").alias("lmax"))


@register("g10_lmax_power")
def g10_lmax_power(spark, sf):
    """Power iteration (iterative: rows-only check; tests compare with NumPy)."""
    e = ug(spark, sf)
    nodes = nodes_of(e)
    return gr.lmax_power(gr.laplacian(e, nodes), nodes)


@register("g10_lmax_exact")
def g10_lmax_exact(spark, sf):
    """Dense eigen-solver per graph (grouped pandas, bounded graph size): rows-only."""
    e = ug(spark, sf)
    nodes = nodes_of(e)
    return gr.lmax_exact(gr.laplacian(e, nodes), nodes)


@register("g11_subgraph", f"""WITH {UG},
k AS (SELECT graph_id, node, CAST(DENSE_RANK() OVER (PARTITION BY graph_id ORDER BY node) - 1
        AS INTEGER) AS nn FROM nodes WHERE node % 3 = 0)
SELECT u.graph_id, a.nn AS src, b.nn AS dst, ROUND(u.w, 6) AS w FROM ug u
  JOIN k a ON a.graph_id = u.graph_id AND a.node = u.src
  JOIN k b ON b.graph_id = u.graph_id AND b.node = u.dst""")
def g11_subgraph(spark, sf):
    e = ug(spark, sf)
    keep = nodes_of(e).filter(F.col("node") % 3 == 0)
    return gr.subgraph(e, keep).select("graph_id", "src", "dst", r6("w").alias("w"))


_REACH = """reach_{t}(graph_id, node) AS (
  SELECT DISTINCT graph_id, 0 FROM {nodes}
  UNION SELECT e.graph_id, e.{b} FROM reach_{t} r
    JOIN {edges} e ON e.graph_id = r.graph_id AND e.{a} = r.node WHERE e.w > 0)"""


@register("g12_connected", f"""WITH RECURSIVE {DG}, {UG[UG.index('memb AS'):]},
{_REACH.format(t='u', nodes='nodes', edges='ug', a='src', b='dst')},
{_REACH.format(t='f', nodes='dnodes', edges='dg', a='src', b='dst')},
{_REACH.format(t='b', nodes='dnodes', edges='dg', a='dst', b='src')},
nu AS (SELECT graph_id, COUNT(*) AS n FROM nodes GROUP BY 1),
nd AS (SELECT graph_id, COUNT(*) AS n FROM dnodes GROUP BY 1)
SELECT 'ug' AS kind, graph_id, (SELECT COUNT(*) FROM reach_u r WHERE r.graph_id = nu.graph_id) = n
  AS connected FROM nu
UNION ALL
SELECT 'dg', graph_id, (SELECT COUNT(*) FROM reach_f r WHERE r.graph_id = nd.graph_id) = n
  AND (SELECT COUNT(*) FROM reach_b r WHERE r.graph_id = nd.graph_id) = n FROM nd""")
def g12_connected(spark, sf):
    # one reachability loop for all graphs: key = class * 2 + kind.  For the symmetric
    # class graphs the transposed pass reaches the same nodes, so checking both
    # orientations everywhere gives the undirected answer for them.
    u, d = ug(spark, sf), dg(spark, sf)
    e = (u.select((F.col("graph_id") * 2).alias("graph_id"), "src", "dst", "w")
         .unionByName(d.select((F.col("graph_id") * 2 + 1).alias("graph_id"), "src", "dst", "w")))
    c = gr.is_connected(e, nodes_of(e), directed=True)
    return c.select(F.when(F.col("graph_id") % 2 == 0, F.lit("ug")).otherwise(F.lit("dg")).alias("kind"),
                    (F.col("graph_id") / 2).cast("int").alias("graph_id"), "connected")


@register("g13_components", f"""WITH RECURSIVE {DG},
se AS (SELECT graph_id, src, dst FROM dg WHERE w >= 2
       UNION SELECT graph_id, dst, src FROM dg WHERE w >= 2),
r(graph_id, a, b) AS (SELECT graph_id, node, node FROM dnodes
  UNION SELECT r.graph_id, r.a, e.dst FROM r JOIN se e ON e.graph_id = r.graph_id AND e.src = r.b)
SELECT graph_id, a AS node, MIN(b) AS component FROM r GROUP BY 1, 2""")
def g13_components(spark, sf):
    d = dg(spark, sf)
    sparse = d.filter(F.col("w") >= 2)
    return gr.components(sparse, nodes_of(d)).select("graph_id", "node", "component")


def _grad_input(spark, sf):
    e = ug(spark, sf)
    nodes = nodes_of(e)
    sig = gr.degrees(e, nodes).select("graph_id", "node", F.col("dw").alias("val"))
    return e, nodes, sig, gr.differential_operator(e, nodes)


@register("g14_g15_grad", f"""WITH {UG},
el AS (SELECT graph_id, ROW_NUMBER() OVER (PARTITION BY graph_id ORDER BY src, dst) - 1 AS e,
         src AS v_in, dst AS v_out, w FROM ug WHERE src >= dst),
s AS (SELECT n.graph_id, n.node, COALESCE(SUM(u.w), 0) AS val FROM nodes n
      LEFT JOIN ug u ON u.graph_id = n.graph_id AND u.src = n.node GROUP BY 1, 2)
SELECT el.graph_id, CAST(el.e AS INTEGER) AS e, ROUND(sqrt(el.w) * (a.val - b.val), 6) AS val
FROM el JOIN s a ON a.graph_id = el.graph_id AND a.node = el.v_in
        JOIN s b ON b.graph_id = el.graph_id AND b.node = el.v_out""")
def g14_g15_grad(spark, sf):
    _, _, sig, dop = _grad_input(spark, sf)
    return gr.grad(dop, sig).select("graph_id", "e", r6("val").alias("val"))


@register("g16_div_grad_is_laplacian", f"""WITH {UG},
s AS (SELECT n.graph_id, n.node, COALESCE(SUM(u.w), 0) AS val FROM nodes n
      LEFT JOIN ug u ON u.graph_id = n.graph_id AND u.src = n.node GROUP BY 1, 2),
lap AS (SELECT graph_id, i, j, SUM(v) AS v FROM
        (SELECT graph_id, src AS i, dst AS j, -w AS v FROM ug
         UNION ALL SELECT graph_id, src, src, SUM(w) FROM ug GROUP BY 1, 2) GROUP BY 1, 2, 3),
ls AS (SELECT l.graph_id, l.i AS node, SUM(l.v * s.val) AS val FROM lap l
       JOIN s ON s.graph_id = l.graph_id AND s.node = l.j GROUP BY 1, 2)
SELECT n.graph_id, n.node, ROUND(COALESCE(ls.val, 0.0), 6) + 0.0 AS val
FROM nodes n LEFT JOIN ls USING (graph_id, node)""")
def g16_div_grad_is_laplacian(spark, sf):
    """div(grad(s)) computed through D; the oracle computes L·s (identity L = DᵀD)."""
    _, nodes, sig, dop = _grad_input(spark, sf)
    out = gr.div(dop, gr.grad(dop, sig), nodes)
    return out.select("graph_id", "node", (r6("val") + F.lit(0.0)).alias("val"))


@register("g21_symmetrize", f"""WITH {DG},
t AS (SELECT COALESCE(a.graph_id, b.graph_id) AS graph_id, COALESCE(a.src, b.dst) AS src,
        COALESCE(a.dst, b.src) AS dst, COALESCE(a.w, 0.0) AS w, COALESCE(b.w, 0.0) AS wt
      FROM dg a FULL JOIN dg b ON a.graph_id = b.graph_id AND a.src = b.dst AND a.dst = b.src),
lo AS (SELECT * FROM dg WHERE src >= dst), up AS (SELECT * FROM dg WHERE src <= dst),
tl AS (SELECT COALESCE(a.graph_id, b.graph_id) AS graph_id, COALESCE(a.src, b.dst) AS src,
        COALESCE(a.dst, b.src) AS dst, greatest(COALESCE(a.w, 0.0), COALESCE(b.w, 0.0)) AS w
      FROM lo a FULL JOIN lo b ON a.graph_id = b.graph_id AND a.src = b.dst AND a.dst = b.src),
tu AS (SELECT COALESCE(a.graph_id, b.graph_id) AS graph_id, COALESCE(a.src, b.dst) AS src,
        COALESCE(a.dst, b.src) AS dst, greatest(COALESCE(a.w, 0.0), COALESCE(b.w, 0.0)) AS w
      FROM up a FULL JOIN up b ON a.graph_id = b.graph_id AND a.src = b.dst AND a.dst = b.src),
r AS (SELECT 'average' AS method, graph_id, src, dst, (w + wt) / 2 AS w FROM t
      UNION ALL SELECT 'maximum', graph_id, src, dst, greatest(w, wt) FROM t
      UNION ALL SELECT 'fill', graph_id, src, dst,
        ((CASE WHEN w <= 0 AND wt > 0 THEN w + wt ELSE w END)
         + (CASE WHEN wt <= 0 AND w > 0 THEN wt + w ELSE wt END)) / 2 FROM t
      UNION ALL SELECT 'tril', * FROM tl UNION ALL SELECT 'triu', * FROM tu)
SELECT method, graph_id, src, dst, ROUND(w, 6) AS w FROM r WHERE w <> 0""")
def g21_symmetrize(spark, sf):
    """All five ways to symmetrize the directed class graphs, from one transpose join."""
    out = gr.symmetrize_by(dg(spark, sf), ["average", "maximum", "fill", "tril", "triu"])
    return out.select("method", "graph_id", "src", "dst", r6("w").alias("w"))


_CENTRES_SQL = """c AS (SELECT label, pos, AVG(x) AS cx FROM
  (SELECT label, UNNEST(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)
  GROUP BY 1, 2),
px AS (SELECT vec_id, UNNEST(embedding) AS x, generate_subscripts(embedding, 1) AS pos
       FROM embeddings)"""


def centres(spark, sf):
    """Centre of every label: mean vector (array<double>)."""
    e = td(spark, sf).table("embeddings")
    long = e.select("label", F.posexplode("embedding").alias("pos", "x"))
    m = long.groupBy("label", "pos").agg(F.avg("x").alias("cx"))
    return (m.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("pos", "cx"))).alias("_s"))
            .select("label", F.transform("_s", lambda s: s["cx"]).alias("center")))


@register("g23_distance_to_centres", f"""WITH {_CENTRES_SQL}
SELECT px.vec_id, c.label, ROUND(sqrt(abs(SUM((px.x - c.cx) * (px.x - c.cx)))), 6) AS dist
FROM px JOIN c ON c.pos = px.pos GROUP BY 1, 2""")
def g23_distance_to_centres(spark, sf):
    e = td(spark, sf).table("embeddings").select(
        "vec_id", F.col("embedding").cast("array<double>").alias("v"))
    d = gr.distances_to(e, centres(spark, sf), "v", "label", "center")
    return d.select("vec_id", "label", r6("dist").alias("dist"))


@register("g24_rescale_center", """WITH p AS (SELECT vec_id, UNNEST(embedding) AS val,
  CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS dim FROM embeddings),
c AS (SELECT vec_id, dim, val - AVG(val) OVER (PARTITION BY dim) AS val FROM p)
SELECT vec_id, dim, ROUND(val / (SELECT MAX(val) FROM c), 6) AS val FROM c""")
def g24_rescale_center(spark, sf):
    e = td(spark, sf).table("embeddings")
    p = e.select("vec_id", F.posexplode("embedding").alias("dim", "val")).withColumn(
        "val", F.col("val").cast("double"))
    return gr.rescale_center(p, "vec_id").select("vec_id", "dim", r6("val").alias("val"))


@register("g25_log_scales", f"""WITH {DG},
dw AS (SELECT graph_id, src, SUM(w) AS dw FROM dg GROUP BY 1, 2),
b AS (SELECT graph_id, MIN(dw) FILTER (WHERE dw > 0) AS lmin, 2.0 * MAX(dw) AS lmax FROM dw
      GROUP BY 1)
SELECT graph_id, CAST(k AS INTEGER) AS k,
  ROUND(exp(ln(2.0 / lmin) + k * (ln(1.0 / lmax) - ln(2.0 / lmin)) / 2), 6) AS scale
FROM b, range(3) t(k)""")
def g25_log_scales(spark, sf):
    d = dg(spark, sf)
    dw = d.groupBy("graph_id", "src").agg(F.sum("w").alias("dw"))
    b = dw.groupBy("graph_id").agg(F.min(F.when(F.col("dw") > 0, F.col("dw"))).alias("lmin"),
                                   (F.lit(2.0) * F.max("dw")).alias("lmax"))
    return gr.log_scales(b, 3).select("graph_id", F.col("k").cast("int"), r6("scale").alias("scale"))
