"""Graph signal operators on many graphs at once.

A graph is a weight table ``edges(graph_id, src, dst, w)`` (entry W[src, dst]) plus a
node table ``nodes(graph_id, node)`` (isolated nodes take part).  Signals are long
tables ``(graph_id, node, [signal,] val)``.  Every operator is a join / aggregation keyed
by ``graph_id``, so the work spreads over all graphs of all samples; no operator
collects a graph to the driver.  Iterative operators (reachability, components, power
iteration) run one distributed step per iteration over all graphs together and cut the
lineage with reliable checkpoints.
"""

from __future__ import annotations

from collections.abc import Iterable
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.sessions import ordinal
from tessera.session import materialize

G = "graph_id"


# ---------------------------------------------------------------- construction, checks
def build(edges: DataFrame) -> DataFrame:
    """G1: drop zero weights (an entry of weight 0 is no edge)."""
    return edges.filter(F.col("w") != 0)


def bad_endpoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """G1: edges whose ends are not nodes of their graph (the "not square" case)."""
    n = nodes.select(G, "node")
    src_ok = edges.join(n.withColumnRenamed("node", "src"), [G, "src"], "left_anti")
    dst_ok = edges.join(n.withColumnRenamed("node", "dst"), [G, "dst"], "left_anti")
    return src_ok.unionByName(dst_ok).distinct()


def check_weights(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per graph has_inf_val, has_nan_value, is_not_square, diag_is_not_zero."""
    flags = edges.groupBy(G).agg(
        F.bool_or(F.col("w").isin(float("inf"), float("-inf"))).alias("has_inf_val"),
        F.bool_or(F.isnan("w")).alias("has_nan_value"),
        F.bool_or((F.col("src") == F.col("dst")) & (F.col("w") != 0)).alias("diag_is_not_zero"))
    bad = bad_endpoints(edges, nodes).select(G).distinct().withColumn("_bad", F.lit(True))
    return (nodes.select(G).distinct().join(flags, G, "left").join(bad, G, "left")
            .select(G, F.coalesce("has_inf_val", F.lit(False)).alias("has_inf_val"),
                    F.coalesce("has_nan_value", F.lit(False)).alias("has_nan_value"),
                    F.coalesce("_bad", F.lit(False)).alias("is_not_square"),
                    F.coalesce("diag_is_not_zero", F.lit(False)).alias("diag_is_not_zero")))


def _with_transpose(edges: DataFrame) -> DataFrame:
    """(graph_id, src, dst, w, wt) over the union of both orientations, 0 where absent."""
    t = edges.select(G, F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("w").alias("wt"))
    return (edges.join(t, [G, "src", "dst"], "full")
            .select(G, "src", "dst", F.coalesce("w", F.lit(0.0)).alias("w"),
                    F.coalesce("wt", F.lit(0.0)).alias("wt")))


def is_directed(edges: DataFrame, tol: float = 0.0) -> DataFrame:
    """A graph is directed iff W differs from its transpose (by more than ``tol``;
    default exact comparison)."""
    return _with_transpose(edges).groupBy(G).agg(
        F.bool_or(F.abs(F.col("w") - F.col("wt")) > F.lit(tol)).alias("directed"))


def edge_count(edges: DataFrame, tol: float = 0.0) -> DataFrame:
    """Ne = all entries if directed, else entries of the lower triangle (diagonal
    included)."""
    d = is_directed(edges, tol)
    c = edges.groupBy(G).agg(F.count(F.lit(1)).alias("_all"),
                             F.count_if(F.col("src") >= F.col("dst")).alias("_low"))
    return c.join(d, G).select(G, "directed", F.when(F.col("directed"), F.col("_all"))
                               .otherwise(F.col("_low")).alias("ne"))


def edge_list(edges: DataFrame) -> DataFrame:
    """(graph_id, e, v_in, v_out, weight) of an undirected graph: lower triangle
    with the diagonal, numbered in (row, column) order; ``e`` is the edge index used by
    the differential operator.  Offsets come from counts of rows, a window holds one row."""
    low = edges.filter(F.col("src") >= F.col("dst"))
    return ordinal(low, [G], ["src", "dst"], F.col("src"), "e").select(
        G, F.col("e").cast("int").alias("e"), F.col("src").alias("v_in"),
        F.col("dst").alias("v_out"), F.col("w").alias("weight"))


def binary_adjacency(edges: DataFrame) -> DataFrame:
    """A = W > 0."""
    return edges.filter(F.col("w") > 0).select(G, "src", "dst")


def degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Degree d (entries > 0 of the row) and weighted degree dw (row sum),
    dense over the node table."""
    agg = edges.groupBy(G, F.col("src").alias("node")).agg(
        F.count_if(F.col("w") > 0).alias("d"), F.sum("w").alias("dw"))
    return (nodes.join(agg, [G, "node"], "left")
            .select(G, "node", F.coalesce("d", F.lit(0)).cast("long").alias("d"),
                    F.coalesce("dw", F.lit(0.0)).alias("dw")))


# ---------------------------------------------------------------- Laplacians
def laplacian(edges: DataFrame, nodes: DataFrame, lap_type: str = "combinatorial",
              directed: bool = False) -> DataFrame:
    """Laplacian entries (graph_id, i, j, v), non-zero only.

    combinatorial: D - W (undirected) or 0.5 (Din + Dout - W - W^T) (directed);
    normalized (undirected only): I - D^-1/2 W D^-1/2, isolated nodes keep 1.
    Off-diagonal terms and diagonal terms are unioned and summed per (i, j).
    """
    if lap_type not in ("combinatorial", "normalized"):
        raise ValueError(f"a Laplacian is combinatorial or normalized, not {lap_type!r}")
    if lap_type == "normalized":
        if directed:
            raise NotImplementedError("the normalized Laplacian needs an undirected graph")
        dw = degrees(edges, nodes).select(G, "node", "dw")
        inv = dw.select(G, "node", F.when(F.col("dw") > 0, F.pow("dw", -0.5)).alias("r"))
        off = (edges.join(inv.withColumnRenamed("node", "src").withColumnRenamed("r", "ri"), [G, "src"])
               .join(inv.withColumnRenamed("node", "dst").withColumnRenamed("r", "rj"), [G, "dst"])
               .select(G, F.col("src").alias("i"), F.col("dst").alias("j"),
                       (-F.col("ri") * F.col("w") * F.col("rj")).alias("v")))
        eye = nodes.select(G, F.col("node").alias("i"), F.col("node").alias("j"), F.lit(1.0).alias("v"))
        parts = off.unionByName(eye)
    elif not directed:
        off = edges.select(G, F.col("src").alias("i"), F.col("dst").alias("j"), (-F.col("w")).alias("v"))
        diag = edges.groupBy(G, F.col("src").alias("i")).agg(F.sum("w").alias("v")) \
            .select(G, "i", F.col("i").alias("j"), "v")
        parts = off.unionByName(diag)
    else:
        half = F.lit(0.5)
        off = edges.select(G, F.col("src").alias("i"), F.col("dst").alias("j"), (-half * F.col("w")).alias("v"))
        offt = edges.select(G, F.col("dst").alias("i"), F.col("src").alias("j"), (-half * F.col("w")).alias("v"))
        dout = edges.select(G, F.col("src").alias("i"), F.col("src").alias("j"), (half * F.col("w")).alias("v"))
        din = edges.select(G, F.col("dst").alias("i"), F.col("dst").alias("j"), (half * F.col("w")).alias("v"))
        parts = off.unionByName(offt).unionByName(dout).unionByName(din)
    # an entry is zero if its parts cancel, whatever the scale of the weights
    return (parts.groupBy(G, "i", "j").agg(F.sum("v").alias("v"), F.sum(F.abs("v")).alias("_s"))
            .filter(F.abs("v") > F.lit(1e-12) * F.col("_s")).drop("_s"))


# ---------------------------------------------------------------- products
def spmv(matrix: DataFrame, signal: DataFrame, i: str = "i", j: str = "j", v: str = "v",
         keys: tuple[str, ...] = ()) -> DataFrame:
    """Sparse matrix times signal per graph: out[i] = Σ_j M[i,j] · s[j].

    ``signal`` is (graph_id, node, *keys, val); output (graph_id, node, *keys, val),
    only rows that some product reaches (callers union shift terms before summing).
    """
    m = matrix.select(G, F.col(i).alias("_i"), F.col(j).alias("node"), F.col(v).alias("_m"))
    return (m.join(signal, [G, "node"])
            .groupBy(G, F.col("_i").alias("node"), *keys)
            .agg(F.sum(F.col("_m") * F.col("val")).alias("val")))


def lmax_bound(edges: DataFrame, nodes: DataFrame, lap_type: str = "combinatorial") -> DataFrame:
    """G10 (bound mode): 2·max(dw) (combinatorial) or 2 (normalized), per graph."""
    d = degrees(edges, nodes)
    if lap_type == "normalized":
        return d.select(G).distinct().withColumn("lmax", F.lit(2.0))
    return d.groupBy(G).agg((F.lit(2.0) * F.max("dw")).alias("lmax"))


def lmax_power(lap: DataFrame, nodes: DataFrame, tol: float = 5e-4, checkpoint_every: int = 5,
               margin: float = 1.01) -> DataFrame:
    """G10 (power mode): power iteration on each L until no graph's Rayleigh quotient rises
    by more than ``tol`` of itself over ``checkpoint_every`` steps, × ``margin`` (the 1 %
    safety margin).  The quotients of a positive semidefinite L only rise and are bounded,
    so the loop ends.  The start vector is a hash of the node: a nearly constant one would
    lie almost in the kernel of L.  Iterates are rescaled per graph every
    ``checkpoint_every`` steps, where the lineage is cut as well, so a step is one join and
    one aggregation; graphs without entries get 0."""
    lap = materialize(lap)       # read once per iteration: cut its lineage first
    x = nodes.select(G, "node", (F.pmod(F.xxhash64("node"), F.lit(2001)) / 1000.0 - 1.0003).alias("val"))
    before = None
    while True:
        for _ in range(checkpoint_every):
            x = spmv(lap, x)
        nrm = x.groupBy(G).agg(F.max(F.abs("val")).alias("_n"))
        x = materialize(x.join(nrm, G).select(
            G, "node", F.when(F.col("_n") > 0, F.col("val") / F.col("_n"))
            .otherwise(F.lit(0.0)).alias("val")))
        y = spmv(lap, x).withColumnRenamed("val", "y")
        now = materialize(x.join(y, [G, "node"], "left").groupBy(G).agg(
            F.coalesce(F.try_divide(F.sum(F.col("val") * F.coalesce("y", F.lit(0.0))),
                                    F.sum(F.col("val") ** 2)), F.lit(0.0)).alias("_r")))
        if before is not None and now.join(before, G).filter(
                F.abs(F.col("_r") - F.col("_b")) > tol * F.col("_r")).isEmpty():
            break
        before = now.withColumnRenamed("_r", "_b")
    return nodes.select(G).distinct().join(now, G, "left").select(
        G, (F.coalesce("_r", F.lit(0.0)) * F.lit(margin)).alias("lmax"))


def lmax_exact(lap: DataFrame, nodes: DataFrame, margin: float = 1.01,
               max_nodes: int = 2000) -> DataFrame:
    """G10 (exact mode): the largest eigenvalue of each graph's L from a dense symmetric
    eigen-solver, × ``margin``.  One group = one graph's Laplacian entries, bounded by
    ``max_nodes``² (the node count is fixed by the item classes), so a grouped pandas
    function is safe here; graphs above the guard raise."""
    import numpy as np
    import pandas as pd

    n = nodes.groupBy(G).agg(F.max("node").alias("_nmax"))
    # graphs without entries have one row of an entry 0
    rows = n.join(lap, G, "left").select(
        G, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("i", "j")], F.coalesce("v", F.lit(0.0)).alias("v"), "_nmax")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        size = int(pdf["_nmax"].iloc[0]) + 1
        if size > max_nodes:
            raise ValueError(f"graph with {size} nodes is above the dense guard {max_nodes}")
        m = np.zeros((size, size))
        np.add.at(m, (pdf["i"].to_numpy(), pdf["j"].to_numpy()), pdf["v"].to_numpy())
        ev = np.linalg.eigvalsh((m + m.T) / 2.0)
        return pd.DataFrame({G: [pdf[G].iloc[0]], "lmax": [float(ev[-1]) * margin]})

    return rows.groupBy(G).applyInPandas(
        solve, schema=f"{G} {nodes.schema[G].dataType.simpleString()}, lmax double")


# ---------------------------------------------------------------- structure
def subgraph(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """The subgraph on the nodes of ``keep(graph_id, node)``, renumbered 0..n-1 in
    node order (both ends must be kept: two semi-joins, then the renumbering).  A node listed
    twice counts once; ranges of 4,096 nodes are numbered apart."""
    rank = ordinal(keep.select(G, "node").distinct(), [G], ["node"],
                   F.floor(F.col("node") / 4096), "_new").withColumn("_new", F.col("_new").cast("int"))
    e = (edges.join(rank.select(G, F.col("node").alias("src"), F.col("_new").alias("_s")), [G, "src"])
         .join(rank.select(G, F.col("node").alias("dst"), F.col("_new").alias("_d")), [G, "dst"]))
    return e.select(G, F.col("_s").alias("src"), F.col("_d").alias("dst"), "w")


def reach_from(edges: DataFrame, nodes: DataFrame, start: int = 0,
               checkpoint_every: int = 4, keys: tuple[str, ...] = (G,)) -> DataFrame:
    """Nodes reachable from ``start`` over edges with w > 0, for every graph (``keys``
    name a graph; extra keys such as an orientation run in the same loop).  Frontier
    expansion: one join + anti-join per step until no graph grows."""
    keys = list(keys)
    # loop inputs are read every step: cut their lineage once
    adj = materialize(edges.filter(F.col("w") > 0).select(*keys, F.col("src").alias("node"), "dst"))
    seen = materialize(nodes.filter(F.col("node") == start).select(*keys, "node"))
    frontier = seen
    for k in count():
        nxt = (frontier.join(adj, [*keys, "node"]).select(*keys, F.col("dst").alias("node")).distinct()
               .join(seen, [*keys, "node"], "left_anti")).persist()
        if nxt.isEmpty():
            break
        seen = seen.unionByName(nxt)
        if (k + 1) % checkpoint_every == 0:
            seen = materialize(seen)
            nxt = materialize(nxt)
        frontier = nxt
    return seen


def is_connected(edges: DataFrame, nodes: DataFrame, directed: bool = False) -> DataFrame:
    """Undirected, all nodes of one component; directed, every node reachable from
    node 0 over the edges and over the transposed edges, both orientations in one loop
    (key ``dir``)."""
    if not directed:
        c = components(edges.filter(F.col("w") > 0), nodes)
        return c.groupBy(G).agg((F.min("component") == F.max("component")).alias("connected"))
    e = edges.select(G, "src", "dst", "w", F.lit(0).alias("dir")).unionByName(
        edges.select(G, F.col("dst").alias("src"), F.col("src").alias("dst"), "w", F.lit(1).alias("dir")))
    n_all = materialize(nodes.select(G, "node", F.explode(F.array(F.lit(0), F.lit(1))).alias("dir")))
    r = (reach_from(e, n_all, keys=(G, "dir")).groupBy(G, "dir").agg(F.count(F.lit(1)).alias("_r")))
    n = n_all.groupBy(G, "dir").agg(F.count(F.lit(1)).alias("_n"))
    per_dir = n.join(r, [G, "dir"], "left").select(
        G, (F.coalesce("_r", F.lit(0)) == F.col("_n")).alias("_ok"))
    return per_dir.groupBy(G).agg(F.bool_and("_ok").alias("connected"))


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Connected components of undirected graphs as (graph_id, node, component) with
    component = smallest node id of the component, all graphs together.

    Every node points to a node of its component, at first to itself.  A round offers each
    node the smallest pointer's pointer among its neighbours, offers the same to the node it
    points to, and lets it skip to its own pointer's pointer.  Offers only lower a pointer, so
    the sum of all pointers tells when a round has changed nothing.  Skipping halves the way
    to the smallest node, so that rounds grow with the logarithm of the diameter."""
    e = binary_adjacency(edges).select(G, "src", "dst")
    adj = materialize(e.unionByName(e.select(G, F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    at = materialize(nodes.select(G, "node", F.col("node").cast("long").alias("to")))
    total = None
    while True:
        now = at.agg(F.sum(F.col("to").cast("decimal(38,0)"))).head()[0]
        if now == total:
            return at.select(G, "node", F.col("to").cast(nodes.schema["node"].dataType).alias("component"))
        total = now
        step = at.select(G, F.col("node").alias("to"), F.col("to").alias("skip"))
        two = at.join(step, [G, "to"])  # (graph_id, to, node, skip)
        near = (adj.join(two.select(G, F.col("node").alias("dst"), "skip"), [G, "dst"])
                .groupBy(G, F.col("src").alias("node")).agg(F.min("skip").alias("best")))
        seen = two.join(near, [G, "node"], "left")
        offers = seen.select(G, F.explode(F.array(
            F.struct("node", F.least("skip", F.coalesce("best", F.col("skip"))).alias("to")),
            F.struct(F.col("to").cast(nodes.schema["node"].dataType).alias("node"),
                     F.coalesce("best", F.col("skip")).alias("to")))).alias("o"))
        # a pointer never rises: a node's own offer is at most its pointer
        at = materialize(offers.groupBy(G, F.col("o.node").alias("node")).agg(F.min("o.to").alias("to")))


# ---------------------------------------------------------------- differential operator
def differential_operator(edges: DataFrame, nodes: DataFrame,
                          lap_type: str = "combinatorial") -> DataFrame:
    """D as (graph_id, e, node, v): +sqrt(w) at v_in, -sqrt(w) at v_out
    (normalized: w / dw of that end), summed per (e, node) (diagonal edges vanish)."""
    el = edge_list(edges)
    if lap_type == "combinatorial":
        a, b = F.sqrt("weight"), -F.sqrt("weight")
        x = el
    else:
        dw = degrees(edges, nodes).select(G, "node", "dw")
        x = (el.join(dw.select(G, F.col("node").alias("v_in"), F.col("dw").alias("dw_in")), [G, "v_in"])
             .join(dw.select(G, F.col("node").alias("v_out"), F.col("dw").alias("dw_out")), [G, "v_out"]))
        a, b = F.sqrt(F.col("weight") / F.col("dw_in")), -F.sqrt(F.col("weight") / F.col("dw_out"))
    rows = (x.select(G, "e", F.col("v_in").alias("node"), a.alias("v"))
            .unionByName(x.select(G, "e", F.col("v_out").alias("node"), b.alias("v"))))
    return rows.groupBy(G, "e", "node").agg(F.sum("v").alias("v"))


def grad(dop: DataFrame, signal: DataFrame) -> DataFrame:
    """y = D·s, an edge signal (graph_id, e, val)."""
    return (dop.join(signal, [G, "node"]).groupBy(G, "e")
            .agg(F.sum(F.col("v") * F.col("val")).alias("val")))


def div(dop: DataFrame, edge_signal: DataFrame, nodes: DataFrame) -> DataFrame:
    """y = D^T·s, a node signal (graph_id, node, val), dense over nodes."""
    y = (dop.join(edge_signal, [G, "e"]).groupBy(G, "node")
         .agg(F.sum(F.col("v") * F.col("val")).alias("val")))
    return nodes.join(y, [G, "node"], "left").select(G, "node", F.coalesce("val", F.lit(0.0)).alias("val"))


# ---------------------------------------------------------------- symmetrize
def symmetrize_by(edges: DataFrame, methods: Iterable[str]) -> DataFrame:
    """G21 for several methods from one join with the transpose: (method, graph_id, src, dst,
    w), non-zero entries.  ``tril`` and ``triu`` mirror one triangle, negative weights off
    the diagonal become 0."""
    w, wt, zero = F.col("w"), F.col("wt"), F.lit(0.0)
    below, above = F.col("src") > F.col("dst"), F.col("src") < F.col("dst")
    filled = F.when((w <= 0) & (wt > 0), w + wt).otherwise(w)
    filled_t = F.when((wt <= 0) & (w > 0), wt + w).otherwise(wt)
    ways = {"average": (w + wt) / 2,
            "maximum": F.greatest(w, wt),
            "fill": (filled + filled_t) / 2,
            "tril": F.when(below, F.greatest(w, zero)).when(above, F.greatest(wt, zero)).otherwise(w),
            "triu": F.when(above, F.greatest(w, zero)).when(below, F.greatest(wt, zero)).otherwise(w)}
    methods = list(methods)
    for m in methods:
        if m not in ways:
            raise ValueError(f"no way to symmetrize by {m!r}")
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), ways[m].alias("w")) for m in methods]))
    return (_with_transpose(edges).select(G, "src", "dst", each.alias("_m"))
            .select("_m.method", G, "src", "dst", "_m.w").filter(F.col("w") != 0))


def symmetrize(edges: DataFrame, method: str = "average") -> DataFrame:
    """Average, maximum, fill, tril or triu; non-zero entries of the result."""
    return symmetrize_by(edges, [method]).drop("method")


# ---------------------------------------------------------------- vectors and scales
def _sqdist(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0),
                       lambda acc, t: acc + t)


def distances_to(points: DataFrame, refs: DataFrame, vec: str, ref_id: str, ref_vec: str) -> DataFrame:
    """G23 re-aimed: Euclidean distance of every point to every reference vector of a
    small, bounded set (e.g. cluster centres).  The reference set is folded into one
    array by a scalar subquery and expanded inside each point row — no join, no pair
    table beyond points × references."""
    arr = refs.agg(F.array_sort(F.collect_list(F.struct(F.col(ref_id).alias("id"),
                                                        F.col(ref_vec).alias("v"))))).scalar()
    per = points.withColumn("_r", F.explode(arr))
    return per.select(*[c for c in points.columns if c != vec],
                      F.col("_r.id").alias(ref_id),
                      F.sqrt(F.abs(_sqdist(F.col(vec), F.col("_r.v")))).alias("dist"))


def rescale_center(points: DataFrame, key: str, dim: str = "dim", val: str = "val") -> DataFrame:
    """Centre each dimension over the points, then divide everything by the
    global maximum (one scalar subquery)."""
    # one mean per dimension: a small table that adaptive execution broadcasts by its bytes
    means = points.groupBy(dim).agg(F.avg(val).alias("_m"))
    c = (points.join(means, dim)
         .withColumn(val, F.col(val) - F.col("_m")).drop("_m"))
    mx = c.select(F.max(val)).scalar()
    return c.withColumn(val, F.col(val) / mx)


def log_scales(bounds: DataFrame, n_scales: int, t1: float = 1.0, t2: float = 2.0,
               lmin: str = "lmin", lmax: str = "lmax") -> DataFrame:
    """Per graph, n scales log-spaced from t2/lmin down to t1/lmax."""
    hi = F.log(F.lit(t2) / F.col(lmin))
    lo = F.log(F.lit(t1) / F.col(lmax))
    k = F.col("k")
    step = (lo - hi) / F.lit(max(n_scales - 1, 1))
    return (bounds.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_scales - 1))).alias("k"))
            .withColumn("scale", F.exp(hi + k * step)))
