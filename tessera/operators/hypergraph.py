"""Hypergraph construction as edge tables (H1-H7).

A hypergraph is an incidence table ``(graph_id, edge, node)`` (``edge`` may be any
comparable column, e.g. a struct naming a session).  Its clique adjacency
``A = H · W · De^-1 · H^T`` becomes one equi-join of the incidence table with itself on
(graph_id, edge) followed by a sum per (graph_id, i, j).  A hyperedge holds distinct
nodes, so it has at most ``n_nodes`` members and the join emits at most ``n_nodes²``
pairs per hyperedge, however large a graph or a user is; the partial aggregate after the
join folds them to at most ``n_nodes²`` rows per task and graph before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dense_nodes(graphs: DataFrame, n_nodes: int, graph_col: str = "graph_id",
                node_col: str = "node") -> DataFrame:
    """Node table with every node 0..n_nodes-1 of every graph (N is fixed, isolated
    nodes included).  A generator per graph row, not a join."""
    return (graphs.select(graph_col).distinct()
            .select(graph_col, F.explode(F.sequence(F.lit(0), F.lit(n_nodes - 1))).alias(node_col)))


def _dedupe(rows: DataFrame) -> DataFrame:
    """Distinct (graph_id, edge, node) through a per-edge set: the shuffle is keyed by
    (graph_id, edge), so later per-edge steps (degrees, member sets) need no new one."""
    return (rows.groupBy("graph_id", "edge").agg(F.collect_set("node").alias("_m"))
            .select("graph_id", "edge", F.explode("_m").alias("node")))


def session_incidence(long: DataFrame, graph_col: str, edge_cols: list[str],
                      node_col: str) -> DataFrame:
    """H1: one hyperedge per session; members = distinct items of the session."""
    return _dedupe(long.select(F.col(graph_col).alias("graph_id"),
                               F.struct(*[F.col(c) for c in edge_cols]).alias("edge"),
                               F.col(node_col).cast("int").alias("node")))


def successor_incidence(pairs: DataFrame, graph_col: str = "graph_id", src: str = "src",
                        dst: str = "dst") -> DataFrame:
    """H2: one hyperedge per source item that has a successor; members = distinct
    items seen right after it in any session of the graph.  ``pairs`` comes from
    ``sessions.consecutive_pairs``."""
    return _dedupe(pairs.select(F.col(graph_col).alias("graph_id"),
                                F.struct(F.col(src).cast("int").alias("src")).alias("edge"),
                                F.col(dst).cast("int").alias("node")))


def edge_degree(incidence: DataFrame) -> DataFrame:
    """H4: members per hyperedge (graph_id, edge, de)."""
    return incidence.groupBy("graph_id", "edge").agg(F.count(F.lit(1)).cast("int").alias("de"))


def vertex_degree(incidence: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """H3: hyperedges per node (graph_id, node, dv); dense over ``nodes`` if given."""
    dv = incidence.groupBy("graph_id", "node").agg(F.count(F.lit(1)).cast("int").alias("dv"))
    if nodes is None:
        return dv
    return (nodes.join(dv, ["graph_id", "node"], "left")
            .withColumn("dv", F.coalesce("dv", F.lit(0))))


def inverse_vertex_degree(dv: DataFrame) -> DataFrame:
    """H7: 1/(dv + 1e-6) (built by the reference, then unused in A)."""
    return dv.withColumn("dv_inv", F.lit(1.0) / (F.col("dv") + F.lit(1e-6)))


def members(incidence: DataFrame) -> DataFrame:
    """Member set of every hyperedge: (graph_id, edge, m array<int>).  At most
    n_nodes entries per row because members are distinct node ids."""
    return incidence.groupBy("graph_id", "edge").agg(F.collect_set("node").alias("m"))


def adjacency(incidence: DataFrame, weight: Column | None = None) -> DataFrame:
    """H6: ``A[i,j] = Σ_e w_e · H[i,e] · H[j,e] / de`` with the diagonal kept.

    ``weight`` (H5) is a column over the member rows (graph_id, edge, m), default 1.0
    for every edge.  One aggregation builds each hyperedge's member set (de = its
    size); the (i, j) products of a hyperedge come from exploding that bounded set
    twice — no self-join, so the incidence lineage is computed once — and are summed
    with a partial aggregate before the shuffle on (graph_id, i, j).
    Output (graph_id, i, j, w), non-zero entries only.
    """
    w = F.lit(1.0) if weight is None else weight
    m = members(incidence)
    return (m.select("graph_id", F.explode("m").alias("i"), "m",
                     (w / F.size("m")).alias("_f"))
            .select("graph_id", "i", F.explode("m").alias("j"), "_f")
            .groupBy("graph_id", "i", "j").agg(F.sum("_f").alias("w")))
