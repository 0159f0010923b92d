"""Next-items recommendation from the sample graphs, and its evaluation.

score(sample, j) = Σ over the distinct history items i of the sample of
``A1n[i,j] + A2n[i,j]``, where ``A·n`` is the row-wise L1-normalized (K17) adjacency of
the sample's two graphs.  For a hypergraph adjacency the row sum of row i equals the
weighted vertex degree, so normalizing is a join with the per-sample degree table.
Only the history rows of each sample's adjacency are materialized.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import ranking as rk
from tessera.operators import hypergraph as hg
from tessera.operators import samples as sp

SAMPLE = sp.SAMPLE


def top_k(scores: DataFrame, part: list[str], score_col: str, item_col: str, k: int,
          digits: int = 6) -> DataFrame:
    """The ``k`` best items per group, score rounded to ``digits`` desc then item
    asc (total order, so results are deterministic).  Bounded per group by the
    candidate count.  A 1e-9 nudge before rounding keeps ulp-level float noise from
    straddling a rounding tie."""
    s = F.round(F.col(score_col) + F.lit(1e-9), digits)
    w = Window.partitionBy(*part).orderBy(s.desc(), F.col(item_col).asc())
    return (scores.withColumn(score_col, s).withColumn("rk", F.row_number().over(w))
            .filter(F.col("rk") <= k).withColumn("rk", F.col("rk").cast("int")))


def sample_scores(g: sp.ClassGraphs, top_k_label: int, history: str = "target") -> DataFrame:
    """R3 scores (sample, j, score) for every sample of ``g``; ``history`` picks the
    history items (D10: 'target' or the original's 'last')."""
    header = sp.sample_header(g, top_k_label)
    ti = sp.target_items(g, top_k_label)
    hist = sp.history_rows(g, ti, header, history)
    removed = sp.removed_pairs(g, top_k_label)
    parts = []
    for inc, (delta, dv_delta) in ((g.inc1, sp.view1_delta(ti)),
                                   (g.inc2, sp.view2_delta(g, removed))):
        adj = hg.adjacency(inc)
        dv = hg.vertex_degree(inc)
        deg = sp.sample_degree(header, dv, dv_delta, rows=hist).withColumnRenamed("node", "i")
        # the degree goes with the row's key: a row is unpacked only after the last join
        wanted = hist.join(header.select(*SAMPLE, "graph_id"), SAMPLE).join(deg, [*SAMPLE, "i"])
        rows = sp.overlay(wanted, sp.class_rows(adj), sp.changed_rows(delta))
        parts.append(rows.select(*SAMPLE, "dv", F.inline("row"))
                     .select(*SAMPLE, "j", (F.col("w") / F.col("dv")).alias("s")))
    return (parts[0].unionByName(parts[1]).groupBy(*SAMPLE, "j")
            .agg(F.sum("s").alias("score")))


def recommend(g: sp.ClassGraphs, top_k_label: int, k: int, history: str = "target") -> DataFrame:
    """Ranked list (sample, item, rk, score), at most ``k`` items per sample."""
    sc = sample_scores(g, top_k_label, history).withColumnRenamed("j", "item")
    return top_k(sc, SAMPLE, "score", "item", k)


def evaluate(ranked: DataFrame, labels: DataFrame) -> DataFrame:
    """Per-sample metrics (R4-R11): the ranked rows are folded into a list per sample
    (bounded by k) and compared with the label list."""
    rec = (ranked.groupBy(*SAMPLE)
           .agg(F.array_sort(F.collect_list(F.struct("rk", "item"))).alias("_r"))
           .select(*SAMPLE, F.transform("_r", lambda x: x["item"]).alias("rec")))
    both = labels.join(rec, SAMPLE, "left").withColumn(
        "rec", F.coalesce("rec", F.array().cast("array<int>")))
    return both.select(*SAMPLE, *rk.all_metrics(F.col("rec"), F.col("label")))


def report(per_sample: DataFrame) -> DataFrame:
    """Mean of every per-sample metric (one row)."""
    return per_sample.agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.avg(F.col("hit").cast("double")).alias("hit_rate"),
        F.avg("rr").alias("mrr"), F.avg("ap").alias("map"),
        F.avg("precision").alias("precision"), F.avg("recall").alias("recall"),
        F.avg("f1").alias("f1"), F.avg("ndcg").alias("ndcg"))


def wavelet_conv(phi: DataFrame, phi_inv: DataFrame, features: DataFrame, weights: DataFrame,
                 theta: DataFrame, keys: tuple[str, ...] = ("graph_id",)) -> DataFrame:
    """One hypergraph wavelet layer with given parameters,
    ``out = Φ · diag(θ) · Φ⁻¹ · (X · W)``, evaluated right to left as three sparse
    products (never an n³ product):

    * ``phi`` / ``phi_inv``: (*keys, i, j, val) wavelet matrices of each graph,
    * ``features``: (node, f, x) node features X (shared by all graphs),
    * ``weights``: (f, o, w) the weight matrix W,
    * ``theta``: (node, theta) the diagonal filter.
    Output (*keys, node, o, val).
    """
    keys = list(keys)
    xw = (features.join(weights, "f").groupBy("node", "o")
          .agg(F.sum(F.col("x") * F.col("w")).alias("y")))
    z = (phi_inv.join(xw.withColumnRenamed("node", "j"), "j")
         .groupBy(*keys, F.col("i").alias("k"), "o").agg(F.sum(F.col("val") * F.col("y")).alias("z")))
    z = z.join(theta.withColumnRenamed("node", "k"), "k").withColumn("z", F.col("z") * F.col("theta"))
    return (phi.join(z.withColumnRenamed("k", "j"), [*keys, "j"])
            .groupBy(*keys, F.col("i").alias("node"), "o")
            .agg(F.sum(F.col("val") * F.col("z")).alias("val")))


def fuse_views(*outs: DataFrame, keys: tuple[str, ...] = ("graph_id",)) -> DataFrame:
    """R2: the layer outputs of the views summed per (graph, node, o)."""
    u = outs[0]
    for o in outs[1:]:
        u = u.unionByName(o)
    return u.groupBy(*keys, "node", "o").agg(F.sum("val").alias("val"))
