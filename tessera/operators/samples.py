"""Leave-one-session-out samples over class hypergraphs.

A sample is one long session (the *target*) of a person class.  Its two graphs are the
class hypergraphs built from every long session of the class, with the target cut to
its prefix (its last ``top_k`` events become the label).  The reference rebuilds both
graphs from all b sessions for each of the b samples of a class (O(b²) work per class).

Here the class graphs are built once and each sample is a *delta*:

* view 1 (session hyperedges) is additive over hyperedges, so
  ``A1(sample) = A1(class) - P(full target) + P(cut target)`` with
  ``P(X)[i,j] = 1/|X|`` for i, j in X, and ``Dv1`` changes by ``-[i∈F] + [i∈Q]``;
* view 2 (successor hyperedges) keeps, per (class, src, dst), the number of sessions
  holding the pair; a pair leaves the sample's graph iff it occurs only in the target
  and only in its cut tail.  Only the hyperedges of the sources of such pairs change;
  their old and new member sets give the correction.

All work is joins and aggregations keyed by the sample, or by a row of a class.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import hypergraph as hg
from tessera.operators import sessions as ss
from tessera.session import materialize
from tessera.sources import io

SAMPLE = ["geek_id", "session_no"]


@dataclass
class ClassGraphs:
    long: DataFrame       # long sessions: graph_id, geek_id, session_no, pos, list_size, node
    inc1: DataFrame       # view-1 incidence (graph_id, edge, node)
    inc2: DataFrame       # view-2 incidence (graph_id, edge=struct(src), node)
    pair_cnt: DataFrame   # (graph_id, src, dst, cnt) sessions holding the pair
    pairs: DataFrame      # consecutive pairs of the long sessions, with pos and list_size


def class_graphs(sessions_long: DataFrame, list_cnt: int, class_col: str = "first_person_class",
                 item_col: str = "job_class", materialize_long: bool = True) -> ClassGraphs:
    """P12 + H1/H2 on the long sessions of every class."""
    long = (ss.keep_long(sessions_long, list_cnt)
            .select(F.col(class_col).alias("graph_id"), "geek_id", "session_no", "pos",
                    "list_size", F.col(item_col).cast("int").alias("node")))
    if materialize_long:
        # read by ~8 branches below: cut the lineage once (reliable checkpoint)
        long = materialize(long)
    inc1 = hg.session_incidence(long, "graph_id", SAMPLE, "node")
    # one pair table for the class graphs and the per-sample removals (exchange reuse)
    pairs = ss.consecutive_pairs(long, SAMPLE, "pos", "node")
    pair_cnt = (pairs.select("graph_id", "geek_id", "session_no", "src", "dst").distinct()
                .groupBy("graph_id", "src", "dst").agg(F.count(F.lit(1)).alias("cnt")))
    inc2 = hg.successor_incidence(pair_cnt)
    return ClassGraphs(long, inc1, inc2, pair_cnt, pairs)


def sample_header(g: ClassGraphs, top_k: int) -> DataFrame:
    """One row per sample: class, target, list size and the cut length (no shuffle:
    the first event of each session carries the session attributes)."""
    return (g.long.filter(F.col("pos") == 0)
            .select("graph_id", *SAMPLE, "list_size",
                    (F.col("list_size") - F.lit(top_k)).alias("cut_len")))


def target_items(g: ClassGraphs, top_k: int) -> DataFrame:
    """Distinct items of each target: (sample, graph_id, node, in_q) where ``in_q`` =
    the item occurs in the kept prefix; plus nF / nQ (distinct items of full / cut)."""
    t = (g.long.withColumn("cut_len", F.col("list_size") - F.lit(top_k))
         .groupBy("graph_id", *SAMPLE, "node")
         .agg(F.min("pos").alias("first_pos"), F.first("cut_len").alias("_c"))
         .withColumn("in_q", F.col("first_pos") < F.col("_c")).drop("_c"))
    w = Window.partitionBy(*SAMPLE)
    return (t.withColumn("n_f", F.count(F.lit(1)).over(w))
            .withColumn("n_q", F.sum(F.col("in_q").cast("int")).over(w)))


def removed_pairs(g: ClassGraphs, top_k: int) -> DataFrame:
    """View-2 pairs that leave each sample's graph: held by no other session and only
    in the target's cut tail.  (sample, graph_id, src, dst)."""
    pairs = g.pairs.withColumn("cut_len", F.col("list_size") - F.lit(top_k))
    per = (pairs.groupBy("graph_id", *SAMPLE, "src", "dst")
           .agg(F.max((F.col("pos") + 1 < F.col("cut_len")).cast("int")).alias("_in_prefix")))
    return (per.filter(F.col("_in_prefix") == 0)
            .join(g.pair_cnt.filter(F.col("cnt") == 1), ["graph_id", "src", "dst"])
            .select(*SAMPLE, "graph_id", "src", "dst"))


#: weight of a hyperedge from its key columns, e.g. ``lambda c: 1 + c("session_no") % 3``
EdgeWeight = Callable[[Callable[[str], Column]], Column]


def unit_weight(c: Callable[[str], Column]) -> Column:
    return F.lit(1.0)


def class_adjacency(inc: DataFrame, weight: EdgeWeight = unit_weight) -> DataFrame:
    """H5/H6 of the whole class with the same edge weights as the sample corrections."""
    return hg.adjacency(inc, weight=weight(lambda n: F.col(f"edge.{n}")).cast("double"))


def _members(node: str, kept: str) -> Column:
    """The (node, kept) pairs of a group whose nodes are distinct; null nodes have no place."""
    return F.collect_list(F.when(F.col(node).isNotNull(), F.struct(F.col(node).alias("j"), F.col(kept).alias("kept"))))


def _correction(kept, e, minus: str, plus: str) -> Column:
    """What a pair of members loses with the old hyperedge and, both kept, gets with the new."""
    return F.when(kept & e["kept"], F.col(minus) + F.col(plus)).otherwise(F.col(minus))


def view1_delta(ti: DataFrame, weight: EdgeWeight = unit_weight) -> tuple[DataFrame, DataFrame]:
    """Per-sample corrections of view 1: rows (sample, i, changed) as of ``changed_rows`` and
    (sample, node, dv_delta).  The hyperedge of view 1 is a session, so ``weight`` sees
    geek_id and session_no.  A row needs its target's members only, so it is formed in place:
    nothing is summed over pairs of members."""
    w = weight(F.col).cast("double")
    sets = ti.groupBy(*SAMPLE, "n_f", "n_q").agg(_members("node", "in_q").alias("_m")).select(
        *SAMPLE, "_m", (-w / F.col("n_f")).alias("_minus"), (w / F.nullif("n_q", F.lit(0))).alias("_plus"))
    changed = F.map_from_entries(F.transform("_m", lambda e: F.struct(
        e["j"].alias("j"), _correction(F.col("_e.kept"), e, "_minus", "_plus").alias("w"))))
    rows = (sets.select("*", F.explode("_m").alias("_e"))
            .select(*SAMPLE, F.col("_e.j").alias("i"), changed.alias("changed")))
    dv = ti.select(*SAMPLE, "node", (F.col("in_q").cast("int") - F.lit(1)).alias("dv_delta"))
    return rows, dv


def view2_delta(g: ClassGraphs, removed: DataFrame,
                weight: EdgeWeight = unit_weight) -> tuple[DataFrame, DataFrame]:
    """Per-sample corrections of view 2 from the hyperedges of affected sources.
    The hyperedge of view 2 is a source item, so ``weight`` sees src."""
    aff = removed.select(*SAMPLE, "graph_id", "src").distinct()
    members = g.inc2.select("graph_id", F.col("edge.src").alias("src"), "node")
    rm = removed.select(*SAMPLE, "src", F.col("dst").alias("node"), F.lit(True).alias("_rm"))
    m = (aff.join(members, ["graph_id", "src"])
         .join(rm, [*SAMPLE, "src", "node"], "left")
         .withColumn("kept", F.col("_rm").isNull()).drop("_rm"))
    n_new = F.size(F.filter("_m", lambda e: e["kept"]))
    w = weight(F.col).cast("double")
    sets = m.groupBy(*SAMPLE, "src").agg(_members("node", "kept").alias("_m")).select(
        *SAMPLE, "_m", (-w / F.size("_m")).alias("_minus"), (w / F.nullif(n_new, F.lit(0))).alias("_plus"))
    delta = (sets.select("*", F.explode("_m").alias("_e"))
             .select(*SAMPLE, F.col("_e.j").alias("i"), F.col("_e.kept").alias("_k"), "_minus", "_plus", F.explode("_m").alias("_e"))
             .select(*SAMPLE, "i", F.col("_e.j").alias("j"),
                     _correction(F.col("_k"), F.col("_e"), "_minus", "_plus").alias("w")))
    dv = (m.filter(~F.col("kept")).groupBy(*SAMPLE, "node")
          .agg((-F.count(F.lit(1))).alias("dv_delta")))
    return delta, dv


# ---------------------------------------------------------------- overlay edge store
# A sample's graph is its class graph but for the few rows of its own target.  The store
# keeps each class row once, (graph_id, i, row), and each sample's changes of a row,
# (sample, i, changed); a row of a sample is read by joining on (graph_id, i) and then
# merged inside the row, so that neither samples x nodes² entries are stored nor shuffled.

def class_rows(adj: DataFrame) -> DataFrame:
    """Adjacency rows of the classes: (graph_id, i, row), row = array of (j, w) by j."""
    return adj.groupBy("graph_id", "i").agg(
        F.array_sort(F.collect_list(F.struct("j", "w"))).alias("row"))


def changed_rows(delta: DataFrame) -> DataFrame:
    """Changes of the samples: (sample, i, changed), changed = map j -> summed correction.

    ``delta`` is (sample, i, j, w), or has these rows already.  The corrections are dealt by
    row before they are summed: they come of few, short input rows, so sums in front of the
    exchange would hold most of a view's pairs in the memory of one task."""
    if "changed" in delta.columns:
        return delta
    per = delta.repartition(*SAMPLE, "i").groupBy(*SAMPLE, "i", "j").agg(F.sum("w").alias("w"))
    return per.groupBy(*SAMPLE, "i").agg(
        F.map_from_entries(F.collect_list(F.struct("j", "w"))).alias("changed"))


def all_rows(header: DataFrame, n_nodes: int) -> DataFrame:
    """(sample, graph_id, i) of every node of every sample, without a join."""
    return header.select(*SAMPLE, "graph_id", F.explode(F.sequence(F.lit(0), F.lit(n_nodes - 1))).alias("i"))


def overlay(wanted: DataFrame, base: DataFrame, changes: DataFrame, eps: float = 1e-9) -> DataFrame:
    """Rows of samples: ``wanted`` (sample, graph_id, i, any more columns) and the two tables
    of the store to (sample, graph_id, i, those columns, row).

    The changes are joined first, on their short keys: the class rows come last and are
    merged where they are met, so no exchange or sort holds a class row per sample.  A correction takes parts of a class weight away, so it only ever meets entries that the
    class row has.  An entry that loses all its parts leaves a rounding residue: what is left
    below ``eps`` of the class weight is no entry."""
    more = [c for c in wanted.columns if c not in (*SAMPLE, "graph_id", "i")]
    joined = wanted.join(changes, [*SAMPLE, "i"], "left").join(base, ["graph_id", "i"])
    now = F.transform("row", lambda e: F.struct(
        e["j"].alias("j"), (e["w"] + F.coalesce(F.try_element_at("changed", e["j"]), F.lit(0.0))).alias("w"),
        e["w"].alias("whole")))
    kept = F.filter(now, lambda e: F.abs(e["w"]) > F.abs(e["whole"]) * F.lit(eps))
    row = F.when(F.col("changed").isNull(), F.col("row")).otherwise(
        F.transform(kept, lambda e: F.struct(e["j"].alias("j"), e["w"].alias("w"))))
    return joined.select(*SAMPLE, "graph_id", "i", *more, row.alias("row")).filter(F.size("row") > 0)


def entries(rows: DataFrame) -> DataFrame:
    """(sample, graph_id, i, j, w) of packed rows."""
    return rows.select(*SAMPLE, "graph_id", "i", F.inline("row"))


def sample_adjacency(header: DataFrame, class_adj: DataFrame, delta: DataFrame, n_nodes: int | None = None,
                     rows: DataFrame | None = None) -> DataFrame:
    """H8: every sample's adjacency = its class adjacency + its corrections (as of ``changed_rows``), as
    (sample, graph_id, i, j, w).  ``rows`` (sample, i) restricts it to those rows (e.g. the
    history items); without it all rows of the ``n_nodes`` nodes are read."""
    wanted = (all_rows(header, n_nodes) if rows is None
              else rows.join(header.select(*SAMPLE, "graph_id"), SAMPLE))
    return entries(overlay(wanted, class_rows(class_adj), changed_rows(delta)))


@dataclass
class SampleStore:
    """Header (sample, graph_id, cut, history, label, split), class rows and sample
    changes of both views, and the features of the nodes, which all samples share."""
    header: DataFrame
    base: DataFrame       # view, graph_id, i, row
    changes: DataFrame    # view, sample, i, changed
    features: DataFrame | None = None

    def rows(self, view: int, n_nodes: int, samples: DataFrame | None = None) -> DataFrame:
        """Adjacency rows of one view of the given samples (rows of the header), or of all."""
        wanted = all_rows(self.header if samples is None else samples, n_nodes)
        return overlay(wanted, self.base.filter(F.col("view") == view).drop("view"),
                       self.changes.filter(F.col("view") == view).drop("view"))

    def write(self, path: str) -> None:
        io.write_partitioned(self.header, f"{path}/header", "split")
        io.write_partitioned(self.base, f"{path}/base", "view")
        split = self.header.select(*SAMPLE, "split")
        io.write_partitioned(self.changes.join(split, SAMPLE), f"{path}/changes", ["split", "view"])
        if self.features is not None:
            io.write_parquet(self.features, f"{path}/features")

    @staticmethod
    def read(spark: SparkSession, path: str, features: bool = False, split: str | None = None) -> SampleStore:
        """``split`` prunes header and changes to that folder."""
        header, changes = (io.read_table(spark, f"{path}/{t}") for t in ("header", "changes"))
        if split is not None:
            header, changes = (t.filter(F.col("split") == split) for t in (header, changes))
        return SampleStore(header, io.read_table(spark, f"{path}/base"), changes.drop("split"),
                           io.read_table(spark, f"{path}/features") if features else None)


def sample_store(g: ClassGraphs, top_k: int, val_prop: float, mode: str = "split",
                 weights: tuple[EdgeWeight, EdgeWeight] = (unit_weight, unit_weight),
                 features: DataFrame | None = None) -> SampleStore:
    """The whole sample set of the class graphs."""
    ti = target_items(g, top_k)
    base, changes = [], []
    for view, inc, weight, (delta, _) in (
            (1, g.inc1, weights[0], view1_delta(ti, weights[0])),
            (2, g.inc2, weights[1], view2_delta(g, removed_pairs(g, top_k), weights[1]))):
        base.append(class_rows(class_adjacency(inc, weight)).withColumn("view", F.lit(view)))
        changes.append(changed_rows(delta).withColumn("view", F.lit(view)))
    header = (split_samples(sample_header(g, top_k), val_prop, mode=mode)
              .join(history_items(ti), SAMPLE, "left").join(label_lists(g, top_k), SAMPLE, "left"))
    return SampleStore(header, base[0].unionByName(base[1]), changes[0].unionByName(changes[1]), features)


def sample_degree(header: DataFrame, class_dv: DataFrame, dv_delta: DataFrame, n_nodes: int | None = None,
                  rows: DataFrame | None = None) -> DataFrame:
    """Per-sample vertex degree = class degree + correction (zeros dropped), of the ``rows``
    (sample, i) or of all ``n_nodes`` nodes; read by (graph_id, node) like the adjacency."""
    wanted = (all_rows(header, n_nodes) if rows is None
              else rows.join(header.select(*SAMPLE, "graph_id"), SAMPLE)).withColumnRenamed("i", "node")
    change = dv_delta.groupBy(*SAMPLE, "node").agg(F.sum("dv_delta").alias("_d"))
    dv = F.col("dv").cast("long") + F.coalesce("_d", F.lit(0))
    return (wanted.join(class_dv, ["graph_id", "node"]).join(change, [*SAMPLE, "node"], "left")
            .select(*SAMPLE, "node", dv.alias("dv")).filter(F.col("dv") != 0))


def label_lists(g: ClassGraphs, top_k: int) -> DataFrame:
    """O3: the label = last ``top_k`` items of each target in time order (repeats
    kept).  Only the tail rows are collected, so each list is bounded by ``top_k``."""
    tail = g.long.filter(F.col("pos") >= F.col("list_size") - F.lit(top_k))
    agg = tail.groupBy(*SAMPLE).agg(F.array_sort(F.collect_list(F.struct("pos", "node"))).alias("_s"))
    return agg.select(*SAMPLE, F.transform("_s", lambda x: x["node"]).alias("label"))


def history_items(ti: DataFrame) -> DataFrame:
    """W9/O4 input: distinct prefix items of each target in first-seen order (bounded by
    the number of nodes)."""
    q = ti.filter(F.col("in_q"))
    agg = q.groupBy(*SAMPLE).agg(F.array_sort(F.collect_list(F.struct("first_pos", "node"))).alias("_s"))
    return agg.select(*SAMPLE, F.transform("_s", lambda x: x["node"]).alias("history"))


def history_rows(g: ClassGraphs, ti: DataFrame, header: DataFrame,
                 mode: str = "target") -> DataFrame:
    """Distinct history items (sample, i) of every sample.

    ``target`` (default): the kept prefix of the sample's own target session.
    ``last``: what the original assembles — the items of the class's last session in
    (geek_id, session_no) order, cut when that session is the target itself."""
    own = ti.filter(F.col("in_q")).select(*SAMPLE, F.col("node").alias("i"))
    if mode == "target":
        return own
    if mode != "last":
        raise ValueError(f"unknown history mode {mode}")
    last = (g.long.groupBy("graph_id")
            .agg(F.max(F.struct("geek_id", "session_no")).alias("_l"))
            .select("graph_id", F.col("_l.geek_id").alias("_lg"), F.col("_l.session_no").alias("_ls")))
    items = (g.long.join(last, "graph_id")
             .filter((F.col("geek_id") == F.col("_lg")) & (F.col("session_no") == F.col("_ls")))
             .select("graph_id", F.col("node").alias("i")).distinct())
    is_last = (F.col("geek_id") == F.col("_lg")) & (F.col("session_no") == F.col("_ls"))
    h = header.select(*SAMPLE, "graph_id").join(last, "graph_id")
    others = h.filter(~is_last).join(items, "graph_id").select(*SAMPLE, "i")
    selves = own.join(h.filter(is_last).select(*SAMPLE), SAMPLE)
    return others.unionByName(selves)


def split_samples(header: DataFrame, val_prop: float, part_col: str = "graph_id",
                  key_range: int = 1 << 16, mode: str = "split") -> DataFrame:
    """With ``mode`` 'all' every sample is of the one split 'all' (the set that is
    only read).  Else a deterministic train/test split — the first ``floor(n*(1-val_prop))`` samples
    in (class, target) order are 'train', the rest 'test'.  The global ordinal is the
    class offset (per-class counts: one row per class) plus a two-level ordinal inside
    the class, so no single task sees all samples of a class."""
    per = header.groupBy(part_col).agg(F.count(F.lit(1)).alias("_c"))
    wc = Window.orderBy(part_col)   # one row per class: bounded by the class count
    per = per.select(part_col, F.coalesce(F.sum("_c").over(wc.rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
                     F.sum("_c").over(Window.partitionBy()).alias("_n"))
    inner = ss.ordinal(header, [part_col], SAMPLE,
                       F.floor(F.col(SAMPLE[0]) / F.lit(key_range)), "_in")
    out = (inner.join(per, part_col)
           .withColumn("sample_no", (F.col("_off") + F.col("_in")).cast("long")))
    if mode not in ("split", "all"):
        raise ValueError(f"a sample set is split or read whole, not {mode!r}")
    if mode == "all":
        return out.withColumn("split", F.lit("all")).drop("_off", "_n", "_in")
    cut = F.floor(F.col("_n") * F.lit(1.0 - val_prop))
    return (out.withColumn("split", F.when(F.col("sample_no") < cut, F.lit("train"))
                           .otherwise(F.lit("test")))
            .drop("_off", "_n", "_in"))
