"""Registered queries: session lists, relation tables, class and sample hypergraphs,
recommendation and ranking metrics (A1, A5, P12-P13, W6-W9, O3-O4, S6-S7, H1-H10,
R3-R13)."""

from pyspark.sql import functions as F

from tessera.functions import ranking as rk
from tessera.operators import hypergraph as hg
from tessera.operators import prep, recommend as rc, samples as sp, sessions as ss
from tessera.params import TESTDATA_PARAMS as P
from tessera.plans.common import r6, sessions_long, td
from tessera.plans.registry import register
from tessera.plans.sqlparts import SAMPLES, SESS
from tessera.session import ensure_checkpoint_dir
from tessera.sources import io


def _graphs(spark, sf):
    return sp.class_graphs(sessions_long(spark, sf), P.list_cnt)


@register("a1_collect_sessions", f"""WITH {SESS}
SELECT geek_id, session_no, CAST(pos // 10000 AS INTEGER) AS chunk_no,
  list(event_id ORDER BY pos) AS event_id_list, list(deal_type ORDER BY pos) AS deal_type_list,
  list(t_us ORDER BY pos) AS t_us_list, list(date ORDER BY pos) AS date_list,
  list(person_class ORDER BY pos) AS person_class_list,
  list(job_class ORDER BY pos) AS job_class_list, any_value(list_size) AS list_size
FROM sess GROUP BY 1, 2, 3""")
def a1_collect_sessions(spark, sf):
    """Session rows with parallel lists (at most 10,000 events per row)."""
    long = ss.sessionize(td(spark, sf).log(), "geek_id", "t_us", 86400 * 10**6,
                         bucket=3600 * 10**6, tiebreak=["event_id"])
    # the six lists of the original session row: job (event) id, deal type, time, date,
    # person class and job class
    return ss.collect_sessions(long, "geek_id", "t_us",
                               ["event_id", "deal_type", "t_us", "date", "person_class", "job_class"],
                               tiebreak=["event_id"])


@register("p12_long_sessions", f"""WITH {SESS}
SELECT DISTINCT geek_id, session_no, list_size, first_person_class FROM sess
WHERE list_size > {P.list_cnt}""")
def p12_long_sessions(spark, sf):
    st = ss.session_table(td(spark, sf).log(), "geek_id", "t_us", 86400 * 10**6,
                          bucket=3600 * 10**6, tiebreak=["event_id"], session_cols=["person_class"])
    return ss.keep_long(st, P.list_cnt).select("geek_id", "session_no", "list_size",
                                               "first_person_class")


_COUNTS_SQL = f"""WITH {SESS},
c AS (SELECT first_person_class AS person_class, COUNT(*) AS cnt FROM
      (SELECT DISTINCT geek_id, session_no, first_person_class FROM sess
       WHERE list_size > {P.list_cnt}) GROUP BY 1)
SELECT CAST(k.range AS INTEGER) AS person_class, CAST(COALESCE(c.cnt, 0) AS BIGINT) AS cnt
FROM range({P.k_person}) k LEFT JOIN c ON c.person_class = k.range"""


def _class_counts(spark, sf):
    g = _graphs(spark, sf)
    firsts = g.long.filter(F.col("pos") == 0).withColumnRenamed("graph_id", "person_class")
    return prep.dense_class_counts(spark, firsts, "person_class", P.k_person)


@register("a5_class_counts", _COUNTS_SQL)
def a5_class_counts(spark, sf):
    return _class_counts(spark, sf)


@register("p13_nonzero_classes", f"SELECT * FROM ({_COUNTS_SQL}) WHERE cnt <> 0")
def p13_nonzero_classes(spark, sf):
    return _class_counts(spark, sf).filter(F.col("cnt") != 0)


_REL_SQL = f"""WITH {SESS},
l AS (SELECT * FROM sess WHERE list_size > {P.list_cnt}),
o AS (SELECT geek_id, session_no, CAST(ROW_NUMBER() OVER (PARTITION BY first_person_class
        ORDER BY geek_id, session_no) - 1 AS INTEGER) AS class_session_no
      FROM (SELECT DISTINCT geek_id, session_no, first_person_class FROM l))
SELECT l.first_person_class AS person_class, o.class_session_no AS session_no, l.pos AS id,
  l.job_class AS pred_job, l.t_us AS unix_time, l.date, l.event_id AS job_id, l.geek_id
FROM l JOIN o USING (geek_id, session_no)"""


def _relations(spark, sf):
    long = ss.keep_long(sessions_long(spark, sf), P.list_cnt).drop("person_class")
    heads = long.filter(F.col("pos") == 0).select(
        "geek_id", "session_no", F.col("first_person_class").alias("person_class"))
    ordn = ss.class_ordinal(heads, "person_class", "geek_id")
    return (long.join(ordn, ["geek_id", "session_no"])
            .select("person_class", F.col("class_session_no").alias("session_no"),
                    F.col("pos").alias("id"), F.col("job_class").alias("pred_job"),
                    F.col("t_us").alias("unix_time"), "date",
                    F.col("event_id").alias("job_id"), "geek_id"))


@register("w6_w7_relation_table", _REL_SQL)
def w6_w7_relation_table(spark, sf):
    """W6 position and W7 class ordinal: the relation rows of every long session."""
    return _relations(spark, sf)


@register("s6_s7_relation_roundtrip", _REL_SQL)
def s6_s7_relation_roundtrip(spark, sf):
    """S6 relation sink (CSV by class and session bucket) read back by S7."""
    import uuid
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/relations-{uuid.uuid4().hex}"
    io.write_relations(_relations(spark, sf), path)
    return io.read_relations(spark, path).select(
        "person_class", "session_no", "id", "pred_job", "unix_time", "date", "job_id", "geek_id")


@register("w8_successor_pairs", f"""WITH {SESS},
p AS (SELECT first_person_class AS graph_id, job_class AS src,
        LEAD(job_class) OVER (PARTITION BY geek_id, session_no ORDER BY pos) AS dst FROM sess)
SELECT DISTINCT graph_id, src, dst FROM p WHERE dst IS NOT NULL""")
def w8_successor_pairs(spark, sf):
    long = sessions_long(spark, sf).withColumnRenamed("first_person_class", "graph_id")
    return (ss.consecutive_pairs(long, ["geek_id", "session_no"], "pos", "job_class")
            .select("graph_id", "src", "dst").distinct())


@register("w9_o4_history", f"""WITH {SAMPLES},
h AS (SELECT geek_id AS sg, session_no AS ss, node, MIN(pos) AS fp FROM long_s
      WHERE pos < list_size - {P.top_k} GROUP BY 1, 2, 3),
d AS (SELECT sg, ss, list(node ORDER BY fp) AS history FROM h GROUP BY 1, 2)
SELECT sg AS geek_id, ss AS session_no, history,
  CASE WHEN len(history) >= 10 THEN list_slice(history, len(history) - 9, len(history))
       ELSE list_concat(list_transform(range(10 - len(history)), lambda x: -1), history)
  END AS last10,
  CASE WHEN len(history) >= {P.k_job} THEN list_slice(history, len(history) - {P.k_job - 1},
       len(history))
       ELSE list_concat(list_transform(range({P.k_job} - len(history)), lambda x: -1), history)
  END AS last_k FROM d""")
def w9_o4_history(spark, sf):
    """W9 first-seen distinct history and O4 last-k padded lists (k = 10 and k_job)."""
    g = _graphs(spark, sf)
    h = sp.history_items(sp.target_items(g, P.top_k))
    return h.select("geek_id", "session_no", "history",
                    ss.history_list(F.col("history"), 10).alias("last10"),
                    ss.history_list(F.col("history"), P.k_job).alias("last_k"))


@register("o3_labels", f"""WITH {SAMPLES} SELECT sg AS geek_id, ss AS session_no, label FROM lab""")
def o3_labels(spark, sf):
    return sp.label_lists(_graphs(spark, sf), P.top_k)


@register("h1_h4_session_edges", f"""WITH {SESS},
m AS (SELECT DISTINCT first_person_class AS graph_id, geek_id, session_no, job_class AS node
      FROM sess)
SELECT graph_id, geek_id, session_no, CAST(COUNT(*) AS INTEGER) AS de FROM m GROUP BY 1, 2, 3""")
def h1_h4_session_edges(spark, sf):
    inc = hg.session_incidence(sessions_long(spark, sf), "first_person_class",
                               ["geek_id", "session_no"], "job_class")
    return hg.edge_degree(inc).select("graph_id", "edge.geek_id", "edge.session_no", "de")


@register("h2_h4_successor_edges", f"""WITH {SESS},
p AS (SELECT first_person_class AS graph_id, job_class AS src,
        LEAD(job_class) OVER (PARTITION BY geek_id, session_no ORDER BY pos) AS dst FROM sess)
SELECT graph_id, src, CAST(COUNT(DISTINCT dst) AS INTEGER) AS de FROM p
WHERE dst IS NOT NULL GROUP BY 1, 2""")
def h2_h4_successor_edges(spark, sf):
    long = sessions_long(spark, sf).withColumnRenamed("first_person_class", "graph_id")
    pairs = ss.consecutive_pairs(long, ["geek_id", "session_no"], "pos", "job_class")
    return hg.edge_degree(hg.successor_incidence(pairs)).select("graph_id", "edge.src", "de")


@register("h3_h7_vertex_degree", f"""WITH {SESS},
m AS (SELECT DISTINCT first_person_class AS graph_id, geek_id, session_no, job_class AS node
      FROM sess),
d AS (SELECT graph_id, node, COUNT(*) AS dv FROM m GROUP BY 1, 2),
n AS (SELECT g.graph_id, CAST(r.range AS INTEGER) AS node FROM (SELECT DISTINCT graph_id FROM m) g,
      range({P.k_job}) r)
SELECT n.graph_id, n.node, CAST(COALESCE(d.dv, 0) AS INTEGER) AS dv,
  ROUND(1.0 / (COALESCE(d.dv, 0) + 1e-6), 6) AS dv_inv
FROM n LEFT JOIN d USING (graph_id, node)""")
def h3_h7_vertex_degree(spark, sf):
    inc = hg.session_incidence(sessions_long(spark, sf), "first_person_class",
                               ["geek_id", "session_no"], "job_class")
    nodes = hg.dense_nodes(inc, P.k_job)
    dv = hg.inverse_vertex_degree(hg.vertex_degree(inc, nodes))
    return dv.select("graph_id", "node", "dv", r6("dv_inv").alias("dv_inv"))


def _sample_view(spark, sf, view):
    g = _graphs(spark, sf)
    header = sp.sample_header(g, P.top_k)
    ti = sp.target_items(g, P.top_k)
    if view == 1:
        inc, (delta, dvd) = g.inc1, sp.view1_delta(ti)
    else:
        inc, (delta, dvd) = g.inc2, sp.view2_delta(g, sp.removed_pairs(g, P.top_k))
    return header, inc, delta, dvd


@register("h8_sample_adjacency_v1", f"""WITH {SAMPLES}
SELECT sg AS geek_id, ss AS session_no, graph_id, i, j, ROUND(w, 6) AS w FROM a1""")
def h8_sample_adjacency_v1(spark, sf):
    header, inc, delta, _ = _sample_view(spark, sf, 1)
    a = sp.sample_adjacency(header, hg.adjacency(inc), delta, P.k_job)
    return a.select("geek_id", "session_no", "graph_id", "i", "j", r6("w").alias("w"))


@register("h8_sample_adjacency_v2", f"""WITH {SAMPLES}
SELECT sg AS geek_id, ss AS session_no, graph_id, i, j, ROUND(w, 6) AS w FROM a2""")
def h8_sample_adjacency_v2(spark, sf):
    header, inc, delta, _ = _sample_view(spark, sf, 2)
    a = sp.sample_adjacency(header, hg.adjacency(inc), delta, P.k_job)
    return a.select("geek_id", "session_no", "graph_id", "i", "j", r6("w").alias("w"))


_WEIGHTED_SQL = SAMPLES.replace("a1 AS (SELECT x.sg, x.ss, x.graph_id, x.node AS i, y.node AS j, SUM(1.0 / x.de)",
                                "a1 AS (SELECT x.sg, x.ss, x.graph_id, x.node AS i, y.node AS j, SUM((1 + x.session_no % 3) * 1.0 / x.de)")
_WEIGHTED_SQL = _WEIGHTED_SQL.replace("a2 AS (SELECT x.sg, x.ss, x.graph_id, x.node AS i, y.node AS j, SUM(1.0 / x.de)",
                                      "a2 AS (SELECT x.sg, x.ss, x.graph_id, x.node AS i, y.node AS j, SUM((1 + x.src % 2) * 1.0 / x.de)")
assert _WEIGHTED_SQL.count("% 3") == _WEIGHTED_SQL.count("% 2") == 1


@register("h8_weighted_samples", f"""WITH {_WEIGHTED_SQL}
SELECT sg AS geek_id, ss AS session_no, graph_id, i, j, ROUND(w, 6) AS w, 1 AS view FROM a1
UNION ALL SELECT sg, ss, graph_id, i, j, ROUND(w, 6), 2 FROM a2""")
def h8_weighted_samples(spark, sf):
    """H5 inside H8: both views with hyperedge weights, 1 + session_no % 3 for a session and
    1 + src % 2 for a source item."""
    store = sp.sample_store(_graphs(spark, sf), P.top_k, P.val_prop, weights=(
        lambda c: F.lit(1) + c("session_no") % 3, lambda c: F.lit(1) + c("src") % 2))
    views = [sp.entries(store.rows(v, P.k_job)).withColumn("view", F.lit(v)) for v in (1, 2)]
    return views[0].unionByName(views[1]).select(
        "geek_id", "session_no", "graph_id", "i", "j", r6("w").alias("w"), "view")


@register("h8_sample_degrees", f"""WITH {SAMPLES}
SELECT sg AS geek_id, ss AS session_no, i AS node, CAST(dv AS BIGINT) AS dv, 1 AS view FROM dv1
UNION ALL
SELECT sg, ss, i, CAST(dv AS BIGINT), 2 FROM dv2""")
def h8_sample_degrees(spark, sf):
    out = []
    for v in (1, 2):
        header, inc, _, dvd = _sample_view(spark, sf, v)
        out.append(sp.sample_degree(header, hg.vertex_degree(inc), dvd, P.k_job)
                   .withColumn("view", F.lit(v)))
    return out[0].unionByName(out[1]).select("geek_id", "session_no", "node", "dv", "view")


@register("h10_split", f"""WITH {SAMPLES},
n AS (SELECT graph_id, sg, ss, ROW_NUMBER() OVER (ORDER BY graph_id, sg, ss) - 1 AS sample_no
      FROM samples)
SELECT graph_id, sg AS geek_id, ss AS session_no, CAST(sample_no AS BIGINT) AS sample_no,
  CASE WHEN sample_no < FLOOR((SELECT COUNT(*) FROM samples) * (1 - {P.val_prop}))
       THEN 'train' ELSE 'test' END AS split
FROM n""")
def h10_split(spark, sf):
    header = sp.sample_header(_graphs(spark, sf), P.top_k)
    return sp.split_samples(header, P.val_prop).select(
        "graph_id", "geek_id", "session_no", "sample_no", "split")


@register("h10_all_samples", f"""WITH {SAMPLES}
SELECT graph_id, sg AS geek_id, ss AS session_no,
  CAST(ROW_NUMBER() OVER (ORDER BY graph_id, sg, ss) - 1 AS BIGINT) AS sample_no, 'all' AS split
FROM samples""")
def h10_all_samples(spark, sf):
    """The mode of the sample set that only reads: every sample, none held out."""
    header = sp.sample_header(_graphs(spark, sf), P.top_k)
    return sp.split_samples(header, P.val_prop, mode="all").select(
        "graph_id", "geek_id", "session_no", "sample_no", "split")


@register("r3_recommend", f"""WITH {SAMPLES}
SELECT sg AS geek_id, ss AS session_no, item, rk, score FROM rec""")
def r3_recommend(spark, sf):
    return rc.recommend(_graphs(spark, sf), P.top_k, P.top_k).select(
        "geek_id", "session_no", "item", "rk", "score")


def _per_sample(spark, sf):
    g = _graphs(spark, sf)
    return rc.evaluate(rc.recommend(g, P.top_k, P.top_k), sp.label_lists(g, P.top_k))


@register("r4_r11_metrics", f"""WITH {SAMPLES}
SELECT geek_id, session_no, hit, ROUND(ap, 6) AS ap, ROUND(precision, 6) AS precision,
  ROUND(recall, 6) AS recall, ROUND(f1, 6) AS f1, ROUND(rr, 6) AS rr, ROUND(dcg, 6) AS dcg,
  ROUND(ndcg, 6) AS ndcg FROM met""")
def r4_r11_metrics(spark, sf):
    m = _per_sample(spark, sf)
    return m.select("geek_id", "session_no", "hit",
                    *[r6(c).alias(c) for c in ("ap", "precision", "recall", "f1", "rr", "dcg", "ndcg")])


@register("r12_position_accuracy", f"""WITH {SAMPLES},
r AS (SELECT sg, ss, list(item ORDER BY rk) AS rec FROM rec GROUP BY 1, 2),
z AS (SELECT l.sg, l.ss, UNNEST(l.label) AS lab, generate_subscripts(l.label, 1) AS p, r.rec
      FROM lab l JOIN r USING (sg, ss))
SELECT sg AS geek_id, ss AS session_no,
  CAST(100.0 * SUM(CASE WHEN rec[p] = lab THEN 1 ELSE 0 END) AS DOUBLE) AS pos_acc
FROM z GROUP BY 1, 2""")
def r12_position_accuracy(spark, sf):
    g = _graphs(spark, sf)
    ranked = rc.recommend(g, P.top_k, P.top_k)
    rec = (ranked.groupBy("geek_id", "session_no")
           .agg(F.array_sort(F.collect_list(F.struct("rk", "item"))).alias("_r"))
           .select("geek_id", "session_no", F.transform("_r", lambda x: x["item"]).alias("rec")))
    lab = sp.label_lists(g, P.top_k)
    return rec.join(lab, ["geek_id", "session_no"]).select(
        "geek_id", "session_no", rk.position_accuracy(F.col("rec"), F.col("label")).alias("pos_acc"))


@register("r13_report", f"""WITH {SAMPLES}
SELECT CAST(COUNT(*) AS BIGINT) AS n_samples, ROUND(AVG(CAST(hit AS DOUBLE)), 6) AS hit_rate,
  ROUND(AVG(rr), 6) AS mrr, ROUND(AVG(ap), 6) AS map, ROUND(AVG(precision), 6) AS precision,
  ROUND(AVG(recall), 6) AS recall, ROUND(AVG(f1), 6) AS f1, ROUND(AVG(ndcg), 6) AS ndcg
FROM met""")
def r13_report(spark, sf):
    """Flagship: event log -> sessions -> leave-one-out class hypergraphs ->
    recommendations -> hit rate, MRR and the other means, in one plan."""
    rep = rc.report(_per_sample(spark, sf))
    return rep.select("n_samples", *[r6(c).alias(c) for c in rep.columns if c != "n_samples"])


_LAST_SQL = SAMPLES.replace(
    "hist AS (SELECT DISTINCT sg, ss, node AS i FROM sv WHERE geek_id = sg AND session_no = ss),",
    """ls AS (SELECT graph_id, geek_id, session_no FROM (SELECT DISTINCT graph_id, geek_id, session_no,
             ROW_NUMBER() OVER (PARTITION BY graph_id ORDER BY geek_id DESC, session_no DESC) AS rn
           FROM long_s WHERE pos = 0) WHERE rn = 1),
hist AS (SELECT DISTINCT s.sg, s.ss, v.node AS i FROM samples s JOIN ls ON ls.graph_id = s.graph_id
         JOIN sv v ON v.sg = s.sg AND v.ss = s.ss AND v.geek_id = ls.geek_id
           AND v.session_no = ls.session_no),""")
assert _LAST_SQL != SAMPLES


@register("r3_recommend_last_history", f"""WITH {_LAST_SQL}
SELECT sg AS geek_id, ss AS session_no, item, rk, score FROM rec""")
def r3_recommend_last_history(spark, sf):
    """R3 with the original's history (D10 'last'): the class's last session."""
    return rc.recommend(_graphs(spark, sf), P.top_k, P.top_k, history="last").select(
        "geek_id", "session_no", "item", "rk", "score")
