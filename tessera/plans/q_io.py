"""Registered queries: sinks and reloads (S3, S4, S8-S12), custom hyperedge weights
(H5), sample assembly (H9) and the centre lookup join (J5)."""

import uuid
from functools import reduce

from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators import hypergraph as hg
from tessera.operators import prep
from tessera.operators import samples as sp
from tessera.params import TESTDATA_PARAMS as P
from tessera.plans.common import r6, sessions_long, td
from tessera.plans.q_graph import centres
from tessera.plans.registry import register
from tessera.plans.sqlparts import ADJ, SAMPLES, SESS
from tessera.session import ensure_checkpoint_dir
from tessera.sources import io


def _scratch(spark, name):
    """A fresh folder under the shared checkpoint folder (never machine-local)."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@register("s3_parquet_roundtrip", "SELECT * FROM customer")
def s3_parquet_roundtrip(spark, sf):
    """Parquet sink (overwrite) read back."""
    path = _scratch(spark, "s3")
    io.write_parquet(td(spark, sf).table("customer"), path)
    return io.read_table(spark, path)


@register("s4_partitioned_roundtrip", """SELECT p_partkey, p_name, p_size % 10 AS prediction
FROM part""")
def s4_partitioned_roundtrip(spark, sf):
    """Parquet sink partitioned by the cluster column, read back with partition discovery
    and pruning on the partition column."""
    path = _scratch(spark, "s4")
    p = td(spark, sf).table("part").select("p_partkey", "p_name",
                                           (F.col("p_size") % 10).alias("prediction"))
    io.write_partitioned(p, path, "prediction")
    return io.read_table(spark, path).select("p_partkey", "p_name", F.col("prediction").cast("int"))


@register("s8_s9_model_roundtrip")
def s8_s9_model_roundtrip(spark, sf):
    """Fitted KMeans saved and loaded back; the centre table exported to Parquet and
    reloaded (rows-only: a fitted model)."""
    e = td(spark, sf).table("embeddings").select(array_to_vector("embedding").alias("features"))
    model = KMeans(k=4, seed=1, featuresCol="features").fit(e)
    mpath, cpath = _scratch(spark, "s8"), _scratch(spark, "s9")
    io.save_model(model, mpath)
    back = io.load_model(KMeansModel, mpath)
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(back.clusterCenters())]
    io.write_parquet(spark.createDataFrame(rows, "cluster int, center array<double>"), cpath)
    return io.read_table(spark, cpath)


_COUNTS_SQL = f"""WITH {SESS},
c AS (SELECT first_person_class AS person_class, COUNT(*) AS cnt FROM
      (SELECT DISTINCT geek_id, session_no, first_person_class FROM sess
       WHERE list_size > {P.list_cnt}) GROUP BY 1)
SELECT CAST(k.range AS INTEGER) AS person_class, CAST(COALESCE(c.cnt, 0) AS BIGINT) AS cnt
FROM range({P.k_person}) k LEFT JOIN c ON c.person_class = k.range"""


@register("s10_counts_roundtrip", _COUNTS_SQL)
def s10_counts_roundtrip(spark, sf):
    """Sessions per class (dense) exported and reloaded."""
    long = sp.class_graphs(sessions_long(spark, sf), P.list_cnt).long
    heads = long.filter(F.col("pos") == 0).withColumnRenamed("graph_id", "person_class")
    path = _scratch(spark, "s10")
    io.write_parquet(prep.dense_class_counts(spark, heads, "person_class", P.k_person), path)
    return io.read_table(spark, path)


@register("s11_sample_roundtrip", f"""WITH {SAMPLES},
n AS (SELECT graph_id, sg, ss, ROW_NUMBER() OVER (ORDER BY graph_id, sg, ss) - 1 AS sample_no
      FROM samples),
sp AS (SELECT *, CASE WHEN sample_no < FLOOR((SELECT COUNT(*) FROM samples) * (1 - {P.val_prop}))
         THEN 'train' ELSE 'test' END AS split FROM n)
SELECT sp.split, a.sg AS geek_id, a.ss AS session_no, a.i, a.j, ROUND(a.w, 6) AS w, 1 AS view
FROM a1 a JOIN sp ON sp.sg = a.sg AND sp.ss = a.ss
UNION ALL
SELECT sp.split, a.sg, a.ss, a.i, a.j, ROUND(a.w, 6), 2 FROM a2 a
JOIN sp ON sp.sg = a.sg AND sp.ss = a.ss""")
def s11_sample_roundtrip(spark, sf):
    """The sample set written as a store (header, class rows, changes of the samples; no
    table of samples x nodes²) and read back: a sample's rows are merged when read."""
    store = sp.sample_store(sp.class_graphs(sessions_long(spark, sf), P.list_cnt), P.top_k, P.val_prop)
    path = _scratch(spark, "s11")
    store.write(path)
    parts = []
    for split in ("train", "test"):
        back = sp.SampleStore.read(spark, path, split=split)
        parts += [sp.entries(back.rows(v, P.k_job)).withColumn("view", F.lit(v)).withColumn("split", F.lit(split))
                  for v in (1, 2)]
    edges = reduce(DataFrame.unionByName, parts)
    return edges.select("split", *sp.SAMPLE, "i", "j", r6("w").alias("w"), "view")


@register("s12_profile_cached", f"""WITH {SESS}
SELECT CAST(COUNT(*) AS BIGINT) AS n_rows, CAST(COUNT(DISTINCT (geek_id, session_no, pos)) AS BIGINT)
  AS n_distinct FROM sess""")
def s12_profile_cached(spark, sf):
    """A reused stage kept in memory and on disk, then profiled (row and distinct counts)."""
    from pyspark import StorageLevel
    long = sessions_long(spark, sf).select("geek_id", "session_no", "pos").persist(
        StorageLevel.MEMORY_AND_DISK)
    return io.profile(long)


@register("h5_weighted_adjacency", f"""WITH {ADJ.replace('SUM(1.0 / a.de) AS w', 'SUM((1 + a.session_no % 3) * 1.0 / a.de) AS w')}
SELECT graph_id, i, j, ROUND(w, 6) AS w FROM adj""")
def h5_weighted_adjacency(spark, sf):
    """Clique adjacency with user-supplied hyperedge weights w_e = 1 + session_no % 3."""
    inc = hg.session_incidence(sessions_long(spark, sf), "first_person_class",
                               ["geek_id", "session_no"], "job_class")
    a = hg.adjacency(inc, weight=F.lit(1.0) + F.col("edge.session_no") % 3)
    return a.select("graph_id", "i", "j", r6("w").alias("w"))


@register("h9_sample_assembly", f"""WITH {SAMPLES},
ft AS (SELECT label AS node, AVG(embedding[1]) AS x FROM embeddings GROUP BY 1),
hp AS (SELECT sg, ss, node AS i, MIN(pos) AS fp FROM sv WHERE geek_id = sg AND session_no = ss GROUP BY 1, 2, 3),
h AS (SELECT sg, ss, list(i ORDER BY fp) AS history, list(ROUND(x, 6) ORDER BY fp) AS history_x
      FROM hp LEFT JOIN ft ON ft.node = hp.i GROUP BY 1, 2),
c1 AS (SELECT sg, ss, COUNT(*) AS n, SUM(w) AS w, SUM((i + 1) * (j + 2) * w) AS m FROM a1 GROUP BY 1, 2),
c2 AS (SELECT sg, ss, COUNT(*) AS n, SUM(w) AS w, SUM((i + 1) * (j + 2) * w) AS m FROM a2 GROUP BY 1, 2),
n AS (SELECT graph_id, sg, ss, ROW_NUMBER() OVER (ORDER BY graph_id, sg, ss) - 1 AS sample_no FROM samples)
SELECT n.sg AS geek_id, n.ss AS session_no, n.graph_id,
  CASE WHEN n.sample_no < FLOOR((SELECT COUNT(*) FROM samples) * (1 - {P.val_prop}))
       THEN 'train' ELSE 'test' END AS split,
  h.history, h.history_x, l.label, CAST(c1.n AS BIGINT) AS n_a1, ROUND(c1.w, 6) AS w_a1, ROUND(c1.m, 3) AS m_a1,
  CAST(COALESCE(c2.n, 0) AS BIGINT) AS n_a2, ROUND(COALESCE(c2.w, 0), 6) AS w_a2, ROUND(COALESCE(c2.m, 0), 3) AS m_a2
FROM n JOIN h USING (sg, ss) JOIN lab l USING (sg, ss) JOIN c1 USING (sg, ss) LEFT JOIN c2 USING (sg, ss)""")
def h9_sample_assembly(spark, sf):
    """The whole sample: person, class, split, the history in first-seen order with the
    features of its items, the label, and both graphs, here as the count, the sum and a
    place-weighted sum of their entries."""
    c = centres(spark, sf).select(F.col("label").cast("int").alias("node"), F.col("center").alias("x"))
    store = sp.sample_store(sp.class_graphs(sessions_long(spark, sf), P.list_cnt), P.top_k, P.val_prop, features=c)
    path = _scratch(spark, "h9")
    store.write(path)
    back = sp.SampleStore.read(spark, path, features=True)
    out = back.header
    for v in (1, 2):
        at = (F.col("i") + 1) * (F.col("j") + 2) * F.col("w")
        per = sp.entries(back.rows(v, P.k_job)).groupBy(*sp.SAMPLE).agg(
            F.count("*").alias(f"n_a{v}"), r6(F.sum("w")).alias(f"w_a{v}"), F.round(F.sum(at), 3).alias(f"m_a{v}"))
        out = out.join(per, sp.SAMPLE, "inner" if v == 1 else "left").fillna(0, [f"n_a{v}", f"w_a{v}", f"m_a{v}"])
    items = (back.header.select(*sp.SAMPLE, F.posexplode("history").alias("at", "node"))
             .join(back.features.select("node", F.get("x", F.lit(0)).alias("x")), "node", "left")
             .groupBy(*sp.SAMPLE).agg(F.array_sort(F.collect_list(F.struct("at", r6("x").alias("x")))).alias("_x")))
    out = out.join(items, sp.SAMPLE).withColumn("history_x", F.transform("_x", lambda e: e["x"]))
    return out.select(*sp.SAMPLE, "graph_id", "split", "history", "history_x", "label",
                      *[f"{c}_a{v}" for v in (1, 2) for c in "nwm"])


@register("j5_centre_lookup", """WITH c AS (SELECT label, pos, AVG(x) AS cx FROM
  (SELECT label, UNNEST(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)
  GROUP BY 1, 2)
SELECT e.vec_id, e.label, CAST(c.pos - 1 AS INT) AS pos, ROUND(c.cx, 6) AS val
FROM embeddings e JOIN c ON c.label = e.label""")
def j5_centre_lookup(spark, sf):
    """Class id -> cluster centre, every component: a plain join with the centre table (one
    row per class), which adaptive execution broadcasts by its bytes."""
    e = td(spark, sf).table("embeddings").select("vec_id", "label")
    c = centres(spark, sf)
    return (e.join(c, "label").select("vec_id", "label", F.posexplode("center").alias("pos", "x"))
            .select("vec_id", "label", "pos", r6(F.col("x")).alias("val")))
