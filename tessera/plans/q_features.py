"""Registered queries: Spark ML feature and clustering steps and the profile
workflows (M1-M14)."""

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tessera.functions import codes as fc
from tessera.operators import features as ft
from tessera.operators import prep
from tessera.plans import profiles
from tessera.plans.common import r6, td
from tessera.plans.q_graph import centres
from tessera.plans.registry import register


def _orders_split(spark, sf):
    o = td(spark, sf).table("orders").select("o_orderkey", "o_orderpriority", "o_orderstatus",
                                             F.to_date("o_orderdate").alias("d"))
    end = o.select(F.max("d")).scalar()
    return prep.split_by_cutoff(o, "d", end, 60)


@register("m1_m12_string_index", """WITH o AS (SELECT *, CASE WHEN CAST(o_orderdate AS DATE) >
  (SELECT MAX(CAST(o_orderdate AS DATE)) FROM orders) - 60 THEN 'test' ELSE 'train' END AS split
  FROM orders),
p AS (SELECT o_orderpriority AS v, ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, o_orderpriority) - 1 AS r
      FROM o WHERE split = 'train' GROUP BY 1),
s AS (SELECT o_orderstatus AS v, ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, o_orderstatus) - 1 AS r
      FROM o WHERE split = 'train' GROUP BY 1)
SELECT o.o_orderkey, o.split,
  CAST(COALESCE(p.r, (SELECT COUNT(*) FROM p)) AS DOUBLE) AS o_orderpriority_idx,
  CAST(COALESCE(s.r, (SELECT COUNT(*) FROM s)) AS DOUBLE) AS o_orderstatus_idx
FROM o LEFT JOIN p ON p.v = o.o_orderpriority LEFT JOIN s ON s.v = o.o_orderstatus""")
def m1_m12_string_index(spark, sf):
    """StringIndexer fit on the train days, applied frozen to all rows."""
    o = _orders_split(spark, sf)
    model = ft.string_index(o.filter(F.col("split") == "train"), ["o_orderpriority", "o_orderstatus"])
    return model.transform(o).select("o_orderkey", "split", "o_orderpriority_idx", "o_orderstatus_idx")


@register("m2_bag_of_words", """SELECT doc_id, term, CAST(COUNT(*) AS DOUBLE) AS count FROM
  (SELECT doc_id, UNNEST(string_split(text, ' ')) AS term FROM documents) GROUP BY 1, 2""")
def m2_bag_of_words(spark, sf):
    """Term counts of whole documents; every term of the corpus."""
    d = td(spark, sf).table("documents").select("doc_id", fc.split_tokens(F.col("text"), " ").alias("tok"))
    return ft.term_counts(d, "doc_id", "tok")


@register("m3_m4_topics")
def m3_m4_topics(spark, sf):
    """LDA (k=5, 5 iterations, seed 1) on the document bag of words and the dominant
    topic of every document (rows-only: a fitted model)."""
    d = td(spark, sf).table("documents").select("doc_id", fc.split_tokens(F.col("text"), " ").alias("tok"))
    tf = ft.bag_of_words(d, ["doc_id"], "tok")
    lda = ft.topic_model(tf, 5, 5)
    return ft.dominant_topic(lda.transform(tf)).select("doc_id", "skills")


@register("m5_m6_scaled", """WITH p AS (SELECT vec_id, UNNEST(embedding) AS x,
  CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS dim FROM embeddings),
s AS (SELECT dim, stddev_samp(x) AS sd FROM p GROUP BY 1)
SELECT vec_id, dim, ROUND(CASE WHEN sd = 0 THEN 0.0 ELSE x / sd END, 6) AS val
FROM p JOIN s USING (dim)""")
def m5_m6_scaled(spark, sf):
    """Assembled vectors scaled to unit sample standard deviation (no centring)."""
    e = td(spark, sf).table("embeddings").select("vec_id", array_to_vector("embedding").alias("features"))
    model, (out,) = ft.fit_apply([ft.scaler()], e)
    return out.select("vec_id", F.posexplode(vector_to_array("scaled")).alias("dim", "val")).select(
        "vec_id", "dim", r6("val").alias("val"))


_CENTRES_SQL = """c AS (SELECT label, pos, AVG(x) AS cx FROM
  (SELECT label, UNNEST(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)
  GROUP BY 1, 2),
px AS (SELECT vec_id, UNNEST(embedding) AS x, generate_subscripts(embedding, 1) AS pos
       FROM embeddings)"""


@register("m8_nearest_centre", f"""WITH {_CENTRES_SQL},
d AS (SELECT px.vec_id, c.label, SUM((px.x - c.cx) * (px.x - c.cx)) AS d FROM px
      JOIN c ON c.pos = px.pos GROUP BY 1, 2)
SELECT vec_id, arg_min(label, (d, label)) AS prediction FROM d GROUP BY 1""")
def m8_nearest_centre(spark, sf):
    """Every vector assigned to the nearest label centre."""
    e = td(spark, sf).table("embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return ft.nearest_centre(e, "v", centres(spark, sf), "label", "center").select("vec_id", "prediction")


@register("m9_silhouette", """WITH p AS (SELECT vec_id, label, UNNEST(embedding) AS x,
  generate_subscripts(embedding, 1) AS pos FROM embeddings),
pair AS (SELECT a.vec_id AS i, a.label AS li, b.label AS lj, SUM((a.x - b.x) * (a.x - b.x)) AS d
         FROM p a JOIN p b ON a.pos = b.pos GROUP BY a.vec_id, b.vec_id, a.label, b.label),
n AS (SELECT label, COUNT(*) AS n FROM embeddings GROUP BY 1),
m AS (SELECT i, li, lj, SUM(d) AS s FROM pair GROUP BY 1, 2, 3),
ab AS (SELECT m.i, MAX(CASE WHEN m.li = m.lj THEN m.s / NULLIF(n.n - 1, 0) END) AS a,
         MIN(CASE WHEN m.li <> m.lj THEN m.s / n.n END) AS b,
         MAX(CASE WHEN m.li = m.lj THEN n.n END) AS own
       FROM m JOIN n ON n.label = m.lj GROUP BY 1)
SELECT ROUND(AVG(CASE WHEN own <= 1 THEN 0.0 WHEN a < b THEN 1 - a / b WHEN a > b THEN b / a - 1
  ELSE 0.0 END), 6) AS silhouette FROM ab""")
def m9_silhouette(spark, sf):
    """Silhouette (squared Euclidean) of the vectors grouped by label."""
    e = td(spark, sf).table("embeddings").select(F.col("embedding").cast("array<double>").alias("v"), "label")
    return ft.silhouette_table(e, "v", "label").select(r6("silhouette").alias("silhouette"))


@register("m7_m10_kmeans")
def m7_m10_kmeans(spark, sf):
    """KMeans (k=8, seed 1) on the scaled vectors; the centre table (rows-only)."""
    e = td(spark, sf).table("embeddings").select("vec_id", array_to_vector("embedding").alias("features"))
    model, _ = ft.fit_apply([ft.scaler(), ft.kmeans(8)], e)
    return ft.centres_table(spark, model.stages[-1])


@register("m11_m13_job_profile")
def m11_m13_job_profile(spark, sf):
    """Job profile workflow: scaled named features and cluster per (job, day)."""
    out, _, _ = profiles.job_profile(spark, sf)
    return out


@register("m14_person_profile")
def m14_person_profile(spark, sf):
    """Person profile workflow with bag of words, topics, scaler and KMeans."""
    return profiles.person_profile(spark, sf)
