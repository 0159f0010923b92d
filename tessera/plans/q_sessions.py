"""Registered queries: sessions and session hypergraphs (W, A, H)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import sessions as ss
from tessera.plans.common import BUCKET_US, GAP_US, class_adjacency, r6, sessions_long, td
from tessera.plans.registry import register
from tessera.plans.sqlparts import ADJ, GAP_US as SQL_GAP, LOG_V, SESS

assert GAP_US == SQL_GAP


@register("w5_sessionize", f"""WITH {SESS}
SELECT geek_id, session_no, pos, list_size, job_class, t_us, first_person_class FROM sess""")
def w5_sessionize(spark, sf):
    return sessions_long(spark, sf).select(
        "geek_id", "session_no", "pos", "list_size", "job_class", "t_us", "first_person_class")


@register("w5_split_buckets", f"""WITH {SESS}
SELECT geek_id, session_no, pos, list_size, job_class, t_us, first_person_class FROM sess""")
def w5_split_buckets(spark, sf):
    """W5 with every bucket of more than 4 events cut by count into slices."""
    return ss.sessionize_split(td(spark, sf).log(), "geek_id", "t_us", GAP_US, bucket=GAP_US,
                               tiebreak=["event_id"], session_cols=["person_class"],
                               split_rows=4).select(
        "geek_id", "session_no", "pos", "list_size", "job_class", "t_us", "first_person_class")


@register("w4_session_flags", f"""WITH {LOG_V},
a AS (SELECT geek_id, t_us, LAG(t_us) OVER (PARTITION BY geek_id ORDER BY t_us) AS prev_time
      FROM log_v),
b AS (SELECT *, COALESCE(t_us - prev_time, 0) AS time_diff FROM a),
c AS (SELECT *, CASE WHEN time_diff > {SQL_GAP} THEN 1 ELSE 0 END AS new_record FROM b)
SELECT geek_id, t_us, prev_time, time_diff, new_record,
       CAST(SUM(new_record) OVER (PARTITION BY geek_id ORDER BY t_us) AS BIGINT) AS group_id
FROM c""")
def w4_session_flags(spark, sf):
    log = td(spark, sf).log().select("geek_id", "t_us", "event_id")
    return ss.session_flags(log, "geek_id", "t_us", GAP_US, bucket=BUCKET_US,
                            tiebreak=["event_id"]).select(
        "geek_id", "t_us", "prev_time", "time_diff", "new_record", "group_id")


@register("h6_class_adjacency", f"""WITH {ADJ}
SELECT graph_id, i, j, ROUND(w, 6) AS w FROM adj""")
def h6_class_adjacency(spark, sf):
    return class_adjacency(spark, sf).select("graph_id", "i", "j", r6("w").alias("w"))


@register("h6_top_pairs", f"""WITH {ADJ},
r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY graph_id ORDER BY ROUND(w, 6) DESC, i, j) AS rk
      FROM adj WHERE i < j)
SELECT graph_id, i, j, ROUND(w, 6) AS w, CAST(rk AS INTEGER) AS rk FROM r WHERE rk <= 10""")
def h6_top_pairs(spark, sf):
    """Flagship of the minimum slice: strongest off-diagonal item pairs per class."""
    a = class_adjacency(spark, sf).filter(F.col("i") < F.col("j")).withColumn("w", r6("w"))
    w = Window.partitionBy("graph_id").orderBy(F.col("w").desc(), "i", "j")
    return (a.withColumn("rk", F.row_number().over(w)).filter(F.col("rk") <= 10)
            .select("graph_id", "i", "j", "w", F.col("rk").cast("int")))
