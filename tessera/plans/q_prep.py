"""Registered queries: scans, preparation, scalar functions, set ops, joins,
aggregations and sorts (S1-S2, S13, P, F, T, J1-J3, J5, A3-A5, A8, O1-O2, O5)."""

import uuid

from pyspark.sql import functions as F

from tessera.functions import codes as fc
from tessera.operators import prep
from tessera.plans.common import td
from tessera.plans.registry import register
from tessera.session import ensure_checkpoint_dir
from tessera.sources import io


@register("s1_scan", "SELECT * FROM part")
def s1_scan(spark, sf):
    return io.read_table(spark, f"{sf}/part.parquet")


@register("s2_pruned_scan", """SELECT o_custkey AS geek_id, o_orderkey AS order_id,
  o_orderdate AS ds FROM orders""")
def s2_pruned_scan(spark, sf):
    return io.read_pruned(spark, f"{sf}/orders.parquet",
                          {"o_custkey": "geek_id", "o_orderkey": "order_id", "o_orderdate": "ds"})


@register("s13_profile", """SELECT CAST(COUNT(*) AS BIGINT) AS n_rows,
  (SELECT CAST(COUNT(*) AS BIGINT) FROM (SELECT DISTINCT * FROM lineitem)) AS n_distinct
FROM lineitem""")
def s13_profile(spark, sf):
    return io.profile(td(spark, sf).table("lineitem"))


_BOUNDS_SQL = "b AS (SELECT MIN(CAST(ts AS DATE)) AS s, MAX(CAST(ts AS DATE)) AS e FROM events)"


@register("p1_calendar", f"""WITH {_BOUNDS_SQL}
SELECT CAST(d AS DATE) AS date,
       CASE WHEN CAST(d AS DATE) > e - 6 THEN 'test' ELSE 'train' END AS split
FROM b, generate_series(CAST(s AS TIMESTAMP), CAST(e AS TIMESTAMP), INTERVAL 1 DAY) g(d)""")
def p1_calendar(spark, sf):
    log = td(spark, sf).log()
    b = log.agg(F.min("date").alias("s"), F.max("date").alias("e"))
    days = b.select(F.explode(F.sequence("s", "e", F.expr("interval 1 day"))).alias("date"), "e")
    return prep.split_by_cutoff(days, "date", F.col("e"), 6).select("date", "split")


@register("p2_split_log", f"""WITH {_BOUNDS_SQL}
SELECT event_id, CAST(ts AS DATE) AS date,
       CASE WHEN CAST(ts AS DATE) > (SELECT e FROM b) - 6 THEN 'test' ELSE 'train' END AS split
FROM events""")
def p2_split_log(spark, sf):
    log = td(spark, sf).log()
    end = log.select(F.max("date")).scalar()          # scalar subquery, no driver round trip
    return prep.split_by_cutoff(log.select("event_id", "date"), "date", end, 6)


@register("p2_partitioned_split", f"""WITH {_BOUNDS_SQL}
SELECT event_id, CAST(ts AS DATE) AS date,
       CASE WHEN CAST(ts AS DATE) > (SELECT e FROM b) - 6 THEN 'test' ELSE 'train' END AS split
FROM events""")
def p2_partitioned_split(spark, sf):
    """Both splits read from a log that is partitioned by date: each scans only the folders
    of its days, found from the calendar when the query runs."""
    log = td(spark, sf).log().select("event_id", "date")
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/p2-{uuid.uuid4().hex}"
    io.write_partitioned(log, f"{path}/log", "date")
    b = log.agg(F.min("date").alias("s"), F.max("date").alias("e"))
    days = b.select(F.explode(F.sequence("s", "e", F.expr("interval 1 day"))).alias("date"), "e")
    io.write_parquet(prep.split_by_cutoff(days, "date", F.col("e"), 6).drop("e"), f"{path}/calendar")
    log, calendar = (io.read_table(spark, f"{path}/{x}") for x in ("log", "calendar"))
    parts = [prep.days_of(log, "date", calendar.filter(F.col("split") == s)).withColumn("split", F.lit(s))
             for s in ("train", "test")]
    return parts[0].unionByName(parts[1]).select("event_id", "date", "split")


# p_partkey * 700 as text: 7-digit codes such as '1000300' fall inside the string range
# although their numeric value does not (the lexicographic rule of the reference).
_CODE_SQL = "CAST(p_partkey * 700 AS VARCHAR)"


@register("p3_code_range", f"""SELECT p_partkey, {_CODE_SQL} AS code FROM part
WHERE {_CODE_SQL} >= '100000' AND {_CODE_SQL} < '110000'""")
def p3_code_range(spark, sf):
    part = td(spark, sf).table("part").select(
        "p_partkey", (F.col("p_partkey") * 700).cast("string").alias("code"))
    return prep.string_code_range(part, "code", "100000", "110000")


@register("p4_cast_project", """SELECT p_partkey AS job_id, p_name AS name,
  TRY_CAST(substr(p_brand, 7) AS INTEGER) AS brand_no, TRY_CAST(p_type AS INTEGER) AS type_code,
  TRY_CAST(CAST(p_size AS VARCHAR) AS INTEGER) AS position_code FROM part""")
def p4_cast_project(spark, sf):
    part = td(spark, sf).table("part").select(
        "p_partkey", "p_name", F.substring("p_brand", 7, 100).alias("brand_tail"), "p_type",
        F.col("p_size").cast("string").alias("size_str"))
    return prep.cast_project(part, [("p_partkey", "job_id", "long"), ("p_name", "name", "string"),
                                    ("brand_tail", "brand_no", "int"), ("p_type", "type_code", "int"),
                                    ("size_str", "position_code", "int")])


@register("p5_to_date", """SELECT o_orderkey,
  CAST(substr(CAST(o_orderdate AS VARCHAR), 1, 10) AS DATE) AS order_day FROM orders""")
def p5_to_date(spark, sf):
    o = td(spark, sf).table("orders")
    return o.select("o_orderkey", F.to_date(F.substring(F.col("o_orderdate").cast("string"), 1, 10))
                    .alias("order_day"))


_NULLY_PART = """SELECT p_partkey, NULLIF(p_size, 7) AS position_code,
  NULLIF(p_size % 5, 0) AS days_per_week, NULLIF(p_type, 'SMALL') AS name, p_brand,
  p_retailprice FROM part"""


def _nully_part(spark, sf):
    p = td(spark, sf).table("part")
    return p.select("p_partkey", F.nullif("p_size", F.lit(7)).alias("position_code"),
                    F.nullif(F.col("p_size") % 5, F.lit(0)).alias("days_per_week"),
                    F.nullif("p_type", F.lit("SMALL")).alias("name"), "p_brand", "p_retailprice")


@register("p6_fill_nulls", f"""WITH n AS ({_NULLY_PART})
SELECT p_partkey, COALESCE(position_code, 0) AS position_code,
  COALESCE(days_per_week, 5) AS days_per_week, COALESCE(name, '无') AS name, p_brand,
  p_retailprice FROM n""")
def p6_fill_nulls(spark, sf):
    return prep.fill_nulls(_nully_part(spark, sf), named={"days_per_week": 5})


@register("p7_drop_nulls", f"WITH n AS ({_NULLY_PART}) SELECT * FROM n "
          "WHERE position_code IS NOT NULL AND days_per_week IS NOT NULL AND name IS NOT NULL")
def p7_drop_nulls(spark, sf):
    return prep.drop_null_rows(_nully_part(spark, sf))


@register("p8_drop_columns", "SELECT p_partkey, p_brand, p_size, p_retailprice FROM part")
def p8_drop_columns(spark, sf):
    return td(spark, sf).table("part").drop("p_name", "p_type")


@register("p9_p10_codes", """SELECT c_custkey,
  CAST(c_nationkey AS BIGINT) * 10000 + c_custkey % 100 AS city_code,
  (100000 + c_custkey % 37) - 100000 AS industry FROM customer""")
def p9_p10_codes(spark, sf):
    c = td(spark, sf).table("customer")
    return c.select("c_custkey",
                    fc.composite_code(F.col("c_nationkey").cast("long"), F.col("c_custkey") % 100)
                    .alias("city_code"),
                    fc.rebase(F.lit(100000) + F.col("c_custkey") % 37).alias("industry"))


@register("p14_null_to_zero", """SELECT p_partkey,
  CASE WHEN NULLIF(p_size, 7) IS NULL THEN 0 ELSE NULLIF(p_size, 7) END AS position_code FROM part""")
def p14_null_to_zero(spark, sf):
    p = td(spark, sf).table("part")
    return p.select("p_partkey", prep.null_to_zero(F.nullif("p_size", F.lit(7))).alias("position_code"))


@register("f1_f2_codes", """SELECT p_partkey, 100 + p_size % 9 AS experience_code,
  CASE 100 + p_size % 9 WHEN 103 THEN 1.0 WHEN 104 THEN 1.5 WHEN 105 THEN 3.0 WHEN 106 THEN 5.5
       WHEN 107 THEN 10.0 ELSE 0.0 END::DOUBLE AS years,
  200 + p_size % 10 AS degree_code,
  CASE 200 + p_size % 10 WHEN 209 THEN 1 WHEN 208 THEN 2 WHEN 206 THEN 3 WHEN 202 THEN 4
       WHEN 203 THEN 5 WHEN 204 THEN 6 WHEN 205 THEN 7 ELSE 0 END::INTEGER AS level FROM part""")
def f1_f2_codes(spark, sf):
    p = td(spark, sf).table("part").select(
        "p_partkey", (F.lit(100) + F.col("p_size") % 9).alias("experience_code"),
        (F.lit(200) + F.col("p_size") % 10).alias("degree_code"))
    return p.select("p_partkey", "experience_code",
                    fc.experience_years(F.col("experience_code")).alias("years"),
                    "degree_code", fc.degree_level(F.col("degree_code")).alias("level"))


@register("f3_f5_f7_tokens", """WITH t AS (SELECT doc_id, string_split(text, ' ') AS tok,
  [lang, source, CAST(n_chars AS VARCHAR)] AS meta FROM documents)
SELECT doc_id, CAST(len(tok) AS INTEGER) AS n_tokens, tok[1] AS first_token,
  tok[len(tok)] AS last_token, CAST(len(list_concat(meta, tok)) AS INTEGER) AS n_all,
  list_concat(meta, tok)[1] AS first_all FROM t""")
def f3_f5_f7_tokens(spark, sf):
    d = td(spark, sf).table("documents")
    t = d.select("doc_id", fc.split_tokens(F.col("text"), " ").alias("tok"),
                 F.array("lang", "source", F.col("n_chars").cast("string")).alias("meta"))
    allc = fc.concat_arrays(F.col("meta"), F.col("tok"))
    return t.select("doc_id", F.size("tok").alias("n_tokens"), fc.first_element(F.col("tok"))
                    .alias("first_token"), F.element_at("tok", -1).alias("last_token"),
                    F.size(allc).alias("n_all"), fc.first_element(allc).alias("first_all"))


@register("f6_vector_element", """SELECT vec_id, CAST(embedding[4] AS FLOAT) AS e3,
  CAST(embedding[65] AS FLOAT) AS e64 FROM embeddings""")
def f6_vector_element(spark, sf):
    e = td(spark, sf).table("embeddings")
    return e.select("vec_id", fc.vector_element(F.col("embedding"), 3).alias("e3"),
                    fc.vector_element(F.col("embedding"), 64).alias("e64"))


@register("f9_date_arith", """SELECT o_orderkey, CAST(o_orderdate AS DATE) + 30 AS due,
  strftime(CAST(o_orderdate AS DATE) - 1, '%Y-%m-%d') AS prev_day FROM orders""")
def f9_date_arith(spark, sf):
    o = td(spark, sf).table("orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    return o.select("o_orderkey", F.date_add("d", 30).alias("due"),
                    F.date_format(F.date_sub("d", 1), "yyyy-MM-dd").alias("prev_day"))


@register("o5_arg_max", """SELECT vec_id,
  CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS top FROM embeddings""")
def o5_arg_max(spark, sf):
    e = td(spark, sf).table("embeddings")
    return e.select("vec_id", fc.arg_max(F.col("embedding")).alias("top"))


@register("t1_distinct", "SELECT DISTINCT l_orderkey, l_partkey FROM lineitem")
def t1_distinct(spark, sf):
    return td(spark, sf).table("lineitem").select("l_orderkey", "l_partkey").distinct()


@register("t2_union_all", """SELECT p_partkey, p_size FROM part WHERE p_size < 10
UNION ALL SELECT p_partkey, p_size FROM part WHERE p_size >= 10
UNION ALL SELECT p_partkey, p_size FROM part WHERE p_size = 3""")
def t2_union_all(spark, sf):
    p = td(spark, sf).table("part").select("p_partkey", "p_size")
    return (p.filter("p_size < 10").unionByName(p.filter("p_size >= 10"))
            .unionByName(p.filter("p_size = 3")))


@register("a3_log_counts", """SELECT CAST(COUNT(*) AS BIGINT) AS n_rows,
  (SELECT CAST(COUNT(*) AS BIGINT) FROM (SELECT DISTINCT o_custkey, l_partkey,
     CAST(o_orderdate AS DATE) FROM lineitem JOIN orders ON l_orderkey = o_orderkey)) AS n_distinct
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def a3_log_counts(spark, sf):
    return io.profile(td(spark, sf).order_log().select("geek_id", "job_id", "ds"))


@register("a4_distinct_values", "SELECT DISTINCT p_type FROM part")
def a4_distinct_values(spark, sf):
    return prep.distinct_values(td(spark, sf).table("part"), "p_type")


@register("a8_best_so_far", """SELECT event_id, user_id, value,
  MAX(value) OVER (PARTITION BY user_id ORDER BY ts, event_id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS best FROM events""")
def a8_best_so_far(spark, sf):
    ev = td(spark, sf).table("events").select("event_id", "user_id", "value", "ts")
    return prep.best_so_far(ev, "value", ["ts", "event_id"], ["user_id"],
                            bucket=F.to_date("ts")).drop("ts")


_O_KEYS = "l_returnflag, l_linestatus, l_shipdate, l_orderkey, l_linenumber"


@register("o1_global_sort", f"SELECT {_O_KEYS}, l_partkey FROM lineitem ORDER BY {_O_KEYS}, l_partkey")
def o1_global_sort(spark, sf):
    li = td(spark, sf).table("lineitem")
    return li.select(*_O_KEYS.split(", "), "l_partkey").orderBy(*_O_KEYS.split(", "), "l_partkey")


@register("o2_head", f"""SELECT {_O_KEYS}, l_partkey, l_suppkey, l_quantity FROM lineitem
ORDER BY {_O_KEYS}, l_partkey, l_suppkey, l_quantity LIMIT 20""")
def o2_head(spark, sf):
    """Head n after a total order (the limit is the feature: a report of the first rows)."""
    keys = _O_KEYS.split(", ") + ["l_partkey", "l_suppkey", "l_quantity"]
    return td(spark, sf).table("lineitem").select(*keys).orderBy(*keys).limit(20)


@register("j1_left_two_keys", """WITH l AS (SELECT o_orderkey, o_custkey, year(o_orderdate) AS yr
  FROM orders),
r AS (SELECT o_custkey, year(o_orderdate) AS yr, CAST(COUNT(*) AS BIGINT) AS n_f FROM orders
  WHERE o_orderstatus = 'F' GROUP BY 1, 2)
SELECT l.o_orderkey, COALESCE(r.n_f, -1) AS n_f FROM l LEFT JOIN r
  ON l.o_custkey = r.o_custkey AND l.yr = r.yr""")
def j1_left_two_keys(spark, sf):
    o = td(spark, sf).table("orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", F.year("o_orderdate").alias("yr"))
    r = (o.filter(F.col("o_orderstatus") == "F").groupBy("o_custkey", "yr")
         .agg(F.count(F.lit(1)).alias("n_f")))
    return (o.select("o_orderkey", "o_custkey", "yr").join(r, ["o_custkey", "yr"], "left")
            .drop("o_custkey", "yr").fillna({"n_f": -1}))


@register("j2_label_log", """SELECT o_custkey AS geek_id, l_partkey AS job_id, l_orderkey AS order_id,
  l_linenumber AS line_no, c_nationkey % 5 AS pred_person, p_size % 10 AS pred_job
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN part ON l_partkey = p_partkey""")
def j2_label_log(spark, sf):
    t = td(spark, sf)
    log = t.order_log()
    person = t.table("customer").select(F.col("c_custkey").alias("geek_id"),
                                        (F.col("c_nationkey") % 5).alias("pred_person"))
    job = t.table("part").select(F.col("p_partkey").alias("job_id"),
                                 (F.col("p_size") % 10).alias("pred_job"))
    out = prep.label_with_classes(log, person, job, ["geek_id"], ["job_id"])
    return out.select("geek_id", "job_id", "order_id", "line_no", "pred_person", "pred_job")


@register("j2_label_log_daily", """WITH sp AS (SELECT DISTINCT o_custkey AS geek_id, CAST(o_orderdate AS DATE) AS ds,
    (c_nationkey + dayofmonth(o_orderdate)) % 5 AS pred_person
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE dayofmonth(o_orderdate) % 7 <> 0),
sj AS (SELECT DISTINCT l_partkey AS job_id, CAST(o_orderdate AS DATE) AS ds, (p_size + dayofmonth(o_orderdate)) % 10 AS pred_job
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  WHERE (l_partkey + dayofmonth(o_orderdate)) % 5 <> 0)
SELECT o.o_custkey AS geek_id, l.l_partkey AS job_id, CAST(o.o_orderdate AS DATE) AS ds, l.l_orderkey AS order_id,
  l.l_linenumber AS line_no, sp.pred_person, sj.pred_job
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN sp ON sp.geek_id = o.o_custkey AND sp.ds = CAST(o.o_orderdate AS DATE)
  JOIN sj ON sj.job_id = l.l_partkey AND sj.ds = CAST(o.o_orderdate AS DATE)""")
def j2_label_log_daily(spark, sf):
    """The log labelled from daily snapshots, by id and day: an id's class changes from day
    to day, and rows without a snapshot of their day go."""
    t = td(spark, sf)
    log = t.order_log()
    day = F.dayofmonth("ds")
    who = log.select("geek_id", "ds").join(t.table("customer").select(
        F.col("c_custkey").alias("geek_id"), "c_nationkey"), "geek_id")
    person = (who.filter(day % 7 != 0).select("geek_id", "ds", ((F.col("c_nationkey") + day) % 5).alias("pred_person"))
              .distinct())
    what = log.select("job_id", "ds").join(t.table("part").select(F.col("p_partkey").alias("job_id"), "p_size"), "job_id")
    job = (what.filter((F.col("job_id") + day) % 5 != 0)
           .select("job_id", "ds", ((F.col("p_size") + day) % 10).alias("pred_job")).distinct())
    out = prep.label_with_classes(log, person, job, ["geek_id", "ds"], ["job_id", "ds"])
    return out.select("geek_id", "job_id", "ds", "order_id", "line_no", "pred_person", "pred_job")


@register("j3_string_date_join", """WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day,
  CAST(COUNT(*) AS BIGINT) AS orders_that_day FROM orders GROUP BY 1)
SELECT o.o_orderkey, d.orders_that_day FROM orders o
  JOIN d ON CAST(strftime(o.o_orderdate, '%Y-%m-%d') AS DATE) = d.day""")
def j3_string_date_join(spark, sf):
    o = td(spark, sf).table("orders")
    days = (o.groupBy(F.to_date("o_orderdate").alias("day"))
            .agg(F.count(F.lit(1)).alias("orders_that_day")))
    log = o.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("ds"))
    return (log.join(days, F.to_date(log["ds"]) == days["day"])
            .select("o_orderkey", "orders_that_day"))
