"""SQL building blocks for the DuckDB oracle (same role views as ``sources.views``)."""

from tessera.params import TESTDATA_PARAMS as P

GAP_US = int(P.gap_days * 86400 * 1_000_000)

LOG_V = f"""log_v AS (
  SELECT user_id AS geek_id,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS job_class,
         event_type AS deal_type, epoch_us(ts) AS t_us, CAST(ts AS DATE) AS date,
         CAST(user_id % {P.k_person} AS INTEGER) AS person_class, event_id
  FROM events)"""

# W1-W5 in the reference's textbook form; session_no = running count of new sessions.
SESS = LOG_V + f""",
s_lag AS (SELECT *, t_us - LAG(t_us) OVER (PARTITION BY geek_id ORDER BY t_us, event_id) AS d
          FROM log_v),
s_no AS (SELECT *, CAST(SUM(CASE WHEN d > {GAP_US} THEN 1 ELSE 0 END)
                    OVER (PARTITION BY geek_id ORDER BY t_us, event_id) AS INTEGER) AS session_no
         FROM s_lag),
sess AS (SELECT geek_id, session_no, job_class, deal_type, t_us, date, person_class, event_id,
           CAST(ROW_NUMBER() OVER (PARTITION BY geek_id, session_no ORDER BY t_us, event_id) - 1
                AS INTEGER) AS pos,
           CAST(COUNT(*) OVER (PARTITION BY geek_id, session_no) AS INTEGER) AS list_size,
           FIRST_VALUE(person_class) OVER (PARTITION BY geek_id, session_no
                                           ORDER BY t_us, event_id) AS first_person_class
         FROM s_no)"""

# H1, H4, H6 on all sessions: graph = class of the session's first event.
ADJ = SESS + """,
memb AS (SELECT DISTINCT first_person_class AS graph_id, geek_id, session_no, job_class AS node
         FROM sess),
memb_d AS (SELECT *, COUNT(*) OVER (PARTITION BY graph_id, geek_id, session_no) AS de FROM memb),
adj AS (SELECT a.graph_id, a.node AS i, b.node AS j, SUM(1.0 / a.de) AS w
        FROM memb_d a JOIN memb_d b
          ON a.graph_id = b.graph_id AND a.geek_id = b.geek_id AND a.session_no = b.session_no
        GROUP BY 1, 2, 3)"""

# Leave-one-session-out samples, the direct (O(b²)) way: every sample re-builds both
# class hypergraphs from all long sessions of its class with its own target cut.
_J = "x.sg = y.sg AND x.ss = y.ss"
SAMPLES = SESS + f""",
long_s AS (SELECT first_person_class AS graph_id, geek_id, session_no, pos, list_size,
                  job_class AS node FROM sess WHERE list_size > {P.list_cnt}),
samples AS (SELECT graph_id, geek_id AS sg, session_no AS ss, list_size - {P.top_k} AS cut_len
            FROM long_s WHERE pos = 0),
sv AS (SELECT s.sg, s.ss, s.graph_id, l.geek_id, l.session_no, l.pos, l.node
       FROM samples s JOIN long_s l ON l.graph_id = s.graph_id
       WHERE NOT (l.geek_id = s.sg AND l.session_no = s.ss AND l.pos >= s.cut_len)),
m1 AS (SELECT DISTINCT sg, ss, graph_id, geek_id, session_no, node FROM sv),
m1d AS (SELECT *, COUNT(*) OVER (PARTITION BY sg, ss, geek_id, session_no) AS de FROM m1),
a1 AS (SELECT x.sg, x.ss, x.graph_id, x.node AS i, y.node AS j, SUM(1.0 / x.de) AS w
       FROM m1d x JOIN m1d y ON {_J} AND x.geek_id = y.geek_id AND x.session_no = y.session_no
       GROUP BY 1, 2, 3, 4, 5),
dv1 AS (SELECT sg, ss, node AS i, COUNT(*) AS dv FROM m1 GROUP BY 1, 2, 3),
pr AS (SELECT sg, ss, graph_id, node AS src,
              LEAD(node) OVER (PARTITION BY sg, ss, geek_id, session_no ORDER BY pos) AS dst
       FROM sv),
m2 AS (SELECT DISTINCT sg, ss, graph_id, src, dst AS node FROM pr WHERE dst IS NOT NULL),
m2d AS (SELECT *, COUNT(*) OVER (PARTITION BY sg, ss, src) AS de FROM m2),
a2 AS (SELECT x.sg, x.ss, x.graph_id, x.node AS i, y.node AS j, SUM(1.0 / x.de) AS w
       FROM m2d x JOIN m2d y ON {_J} AND x.src = y.src GROUP BY 1, 2, 3, 4, 5),
dv2 AS (SELECT sg, ss, node AS i, COUNT(*) AS dv FROM m2 GROUP BY 1, 2, 3),
hist AS (SELECT DISTINCT sg, ss, node AS i FROM sv WHERE geek_id = sg AND session_no = ss),
sc AS (SELECT h.sg, h.ss, a.j, a.w / d.dv AS s FROM hist h
         JOIN a1 a ON a.sg = h.sg AND a.ss = h.ss AND a.i = h.i
         JOIN dv1 d ON d.sg = h.sg AND d.ss = h.ss AND d.i = h.i
       UNION ALL
       SELECT h.sg, h.ss, a.j, a.w / d.dv FROM hist h
         JOIN a2 a ON a.sg = h.sg AND a.ss = h.ss AND a.i = h.i
         JOIN dv2 d ON d.sg = h.sg AND d.ss = h.ss AND d.i = h.i),
tot AS (SELECT sg, ss, j, SUM(s) AS score FROM sc GROUP BY 1, 2, 3),
ranked AS (SELECT sg, ss, j, ROUND(score, 6) AS score,
                  ROW_NUMBER() OVER (PARTITION BY sg, ss ORDER BY ROUND(score, 6) DESC, j) AS rk
           FROM tot),
rec AS (SELECT sg, ss, j AS item, CAST(rk AS INTEGER) AS rk, score FROM ranked
        WHERE rk <= {P.top_k}),
lab AS (SELECT geek_id AS sg, session_no AS ss, list(node ORDER BY pos) AS label FROM long_s
        WHERE pos >= list_size - {P.top_k} GROUP BY 1, 2),
ex AS (SELECT l.sg, l.ss, l.label, r.item, r.rk,
              CASE WHEN list_contains(l.label, r.item) THEN 1 ELSE 0 END AS h
       FROM lab l LEFT JOIN rec r ON r.sg = l.sg AND r.ss = l.ss),
ex2 AS (SELECT *, SUM(h) OVER (PARTITION BY sg, ss ORDER BY rk) AS ch FROM ex),
per AS (SELECT sg, ss, any_value(label) AS label, SUM(h) AS nh, COUNT(item) AS nrec,
               SUM(CASE WHEN h = 1 THEN ch * 1.0 / rk ELSE 0 END) AS ap_num,
               MIN(CASE WHEN h = 1 THEN rk END) AS first_hit,
               SUM(CASE WHEN h = 1 THEN 1.0 / log2(rk + 1) ELSE 0 END) AS dcg
        FROM ex2 GROUP BY 1, 2),
per2 AS (SELECT *, nh * 1.0 / nrec AS p, nh * 1.0 / len(label) AS r,
                list_sum(list_transform(range(1, len(label) + 1), lambda i: 1.0 / log2(i + 1))) AS ideal
         FROM per),
met AS (SELECT sg AS geek_id, ss AS session_no, nh > 0 AS hit,
               ap_num / LEAST(len(label), nrec) AS ap, p AS precision, r AS recall,
               CASE WHEN p + r = 0 THEN 0.0 ELSE 2.0 * p * r / (p + r) END AS f1,
               CASE WHEN first_hit IS NULL THEN 0.0 ELSE 1.0 / first_hit END AS rr,
               dcg, CASE WHEN ideal = 0 THEN 0.0 ELSE dcg / ideal END AS ndcg
        FROM per2)"""

# Test graphs: UG = class adjacency (undirected, weighted, diagonal kept);
# DG = successor pair counts per class (directed); N = k_job nodes per graph.
UG = ADJ + f""",
ug AS (SELECT graph_id, i AS src, j AS dst, w FROM adj),
nodes AS (SELECT g.graph_id, CAST(r.range AS INTEGER) AS node
          FROM (SELECT DISTINCT graph_id FROM ug) g, range({P.k_job}) r)"""

DG = SESS + f""",
pp AS (SELECT first_person_class AS graph_id, geek_id, session_no, job_class AS src,
         LEAD(job_class) OVER (PARTITION BY geek_id, session_no ORDER BY pos) AS dst FROM sess),
dg AS (SELECT graph_id, src, dst, CAST(COUNT(*) AS DOUBLE) AS w FROM
         (SELECT DISTINCT graph_id, geek_id, session_no, src, dst FROM pp WHERE dst IS NOT NULL)
       GROUP BY 1, 2, 3),
dnodes AS (SELECT g.graph_id, CAST(r.range AS INTEGER) AS node
           FROM (SELECT DISTINCT graph_id FROM dg) g, range({P.k_job}) r)"""

# Combinatorial Laplacian of UG, weighted degrees and the bound lmax (2·max dw).
LAP = UG + """,
lap AS (SELECT graph_id, i, j, SUM(v) AS v FROM
          (SELECT graph_id, src AS i, dst AS j, -w AS v FROM ug
           UNION ALL SELECT graph_id, src, src, SUM(w) FROM ug GROUP BY 1, 2)
        GROUP BY 1, 2, 3 HAVING abs(SUM(v)) > 1e-12),
dwt AS (SELECT n.graph_id, n.node, COALESCE(SUM(u.w), 0) AS dw FROM nodes n
        LEFT JOIN ug u ON u.graph_id = n.graph_id AND u.src = n.node GROUP BY 1, 2),
gl AS (SELECT graph_id, 2.0 * MAX(dw) AS lmax, (2.0 * MAX(dw) + 1e-5) / 2 AS a FROM dwt
       GROUP BY 1)"""


def heat_coeff_sql(taus, m, name="cf"):
    """K5 for the heat kernel in SQL: (graph_id, filter, k, c) per graph of gl."""
    n = m + 1
    vals = ", ".join(f"({i}, {float(t)!r})" for i, t in enumerate(taus))
    return f"""{name} AS (SELECT g.graph_id, f.filter, CAST(k.range AS INTEGER) AS k,
  2.0 / {n} * SUM(exp(-f.t * (g.lmax / 2 * cos(pi() * (q.range + 0.5) / {n}) + g.lmax / 2) / g.lmax)
                  * cos(pi() * k.range * (q.range + 0.5) / {n})) AS c
  FROM gl g, (VALUES {vals}) f(filter, t), range({m + 1}) k, range({n}) q GROUP BY 1, 2, 3)"""


def cheby_terms_sql(signal, order, keys=("signal",), prefix="t", a_expr="g.a"):
    """Chebyshev terms T0..T_order of the scaled Laplacian on a signal CTE
    (graph_id, node, *keys, val); CTE names {prefix}0..{prefix}{order}."""
    ks = "".join(f", {k}" for k in keys)
    tks = "".join(f", t.{k}" for k in keys)
    grp = ", ".join(str(i) for i in range(1, 3 + len(keys)))
    out = [f"{prefix}0 AS (SELECT graph_id, node{ks}, val FROM {signal})"]
    for k in range(1, order + 1):
        scale = 1.0 if k == 1 else 2.0
        old = "" if k == 1 else f" UNION ALL SELECT graph_id, node{ks}, -val FROM {prefix}{k - 2}"
        out.append(f"""{prefix}{k} AS (SELECT graph_id, node{ks}, SUM(val) AS val FROM (
  SELECT l.graph_id, l.i AS node{tks}, {scale} * l.v / {a_expr} * t.val AS val FROM lap l
    JOIN {prefix}{k - 1} t ON t.graph_id = l.graph_id AND t.node = l.j
    JOIN gl g ON g.graph_id = l.graph_id
  UNION ALL SELECT graph_id, node{ks}, -{scale} * val FROM {prefix}{k - 1}{old}) GROUP BY {grp})""")
    return ",\n".join(out)


def cheby_combine_sql(order, coeff="cf", keys=("signal",), prefix="t", name="r"):
    """r_f = ½ c_f0 T0 + Σ_k c_fk T_k per filter."""
    ks = "".join(f", t.{k}" for k in keys)
    terms = " UNION ALL ".join(f"SELECT {k} AS k, * FROM {prefix}{k}" for k in range(order + 1))
    grp = ", ".join(str(i) for i in range(1, 4 + len(keys)))
    return f"""{name} AS (SELECT t.graph_id, t.node{ks}, c.filter,
  SUM(CASE WHEN c.k = 0 THEN 0.5 ELSE 1.0 END * c.c * t.val) AS val
  FROM ({terms}) t JOIN {coeff} c ON c.graph_id = t.graph_id AND c.k = t.k GROUP BY {grp})"""

# Both class hypergraph views as one set of graphs: graph key = class * 2 + view
# (view 0 = session hyperedges, view 1 = successor hyperedges).
TWO_VIEWS = ADJ + f""",
pp2 AS (SELECT first_person_class AS graph_id, job_class AS src,
          LEAD(job_class) OVER (PARTITION BY geek_id, session_no ORDER BY pos) AS dst FROM sess),
m2 AS (SELECT DISTINCT graph_id, src, dst AS node FROM pp2 WHERE dst IS NOT NULL),
m2d AS (SELECT *, COUNT(*) OVER (PARTITION BY graph_id, src) AS de FROM m2),
adj2 AS (SELECT a.graph_id, a.node AS i, b.node AS j, SUM(1.0 / a.de) AS w FROM m2d a
         JOIN m2d b ON a.graph_id = b.graph_id AND a.src = b.src GROUP BY 1, 2, 3),
ug AS (SELECT graph_id * 2 AS graph_id, i AS src, j AS dst, w FROM adj
       UNION ALL SELECT graph_id * 2 + 1, i, j, w FROM adj2),
nodes AS (SELECT g.graph_id, CAST(r.range AS INTEGER) AS node
          FROM (SELECT DISTINCT graph_id FROM ug) g, range({P.k_job}) r),
""" + LAP[LAP.index("lap AS"):]

# Every sample's two graphs (direct construction) as one set of graphs:
# graph key = (geek_id * 100000 + session_no) * 2 + view - 1.
SAMPLE_GRAPHS = SAMPLES + f""",
ug AS (SELECT sg || ':' || ss || ':1' AS graph_id, i AS src, j AS dst, w FROM a1
       UNION ALL SELECT sg || ':' || ss || ':2', i, j, w FROM a2),
nodes AS (SELECT g.graph_id, CAST(r.range AS INTEGER) AS node
          FROM (SELECT DISTINCT graph_id FROM ug) g, range({P.k_job}) r),
""" + LAP[LAP.index("lap AS"):]
