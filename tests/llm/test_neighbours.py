"""Approximate neighbours against brute force: scores exact, order exact, recall 0.9 or more."""

import math
import random

import numpy as np
import pytest

from tessera.llm.neighbours import Lower, Search, chi_square, nearest, stop_ratio
from tessera.llm.queries import op13_nearest_neighbours

SCHEMA = "vec_id long, embedding array<double>, label int, query long, cell string, rank int"


def brute(rows, k=5, every=50):
    ok = {(i, tuple(v)) for i, v in rows if i is not None and v and all(
        x is not None and math.isfinite(x) for x in v) and any(v)}
    ok = {(i, v): tuple(x / 2.0 ** math.frexp(max(map(abs, v)))[1] for x in v) for i, v in ok}
    ok = [(i, v) for (i, _), v in ok.items()]
    out = {}
    for i, q in ok:
        if i % every == 0:
            near = {}
            for j, v in ok:
                if j != i and len(v) == len(q):
                    s = sum(a * b for a, b in zip(q, v, strict=True)) / (math.sqrt(sum(a * a for a in q))
                                                                         * math.sqrt(sum(a * a for a in v)))
                    near[j] = max(s, near.get(j, -2))
            out[i] = sorted(near.items(), key=lambda x: (-round(x[1], 12), x[0]))[:k]
    return out


def check(got, want, recall):
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == {i for i, w in want.items() if w}
    hit = total = 0
    for i, w in want.items():
        rows = sorted(by.get(i, []), key=lambda r: r.rank)
        assert [r.rank for r in rows] == list(range(1, len(w) + 1))
        assert all(a.score >= b.score - 1e-12 for a, b in zip(rows, rows[1:], strict=False))
        exact, found = dict(w), {r.vec_id for r in rows}
        assert len(found) == len(rows) and i not in found
        for r in rows:
            if r.vec_id in exact:
                assert r.score == pytest.approx(exact[r.vec_id], abs=1e-14)
        hit, total = hit + len(found & set(exact)), total + len(w)
    assert hit >= recall * total
    return hit / max(total, 1)


def test_recall_on_clusters_and_edges(spark):
    r = np.random.default_rng(3)
    centre = r.standard_normal((20, 16))
    vecs = [*(centre[i % 20] + 0.3 * r.standard_normal(16) for i in range(1500)), *r.standard_normal((500, 16))]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vecs)]
    one = rows[7][1]
    rows += [(i, one) for i in range(2000, 3000)] + [(3000, [2 * x for x in one])]  # copies, and one of equal direction
    rows += [(4000, None), (4050, [0.0] * 16), (4100, []), (4150, [float("nan")] * 16), (4200, [None] * 16), (None, one),
             (4250, [float("inf")] + [1.0] * 15), (50, rows[50][1]), (51, rows[51][1])]
    rows += [(5000 + i, [1.0, float(i)]) for i in range(8)] + [(6000, [1.0, 2.0, 3.0])]  # another length, few rows
    rows += [(7000 + i, [1e200 * (i + 1), 1e201, 1e-200, 0.0]) for i in range(60)]
    df = spark.createDataFrame([(*x, 1, 2, "c", 3) for x in rows], SCHEMA).repartition(4)
    p = Search(chunk_rows=128, query_rows=16, leaf_rows=16, verify_rows=8, sample_rows=400)
    check(nearest(df, p=p).collect(), brute(rows), 0.95)
    assert nearest(df.limit(0)).count() == 0


def test_lower_tree_is_incremental():
    r = np.random.default_rng(1)
    pts = np.round(r.standard_normal((700, 4)), 1)
    tree = Lower(pts, 16)
    q = r.standard_normal(4)
    at, far = (np.concatenate(x) for x in zip(*tree.nearer(q), strict=True))
    d = ((pts - q) ** 2).sum(1)
    assert sorted(at) == list(range(700)) and np.allclose(d[at], far) and (np.diff(far) >= -1e-12).all()


def test_stop_ratio():
    p = Search(dims=8, confidence=0.95)
    assert stop_ratio(p) == pytest.approx(15.507, abs=1e-3)  # tabulated quantile
    random.seed(1)
    draws = [sum(random.gauss(0, 1) ** 2 for _ in range(8)) for _ in range(4000)]
    assert sum(x < 10 for x in draws) / 4000 == pytest.approx(chi_square(10, 8), abs=0.03)


def test_query_recall(spark):
    d = "/root/testdata/sf0.01"
    rows = [(x.vec_id, list(x.embedding)) for x in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    got = op13_nearest_neighbours(spark, d)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")]
    check(got.collect(), brute(rows), 0.9)
