"""Ranking metrics of one recommended list against one truth list (R4-R12), as
Column expressions over ``array<int>`` columns (JVM-side higher-order functions; no
Python per row).  Semantics follow the workflow's definitions exactly: repeats in the
recommended list count each time, AP divides by min(len truth, len rec), and the ideal
DCG credits every truth item as a hit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _hit_mask(rec: Column, truth: Column) -> Column:
    return F.transform(rec, lambda x: F.array_contains(truth, x).cast("int"))


def n_hits(rec: Column, truth: Column) -> Column:
    return F.aggregate(_hit_mask(rec, truth), F.lit(0), lambda a, x: a + x)


def hit_rate(rec: Column, truth: Column) -> Column:
    """Any recommended item in the truth."""
    return F.exists(rec, lambda x: F.array_contains(truth, x))


def average_precision(rec: Column, truth: Column) -> Column:
    """Σ (hits so far / n) over hit positions, / min(len truth, len rec)."""
    acc0 = F.struct(F.lit(0).alias("h"), F.lit(0.0).alias("s"), F.lit(0).alias("n"))

    def step(acc, x):
        hit = F.array_contains(truth, x)
        h = acc["h"] + hit.cast("int")
        n = acc["n"] + 1
        return F.struct(h.alias("h"),
                        (acc["s"] + F.when(hit, h / n).otherwise(F.lit(0.0))).alias("s"),
                        n.alias("n"))

    total = F.aggregate(rec, acc0, step, lambda a: a["s"])
    return F.try_divide(total, F.least(F.size(truth), F.size(rec)).cast("double"))


def precision(rec: Column, truth: Column) -> Column:
    """Hits / len(rec)."""
    return F.try_divide(n_hits(rec, truth).cast("double"), F.size(rec).cast("double"))


def recall(rec: Column, truth: Column) -> Column:
    """Hits / len(truth) (can exceed 1 with repeats)."""
    return F.try_divide(n_hits(rec, truth).cast("double"), F.size(truth).cast("double"))


def f1(p: Column, r: Column) -> Column:
    """Harmonic mean, 0 when both are 0."""
    return F.when(p + r == 0, F.lit(0.0)).otherwise(F.lit(2.0) * p * r / (p + r))


def reciprocal_rank(rec: Column, truth: Column) -> Column:
    """1 / position of the first hit, 0 without a hit."""
    first = F.array_position(_hit_mask(rec, truth), 1)
    return F.when(first > 0, F.lit(1.0) / first).otherwise(F.lit(0.0))


def dcg(rec: Column, truth: Column) -> Column:
    """Σ over hit positions idx (1-based) of 1/log2(idx+1)."""
    idx = F.sequence(F.lit(1), F.greatest(F.size(rec), F.lit(1)))
    terms = F.zip_with(rec, idx, lambda x, i: F.when(F.array_contains(truth, x),
                                                     F.lit(1.0) / F.log2(i + 1)).otherwise(0.0))
    return F.aggregate(F.coalesce(F.filter(terms, lambda t: t.isNotNull()), F.array()),
                       F.lit(0.0), lambda a, t: a + t)


def ideal_dcg(truth: Column) -> Column:
    """Ideal DCG: every truth item is a hit, so Σ_{i=1..len(truth)} 1/log2(i+1)."""
    n = F.size(truth)
    s = F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.lit(0.0),
                    lambda a, i: a + F.lit(1.0) / F.log2(i + 1))
    return F.when(n > 0, s).otherwise(F.lit(0.0))


def ndcg(rec: Column, truth: Column) -> Column:
    """DCG / ideal DCG, 0 when the ideal is 0."""
    ideal = ideal_dcg(truth)
    return F.when(ideal == 0, F.lit(0.0)).otherwise(dcg(rec, truth) / ideal)


def position_accuracy(pred: Column, label: Column) -> Column:
    """100 × number of positions where prediction equals label."""
    eq = F.zip_with(pred, label, lambda a, b: F.when(a == b, 1).otherwise(0))
    return F.lit(100.0) * F.aggregate(F.coalesce(eq, F.array()), F.lit(0),
                                      lambda a, x: a + F.coalesce(x, F.lit(0)))


def all_metrics(rec: Column, truth: Column) -> list[Column]:
    p, r = precision(rec, truth), recall(rec, truth)
    return [hit_rate(rec, truth).alias("hit"), average_precision(rec, truth).alias("ap"),
            p.alias("precision"), r.alias("recall"), f1(p, r).alias("f1"),
            reciprocal_rank(rec, truth).alias("rr"), dcg(rec, truth).alias("dcg"),
            ndcg(rec, truth).alias("ndcg")]
