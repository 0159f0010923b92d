"""Quality rules with adaptive thresholds.

Text measures are counted over every whole text.  A relative-error quantile sketch
(log-spaced buckets with counts, after DDSketch) is built per language and source; two
sketches merge by adding counts, so small sources fall back on the merged sketch of
their language and small languages on that of the corpus.  The sketch table gives robust
fences, which replace fixed cut-offs, and a join with the fences filters the documents.
Symbols and word length are fenced by quartiles and three interquartile ranges: junk can be
several per cent of a source, and a high quantile would let it in.  Repeated lines and words
are rare in most sources, so that their quartiles say nothing: their fence is the 0.99
quantile plus its distance from the upper quartile.

Edge cases: a null or empty text has no words and fails the base rule; null language or
source is a group of its own; repeated rows are judged alike, one row each; an empty
table gives an empty result; extra columns are ignored (``measure``) or kept (``keep``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.numtext import Texts, buffers, repeated, slices, span_hash, windows
from tessera.llm.tables import staged

MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Rules:
    """``slack`` is the least distance of a fence from its quantile, per metric; metrics in
    ``tails`` have the 0.99 quantile."""
    min_words: int = 20
    max_repeat_pct: int = 30
    window: int = 8
    spread: float = 3.0
    accuracy: float = 0.01
    min_group: int = 200
    slack: tuple = (("symbols", None, 0.25), ("dup_lines", None, 0.2),
                    ("repeats", None, 0.1), ("word_len", 2.0, 3.0))
    tails: tuple = ("dup_lines", "repeats")


def _counts(data: np.ndarray, off: np.ndarray, window: int) -> list[np.ndarray]:
    t = Texts(data, off)
    start, end, doc = t.words()
    n_words = np.bincount(doc, minlength=t.n)
    at, wh = windows(span_hash(t.pre, start, end), doc, window)
    again, _ = repeated(doc[at], wh)
    step = np.zeros(len(doc) + 1, np.int64)
    np.add.at(step, at[again], 1)
    np.add.at(step, at[again] + window, -1)
    n_repeat = np.bincount(doc[np.cumsum(step)[:-1] > 0], minlength=t.n)
    ls, le, ld = t.lines()
    full = t.seen[le] > t.seen[ls]
    ls, le, ld = ls[full], le[full], ld[full]
    _, later = repeated(ld, span_hash(t.pre, ls, le))
    return [n_words, t.per_text(t.solid & ((t.data & 0xC0) != 0x80)), t.per_text(SYMBOL[t.data]),
            np.bincount(ld, minlength=t.n), np.bincount(ld[later], minlength=t.n), n_repeat]


def measure(docs: DataFrame, carry: list[str], rules: Rules = Rules(), text: str = "text") -> DataFrame:
    """``carry`` columns (``text`` among them if wanted) plus MEASURES, one row each."""
    cols = [*dict.fromkeys([*carry, text])]
    out = [f for f in docs.select(*cols).schema.fields if f.name in carry]
    window = rules.window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = buffers(b.column(text))
            parts = [_counts(data[off[i]:off[j]], off[i:j + 1], window) for i, j in slices(off)]
            if parts:
                got = [pa.array(np.concatenate(p).astype(np.int64)) for p in zip(*parts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(f.name) for f in out), *got], names=[*(f.name for f in out), *MEASURES])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in out),
                        *(f"{m} long" for m in MEASURES)])
    return docs.select(*cols).mapInArrow(run, schema)


def _metrics() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return {"symbols": F.col("n_symbols") / words,
            "dup_lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double"),
            "repeats": F.col("n_repeat_words") / words, "word_len": F.col("word_chars") / words}


def base_failed(rules: Rules) -> Column:
    return (F.col("n_words") < rules.min_words) | (
        100 * F.col("n_repeat_words") > rules.max_repeat_pct * F.col("n_words"))


def sketch(measured: DataFrame, rules: Rules) -> DataFrame:
    """One row (lang, source, metric, bucket, n) per used bucket; mergeable by sums."""
    log_gamma = math.log((1 + rules.accuracy) / (1 - rules.accuracy))
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), v.alias("v"))
                               for m, v in _metrics().items()]))
    return (measured.filter(~base_failed(rules)).select("lang", "source", rows.alias("r"))
            .select("lang", "source", "r.metric", F.when(
                F.col("r.v") > 0, F.ceil(F.ln("r.v") / log_gamma).cast("int"))
                .otherwise(F.lit(-(1 << 30))).alias("bucket"))
            .groupBy("lang", "source", "metric", "bucket").agg(F.count("*").alias("n")))


def fences(sk: DataFrame, rules: Rules) -> DataFrame:
    """(lang, source, <metric>_lo, <metric>_hi): sketches of all three levels, the finest
    of at least ``min_group`` documents wins (the corpus if none has so many)."""
    gamma = (1 + rules.accuracy) / (1 - rules.accuracy)
    value = F.when(F.col("bucket") == -(1 << 30), F.lit(0.0)).otherwise(
        2 * F.pow(F.lit(gamma), F.col("bucket")) / (gamma + 1))

    def quantiles(level: list[str], tag: str) -> DataFrame:
        merged = sk.groupBy(*level, "metric", "bucket").agg(F.sum("n").alias("n"))
        by = Window.partitionBy(*level, "metric")
        c = (merged.withColumn("below", F.sum("n").over(by.orderBy("bucket")))
             .withColumn("total", F.sum("n").over(by)).withColumn("v", value))
        got = c.groupBy(*level, "metric").agg(F.max("total").alias("total"), *[
            F.min(F.when(F.col("below") >= q * F.col("total"), F.col("v"))).alias(f"q{int(q * 100)}")
            for q in (0.25, 0.75, 0.99)])
        return got.select(*[F.col(k).alias(f"{tag}_{k}") for k in level],
                          F.col("metric").alias(f"{tag}_metric"), F.struct("total", "q25", "q75", "q99").alias(tag))

    own, lang, all_ = (quantiles(k, t) for k, t in ((["lang", "source"], "own"), (["lang"], "up"), ([], "top")))
    j = (own.join(lang, F.col("own_lang").eqNullSafe(F.col("up_lang")) & (F.col("own_metric") == F.col("up_metric")))
         .join(all_, F.col("own_metric") == F.col("top_metric")))
    pick = (F.when(F.col("own.total") >= rules.min_group, F.col("own"))
            .when(F.col("up.total") >= rules.min_group, F.col("up")).otherwise(F.col("top")))
    j = j.select(F.col("own_lang").alias("f_lang"), F.col("own_source").alias("f_source"),
                 F.col("own_metric").alias("metric"), pick.alias("q"))
    spread = rules.spread * (F.col("q.q75") - F.col("q.q25"))
    aggs = []
    for m, lo, hi in rules.slack:
        here = F.col("metric") == m
        if lo is not None:
            aggs.append(F.max(F.when(here, F.col("q.q25") - F.greatest(spread, F.lit(lo)))).alias(f"{m}_lo"))
        top, wide = (F.col("q.q99"), F.col("q.q99") - F.col("q.q75")) if m in rules.tails else (F.col("q.q75"), spread)
        aggs.append(F.max(F.when(here, top + F.greatest(wide, F.lit(hi)))).alias(f"{m}_hi"))
    return j.groupBy("f_lang", "f_source").agg(*aggs)


def judge(measured: DataFrame, bounds: DataFrame, rules: Rules) -> DataFrame:
    """Adds base_failed and kept; a group that has no fences only has failed rows."""
    metric, ok = _metrics(), F.lit(True)
    for m, lo, _ in rules.slack:
        ok = ok & F.coalesce(metric[m] <= F.col(f"{m}_hi"), F.lit(True))
        if lo is not None:
            ok = ok & F.coalesce(metric[m] >= F.col(f"{m}_lo"), F.lit(True))
    j = measured.join(bounds, F.col("lang").eqNullSafe(F.col("f_lang"))
                      & F.col("source").eqNullSafe(F.col("f_source")), "left")
    return (j.withColumn("base_failed", base_failed(rules))
            .withColumn("kept", ~F.col("base_failed") & ok).drop(*bounds.columns))


def quality(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """One row per document: doc_id, lang, source, the measures, base_failed and kept."""
    m = staged(measure(docs, ["doc_id", "lang", "source"], rules), "quality")
    return judge(m, fences(sketch(m, rules), rules), rules)


def keep(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """The documents that pass, with all their columns: fences from one scan, the filter
    in a second (text is measured twice but neither shuffled nor stored)."""
    cols = docs.columns
    d = docs.select([docs[c].alias(f"_c{i}") for i, c in enumerate(cols)])
    text, lang, source = (F.col(f"_c{cols.index(c)}").alias(c) for c in ("text", "lang", "source"))
    first = staged(measure(d.select(text, lang, source), ["lang", "source"], rules), "quality")
    bounds = staged(fences(sketch(first, rules), rules), "fences")
    second = judge(measure(d, d.columns, rules, f"_c{cols.index('text')}").select("*", lang, source), bounds, rules)
    return second.filter("kept").select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(cols)])
