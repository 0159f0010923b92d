"""Line dedup by pairwise alignment.

Every line is hashed.  A line of some words links each document that holds it to the
earliest holder (a star, so a line in a million documents gives a million rows, not their
square).  A pair overlaps if the lines it shares have the words of a block in all, however
many documents hold them: the verdict on a pair does not change with the corpus.
Overlapping pairs are aligned by patience diff on the hashes (a gap without unique lines by
its longest common runs), and the aligned blocks of enough words are deleted from the later
document; an alignment is one to one.  "Earlier" is the order of (doc_id, hash of the text).
Only line hashes move between tasks until the texts are rewritten.

Edge cases: null and empty texts have no lines to share and stay as they are; a null
doc_id is the earliest; rows equal in doc_id and text are one document and are rewritten
alike; a document whose every word is deleted keeps an empty remainder (``dedup`` drops
it); an empty table gives no rows; extra columns are kept by ``dedup``.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.numtext import Texts, U, buffers, prefix, slices, span_hash
from tessera.llm.tables import staged


@dataclass(frozen=True)
class Align:
    """A seed line has ``seed_words`` words; a deleted block, and what a pair must share to
    be aligned, has ``block_words``."""
    seed_words: int = 3
    block_words: int = 5


def _increasing(pos: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence (patience piles with back links)."""
    tops, at, back = [], [], []
    for i, p in enumerate(pos):
        k = bisect_left(tops, p)
        back.append(at[k - 1] if k else -1)
        if k == len(tops):
            tops.append(p)
            at.append(i)
        else:
            tops[k], at[k] = p, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def _passages(h: list[int], w: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """End and hash of the shortest run of lines from each line on that has ``least`` words."""
    below = np.concatenate([[0], np.cumsum(w)])
    end = np.searchsorted(below, below[:-1] + least)
    start = np.arange(int((end <= len(h)).sum()))
    return end[start], span_hash(prefix(np.array(h, np.int64).view(U)), start, end[start])


def common_run(a: list[int], b: list[int], words: list[int], least: int) -> tuple[int, int, int] | None:
    """(start in a, start in b, lines) of a longest common run of ``least`` words (``words``
    are those of ``b``), or None.  Passages of ``least`` words are compared by hash, and the
    number of them in a row is found by bisection: no table of all pairs of lines."""
    of = dict(zip(b, words, strict=True))
    (ea, ha), (eb, hb) = _passages(a, np.array([of.get(x, least) for x in a]), least), _passages(b, np.array(words), least)

    def start(n: int) -> tuple[int, int] | None:
        if min(len(ha), len(hb)) < n:
            return None
        ra, rb = (span_hash(prefix(h), np.arange(len(h) - n + 1), np.arange(n, len(h) + 1)) for h in (ha, hb))
        both, i, j = np.intersect1d(ra, rb, return_indices=True)
        if not len(both):
            return None
        k = np.lexsort((i, j))[0]
        return int(i[k]), int(j[k])

    best, lo, hi = start(1), 1, min(len(ha), len(hb)) + 1
    if best is None:
        return None
    while hi - lo > 1:
        n = (lo + hi) // 2
        at = start(n)
        if at:
            best, lo = at, n
        else:
            hi = n
    i, j = best
    n = 0
    while n < min(len(a) - i, len(b) - j) and a[i + n] == b[j + n]:
        n += 1
    return (i, j, n) if n and sum(words[j:j + n]) >= least else None


def patience(a: list[int], b: list[int], words: list[int] | None = None, least: int = 1) -> list[tuple[int, int]]:
    """Aligned index pairs of two sequences: lines unique in both anchor the alignment,
    the gaps between anchors are aligned in turn; equal ends always match.  A gap without
    such a line is anchored by its longest common run of ``least`` words."""
    words = [1] * len(b) if words is None else words
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i == j or k == m:
            continue
        na, nb = Counter(a[i:j]), Counter(b[k:m])
        where = {x: p for p, x in enumerate(a[i:j], i) if na[x] == 1 and nb.get(x) == 1}
        both = [(where[x], q) for q, x in enumerate(b[k:m], k) if x in where]
        for t in _increasing([p for p, _ in both]):
            p, q = both[t]
            todo.append((i, p, k, q))
            out.append((p, q))
            i, k = p + 1, q + 1
        if both:
            todo.append((i, j, k, m))
        elif na.keys() & nb.keys() and (run := common_run(a[i:j], b[k:m], words[k:m], least)):
            p, q, n = i + run[0], k + run[1], run[2]
            out.extend((p + t, q + t) for t in range(n))
            todo += [(i, p, k, q), (p + n, j, q + n, m)]
    return sorted(out)


def common_runs(a: list[int], b: list[int], words: list[int], least: int) -> list[tuple[int, int]]:
    """Runs (start, end) of ``b`` in blocks aligned with ``a`` of at least ``least`` words."""
    out, pairs = [], patience(a, b, words, least)
    s = 0
    for t in range(1, len(pairs) + 1):
        if t == len(pairs) or pairs[t] != (pairs[t - 1][0] + 1, pairs[t - 1][1] + 1):
            lo, hi = pairs[s][1], pairs[t - 1][1] + 1
            if sum(words[lo:hi]) >= least:
                out.append((lo, hi))
            s = t
    return out


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_hashes(docs: DataFrame) -> DataFrame:
    """(did, th, h, w): the hashes and word counts of a document's lines, once for each
    document with a word."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = buffers(b.column("text"))
            for i, j in slices(off):
                t = Texts(data[off[i]:off[j]], off[i:j + 1])
                start, end, doc = t.lines()
                ws, _, _ = t.words()
                at = np.searchsorted(ws, [start, end])
                cut = np.searchsorted(doc, np.arange(t.n + 1)).astype(np.int32)
                h = span_hash(t.pre, start, end).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c).slice(i, j - i) for c in ("did", "th")), pa.ListArray.from_arrays(cut, h),
                     pa.ListArray.from_arrays(cut, (at[1] - at[0]).astype(np.int32))], names=["did", "th", "h", "w"])

    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("did"),
                       text_key(F.col("text")).alias("th"), "text")
    lines = rows.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]")).mapInArrow(
        run, "did long, th long, h array<long>, w array<int>")
    return lines.dropDuplicates(["did", "th"])


def overlapping(lines: DataFrame, p: Align) -> DataFrame:
    """Pairs (did, th) of a later and (f.did, f.th) of an earlier document that overlap."""
    seed = F.array_distinct(F.transform(
        F.filter(F.arrays_zip("h", "w"), lambda x: x["w"] >= p.seed_words),
        lambda x: F.struct(x["h"].alias("line"), x["w"].alias("words"))))
    held = lines.select("did", "th", F.explode(seed).alias("s")).select("did", "th", "s.*")
    first = (held.groupBy("line").agg(F.min(F.struct("did", "th")).alias("f"), F.count("*").alias("df"))
             .filter("df > 1").select(F.col("line").alias("l"), "f"))
    return (held.join(first, F.col("line") == F.col("l")).filter(F.struct("did", "th") != F.col("f"))
            .groupBy("did", "th", "f").agg(F.sum("words").alias("words"))
            .filter(F.col("words") >= p.block_words).select("did", "th", "f"))


def removed_runs(docs: DataFrame, p: Align) -> DataFrame:
    """(did, th, runs): the line ranges to delete, one row per document that loses any."""
    lines = staged(line_hashes(docs), "lines")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [common_runs(x, h, w, p.block_words) for x, h, w in zip(
                *(b.column(c).to_pylist() for c in ("fh", "h", "w")), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("did"), b.column("th"),
                 pa.array([[{"s": s, "e": e} for s, e in g] for g in got],
                          pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))], names=["did", "th", "runs"])

    earlier = lines.select(F.struct("did", "th").alias("g"), F.col("h").alias("fh"))
    pairs = overlapping(lines, p).join(lines, ["did", "th"])
    aligned = (pairs.join(earlier, F.col("f") == F.col("g")).select("did", "th", "h", "w", "fh")
               .mapInArrow(run, "did long, th long, runs array<struct<s:int,e:int>>"))
    # a document has at most one earlier partner per line, so this list is bounded by its lines
    return (aligned.filter(F.size("runs") > 0).groupBy("did", "th")
            .agg(F.flatten(F.collect_list("runs")).alias("runs")))


def rewrite(docs: DataFrame, p: Align = Align()) -> DataFrame:
    """``docs`` with __kept (the remaining text), __lines and __removed (line counts)."""
    # the runs grow with the corpus: the same sorted join at every size, never a broadcast
    runs = staged(removed_runs(docs, p), "runs").select(
        F.col("did").alias("__did"), F.col("th").alias("__th"), F.col("runs").alias("__runs")).hint("merge")
    j = docs.join(runs, (F.coalesce(docs["doc_id"].cast("long"), F.lit(-(1 << 63))) == F.col("__did"))
                  & (text_key(docs["text"]) == F.col("__th")), "left")
    lines = F.split("text", "\n", -1)
    rest = F.filter(lines, lambda x, i: ~F.exists("__runs", lambda r: (r["s"] <= i) & (i < r["e"])))
    j = j.withColumn("__rest", F.when(F.col("__runs").isNotNull(), rest))
    return (j.withColumn("__lines", F.coalesce(F.size(lines), F.lit(0)).cast("long"))
            .withColumn("__removed", F.when(F.col("__rest").isNull(), F.lit(0).cast("long"))
                        .otherwise(F.col("__lines") - F.size("__rest")))
            .withColumn("__kept", F.when(F.col("__rest").isNull(), F.col("text"))
                        .otherwise(F.array_join("__rest", "\n"))).drop("__did", "__th", "__runs", "__rest"))


def dedup(docs: DataFrame, p: Align = Align()) -> DataFrame:
    """The documents with repeated blocks deleted from the later ones (``n_chars`` follows
    the text); documents of which no word is left go."""
    out = rewrite(docs, p).filter((F.col("__removed") == 0) | F.col("__kept").rlike(r"[^\x20\x09-\x0D]"))
    new = {"text": F.col("__kept"),
           "n_chars": F.when(F.col("__removed") > 0, F.length("__kept")).otherwise(F.col("n_chars"))}
    return out.select(*[new[c].cast(t).alias(c) if c in new else F.col(f"`{c}`") for c, t in docs.dtypes])
