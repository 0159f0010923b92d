"""Near duplicates by one-permutation hashing.

Each text's distinct word shingles are hashed once; the top bits choose one of ``bins``
bins and the least hash of a bin is its value (one permutation).  Empty bins borrow by
optimal densification: a bin probes others in an order that depends on the bin alone, until
it meets a filled one.  Bands of ``rows`` bins give bucket keys.

Texts of equal sets are one class, so copies cost one row each and no pairs.  Within a
bucket candidates are a star: the member that shares most buckets is the centre, and the
others are compared with it on the full sets.  Confirmed links merge components.  Buckets
that still hold two components are settled exactly: their members are bucketed anew by
prefix shingles (any two sets of the wanted similarity share one), and stars of more and
more centres (16 times as many per round, each of which then leaves its bucket) compare
members of different components, until every pair of a bucket is compared or connected.
No step writes out all pairs of a group.

Edge cases: a text without words (null, empty) has no set and links with nothing; fewer
words than a shingle make one shingle; ties and repeated rows fall into one class; a null
doc_id takes part in links but is nobody's component id, and is kept only if its component
has no id; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import connected_components
from tessera.llm.numtext import Texts, U, buffers, mix64, shingle_sets, slices
from tessera.llm.tables import staged


@dataclass(frozen=True)
class MinHash:
    """A pair at similarity s shares a band with probability 1-(1-s**rows)**(bins/rows):
    4e-8 short of 1 at s = 0.8 with the defaults."""
    shingle: int = 5
    percent: int = 80
    bins: int = 128
    rows: int = 4


def _set_digest(doc: np.ndarray, sh: np.ndarray, n: int) -> np.ndarray:
    """16 bytes per text from its set, independent of order: two wrapped sums."""
    out = np.zeros((n, 2), U)
    for i, salt in enumerate((0x51ED270B, 0xC2B2AE3D27D4EB4F)):
        c = np.zeros(len(sh) + 1, U)
        np.cumsum(mix64(sh ^ U(salt)), out=c[1:])
        at = np.searchsorted(doc, np.arange(n + 1))
        out[:, i] = mix64(c[at[1:]] - c[at[:-1]] + (at[1:] - at[:-1]).astype(U))
    return out


def signatures(doc: np.ndarray, sh: np.ndarray, n: int, bins: int) -> np.ndarray:
    """(n, bins) values; rows of texts without shingles are zero."""
    shift = U(64 - int(bins).bit_length() + 1)
    cell = doc * bins + (sh >> shift).astype(np.int64)
    first = np.ones(len(cell), bool)
    first[1:] = cell[1:] != cell[:-1]
    sig, full = np.zeros(n * bins, U), np.zeros(n * bins, bool)
    sig[cell[first]], full[cell[first]] = sh[first], True
    some = full.reshape(n, bins).any(axis=1)
    todo = np.flatnonzero(~full & np.repeat(some, bins))
    t = 0
    while len(todo):
        t += 1
        bin_ = (todo % bins).astype(U)
        probe = (mix64(bin_ * U(0x9E3779B1) + U(t) * U(0x85EBCA77C2B2AE63)) % U(bins)).astype(np.int64)
        source = todo - todo % bins + probe
        hit = full[source]
        sig[todo[hit]] = sig[source[hit]]
        todo = todo[~hit]
    return sig.reshape(n, bins)


def _bands(sig: np.ndarray, rows: int) -> np.ndarray:
    n, bins = sig.shape
    parts = sig.reshape(n, bins // rows, rows)
    h = np.broadcast_to(np.arange(bins // rows, dtype=U) + U(1), (n, bins // rows)).copy()
    for r in range(rows):
        h = mix64(h * U(0x9FB21C651E98DF25) + parts[:, :, r])
    return h.view(np.int64)


def _digest_array(d: np.ndarray, has: np.ndarray) -> pa.Array:
    raw = d.astype("<u8").tobytes()
    return pa.array([raw[16 * i:16 * i + 16] if ok else None for i, ok in enumerate(has)], pa.binary())


def sketch(docs: DataFrame, p: MinHash) -> DataFrame:
    """(doc_id, th, n_shingles, cls, bands) per row; th is the hash of the text, cls (the
    set's digest) is null if empty."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = buffers(b.column("text"))
            for i, j in slices(off):
                t = Texts(data[off[i]:off[j]], off[i:j + 1], lower=True)
                doc, sh = shingle_sets(t, p.shingle)
                n = np.bincount(doc, minlength=t.n)
                bands = _bands(signatures(doc, sh, t.n, p.bins), p.rows)
                bands = pa.ListArray.from_arrays(
                    np.arange(0, bands.size + 1, bands.shape[1], dtype=np.int32), bands.ravel())
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c).slice(i, j - i) for c in ("doc_id", "th")), pa.array(n.astype(np.int64)),
                     _digest_array(_set_digest(doc, sh, t.n), n > 0), bands],
                    names=["doc_id", "th", "n_shingles", "cls", "bands"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(
        run, f"doc_id {kind}, th long, n_shingles long, cls binary, bands array<long>")


def _class_texts(docs: DataFrame, needed: DataFrame, p: MinHash) -> DataFrame:
    """(cls, text) of one document for every class in ``needed(doc_id, cls)``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = buffers(b.column("text"))
            for i, j in slices(off):
                t = Texts(data[off[i]:off[j]], off[i:j + 1], lower=True)
                doc, sh = shingle_sets(t, p.shingle)
                has = np.bincount(doc, minlength=t.n) > 0
                yield pa.RecordBatch.from_arrays(
                    [_digest_array(_set_digest(doc, sh, t.n), has), b.column("text").slice(i, j - i)],
                    names=["cls", "text"])

    ids = needed.select(F.col("doc_id").alias("i")).distinct()
    found = (docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("i")), "left_semi")
             .select("text").mapInArrow(run, "cls binary, text string"))
    return found.join(needed.select("cls"), "cls", "left_semi").dropDuplicates(["cls"])


def confirm(pairs: DataFrame, texts: DataFrame, p: MinHash) -> DataFrame:
    """The rows (a, b) of ``pairs`` whose full shingle sets reach the similarity."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            (da, oa), (db, ob) = buffers(b.column("ta")), buffers(b.column("tb"))
            for i, j in slices(oa + ob):
                sets = [shingle_sets(Texts(d[o[i]:o[j]], o[i:j + 1], lower=True), p.shingle)
                        for d, o in ((da, oa), (db, ob))]
                doc, sh = (np.concatenate(x) for x in zip(*sets, strict=True))
                order = np.lexsort((sh, doc))
                doc, sh = doc[order], sh[order]
                both = doc[1:][(doc[1:] == doc[:-1]) & (sh[1:] == sh[:-1])]
                inter = np.bincount(both, minlength=j - i)
                union = np.bincount(doc, minlength=j - i) - inter
                ok = 100 * inter >= p.percent * union
                yield pa.RecordBatch.from_arrays(
                    [b.column(c).slice(i, j - i).filter(pa.array(ok)) for c in ("a", "b")], names=["a", "b"])

    ta = texts.select(F.col("cls").alias("ca"), F.col("text").alias("ta"))
    tb = texts.select(F.col("cls").alias("cb"), F.col("text").alias("tb"))
    # the centre of a star (b) can occur in very many pairs: its text joins last
    j = pairs.join(ta, F.col("a") == F.col("ca")).select("a", "b", "ta")
    return j.join(tb, F.col("b") == F.col("cb")).select("a", "b", "ta", "tb").mapInArrow(run, "a binary, b binary")


def _prefix_buckets(members: DataFrame, texts: DataFrame, p: MinHash) -> DataFrame:
    """(bucket, cls, n, hub, rest) for the prefix shingles of ``members(cls, n, hub)``: with the
    shingles of a set ordered from rare to frequent, two sets of the wanted similarity
    share one of their first n - ceil(n * percent / 100) + 1 shingles.  ``rest`` counts the
    shingles from there on: the first shared one bounds the size of the intersection."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = buffers(b.column("text"))
            for i, j in slices(off):
                doc, sh = shingle_sets(Texts(data[off[i]:off[j]], off[i:j + 1], lower=True), p.shingle)
                yield pa.RecordBatch.from_arrays(
                    [b.column("cls").slice(i, j - i).take(pa.array(doc)), pa.array(sh.view(np.int64))],
                    names=["cls", "token"])

    tokens = staged(texts.join(members.select("cls"), "cls", "left_semi").mapInArrow(run, "cls binary, token long"), "tokens")
    freq = tokens.groupBy("token").agg(F.count("*").alias("f")).withColumnRenamed("token", "t")
    ordered = (tokens.join(freq, F.col("token") == F.col("t")).groupBy("cls")
               .agg(F.array_sort(F.collect_list(F.struct("f", "token"))).alias("set")))
    length = F.size("set") - F.ceil(F.size("set") * p.percent / 100).cast("int") + 1
    rare = ordered.select(F.col("cls").alias("c"), F.posexplode(F.slice("set", F.lit(1), length)).alias("i", "s")).filter("s.f > 1")
    return members.join(rare, F.col("cls") == F.col("c")).select(
        F.col("s.token").alias("bucket"), "cls", "n", "hub", (F.col("n") - F.col("i")).alias("rest"))


def class_labels(classes: DataFrame, docs: DataFrame, p: MinHash) -> DataFrame:
    """(node, label) of every class that confirmed links connect with another.
    ``classes``: (cls, doc_id, n, bands), one row per class."""
    rows = classes.select("cls", "n", F.explode("bands").alias("bucket"))
    crowded = rows.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1").withColumnRenamed("bucket", "k")
    left = staged(rows.join(crowded, F.col("bucket") == F.col("k")).select("bucket", "cls", "n", "size"), "buckets")
    none = rows.select(F.col("cls").alias("a"), F.col("cls").alias("b")).filter("false")
    if left.isEmpty():
        return none.toDF("node", "label")
    # a text that shares many buckets with many others (the original of edited copies) is a good centre
    hub = left.groupBy("cls").agg(F.sum("size").alias("hub")).withColumnRenamed("cls", "c")
    left = left.join(hub, F.col("cls") == F.col("c")).select("bucket", "cls", "n", "hub", F.col("n").alias("rest"))
    texts = staged(_class_texts(docs, classes.join(left.select("cls").distinct(), "cls", "left_semi")
                                .select("doc_id", "cls"), p), "texts")
    seen, labels, centres = none, none.toDF("node", "label"), 1
    while True:
        here = left.join(labels, F.col("cls") == F.col("node"), "left").select(
            "bucket", "cls", "n", "hub", "rest", F.coalesce("label", "cls").alias("comp"))
        mixed = (here.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
                 .filter("lo <> hi").select(F.col("bucket").alias("k")))
        left = here.join(mixed, F.col("bucket") == F.col("k"), "left_semi")
        if centres == 8:  # the first stars are done: exact candidates for what is still apart
            members = left.select("cls", "n", "hub").distinct()
            left = _prefix_buckets(members, texts, p).join(
                labels, F.col("cls") == F.col("node"), "left").select(
                "bucket", "cls", "n", "hub", "rest", F.coalesce("label", "cls").alias("comp"))
        left = staged(left, "buckets")
        if left.isEmpty():
            return labels
        star = (left.groupBy("bucket", F.pmod(F.xxhash64("cls"), F.lit(centres)).alias("part"))
                .agg(F.max(F.struct("hub", "cls", "comp", "n", "rest")).alias("c")))
        star = staged(star.select(F.col("bucket").alias("k"), "c.*").toDF(
            "k", "c_hub", "centre", "c_comp", "c_n", "c_rest"), "stars")
        # a link needs this much in common: unequal sizes or late first matches rule it out
        both = (100 + p.percent) * F.least("rest", "c_rest") >= p.percent * (F.col("n") + F.col("c_n"))
        pairs = (left.join(star, (F.col("bucket") == F.col("k")) & (F.col("comp") != F.col("c_comp")) & both)
                 .select(F.col("cls").alias("a"), F.col("centre").alias("b")).distinct()
                 .join(seen, ["a", "b"], "left_anti")
                 .join(seen.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti"))
        pairs = staged(pairs, "pairs")
        seen, new = seen.union(pairs), staged(confirm(pairs, texts, p), "links")
        if not new.isEmpty():  # the components so far are stars: their labels stand for their links
            labels = connected_components(new.union(labels.select("label", "node")))
        left = left.join(star, (F.col("bucket") == F.col("k")) & (F.col("cls") == F.col("centre")), "left_anti").select(
            "bucket", "cls", "n", "hub", "rest")
        centres = 8 if centres == 1 else 16 * centres


def _judged(docs: DataFrame, p: MinHash) -> DataFrame:
    """(doc_id, th, n_shingles, component_id, kept) of every row."""
    rows = staged(sketch(docs, p), "minhash")
    some = rows.filter("cls is not null")
    classes = staged(some.groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"),
                                             F.first("bands").alias("bands")), "classes")
    labels = class_labels(classes, docs, p)
    comp = classes.select("cls", "doc_id").join(labels, F.col("cls") == F.col("node"), "left").select(
        "cls", "doc_id", F.coalesce("label", "cls").alias("label"))
    least = comp.groupBy("label").agg(F.min("doc_id").alias("component_id")).withColumnRenamed("label", "l")
    by_class = comp.join(least, F.col("label") == F.col("l")).select(F.col("cls").alias("c"), "component_id")
    return (rows.select("doc_id", "th", "n_shingles", "cls").join(by_class, F.col("cls") == F.col("c"), "left")
            .withColumn("component_id", F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
            .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
            .select("doc_id", "th", "n_shingles", "component_id", "kept"))


def near_duplicates(docs: DataFrame, p: MinHash = MinHash()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    return _judged(docs, p).drop("th")


def dedup(docs: DataFrame, p: MinHash = MinHash()) -> DataFrame:
    """The documents without those whose component has a smaller id; rows without an id
    stay, and so does another text with the id of one that goes."""
    gone = _judged(docs, p).filter("not kept and doc_id is not null").select(
        F.col("doc_id").alias("__gone"), F.col("th").alias("__th")).distinct()
    return docs.join(gone, (docs["doc_id"] == F.col("__gone"))
                     & (F.xxhash64(docs["text"]) == F.col("__th")), "left_anti")
