"""Benchmark decontamination (DataFrame functions only): containment search by MinHash.

Test items are partitioned by the size of their shingle sets (powers of four).  For a part
of items of up to L shingles every document is read in windows of 2L shingles, one per L,
so the set that an item is compared with is of like size even in a very long document; a
document below that size is one window.  One-permutation MinHash with 128 bins gives each
window and item its bin minima; equal minima make a candidate.  An item with 80 % of its
shingles in a window has a Jaccard similarity of 0.1 with it at least, and one bin minimum
in common with probability 1 - 0.9**128 = 1 - 1.4e-6.  That needs bins that are filled: in
parts whose windows have fewer shingles than bins every shingle is used.  Candidates are verified by exact
containment of the item's shingles in the whole document.

Edge cases: texts without words (null, empty) contain and match nothing; an item of fewer
words than a shingle is one shingle and matches documents of just these words; repeated
rows and ids give a result per distinct (doc_id, text) and (item_id, text); null ids are
carried; empty tables give no rows; extra columns are ignored or, in ``clean``, kept.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.secret_scan import let
from tessera.llm.tables import staged


@dataclass(frozen=True)
class Containment:
    """Minima of all items are broadcast while they take at most ``broadcast_bytes``."""
    shingle: int = 5
    percent: int = 80
    bin_bits: int = 7
    broadcast_bytes: int = 8 << 20


def shingled(df: DataFrame, key: str, k: int) -> DataFrame:
    """(key, th, sh): distinct texts with the hashes of their word shingles, in order."""
    def of(hw: Column) -> Column:
        n = F.size(hw)
        runs = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(hw, i + d) for d in range(k)]))
        return F.when(n >= k, runs).otherwise(F.array(F.xxhash64(hw)))

    words = F.filter(F.split(F.lower("text"), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    # one expression that binds the word hashes: as a column of its own they could be
    # copied into the inner function and computed for every shingle
    sh = let(F.transform(words, lambda w: F.xxhash64(w)), of)
    return df.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(
        key, F.xxhash64("text").alias("th"), sh.alias("sh"))


def minima(values: Column, bits: int) -> Column:
    """The least value of every bin (top bits) of an array of hashes."""
    def bin_of(x: Column) -> Column:
        return F.shiftrightunsigned(x, 64 - bits)

    return let(F.sort_array(values), lambda s: F.filter(
        s, lambda x, i: (i == 0) | (bin_of(x) != bin_of(F.get(s, i - 1)))))


def contaminated(docs: DataFrame, items: DataFrame, p: Containment = Containment()) -> DataFrame:
    """(doc_id, th, item_id, n_item, n_shared): the documents that hold an item."""
    it = staged(shingled(items, "item_id", p.shingle).select(
        "item_id", F.col("th").alias("ith"), F.array_distinct("sh").alias("ish"))
        .dropDuplicates(["item_id", "ith"])
        .withColumn("part", F.pow(F.lit(4), F.ceil(F.log2(F.greatest(F.size("ish"), F.lit(4)).cast("double")) / 2)).cast("int")), "items")
    parts = sorted(r["part"] for r in it.select("part").distinct().collect())  # at most 16: powers of four
    if not parts:
        empty = docs.select("doc_id", F.lit(0).cast("long").alias("th")).filter("false")
        return empty.join(items.select("item_id").filter("false")).withColumns(
            {"n_item": F.lit(0), "n_shared": F.lit(0)})
    few = 1 << p.bin_bits  # windows of fewer shingles send them all
    keys = it.select("item_id", "ith", "part", F.explode(F.when(2 * F.col("part") < few, F.col("ish")).otherwise(
        minima(F.col("ish"), p.bin_bits))).alias("v"))
    # every item has at most 2**bin_bits minima of about 40 bytes
    if it.count() * 40 << p.bin_bits <= p.broadcast_bytes:
        keys = F.broadcast(keys)
    seen = shingled(docs, "doc_id", p.shingle)

    def cut(part: int) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size("sh") - part - 1, F.lit(0)), F.lit(part))

        def sent(window: Column) -> Column:
            return F.array_distinct(window) if 2 * part < few else minima(window, p.bin_bits)

        return F.transform(starts, lambda s: F.struct(
            F.lit(part).alias("part"), sent(F.slice("sh", s + 1, 2 * part)).alias("m")))

    windows = F.concat(*[cut(part) for part in parts])
    rows = (seen.select("doc_id", "th", F.explode(windows).alias("w"))
            .select("doc_id", "th", F.col("w.part").alias("wp"), F.explode("w.m").alias("m")))
    found = staged(rows.join(keys, (F.col("m") == F.col("v")) & (F.col("wp") == F.col("part")))
                   .select("doc_id", "th", "item_id", "ith").distinct(), "candidates")
    pairs = found.join(it.select(F.col("item_id").alias("j"), F.col("ith").alias("jth"), "ish"),
                       F.col("item_id").eqNullSafe(F.col("j")) & (F.col("ith") == F.col("jth"))).select(
        F.col("doc_id").alias("d"), F.col("th").alias("dth"), "item_id", "ish")
    ids = found.select(F.col("doc_id").alias("d"), F.col("th").alias("dth")).distinct()
    full = shingled(docs.withColumn("__t", F.xxhash64("text")).join(
        ids, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("__t") == F.col("dth")), "left_semi"), "doc_id", p.shingle)
    shared = F.size(F.array_intersect("ish", "sh"))
    return (full.dropDuplicates(["doc_id", "th"])
            .join(pairs, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("dth")))
            .select("doc_id", "th", "item_id", F.size("ish").alias("n_item"), shared.alias("n_shared"))
            .filter(100 * F.col("n_shared") >= p.percent * F.col("n_item")))


def clean(docs: DataFrame, items: DataFrame, p: Containment = Containment()) -> DataFrame:
    """The documents that hold no item."""
    bad = staged(contaminated(docs, items, p).select(
        F.col("doc_id").alias("__d"), F.col("th").alias("__th")).distinct(), "contaminated")
    return docs.join(bad, docs["doc_id"].eqNullSafe(F.col("__d"))
                     & (F.xxhash64(docs["text"]) == F.col("__th")), "left_anti")
