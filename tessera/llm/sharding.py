"""Proportional stratified interleaving into shards (DataFrame functions only).

Rows of each source are put in a seeded random order and ranked; the fractional rank
``(rank + u) / n`` (u: a seeded offset of the source) spreads every source evenly over
the unit interval.  All rows sorted by it and cut into equal runs give shards whose
sources have the proportions of the corpus and whose counts are at most one apart.

Ranks are two-level (``rank_within``): a source is ranked in cells of its hash range, the
total order in cells of the interval, so neither a hot source nor the corpus is sorted by
one task.  Texts are read but not shuffled.

Edge cases: a null text has size 8 and CRC 0; null sources are a source of their own;
rows with null or repeated doc_id are placed one by one (the seeded hash takes in CRC and
size, so they spread over the cells like any others; rows equal in all three are
interchangeable and share a cell); very long texts are read once and only their size and CRC
travel; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.tables import rank_within

CELLS = 4096


def shard_rows(docs: DataFrame, shards: int = 24, seed: int = 20, cells: int = CELLS) -> DataFrame:
    """(doc_id, source, size, text_crc32, shard, slot) of every row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", "source", (F.octet_length(text) + F.lit(8)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size"))
    ties = ["h", "doc_id", "text_crc32", "size"]
    ranked = rank_within(rows, ["source"], ties, "rank", F.shiftrightunsigned("h", 64 - 12) % cells)
    n_source = rows.groupBy(F.col("source").alias("s")).agg(F.count("*").alias("n_s"))
    offset = F.pmod(F.xxhash64(F.lit(seed), F.lit("offset"), F.col("source")), F.lit(1 << 20)) / float(1 << 20)
    placed = (ranked.join(n_source, F.col("source").eqNullSafe(F.col("s")))
              .withColumn("f", (F.col("rank") + offset) / F.col("n_s"))
              .withColumn("one", F.lit(1)))
    total = rows.agg(F.count("*").alias("n"))
    pos = rank_within(placed, ["one"], ["f", "source", *ties], "pos",
                      F.least(F.floor(F.col("f") * cells), F.lit(cells - 1)).cast("int"))
    pos = pos.withColumn("n", total.scalar())
    return (pos.withColumn("shard", F.expr(f"cast((pos * {shards}) div n as int)"))
            .withColumn("slot", F.expr(f"pos - (shard * n + {shards - 1}) div {shards}"))
            .select("doc_id", "source", "size", "text_crc32", "shard", "slot"))
