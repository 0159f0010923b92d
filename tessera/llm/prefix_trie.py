"""Prefix trie of conversations, built by van Emde Boas recursion over depth.

A conversation of n turns has a position for each of its prefixes, of depth 0 to n.  The
recursion cuts a range of depths at half: the upper trie holds the prefixes up to the cut,
and each distinct cut prefix is the root of a lower trie.  All tries of one size are
treated by one job, so that depth D takes about log2(D) rounds, not D:

* upward, ``segments`` names every aligned run of 2**k turns by its two halves;
* downward, ``positions`` names the root of each half: the upper half keeps the root of the
  whole, the lower half gets the name of its cut prefix (root and upper segment);
  after the last cut a position's root is its own prefix, and equal names are one node;
* upward again, ``graft`` adds the totals of the lower tries to the nodes above their cut,
  first in tries of two levels, then four, and so on.

A name is the MD5 of the two names it joins, so nothing but 16 bytes is ever compared.
Every table has one row for a position, a segment or a node, keyed by (conversation, place):
a conversation with most of the turns is spread like any other, and first turns that many
conversations share are summed before they are shuffled.

Edge cases: a null role or text is empty; rows without conv_id belong to no conversation and
are left out; turns are ordered with null first, equal turns by role and text, and repeated
rows are turns of their own; texts are only hashed and measured; an empty table has no
nodes, a conversation without turns is a member of the root; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.tables import range_cells, staged

ROOT = bytes(16)
KEYED = 64       # characters of role and text that may decide a range cut
SPAN_BITS = 8    # ancestors are looked up in runs of at most 2**8 positions
NO_ENDS = hashlib.sha256(b"").hexdigest()


@dataclass(frozen=True)
class Regrouping:
    """The conversation c starts with the first crc32(c) % ``heads`` turns of the first
    conversation of its ``family`` (c - c % family)."""
    family: int = 5
    heads: int = 9


def _name(*parts: str) -> Column:
    return F.unhex(F.md5(F.concat(*parts)))


def _numbered(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, pos, sym, bytes) and conversations (conv_id, n).

    Turns are sorted by ranges; a turn's place is the turns of its conversation in earlier
    ranges plus its place in its own."""
    t = turns.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("row"))
    t = t.withColumn("sym", _name(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")).withColumn(
        "bytes", F.octet_length("text").cast("long"))
    short_role, short_text = F.length("role") < KEYED, F.length("text") < KEYED
    cut = ["conv_id", F.asc_nulls_first("turn"), F.substring("role", 1, KEYED),
           F.when(short_role, F.substring("text", 1, KEYED)), F.when(short_role & short_text, F.col("row"))]
    cells = range_cells(t, ["conv_id", F.asc_nulls_first("turn"), "role", "text", "row"], "turns", cut,
                        drop=("turn", "role", "text", "row"))
    per = cells.groupBy("conv_id", "__pid").agg(F.count("*").alias("n"), F.min("__seq").alias("first"))
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("__pid")) - F.col("n")
    at = per.select("conv_id", "__pid", (before - F.col("first")).alias("shift"))
    placed = cells.join(at, ["conv_id", "__pid"]).select(
        "conv_id", (F.col("shift") + F.col("__seq")).alias("pos"), "sym", "bytes")
    return staged(placed, "placed"), per.groupBy("conv_id").agg(F.sum("n").alias("n"))


def rebuilt(turns: DataFrame, how: Regrouping = Regrouping()) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, depth from 1, sym, bytes) and conversations (conv_id, len)."""
    placed, sizes = _numbered(turns)
    h = F.crc32(F.col("conv_id").cast("string")) % how.heads
    base = F.col("conv_id") - F.pmod(F.col("conv_id"), F.lit(how.family))
    first = sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = (sizes.withColumn("h", h).withColumn("base", base).join(first, "base", "left")
             .withColumn("m", F.least("h", F.coalesce("base_n", F.lit(0))))
             .withColumn("len", F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0))))
    convs = staged(convs.select("conv_id", "base", "h", "m", "len"), "convs")
    # a conversation's own turns move by h - m only where its base is shorter than h
    own = placed.filter(F.col("pos") >= h)
    moved = convs.filter(F.col("m") < F.col("h")).select("conv_id", (F.col("h") - F.col("m")).alias("back"))
    own = own.join(moved, "conv_id", "left").select(
        "conv_id", (F.col("pos") + 1 - F.coalesce("back", F.lit(0))).alias("depth"), "sym", "bytes")
    heads = (placed.filter((F.col("pos") < how.heads - 1) & (base == F.col("conv_id")))
             .withColumnRenamed("conv_id", "base").join(convs.select("conv_id", "base", "h"), "base")
             .filter(F.col("pos") < F.col("h")).select("conv_id", (F.col("pos") + 1).alias("depth"), "sym", "bytes"))
    return staged(own.unionByName(heads), "rebuilt"), convs.select("conv_id", "len")


def segments(turns: DataFrame, levels: int) -> list[DataFrame]:
    """By level k the names (conv_id, i, s) of the whole runs of 2**k turns."""
    out = [turns.select("conv_id", (F.col("depth") - 1).alias("i"), F.col("sym").alias("s"))]
    odd = F.col("i") % 2 == 1
    for k in range(1, levels):
        halves = (out[-1].groupBy("conv_id", F.shiftright("i", 1).alias("i"))
                  .agg(F.max(F.when(~odd, F.col("s"))).alias("a"), F.max(F.when(odd, F.col("s"))).alias("b")))
        out.append(staged(halves.filter(F.col("a").isNotNull() & F.col("b").isNotNull())
                          .select("conv_id", "i", _name("a", "b").alias("s")), f"segments-{k}"))
    return out


def positions(convs: DataFrame, segs: list[DataFrame], levels: int) -> DataFrame:
    """(conv_id, len, i, name): the name of the prefix of depth i, for i from 0 to len."""
    at = convs.select("conv_id", "len", F.lit(0).cast("long").alias("i"), F.lit(ROOT).alias("name"))
    for k in reversed(range(levels)):
        upper = segs[k].filter(F.col("i") % 2 == 0).select("conv_id", F.shiftright("i", 1).alias("i"), "s")
        both = F.array(F.struct((2 * F.col("i")).alias("i"), F.col("name").alias("name")),
                       F.struct((2 * F.col("i") + 1).alias("i"), _name("name", "s").alias("name")))
        at = staged(at.join(upper, ["conv_id", "i"], "left").select("conv_id", "len", F.explode(both).alias("c"))
                    .select("conv_id", "len", "c.i", "c.name")
                    .filter(F.shiftleft("i", k) <= F.col("len")), f"positions-{k}")
    return at


def nodes(at: DataFrame, turns: DataFrame) -> DataFrame:
    """One row per distinct prefix: (i, name, conv_id, n_convs, parent, bytes)."""
    own = at.groupBy("i", "name").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    up = at.select("conv_id", (F.col("i") + 1).alias("i"), F.col("name").alias("parent"))
    last = turns.select("conv_id", F.col("depth").alias("i"), "bytes")
    return staged(own.join(up, ["conv_id", "i"], "left").join(last, ["conv_id", "i"], "left"), "nodes")


def graft(node: DataFrame, at: DataFrame, levels: int) -> DataFrame:
    """Subtree sums of ``leaf`` and ``save``: (i, name, leaf, save).

    With totals right inside tries of 2**k levels, the roots of the lower tries are summed
    by their parent, the cut prefix, and added to each node of the upper trie above it: the
    positions, in that range of depths, of any conversation that holds the cut prefix."""
    total = node.select("i", "name", "conv_id", "parent", "leaf", "save")
    for k in range(levels):
        half, bits = 1 << k, min(k, SPAN_BITS)
        cut = (total.filter(F.col("i") % (2 * half) == half).groupBy("i", "parent")
               .agg(F.sum("leaf").alias("more"), F.sum("save").alias("saved"), F.min("conv_id").alias("conv_id")))
        span = F.explode(F.sequence(F.shiftright(F.col("i") - half, bits), F.shiftright(F.col("i") - 1, bits)))
        cut = cut.select("conv_id", span.alias("span"), "more", "saved")
        above = at.filter(F.col("i") % (2 * half) < half).select(
            "conv_id", "i", "name", F.shiftright("i", bits).alias("span"))
        add = (above.join(cut, ["conv_id", "span"]).groupBy("i", "name")
               .agg(F.sum("more").alias("more"), F.sum("saved").alias("saved")))
        total = staged(total.join(add, ["i", "name"], "left").select(
            "i", "name", "conv_id", "parent", (F.col("leaf") + F.coalesce("more", F.lit(0))).alias("leaf"),
            (F.col("save") + F.coalesce("saved", F.lit(0))).alias("save")), f"totals-{k}")
    return total.select("i", "name", "leaf", "save")


def ends(at: DataFrame) -> DataFrame:
    """(i, name, ends_sha256) of nodes at which conversations end.  The sorted ids of a node
    are hashed as they stream by, so a node's list is never held."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, sha = None, None
        for b in batches:
            depth, name, ids = (b.column(c).to_pylist() for c in ("i", "name", "conv_id"))
            start = [0, *(j for j in range(1, len(ids)) if name[j] != name[j - 1] or depth[j] != depth[j - 1])]
            done = []
            for lo, hi in zip(start, [*start[1:], len(ids)], strict=True):
                if lo == hi:
                    continue
                text = ",".join(map(str, ids[lo:hi])).encode()
                if key == (depth[lo], name[lo]):
                    sha.update(b"," + text)
                else:
                    if key is not None:
                        done.append((*key, sha.hexdigest()))
                    key, sha = (depth[lo], name[lo]), hashlib.sha256(text)
            yield _digests(done)
        if key is not None:
            yield _digests([(*key, sha.hexdigest())])

    last = at.filter(F.col("i") == F.col("len")).select("i", "name", "conv_id")
    return (last.repartition("i", "name").sortWithinPartitions("i", "name", "conv_id")
            .mapInArrow(run, "i long, name binary, ends_sha256 string"))


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.array([r[0] for r in rows], np.int64)), pa.array([r[1] for r in rows], pa.binary()),
         pa.array([r[2] for r in rows], pa.string())], names=["i", "name", "ends_sha256"])


def trie(turns: DataFrame, how: Regrouping = Regrouping()) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256."""
    said, convs = rebuilt(turns, how)
    levels = int(convs.agg(F.max("len")).head()[0] or 0).bit_length()
    at = positions(convs, segments(said, levels), levels)
    node = nodes(at, said)
    kids = (node.filter(F.col("i") > 0).groupBy((F.col("i") - 1).alias("i"), F.col("parent").alias("name"))
            .agg(F.count("*").alias("n_children")))
    node = staged(node.join(kids, ["i", "name"], "left")
                  .withColumn("n_children", F.coalesce("n_children", F.lit(0)))
                  .withColumn("leaf", (F.col("n_children") == 0).cast("long"))
                  .withColumn("save", (F.col("n_convs") - 1) * F.coalesce("bytes", F.lit(0))), "node-values")
    above = node.select((F.col("i") + 1).alias("i"), F.col("name").alias("parent"),
                        F.col("conv_id").alias("parent_conv_id"))
    return (node.drop("leaf", "save").join(above, ["i", "parent"], "left")
            .join(graft(node, at, levels), ["i", "name"]).join(ends(at), ["i", "name"], "left")
            .select("conv_id", F.col("i").alias("depth"), "parent_conv_id", "n_convs", "n_children",
                    F.col("leaf").alias("n_leaves"), F.col("save").alias("saved_tokens"),
                    F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256")))
