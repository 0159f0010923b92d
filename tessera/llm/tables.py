"""Helpers shared by the operators: staged tables, distributed ranks, column guards."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.session import ensure_checkpoint_dir


def batches_by_bytes(spark: SparkSession, size: int = 4 << 20) -> None:
    """Bound the record batches between Spark and its Python workers by their bytes, not by
    rows alone: ten thousand documents are too many for one buffer."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet under the shared checkpoint folder and read it back:
    lineage is cut, a lost executor costs no recomputation, and the copy is compressed."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def rank_within(df: DataFrame, keys: list[str], order: list[str | Column], out: str,
                cell: Column, seed: int = 0) -> DataFrame:
    """Add ``out``, the gapless 0-based rank of a row among rows of equal ``keys``.

    Rows are ordered by ``cell`` (an int that splits every key into bounded cells, e.g.
    the top bits of a hash) and then by ``order``.  Only a cell is ever sorted in one
    task; the offsets of the cells come from a table of counts, so a key with a third of
    all rows is ranked by many tasks.  Null keys form a group of their own."""
    names = [f"__k{i}" for i in range(len(keys))]
    df = df.withColumn("__cell", cell)
    counts = (df.groupBy(*keys, "__cell").agg(F.count("*").alias("__n"))
              .withColumn("__off", F.sum("__n").over(
                  Window.partitionBy(*keys).orderBy("__cell")) - F.col("__n"))
              .select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)],
                      F.col("__cell").alias("__c"), "__off"))
    local = df.withColumn("__rn", F.row_number().over(
        Window.partitionBy(*keys, "__cell").orderBy(*order)))
    cond = F.col("__cell") == F.col("__c")
    for k, n in zip(keys, names, strict=True):
        cond = cond & F.col(k).eqNullSafe(F.col(n))
    return (local.join(counts, cond).withColumn(out, F.col("__off") + F.col("__rn") - 1)
            .drop("__cell", "__c", "__off", "__rn", *names))


def range_cells(df: DataFrame, order: list[str | Column], name: str,
                cut: list[str | Column] | None = None, drop: tuple[str, ...] = ()) -> DataFrame:
    """``df`` written in the given order, with ``__pid`` (its range) and ``__seq`` (its place
    there).  Ranges are cut by sampled rows, so a hot prefix of ``order`` spans several.
    ``cut`` (short columns in an order that ``order`` refines) spares the driver the sampled
    values of long columns; ``drop`` columns serve the order only."""
    place = F.monotonically_increasing_id()
    out = (df.repartitionByRange(*(cut or order)).sortWithinPartitions(*order).withColumn("__place", place)
           .withColumn("__pid", F.shiftright("__place", 33))
           .withColumn("__seq", F.col("__place").bitwiseAND((1 << 33) - 1)).drop("__place", *drop))
    return staged(out, name)


def numbered(df: DataFrame, order: list[str | Column], out: str) -> DataFrame:
    """Add ``out``, the gapless 0-based place of a row in the order of the whole table: a
    sort by ranges and the counts of the ranges, one row each."""
    s = range_cells(df, order, "numbered")
    off = (s.groupBy("__pid").agg(F.count("*").alias("__n"))
           .select(F.col("__pid").alias("__p"), (F.sum("__n").over(Window.orderBy("__pid")) - F.col("__n")).alias("__off")))
    return (s.join(off, F.col("__pid") == F.col("__p")).withColumn(out, F.col("__off") + F.col("__seq"))
            .drop("__pid", "__seq", "__p", "__off"))
