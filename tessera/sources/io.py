"""Scans and sinks.

Everything goes through Spark's Parquet/CSV data sources so that the scans get column
pruning, predicate pushdown and partition discovery; nothing is read on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet file or directory of part files, schema from the footers."""
    return spark.read.parquet(path)


def read_pruned(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """Scan only the named columns, renamed ``{source: alias}`` (pruned in the scan)."""
    return spark.read.parquet(path).select([F.col(c).alias(a) for c, a in columns.items()])


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S3: Parquet sink."""
    df.write.mode(mode).parquet(path)


def write_partitioned(df: DataFrame, path: str, by: list[str] | str,
                      mode: str = "overwrite", salt: int = 16) -> None:
    """Parquet sink partitioned by columns (e.g. the cluster id).

    Rows are clustered by the partition columns and a hash of the others, so that a value
    goes to at most ``salt`` tasks (and files) instead of one file per task, and a value
    with a third of all rows is not written by one task.
    """
    by = [by] if isinstance(by, str) else list(by)
    # maps have no hash
    rest = [F.col(f.name) for f in df.schema.fields if f.name not in by and not isinstance(f.dataType, T.MapType)]
    part = F.pmod(F.xxhash64(*rest), F.lit(salt)) if rest else F.lit(0)
    (df.repartition(*[F.col(c) for c in by], part)
     .write.mode(mode).partitionBy(*by).parquet(path))


RELATION_SCHEMA = T.StructType([
    T.StructField("id", T.IntegerType()),
    T.StructField("pred_job", T.IntegerType()),
    T.StructField("unix_time", T.LongType()),
    T.StructField("date", T.DateType()),
    T.StructField("job_id", T.LongType()),
    T.StructField("geek_id", T.LongType()),
])


def write_relations(relations: DataFrame, path: str, mode: str = "overwrite",
                    buckets: int = 64) -> None:
    """The relation table as CSV with headers, in ``buckets`` folders to a class.

    ``relations`` is the long table of ``operators.sessions.relation_table``.  A session's
    ordinal is a column, and its residue modulo ``buckets`` the second folder level, so the
    number of folders does not grow with the sessions.  Rows are spread by ranges of (class,
    bucket, session, id): a class with a third of all rows goes to many tasks, and a file
    holds few folders' rows, sorted by session.
    """
    cols = ["person_class", "session_bucket", "session_no"] + RELATION_SCHEMA.fieldNames()
    keys = ["person_class", "session_bucket", "session_no", "id"]
    (relations.withColumn("session_bucket", F.pmod("session_no", F.lit(buckets)).cast("int"))
     .select(*cols).repartitionByRange(*keys).sortWithinPartitions(*keys)
     .write.mode(mode).partitionBy("person_class", "session_bucket")
     .option("header", True).csv(path))


def read_relations(spark: SparkSession, path: str, person_class: int | None = None,
                   session_no: int | None = None, buckets: int = 64) -> DataFrame:
    """Relation scan with a fixed schema; the class comes from the folders.

    A given class or session reads the folders that can hold it only; ``buckets`` is that
    of the store."""
    schema = T.StructType([T.StructField("session_no", T.IntegerType())] + RELATION_SCHEMA.fields + [
        T.StructField("person_class", T.IntegerType()),
        T.StructField("session_bucket", T.IntegerType()),
    ])
    df = spark.read.schema(schema).option("header", True).csv(path)
    if person_class is not None:
        df = df.filter(F.col("person_class") == person_class)
    if session_no is not None:
        df = df.filter((F.col("session_bucket") == session_no % buckets)
                       & (F.col("session_no") == session_no))
    return df.drop("session_bucket")


def save_model(model, path: str) -> None:
    """Persist a fitted Spark ML model (overwrite)."""
    model.write().overwrite().save(path)


def load_model(cls, path: str):
    """Load a fitted model of class ``cls`` (e.g. ``KMeansModel``)."""
    return cls.load(path)


def profile(df: DataFrame) -> DataFrame:
    """One row with the row count and the distinct row count of a stage.

    One aggregate job instead of ``count()`` plus ``distinct().count()``.
    """
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.count_distinct(F.struct(*[F.col(c) for c in df.columns])).alias("n_distinct"))
