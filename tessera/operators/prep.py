"""Preparation operators of the profile steps.

All are thin, declarative DataFrame expressions so that Catalyst can push the filters
into the Parquet scan (date ranges map to row-group statistics) and prune columns.
"""

from __future__ import annotations

from typing import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.codes import NULL_STRING


def calendar(spark: SparkSession, start: str | Column, end: str | Column,
             test_days: int) -> DataFrame:
    """Every day from start to end inclusive, the last ``test_days`` = 'test'."""
    s = F.to_date(F.lit(start)) if isinstance(start, str) else start
    e = F.to_date(F.lit(end)) if isinstance(end, str) else end
    days = spark.range(1).select(F.explode(F.sequence(s, e, F.expr("interval 1 day"))).alias("date"))
    return split_by_cutoff(days, "date", e, test_days)


def split_by_cutoff(df: DataFrame, date_col: str, end: Column, test_days: int) -> DataFrame:
    """P2: 'test' for dates after ``end - test_days``, else 'train' (a range predicate
    that prunes by file statistics, unlike a 155-value IN list)."""
    cut = F.date_sub(end, test_days)
    return df.withColumn("split", F.when(F.col(date_col) > cut, F.lit("test")).otherwise(F.lit("train")))


def split_days_by_cutoff(df: DataFrame, dates_col: str, end: Column, test_days: int) -> DataFrame:
    """P2 for rows with a list of dates: a row for each split that has any, with its dates."""
    late = F.filter(dates_col, lambda d: d > F.col("_cut"))
    rest = F.filter(dates_col, lambda d: ~F.coalesce(d > F.col("_cut"), F.lit(False)))
    # the end may be a subquery, which cannot sit inside a lambda
    parts = F.array(F.struct(F.lit("train").alias("split"), rest.alias("days")),
                    F.struct(F.lit("test").alias("split"), late.alias("days")))
    out = df.withColumn("_cut", F.date_sub(end, test_days)).withColumn("_part", F.explode(parts))
    return (out.withColumn("split", F.col("_part.split")).withColumn(dates_col, F.col("_part.days"))
            .drop("_cut", "_part").filter(F.size(dates_col) > 0))


def days_of(log: DataFrame, date_col: str, days: DataFrame) -> DataFrame:
    """The rows of a log on the listed ``days``.  Where the log is partitioned by date,
    the list prunes the folders that are scanned (a calendar has one row a day, so it is
    broadcast by its size)."""
    return log.join(days.select(F.col("date").alias(date_col)).distinct(), date_col, "left_semi")


def date_range_filter(df: DataFrame, date_col: str, start, end) -> DataFrame:
    """Rows whose date lies in [start, end]."""
    return df.filter(F.col(date_col).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def string_code_range(df: DataFrame, col: str, lo: str, hi: str) -> DataFrame:
    """Half-open range on a string column, compared lexicographically."""
    c = F.col(col).cast("string")
    return df.filter((c >= F.lit(lo)) & (c < F.lit(hi)))


def cast_project(df: DataFrame, spec: Iterable[tuple[str, str, str]]) -> DataFrame:
    """``(source, alias, type)`` projection with ``try_cast`` (null when a value does
    not parse; ANSI mode would raise on ``cast``)."""
    return df.select([F.col(src).try_cast(t).alias(alias) for src, alias, t in spec])


def fill_nulls(df: DataFrame, named: dict | None = None, number: float = 0,
               string: str = NULL_STRING) -> DataFrame:
    """Named columns first, then every numeric column, then every string column."""
    out = df.fillna(named) if named else df
    return out.fillna(number).fillna(string)


def drop_null_rows(df: DataFrame) -> DataFrame:
    """Drop rows with a null in any column."""
    return df.dropna(how="any")


def null_to_zero(c: Column) -> Column:
    """``when(isnull(c), 0).otherwise(c)``."""
    return F.when(F.isnull(c), F.lit(0)).otherwise(c)


def dense_class_counts(spark: SparkSession, rows: DataFrame, class_col: str, k: int,
                       out_col: str = "cnt") -> DataFrame:
    """A5: rows per class over every class id 0..k-1, zeros kept.  The class range is a
    generated table; the counts are aggregated before the (k-row) join."""
    counts = rows.groupBy(class_col).agg(F.count(F.lit(1)).alias(out_col))
    ids = spark.range(k).select(F.col("id").cast("int").alias(class_col))
    return (ids.join(counts, class_col, "left")
            .select(class_col, F.coalesce(F.col(out_col), F.lit(0)).cast("long").alias(out_col)))


def best_so_far(df: DataFrame, value: str, order: list[str], part: list[str],
                out: str = "best", bucket: Column | None = None) -> DataFrame:
    """Running maximum of ``value`` in ``order`` inside each ``part`` group.

    With ``bucket`` (non-decreasing in ``order``, e.g. the day of a timestamp) the
    running max is two-level: the maximum of all earlier buckets (a window over the
    small per-bucket table) combined with the running max inside the bucket, so a large
    group is not one window task."""
    if bucket is None:
        w = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(out, F.max(value).over(w))
    x = df.withColumn("_bk", bucket)
    per = x.groupBy(*part, "_bk").agg(F.max(value).alias("_m"))
    wc = Window.partitionBy(*part).orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    carry = per.select(*part, "_bk", F.max("_m").over(wc).alias("_carry"))
    wb = Window.partitionBy(*part, "_bk").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (x.join(carry, [*part, "_bk"])
            .withColumn(out, F.greatest(F.max(value).over(wb), F.col("_carry")))
            .drop("_bk", "_carry"))


def distinct_values(df: DataFrame, col: str) -> DataFrame:
    """A4: distinct values of one column."""
    return df.select(col).distinct()


def label_with_classes(log: DataFrame, person: DataFrame, job: DataFrame,
                       person_keys: list[str], job_keys: list[str],
                       dedupe: bool = False) -> DataFrame:
    """Label every log row with its person class and job class.

    The reference writes two left joins, each followed by a not-null filter; that is an
    inner join, and Catalyst plans it as one.  Snapshots are not deduplicated by
    default, so repeated snapshot rows multiply log rows as in the reference (D6);
    ``dedupe=True`` keeps one snapshot row per key first."""
    if dedupe:
        person = person.dropDuplicates(person_keys)
        job = job.dropDuplicates(job_keys)
    return log.join(person, person_keys, "inner").join(job, job_keys, "inner")
