"""Shared inputs of the registered queries (Spark side)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import hypergraph as hg
from tessera.operators import sessions as ss
from tessera.params import TESTDATA_PARAMS as P
from tessera.sources.views import TestData

GAP_US = int(P.gap_days * 86400 * 1_000_000)
BUCKET_US = int(P.bucket_seconds * 1_000_000)


def td(spark: SparkSession, sf_dir: str) -> TestData:
    return TestData(spark, sf_dir, P)


def sessions_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessionized events (long table), one-day gap, tie broken by event_id."""
    return ss.sessionize(td(spark, sf_dir).log(), "geek_id", "t_us", GAP_US,
                         bucket=BUCKET_US, tiebreak=["event_id"],
                         session_cols=["person_class"])


def class_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """View-1 adjacency of every person class over all its sessions."""
    inc = hg.session_incidence(sessions_long(spark, sf_dir), "first_person_class",
                               ["geek_id", "session_no"], "job_class")
    return hg.adjacency(inc)


def r6(c):
    """Round to 6 digits after a 1e-9 nudge (see ``registry.tie_safe_sql``)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c + F.lit(1e-9), 6)
