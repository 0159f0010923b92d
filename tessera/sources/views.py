"""Role views of the synthetic test tables (FIXTURES.md "Role mapping").

The interaction log of the workflow is the ``events`` table: user = person, the
``k`` of ``props`` = item (job) class, the user id modulo ``k_person`` = person class.
Times are kept as epoch microseconds (``unix_micros``) so that windows order on a long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.params import TESTDATA_PARAMS, Params


def epoch_micros(ts_ntz):
    """Microseconds since 1970-01-01 of a zone-less timestamp, read as UTC wall time.

    Computed on the ``timestamp_ntz`` value itself, so the result does not depend on
    the session time zone (a cast to ``timestamp`` would)."""
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", epoch, ts_ntz)


class TestData:
    __test__ = False  # not a pytest class

    def __init__(self, spark: SparkSession, sf_dir: str, params: Params = TESTDATA_PARAMS):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self.params = params

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def log(self) -> DataFrame:
        """Interaction log: geek_id, job_class, deal_type, t_us, date, person_class, event_id."""
        ev = self.table("events")
        return ev.select(
            F.col("user_id").alias("geek_id"),
            F.get_json_object("props", "$.k").cast("int").alias("job_class"),
            F.col("event_type").alias("deal_type"),
            epoch_micros(F.col("ts")).alias("t_us"),
            F.to_date(F.col("ts")).alias("date"),
            F.pmod(F.col("user_id"), F.lit(self.params.k_person)).cast("int").alias("person_class"),
            F.col("event_id"),
        )

    def order_log(self) -> DataFrame:
        """Log for the snapshot joins: lineitem joined to its order."""
        li = self.table("lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
        od = self.table("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        return li.join(od, li.l_orderkey == od.o_orderkey).select(
            F.col("o_custkey").alias("geek_id"),
            F.col("l_partkey").alias("job_id"),
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("line_no"),
            F.to_date("o_orderdate").alias("ds"),
        )
