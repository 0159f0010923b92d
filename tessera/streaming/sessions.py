"""Gap sessions of an event stream (the W5 operator as a Structured Streaming job).

``session_window(ts, gap)`` groups events of one user whose gaps do not exceed ``gap``
(events exactly ``gap`` apart stay together, the strict ``>`` of the batch operator).  In
append mode a session is written once the watermark has passed its end, so every
emitted row is final; state for open sessions is kept by Spark's state store and the
checkpoint makes the query restartable after a failure.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def session_stream(events: DataFrame, user: str = "user_id", ts: str = "ts",
                   gap: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Streaming DataFrame of closed sessions: user, start/end time, size, first item."""
    t = F.col(ts).cast("timestamp")
    ev = events.withColumn("_t", t).withWatermark("_t", delay)
    return (ev.groupBy(F.col(user).alias("geek_id"), F.session_window("_t", gap).alias("w"))
            .agg(F.count(F.lit(1)).cast("int").alias("list_size"),
                 F.min("_t").alias("start_time"), F.max("_t").alias("end_time"),
                 F.min_by(F.get_json_object("props", "$.k").cast("int"),
                          F.struct("_t", "event_id")).alias("first_job_class")))


def run_to_parquet(spark: SparkSession, source: str, schema: T.StructType, out: str,
                   checkpoint: str, gap: str = "1 day", delay: str = "1 day"):
    """Process everything available in ``source`` (a folder of Parquet files) and append
    the closed sessions to ``out``; returns the finished query."""
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = (session_stream(events, gap=gap, delay=delay).drop("w")
         .writeStream.outputMode("append").format("parquet")
         .option("path", out).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q
