"""The streaming sessions agree with the batch sessionization on every closed session."""

import uuid

from pyspark.sql import functions as F

from tessera.operators import sessions as ss
from tessera.session import ensure_checkpoint_dir
from tessera.streaming.sessions import run_to_parquet
from tests.conftest import SF_SMALL


def test_stream_sessions_match_batch(spark):
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    # feed the stream as several files in time order
    ev.withColumn("_day", F.to_date("ts")).repartition("_day").sortWithinPartitions("ts") \
        .drop("_day").write.parquet(f"{base}/src")
    run_to_parquet(spark, f"{base}/src", ev.schema, f"{base}/out", f"{base}/ckpt")
    got = spark.read.parquet(f"{base}/out").select(
        "geek_id", F.unix_micros("start_time").alias("start"), "list_size", "first_job_class")
    log = ev.select(F.col("user_id").alias("geek_id"),
                    F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "event_id",
                    F.get_json_object("props", "$.k").cast("int").alias("k"))
    batch = ss.session_table(log, "geek_id", "t", 86400 * 10**6, bucket=3600 * 10**6,
                             tiebreak=["event_id"], session_cols=["k"])
    want = {(r.geek_id, r.start_time): (r.list_size, r.first_k) for r in batch.collect()}
    rows = got.collect()
    assert len(rows) > 0
    for r in rows:     # every closed session of the stream is a batch session
        assert want[(r.geek_id, r.start)] == (r.list_size, r.first_job_class)
