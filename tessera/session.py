"""SparkSession helpers: a session for tests/bench and a shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int = 8,
              app: str = "tessera") -> SparkSession:
    """Build (or reuse) a session with AQE on, UTC time and the UI off.

    On a cluster the caller owns the session; this is for tests, bench and smoke runs.
    """
    builder = (
        SparkSession.builder.master(master or os.environ.get("TESSERA_MASTER", "local[*]"))
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled",
                os.environ.get("TESSERA_AQE_COALESCE", "true"))
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # joins that expand small inputs (per-sample copies of class rows) are CPU-bound:
        # do not let AQE merge their tiny input shuffles into one or two tasks
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize",
                os.environ.get("TESSERA_MIN_PARTITION", "256k"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TESSERA_DRIVER_MEMORY", "16g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster names a shared folder there; only when it is unset (local tests) do we
    create one of our own under the system temp folder; off a local master it must be set.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not configured:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="tessera-ckpt-")
    sc.setCheckpointDir(configured)
    return configured


def materialize(df, eager: bool = True):
    """Cut the lineage of a table that several branches of a plan read.

    A reliable ``checkpoint`` writes the rows once to the shared folder of
    ``spark.checkpoint.dir``, so later stages read them back instead of recomputing the
    whole upstream plan, and a lost executor does not force a recompute either.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def batches_by_bytes(spark: SparkSession, size: int = 8 << 20) -> None:
    """Bound the record batches between Spark and its Python workers by bytes: ten thousand
    rows of matrix blocks are too many for one buffer.  A lower bound of the session stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key, None)
    if now is None or not now.isdigit() or int(now) > size:
        spark.conf.set(key, str(size))
