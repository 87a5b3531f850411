"""SparkSession construction and the shared checkpoint folder.

On a cluster the session comes from the launcher and already names
``spark.checkpoint.dir`` (a shared folder).  We only ever *read* that setting;
a folder of our own is chosen only when it is unset, as in tests and local runs.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # 128 MB input splits keep one task's scan well inside executor memory; AQE
    # coalesces or splits shuffle partitions toward the same size, so the static
    # shuffle.partitions only needs to be an upper bound.
    "spark.sql.files.maxPartitionBytes": str(128 * 1024 * 1024),
}

# Runtime SQL settings applied to any session we are handed.
RUNTIME_SQL_CONF = {
    # The JVM does not JIT methods above 8 KB of bytecode; wide feature
    # projections (36-160 columns) would then run interpreted (measured 18x
    # slower).  Above this size Spark falls back to split, JIT-able functions.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 * 1024 * 1024),
    # Streaming state (windows, dedup, stream-stream join, EMA state) in RocksDB:
    # off the JVM heap, checkpointed incrementally.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "motorsight", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in {**DEFAULT_CONF, **RUNTIME_SQL_CONF}.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def tune_session(spark: SparkSession) -> None:
    """Apply the runtime SQL settings and make sure a checkpoint folder is known."""
    for k, v in RUNTIME_SQL_CONF.items():
        spark.conf.set(k, v)
    ensure_checkpoint_dir(spark)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder, setting a local one only if unset."""
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if conf_dir:
        if current is None:
            sc.setCheckpointDir(conf_dir)
        return conf_dir
    if current is not None:
        return current
    # Unset: tests and local runs only; on a cluster each machine would write to its own disk.
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("spark.checkpoint.dir names no shared folder")
    local = tempfile.mkdtemp(prefix="motorsight-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    spark.conf.set("spark.checkpoint.dir", local)
    sc.setCheckpointDir(local)
    return local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A folder under the shared checkpoint folder for written intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"
