"""Spark session defaults and the shared checkpoint folder.

On a cluster the session is created by the platform; we only read its
settings.  ``spark.checkpoint.dir`` names the shared folder for lineage cuts;
we set our own only where it is unset (local runs and tests).
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings we rely on; each is only applied when the caller builds the session.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "12g",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "tillroll", extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder, creating a local one only if unset."""
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return sc.getCheckpointDir() or current
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("spark.checkpoint.dir is not set: name a folder that the driver and all executors share")
    # Unset in a local session: driver and executors share this machine; take a fresh private folder.
    base = os.environ.get("TILLROLL_LOCAL_CKPT") or tempfile.mkdtemp(prefix="tillroll-ckpt-")
    spark.conf.set("spark.checkpoint.dir", base)
    sc.setCheckpointDir(base)
    return sc.getCheckpointDir() or base


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written intermediate tables."""
    root = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{root}/{name}"


def cut_lineage(df, name: str = "cut"):
    """Write ``df`` as a parquet table in the shared checkpoint folder and
    return a frame that reads it back.

    Used where one intermediate result (the cleaned fact, small per-group
    tables) feeds several outputs, so the plan does not repeat its lineage.
    A written table survives executor loss like ``checkpoint()``, but it is
    columnar and compressed, and later reads get column pruning and filter
    pushdown.  Each call writes a fresh folder; ``drop_written`` removes them
    once no frame that reads them is needed any more.
    """
    import uuid

    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.mode("errorifexists").parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.parquet(path)


#: Folders written by ``cut_lineage``, by application.
_written: dict[str, list[str]] = {}


def drop_written(spark: SparkSession) -> int:
    """Remove the folders that ``cut_lineage`` has written in this application; how many there were.

    For the end of a job, when its results are stored elsewhere: frames that
    read the folders can't be used afterwards.
    """
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)


def cluster_conf(input_bytes: int, executors: int, cores_per_executor: int = 4,
                 target_partition_mb: int = 256) -> dict[str, str]:
    """Starting settings for a large cluster, sized from the input volume.

    Scan splits and post-shuffle partitions aim at ``target_partition_mb``;
    the initial shuffle partition count covers the input at that size (AQE
    then coalesces the many small post-aggregation partitions); skewed
    partitions above 3x the median and 512 MB are split by AQE.  The
    platform's own settings win: apply these only where unset.
    """
    import math

    size = target_partition_mb << 20
    parts = max(executors * cores_per_executor * 2, math.ceil(input_bytes / size))
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": f"{target_partition_mb}m",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "3",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
        "spark.sql.files.maxPartitionBytes": f"{target_partition_mb}m",
        "spark.sql.shuffle.partitions": str(parts),
    }
