"""Session construction and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every session of the toolkit should carry.  AQE is what turns the
# declarative plans into skew-aware, right-sized physical plans at runtime:
# it coalesces small shuffle partitions, splits skewed join partitions and
# rebalances skewed REBALANCE partitions before a write.
BASE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "lakeward") -> SparkSession:
    """Local session for tests and the bench (one JVM, `cores` task threads)."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = os.environ.get("LAKEWARD_DRIVER_MEMORY", "8g")
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def cluster_conf(input_bytes: int, executor_cores_total: int, target_partition_bytes: int = 256 << 20) -> dict:
    """Starting point for a cluster session sized to the input.

    Shuffle partitions start at about one per ``target_partition_bytes`` of
    input (and at least 2x the total cores) so that no shuffle partition has
    to spill heavily at the start; AQE then coalesces them to the advisory
    size and splits skewed ones.  Scans split files at 256 MiB."""
    parts = max(2 * executor_cores_total, -(-int(input_bytes) // target_partition_bytes))
    return {
        **{k: v for k, v in BASE_CONF.items() if k != "spark.ui.enabled"},
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(128 << 20),
        "spark.sql.files.maxPartitionBytes": str(256 << 20),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 << 20),
    }


def apply_runtime_conf(spark: SparkSession) -> None:
    """Apply the runtime-settable part of BASE_CONF to an existing session."""
    for k, v in BASE_CONF.items():
        if k.startswith("spark.sql."):
            try:
                spark.conf.set(k, v)
            except Exception:  # some deployments pin these; keep theirs
                pass


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster this must already be set to storage every executor sees.
    A cluster session without it is refused: a folder on the driver alone
    would lose what executors write.  Only in local mode is a fresh scratch folder created and
    registered, so checkpoints and written tables land somewhere durable for
    the life of the session.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir()
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name storage that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="lakeward-ckpt-")
        try:
            spark.conf.set("spark.checkpoint.dir", d)
        except Exception:  # some sessions refuse core settings at runtime
            pass
        spark.sparkContext.setCheckpointDir(d)
    elif spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique sub-folder of the shared folder for one written table."""
    base = shared_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df, name: str = "stage"):
    """Write ``df`` once as parquet under the shared folder and read it back.

    Used where one intermediate result feeds two branches of a plan (Spark
    would otherwise compute it twice) and to cut long lineages: the written
    table is durable, so a lost executor costs a re-read, not a recompute of
    everything upstream."""
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
