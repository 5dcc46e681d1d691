"""Spark session and checkpoint-directory helpers."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

# Settings every job relies on.  AQE re-plans joins from runtime sizes (a
# broadcast is only chosen when the measured side is under the threshold) and
# splits skewed shuffle partitions; times are epoch-millisecond longs and
# calendar days are UTC.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.session.timeZone": "UTC",
    # loop rounds checkpoint into spark.checkpoint.dir; delete those files
    # once nothing references the checkpointed data any more
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(
    app_name: str = "depuse",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    conf: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or reuse) a session with the settings above.

    ``master`` and ``shuffle_partitions`` are left to the cluster when None.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = dict(DEFAULT_CONF)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    settings.update(conf or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    try:
        spark.sparkContext.setLogLevel("WARN")
    except Exception:  # noqa: BLE001 - Spark Connect sessions have no SparkContext
        pass
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory, setting it up if needed.

    The cluster names a shared folder in ``spark.checkpoint.dir``; that is
    used as is.  Only a local-mode session without one (tests, a laptop) gets
    a private temporary folder.  On a cluster without the setting this raises:
    a machine-local folder would not survive the loss of an executor.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: the server owns the setting
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if not configured:
            raise RuntimeError("spark.checkpoint.dir is not set on the Spark Connect server") from None
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir() or configured
    if sc.master.startswith("local"):
        folder = tempfile.mkdtemp(prefix="depuse-checkpoint-")
        sc.setCheckpointDir(folder)
        return sc.getCheckpointDir() or folder
    raise RuntimeError(
        "spark.checkpoint.dir is not set: point it at a shared folder "
        "(HDFS, object store) so iterative jobs can cut their lineage"
    )


# Target bytes per shuffle partition on a cluster: large enough to keep task
# counts and per-task overheads down, small enough to sort and aggregate in
# executor memory without heavy spilling.
TARGET_PARTITION_BYTES = 256 * 1024 * 1024


def cluster_conf(shuffle_input_bytes: int, cores: int, target_bytes: int = TARGET_PARTITION_BYTES) -> dict[str, str]:
    """Suggested sizing for a run whose largest shuffle moves about
    ``shuffle_input_bytes`` on ``cores`` executor cores.

    The initial partition count is chosen so each partition is about
    ``target_bytes`` (and at least two waves of tasks); AQE then merges small
    partitions towards the same advisory size and splits skewed ones.
    """
    partitions = max(2 * cores, -(-shuffle_input_bytes // target_bytes))
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_bytes),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(target_bytes * 2),
        "spark.sql.files.maxPartitionBytes": str(min(target_bytes, 512 * 1024 * 1024)),
    }
