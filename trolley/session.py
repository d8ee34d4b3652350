"""Session construction and the shared checkpoint location."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings a job of this library wants; cluster-level values (memory, executors,
# checkpoint dir) come from the cluster's own configuration and are not overridden.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "trolley", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster this setting points at shared storage and is used as is. Only when
    it is unset (a local test session) a fresh scratch folder is created."""
    try:
        sc = spark.sparkContext
    except Exception:  # remote (Connect) session: the server owns the checkpoint dir
        return spark.conf.get("spark.checkpoint.dir", "")
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local"):
            # a machine-local folder would not survive the loss of an executor
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        conf = tempfile.mkdtemp(prefix="trolley-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def cut_lineage(df, eager: bool = True):
    """Reliable checkpoint into the shared checkpoint dir (survives executor loss)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-path of the shared checkpoint folder for intermediate tables."""
    base = checkpoint_dir(spark)
    return os.path.join(base, name) if "://" not in base else base.rstrip("/") + "/" + name


def scale_settings(input_bytes: int, total_cores: int) -> dict[str, str]:
    """Starting configuration for a cluster run over ``input_bytes`` of Parquet input.

    * scans: 256 MB splits (100 TB -> ~400k scan tasks, ~100 waves on 4000 cores);
    * shuffles: enough initial partitions for ~512 MB of pre-aggregation input each,
      at least 2 per core, at most 100k; AQE then coalesces toward 256 MB partitions and
      splits skewed ones (a key with a third of the rows) in joins;
    * broadcasts: the engine's own threshold stays modest; the library's explicit checks
      bound broadcast sides by rows.
    Values the cluster already sets (memory, executors, checkpoint dir) are not touched."""
    mb = 1024 * 1024
    shuffle = max(2 * total_cores, min(100_000, input_bytes // (512 * mb) or 1))
    return {
        "spark.sql.files.maxPartitionBytes": str(256 * mb),
        "spark.sql.shuffle.partitions": str(int(shuffle)),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * mb),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(512 * mb),
        "spark.sql.autoBroadcastJoinThreshold": str(64 * mb),
        "spark.sql.optimizer.windowGroupLimitThreshold": "1000",
    }
