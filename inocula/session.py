"""SparkSession construction and the shared checkpoint folder.

On a cluster the session is created by the platform; the library only reads
its settings.  ``build_session`` exists for tests, the bench and local runs.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

# Settings every plan in this package is designed around.  AQE re-plans joins
# at runtime from measured shuffle sizes (broadcast conversion, skew split of
# hot keys, partition coalescing), so no plan hard-codes a join strategy.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # size partitions by the advisory size, not by core count (fewer tiny tasks)
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "4",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64m",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64m",
    "spark.sql.session.timeZone": "UTC",
    # A broadcast hash relation takes at least one memory page.  The default
    # page (up to 64 MB) makes every small broadcast cost 64 MB of driver
    # heap; reports and audits issue dozens of them concurrently.  8 MB pages
    # bound that and are still large for executor sorts and aggregations.
    "spark.buffer.pageSize": "8m",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def cluster_conf(
    input_bytes: int, executors: int, cores_per_executor: int = 4, max_partitions: int = 200_000
) -> dict[str, str]:
    """Settings for a cluster run over ``input_bytes`` of Parquet.

    Shuffles start with one partition per 512 MB of input (at least three per
    core, at most ``max_partitions``, a tuning bound: map tasks x reducers is the number of shuffle blocks
    the driver tracks, so ~400k scan tasks must not meet ~800k reducers) and
    AQE coalesces them to 256 MB or splits partitions over 1 GB that are 4x
    the median.  Scans read up to 256 MB per task.  The checkpoint folder is
    the cluster's shared one and is not set here.
    """
    mb = 1024 * 1024
    cores = executors * cores_per_executor
    partitions = max(3 * cores, min(input_bytes // (512 * mb), max_partitions))
    return {
        **DEFAULT_CONF,
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(partitions),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(256 * mb),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(1024 * mb),
        # split a hot key's partition even when that costs an extra shuffle
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.files.maxPartitionBytes": str(256 * mb),
        "spark.sql.autoBroadcastJoinThreshold": str(64 * mb),
        "spark.sql.adaptive.autoBroadcastJoinThreshold": str(64 * mb),
        "spark.sql.parquet.filterPushdown": "true",
        "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    }


def build_session(
    app: str = "inocula",
    cpus: int | str = "*",
    shuffle_partitions: int = 8,
    driver_memory: str = "16g",
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Local session for tests/bench; settings mirror what a cluster job sets."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for k, v in {**DEFAULT_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str | None:
    """Return the shared checkpoint folder, setting one only when none is set.

    A cluster names its shared folder in ``spark.checkpoint.dir``; that value
    wins.  Only a local-mode session (tests, bench) with none set gets a
    private scratch folder; a cluster session without one is an error, since
    a machine-local folder would not survive the loss of that machine.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # a Spark Connect session: the server owns the folder
        return spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (HDFS/object store)")
        conf_dir = tempfile.mkdtemp(prefix="inocula-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir
