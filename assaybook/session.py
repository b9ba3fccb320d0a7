"""Session construction (bench/tests only) and the shared work folder.

Library code never changes the confs of a session it is handed. It reads
``spark.checkpoint.dir`` to find the shared folder for materialised tables;
only a local-mode session that names none gets a folder of its own.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "assaybook", event_log_dir: str | None = None,
                  advisory_partition_size: str = "8m") -> SparkSession:
    """A local session tuned for the test/bench machine (a few cores, small
    data): AQE aims at 8 MB partitions so small outputs still use every core.
    A cluster sets its own (see README, suggested confs)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", advisory_partition_size)
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if event_log_dir:
        builder = (builder.config("spark.eventLog.enabled", "true")
                   .config("spark.eventLog.dir", event_log_dir))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def work_dir(spark: SparkSession) -> str:
    """Shared folder for materialised tables.

    Uses the folder the cluster names in ``spark.checkpoint.dir`` (or a
    checkpoint dir already set on the context). Only a local-mode session
    without one gets a private folder, as in tests.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if d:
        return d.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError(
            "spark.checkpoint.dir must name a shared folder on a cluster")
    d = tempfile.mkdtemp(prefix="assaybook-ckpt-")
    sc.setCheckpointDir(d)
    return (sc.getCheckpointDir() or d).rstrip("/")
