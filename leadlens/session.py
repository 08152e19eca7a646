"""Session construction and checkpoint-directory handling."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile

from pyspark.sql import SparkSession


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "leadlens") -> SparkSession:
    """Local/test session. On a cluster, use the session the platform gives you."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("LEADLENS_DRIVER_MEMORY", "16g"))
    )
    if master:
        builder = builder.master(master)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory, configuring it if needed.

    The cluster names a shared folder in ``spark.checkpoint.dir``; it is read
    from the session. Only a local-mode session (tests) may fall back to a
    fresh folder under the system temp dir.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if configured:
        sc.setCheckpointDir(configured)
        atexit.register(_remove, sc, sc._jsc.sc().getCheckpointDir().get())
        return configured
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; point it at a shared folder")
    local_dir = tempfile.mkdtemp(prefix="leadlens-ckpt-")
    sc.setCheckpointDir(local_dir)
    atexit.register(_remove, sc, sc._jsc.sc().getCheckpointDir().get())
    return local_dir


def _remove(sc, folder: str) -> None:
    """Delete this application's own folder under the checkpoint directory when it ends."""
    with contextlib.suppress(Exception):   # the JVM may be gone by then
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jvm.org.apache.hadoop.conf.Configuration()).delete(path, True)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A sub-folder of the checkpoint directory for written intermediate tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"
