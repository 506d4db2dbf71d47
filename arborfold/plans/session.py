"""Local sessions for tests and benchmarks; a cluster brings its own."""

from __future__ import annotations

import atexit
import os
import tempfile

from pyspark.sql import SparkSession


def local_session(cores: int = 8, memory: str = "16g", partitions: int = 8) -> SparkSession:
    """A local session with the settings that every query expects (UTC, adaptive plans)."""
    shared = os.environ.get("ARBORFOLD_CHECKPOINTS")
    if not shared:
        own = tempfile.TemporaryDirectory(prefix="arborfold-", ignore_cleanup_errors=True)
        atexit.register(own.cleanup)
        shared = own.name
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("arborfold")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.checkpoint.dir", shared)
        .getOrCreate()
    )
