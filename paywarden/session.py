"""Session settings and the shared working folder."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid

from pyspark.sql import SparkSession

WORK_DIR_KEY = "spark.checkpoint.dir"


@functools.cache
def _local_base() -> str:
    return tempfile.mkdtemp(prefix="paywarden-")


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the local bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("paywarden")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("PAYWARDEN_DRIVER_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def work_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for one written table or stream, below the cluster's shared folder.

    The cluster names that folder in ``spark.checkpoint.dir``. Only a local master, which has no
    other machines to share with, may fall back to a temporary folder.
    """
    base = spark.conf.get(WORK_DIR_KEY, None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise RuntimeError(f"set {WORK_DIR_KEY} to a folder every executor can reach")
        base = _local_base()
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
