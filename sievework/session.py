"""One place for the session settings that the bench and the tests share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, driver_memory: str = "8g") -> SparkSession:
    """A session for one machine. A cluster job brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("sievework")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", driver_memory))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def scratch_folder(spark: SparkSession, what: str) -> str:
    """A path that no other run uses, in the folder that driver and executors share: spark.checkpoint.dir, or, where that is
    unset, a local one, which only a session on one machine may use."""
    if shared := spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return f"{shared.rstrip('/')}/{what}-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is needed on a cluster")
    return f"{tempfile.mkdtemp(prefix='spark-')}/{what}"
