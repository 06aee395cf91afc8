"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

from corpuslens.errors import ConfigurationError


def get_session(cores: str | int = "*", shuffle_partitions: int = 8, app: str = "corpuslens") -> SparkSession:
    """Local session for tests and benchmarks; clusters bring their own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """Folder named by spark.checkpoint.dir; where the setting is absent, a local master gets a folder and a cluster an error."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    jvm_dir = context._jsc.sc().getCheckpointDir()
    if jvm_dir.isDefined():
        return jvm_dir.get().rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ConfigurationError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = "file://" + os.path.realpath(tempfile.mkdtemp(prefix="corpuslens-"))
    context.setCheckpointDir(made)
    return made
