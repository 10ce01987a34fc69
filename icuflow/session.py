"""The session that scripts and tests use; a cluster's own settings stay as they are."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(cores: int | str = "*", shuffle_partitions: int = 8, driver_memory: str = "4g") -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("icuflow")
        .config("spark.driver.memory", driver_memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
