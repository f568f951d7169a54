"""Session settings the jobs are designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session with adaptive execution.

    On a cluster leave ``shuffle_partitions`` unset and start with many small
    partitions (``spark.sql.adaptive.coalescePartitions.initialPartitionNum``);
    adaptive execution joins small ones and splits skewed ones.
    """
    builder = (
        SparkSession.builder.appName("tidewatch")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master).config("spark.driver.memory", "8g")
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return builder.getOrCreate()
