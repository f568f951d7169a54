"""Intermediate tables in the folder the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Without that setting only a local session may go on, with a folder of its
    own: on a cluster a machine-local folder would be lost with its machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return _local_roots.setdefault(
        context.applicationId, tempfile.mkdtemp(prefix="tidewatch-")
    )


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/tidewatch/{label}-{uuid.uuid4().hex}"


def store(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it back.

    This cuts the lineage, survives lost executors, keeps column pruning and
    filter pushdown, and gives Catalyst the real size to choose joins by.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
