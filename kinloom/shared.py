"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(8)
def _local_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="kinloom-shared-")


def shared_folder(spark: SparkSession) -> str:
    """The session's `spark.checkpoint.dir`.

    Where that is unset, a local session (driver and executors are one process)
    gets a temporary folder; on a cluster it is an error.
    """
    sc = spark.sparkContext
    if where := sc.getConf().get("spark.checkpoint.dir"):
        return where.rstrip("/")
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _local_folder(sc.applicationId)


def cut(df: DataFrame) -> DataFrame:
    """Writes `df` to the shared folder and cuts its lineage."""
    ready(df.sparkSession)
    return df.checkpoint(eager=True)


def ready(spark: SparkSession) -> None:
    """Names the checkpoint folder to the context, if nobody has."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
