"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _shared(spark: SparkSession) -> str | None:
    """spark.checkpoint.dir; None in local mode where that is unset."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir")
    if not found and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return found


def folder(spark: SparkSession) -> str:
    """A new folder in the shared one; a temporary one only in local mode where that is unset."""
    found = _shared(spark)
    return f"{found.rstrip('/')}/{uuid.uuid4().hex}" if found else tempfile.mkdtemp(prefix="spark-")


def cut(df: DataFrame) -> DataFrame:
    """df.checkpoint() in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(_shared(df.sparkSession) or tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()
