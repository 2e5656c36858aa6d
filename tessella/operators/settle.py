"""Cuts lineage in iterations."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; without it, a folder of our own if all of Spark runs in this process, else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="tessella-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def settle(df: DataFrame) -> DataFrame:
    """df written to the shared folder that the cluster names, and read again.

    A checkpoint would also cut lineage, but hands the size estimates of its
    plan on: joined round by round they grow to numbers of thousands of
    digits.  A written table has those of its files.
    """
    path = f"{shared_folder(df.sparkSession)}/tessella-settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
