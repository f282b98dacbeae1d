"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``; a local session without the setting gets one of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="inkfold-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/inkfold-{spark.sparkContext.applicationId}"


def settled(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` and go on from the files: lineage and size estimates start anew.

    Rounds of joins over checkpoints keep the estimates of the plans before, which
    every join multiplies; those of files are their sizes.
    """
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cleared(spark: SparkSession) -> None:
    """Delete all that this application has stored; nothing that reads it may follow."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
