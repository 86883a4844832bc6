"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only where a session has none (tests) a folder of its own is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = "file://" + tempfile.mkdtemp(prefix="cadenza-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def own_folder(spark: SparkSession) -> str:
    """The application's part of the shared folder."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"


def drop_written(spark: SparkSession) -> None:
    """Delete the intermediate tables of this application, once no result that reads them is needed any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write a table once and read it back: what follows starts from files that survive the loss of executors."""
    path = f"{own_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
