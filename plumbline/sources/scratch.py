"""Intermediate tables of operators that take several rounds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.  A local session without one gets a folder of its
    own; a cluster has to name one, since its machines do not see each other's disks."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="plumbline-scratch-"))
    return spark.sparkContext.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """The rows of df, written as Parquet and read back.

    Lineage ends here, lost executors cost a retry of a task, and plans built on
    the result know its size.
    """
    path = f"{scratch_folder(df.sparkSession)}/scratch-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
