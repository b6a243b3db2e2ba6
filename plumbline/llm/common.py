"""Helpers that the operators share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but these six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: Column) -> Column:
    """Number of words of a text; a null text has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def least_places(df: DataFrame, place: str, rows: int, most: int) -> DataFrame:
    """The `most` rows of df (of about `rows`) with the least places, which are hashes. About twice as many pass a
    filter first, so that the task that picks among them gets few rows, however many tasks read df."""
    enough = min(1.0, 2 * most / max(1, rows))
    few = df.filter(F.pmod(F.col(place), F.lit(1 << 40)) < F.lit(int(enough * (1 << 40))))
    return few.withColumn(place, F.pmod(F.col(place), F.lit(1 << 40))).orderBy(place).limit(most)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset, a local session gets a
    temporary one; a cluster must name it, because executors and driver do not see each other's disks."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="plumbline-")
        context.setCheckpointDir(folder)
    return folder


_open = threading.local()


def stored(df: DataFrame, keep: bool = False, outer: bool = False) -> DataFrame:
    """df written as Parquet in the shared folder and read back: cuts lineage, survives lost executors, and
    gives later joins true sizes and exchanges of their own, which adaptive execution can split. Inside of
    temporary() the table goes when the block ends, or with `outer` the block around that one, unless it is to be kept."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/plumbline-{uuid.uuid4().hex}"
    if not keep:
        for tables in getattr(_open, "blocks", ())[-2:-1] if outer else getattr(_open, "blocks", ())[-1:]:
            tables.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """A block whose stored tables are removed at its end; what is made from them must be stored with keep by then."""
    _open.blocks = [*getattr(_open, "blocks", ()), tables := []]
    try:
        yield
    finally:
        _open.blocks = _open.blocks[:-1]
        for path in tables:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
