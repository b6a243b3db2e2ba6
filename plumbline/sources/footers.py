"""Row counts, NULL counts and bounds of Parquet tables from the footers of their files.

Spark answers COUNT, MIN and MAX from the footers when they are pushed into its newer
file reader.  That reader and the push-down are switched on in a session of their own, so the
caller's settings stay as they are.  Footers have no bounds of times and texts that
could be trusted, and none of numbers that hold NaN, so bounds are read for whole numbers and dates only.
Where footers lack a count or bound (files of other writers, partition columns), the column is scanned instead.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import quoted
from plumbline.plans.measure import local_frame

_SETTINGS = {"spark.sql.sources.useV1SourceList": "", "spark.sql.parquet.aggregatePushdown": "true"}
_BOUNDED = (T.IntegralType, T.DateType)


def footer_session(spark: SparkSession) -> SparkSession:
    """A session over the same data and machines that answers aggregates from footers."""
    session = spark.newSession()
    for key, value in _SETTINGS.items():
        session.conf.set(key, value)
    return session


def has_bounds(field: T.StructField) -> bool:
    return isinstance(field.dataType, _BOUNDED)


def counted(field: T.StructField) -> bool:
    """Whether footers count the NULLs of the column: nested ones have a footer entry for each leaf only."""
    return not isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType))


def _facts(fields: Iterable[T.StructField]) -> list[Column]:
    out = [F.count(F.lit(1)).alias("rows")]
    for i, f in enumerate(fields):
        col = F.col(quoted(f.name))
        out += [F.count(col).alias(f"n{i}")]
        if has_bounds(f):
            out += [F.min(col).alias(f"low{i}"), F.max(col).alias(f"high{i}")]
    return out


def pushed(df: DataFrame, fields: Iterable[T.StructField]) -> DataFrame:
    """One row with the facts of the fields; df comes from a footer session."""
    return df.agg(*_facts(fields))


def bounds(spark: SparkSession, paths: Mapping[str, str], names: Iterable[str] | None = None) -> DataFrame:
    """(table, column, row_count, null_count, low, high, from_footers) for the columns of Parquet tables, or those of
    ``names``; low and high as text, NULL for columns that footers have no bounds of.

    Runs now: one pass over the footers of each table.  Nested columns are left out.
    """
    wanted = None if names is None else {n.lower() for n in names}
    session, rows = footer_session(spark), []
    for table, path in paths.items():
        df = session.read.parquet(path)
        fields = [f for f in df.schema.fields if counted(f) and (wanted is None or f.name.lower() in wanted)]
        rows += [(table, *row) for row in _known(df, spark, path, fields)]
    kinds = {
        "table": pa.string(), "column": pa.string(), "row_count": pa.int64(), "null_count": pa.int64(),
        "low": pa.string(), "high": pa.string(), "from_footers": pa.bool_(),
    }
    return local_frame(spark, {name: ([r[i] for r in rows], kind) for i, (name, kind) in enumerate(kinds.items())})


def _known(df: DataFrame, spark: SparkSession, path: str, fields: list[T.StructField], footers: bool = True) -> list[tuple]:
    """A row per field.  Fields whose footers lack something are told apart by halving, and scanned."""
    if not fields:
        return []
    try:
        row = pushed(df, fields).first()
    except (PySparkException, Py4JJavaError) as exc:
        if not footers or "aggregatePushdown" not in str(exc):     # which Spark names where footers lack something
            raise
        if len(fields) == 1:
            return _known(spark.read.parquet(path), spark, path, fields, footers=False)
        middle = len(fields) // 2
        return _known(df, spark, path, fields[:middle]) + _known(df, spark, path, fields[middle:])
    text = lambda name: str(row[name]) if name in row and row[name] is not None else None
    return [(f.name, row["rows"], row["rows"] - row[f"n{i}"], text(f"low{i}"), text(f"high{i}"), footers) for i, f in enumerate(fields)]
