"""Where tables come from: a resolver from a table name to a DataFrame."""

from __future__ import annotations

import posixpath
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

Source = DataFrame | str | Mapping[str, Any] | Callable[[], DataFrame]


def path_format(path: str) -> str:
    """File format of a path: parquet by its ending, otherwise CSV."""
    return "parquet" if path.lower().rstrip("/").endswith((".parquet", ".pq")) else "csv"


def path_table_name(path: str) -> str:
    """Table name of a path: the last part without its ending."""
    return posixpath.basename(path.rstrip("/")).rsplit(".", 1)[0]


def path_source(path: str, **options: Any) -> dict[str, Any]:
    return {"path": path, **options}


class Tables:
    """Resolves table names.

    A source is a DataFrame, a function that returns one when the table is first
    needed, a path, or a mapping.  A mapping names a ``path``
    with optional ``format``, ``schema``, ``sep``/``delim``, ``header`` and
    ``options``, a catalog ``table``, or ``format: jdbc`` with the ``options`` of
    Spark's JDBC reader (give partitionColumn, lowerBound, upperBound and
    numPartitions there, so that a big table is read by many tasks).  A name
    without a source is looked up in the session catalog.
    """

    def __init__(self, spark: SparkSession, sources: Mapping[str, Source] | None = None) -> None:
        self.spark = spark
        self._sources: dict[str, Source] = dict(sources or {})
        self._frames: dict[str, DataFrame] = {}
        self._schemas: dict[str, StructType] = {}

    @classmethod
    def of(cls, spark: SparkSession, tables: "Tables | Mapping[str, Source]") -> "Tables":
        return tables if isinstance(tables, Tables) else cls(spark, tables)

    @classmethod
    def from_paths(cls, spark: SparkSession, *paths: str, **options: Any) -> "Tables":
        """Name each path's table after its file or folder."""
        return cls(spark, {path_table_name(p): path_source(p, **options) for p in paths})

    def add(self, name: str, source: Source) -> "Tables":
        self._sources[name] = source
        self._frames.pop(name, None)
        self._schemas.pop(name, None)
        return self

    def names(self) -> list[str]:
        return list(self._sources)

    def has(self, name: str) -> bool:
        return name in self._sources or self.spark.catalog.tableExists(name)

    def parquet_path(self, name: str) -> str | None:
        """Where the files of a table lie, if it is read from Parquet files as they are."""
        source = self._sources.get(name)
        source = path_source(source) if isinstance(source, str) else source
        if not isinstance(source, Mapping) or "path" not in source or source.get("schema") is not None:
            return None
        return source["path"] if (source.get("format") or path_format(source["path"])) == "parquet" else None

    def frame(self, name: str) -> DataFrame:
        if name not in self._frames:
            self._frames[name] = self._open(name)
        return self._frames[name]

    def schema(self, name: str) -> StructType:
        if name not in self._schemas:
            self._schemas[name] = self.frame(name).schema
        return self._schemas[name]

    def _open(self, name: str) -> DataFrame:
        source = self._sources.get(name)
        if source is None:
            return self.spark.table(name)
        if isinstance(source, DataFrame):
            return source
        if callable(source):
            return source()
        if isinstance(source, str):
            source = path_source(source)
        if "table" in source:
            return self.spark.table(source["table"])
        fmt = source.get("format") or path_format(source["path"])
        reader = self.spark.read.format(fmt).options(**source.get("options", {}))
        if source.get("schema") is not None:
            reader = reader.schema(source["schema"])
        if fmt == "csv":
            reader = reader.options(
                sep=source.get("sep") or source.get("delim") or ",",
                header=source.get("header", True),
            )
            if source.get("schema") is None:
                # Types are read from the file, as a warehouse would load it.
                # Give a schema for big files: inferring costs one more pass.
                reader = reader.option("inferSchema", True)
        return reader.load(source["path"]) if "path" in source else reader.load()
