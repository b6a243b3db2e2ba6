"""Measures and the passes that compute them.

A check becomes a measure: what to compute (payload), in which pass, and under
which key.  Measures with the same pass and key are computed together, so that
a table is read once for all of them and not once per check.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import datetime
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import column, find_field, plain_column
from plumbline.functions.timing import moment_literal, wall_time
from plumbline.sources.tables import Tables

# Spark leaves whole-stage code generation when an aggregate carries more than
# spark.sql.codegen.maxFields (100) buffer fields.
MAX_SLOTS = 90


@dataclass
class ScanContext:
    """What a check may look at while it is planned."""

    spark: SparkSession
    tables: Tables
    as_of: datetime
    rows_per_bucket: int = 250_000     # of the sequence check
    _types: dict[tuple[str, str], T.DataType] = field(default_factory=dict)

    def frame(self, table: str) -> DataFrame:
        return self.tables.frame(table)

    def schema(self, table: str) -> T.StructType:
        return self.tables.schema(table)

    def col(self, table: str, name: str) -> Column:
        return column(self.schema(table), name)

    def field(self, table: str, name: str) -> T.StructField:
        return plain_column(self.schema(table), name)

    def type_of(self, table: str, name: str) -> T.DataType:
        found = find_field(self.schema(table), name)
        if found is not None:
            return found.dataType
        if (table, name) not in self._types:
            self._types[table, name] = self.frame(table).select(F.expr(name)).schema[0].dataType
        return self._types[table, name]

    def time(self, table: str, name: str) -> Column:
        return wall_time(self.col(table, name), self.type_of(table, name))

    def now(self) -> Column:
        return moment_literal(self.as_of)


PassFn = Callable[[ScanContext, tuple, "Sequence[Measure]"], DataFrame]


@dataclass(frozen=True)
class Measure:
    compute: PassFn
    key: tuple
    payload: Any
    text: str                 # what is computed, for the report
    slots: int = 1            # aggregate buffer fields it takes
    affinity: str = ""        # measures on the same columns go into the same pass
    seq: int = -1


def describe(col: Column) -> str:
    return str(col).removeprefix("Column<'").removesuffix("'>")


def long_rows(one_row: DataFrame, seqs: Sequence[int]) -> DataFrame:
    """One wide row with a column m<seq> for each measure -> rows (seq, metric_value)."""
    entries = ", ".join(f"struct({seq} AS seq, CAST(m{seq} AS DOUBLE) AS metric_value)" for seq in seqs)
    return one_row.selectExpr(f"inline(array({entries}))")


def aggregate_measures(df: DataFrame, measures: Sequence[Measure]) -> DataFrame:
    """Aggregate once for all measures whose payload is an aggregate column."""
    wide = df.agg(*[m.payload.alias(f"m{m.seq}") for m in measures])
    return long_rows(wide, [m.seq for m in measures])


def chunks(measures: Sequence[Measure], limit: int = MAX_SLOTS) -> list[list[Measure]]:
    """Split measures so that each part stays inside generated code.

    Parts follow the columns they touch.  A further part then reads other
    columns of the files, and all parts together read about one full scan.
    """
    parts: list[list[Measure]] = []
    used = limit
    for m in sorted(measures, key=lambda m: (m.affinity, m.seq)):
        if used + m.slots > limit and (used or not parts):
            parts.append([])
            used = 0
        parts[-1].append(m)
        used += m.slots
    return parts


def local_frame(spark: SparkSession, columns: dict[str, tuple[Sequence[Any], pa.DataType]]) -> DataFrame:
    """A frame of driver-side values that needs no Python worker to read."""
    return spark.createDataFrame(pa.table({k: pa.array(list(v), t) for k, (v, t) in columns.items()}))
