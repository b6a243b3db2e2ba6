"""Aggregates and row predicates that the checks share.

Everything here is a built-in expression, so any number of checks on one table
run inside the generated code of one scan.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import is_text
from plumbline.spec import SpecError


def rows() -> Column:
    return F.count(F.lit(1))


def count_where(condition: Column) -> Column:
    """Rows for which the condition is true.

    Unlike count_if, this needs no helper column in front of the aggregate: many
    of those together would take the scan out of generated code.
    """
    return F.count(F.when(condition, F.lit(1)))


def share(part: Column, whole: Column) -> Column:
    """part / whole as a double; NULL where whole is 0."""
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def ratio(condition: Column) -> Column:
    """Share of all rows for which the condition is true.  NULL counts as not true."""
    return share(count_where(condition), rows())


def as_number(col: Column, data_type: T.DataType) -> Column:
    """Text read as a number where it is one; other types as they are."""
    return col.try_cast("double") if is_text(data_type) else col


def finite(col: Column) -> Column:
    """A number as a double, NULL in place of NaN: one NaN would make every moment NaN."""
    value = col.cast("double")
    return F.when(~F.isnan(value), value)


def label(col: Column) -> Column:
    """Text of a value with case and outer blanks removed."""
    return F.upper(F.trim(col.cast("string")))


# A decimal number in full, with an optional exponent.  Spark's own cast also
# takes Java spellings such as '1d' and '0x1p3', which are not numbers in SQL.
_DECIMAL_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_SPECIAL_NUMBER = r"^(?i)\s*[+-]?(nan|inf|infinity)\s*$"

_SIZED_TEXT = r"^(varchar|nvarchar|char|nchar|character|character varying|string)\s*\(.*\)$"
_SIZED_NUMBER = r"^(numeric|number|decimal)\s*\("

# SQL type names that Spark spells in another way.
_SQL_TYPES = {
    "varchar": "string", "text": "string", "char": "string", "nvarchar": "string",
    "character varying": "string", "character": "string", "bpchar": "string", "nchar": "string", "clob": "string",
    "number": "decimal(38,10)", "numeric": "decimal(38,10)", "decimal": "decimal(38,10)",
    "real": "float", "float8": "double", "float4": "float", "double precision": "double",
    "float64": "double", "float32": "float", "int64": "bigint", "int32": "int", "int16": "smallint",
    "int8": "bigint", "int4": "int", "int2": "smallint", "integer": "int", "long": "bigint",
    "bool": "boolean", "bit": "boolean", "datetime": "timestamp_ntz", "datetime2": "timestamp_ntz",
    "timestamp without time zone": "timestamp_ntz", "timestamp with time zone": "timestamp",
    "timestamptz": "timestamp", "timestamp_tz": "timestamp", "timestamp_ltz": "timestamp",
    "blob": "binary", "bytes": "binary", "bytea": "binary", "varbinary": "binary",
}


def spark_type_names(sql_type: Column) -> Column:
    """spark_type_name of a column of names, from the same list."""
    text = F.regexp_replace(F.trim(F.lower(sql_type)), r"\s+", " ")
    text = F.when(text.rlike(_SIZED_TEXT), "string").otherwise(text)
    text = F.regexp_replace(F.regexp_replace(text, _SIZED_NUMBER, "decimal("), ", ", ",")
    listed = F.create_map(*[F.lit(x) for item in _SQL_TYPES.items() for x in item])
    return F.coalesce(F.try_element_at(listed, text), text)


def spark_type_name(sql_type: str) -> str:
    """Spark's name for a SQL type name; equal types of two dialects get one name."""
    text = re.sub(r"\s+", " ", sql_type.strip().lower())
    text = re.sub(_SIZED_TEXT, "string", text)
    text = re.sub(_SIZED_NUMBER, "decimal(", text).replace(", ", ",")
    return _SQL_TYPES.get(text, text)


def fails_cast(col: Column, data_type: T.DataType, target: str) -> Column:
    """True where a value is present but is not of the target type."""
    name = spark_type_name(target)
    try:
        T.DataType.fromDDL(name)
    except Exception as exc:
        raise SpecError(f"unknown type {target!r}") from exc
    failed = col.try_cast(name).isNull()
    if is_text(data_type) and name in ("double", "float"):
        failed = failed | ~(col.rlike(_DECIMAL_NUMBER) | col.rlike(_SPECIAL_NUMBER))
    return col.isNotNull() & failed
