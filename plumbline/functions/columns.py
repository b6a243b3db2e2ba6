"""Resolving column names and classifying column types."""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal, InvalidOperation
from typing import Any

from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

from plumbline.spec import SpecError


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def find_field(schema: T.StructType, name: str) -> T.StructField | None:
    """The field of that name, ignoring case."""
    bare = name.strip().strip('`"').lower()
    return next((f for f in schema.fields if f.name.lower() == bare), None)


def column(schema: T.StructType, name: str) -> Column:
    """The named column, or the SQL expression that stands in its place."""
    found = find_field(schema, name)
    return F.col(quoted(found.name)) if found else F.expr(name)


def plain_column(schema: T.StructType, name: str) -> T.StructField:
    found = find_field(schema, name)
    if found is None:
        raise SpecError(f"there is no column {name!r}")
    return found


def type_category(data_type: T.DataType) -> str:
    """int, float, bool, datetime or str."""
    if isinstance(data_type, T.DecimalType):
        return "float" if data_type.scale > 0 else "int"
    if isinstance(data_type, T.IntegralType):
        return "int"
    if isinstance(data_type, T.FractionalType):
        return "float"
    if isinstance(data_type, T.BooleanType):
        return "bool"
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return "str"


def is_text(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.StringType, T.VarcharType, T.CharType))


def is_nested(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.ArrayType, T.MapType, T.StructType)) or data_type.typeName() == "variant"


def typed_literal(value: Any, data_type: T.DataType) -> Column:
    """A configured value as a literal of the column's type.

    A value the type cannot hold is an error of the specification: left to the
    engine it would fail the whole pass in which the check runs.
    """
    text = str(value)
    try:
        if isinstance(data_type, T.BooleanType):
            return F.lit({"true": True, "false": False, "1": True, "0": False}[text.lower()])
        if isinstance(data_type, T.NumericType):
            number = Decimal(text)
            if isinstance(data_type, T.FractionalType) and not isinstance(data_type, T.DecimalType):
                return F.lit(float(number)).cast(data_type)     # 0.1 as FLOAT is not 0.1 as DOUBLE
            if number == number.to_integral_value():
                return F.lit(int(number))
            return F.lit(number)
        if isinstance(data_type, T.DateType):
            return F.lit(value if type(value) is date else date.fromisoformat(text))
        if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
            moment = datetime.fromisoformat(text).isoformat(sep=" ")
            return F.lit(moment).cast(data_type)
    except (KeyError, ValueError, InvalidOperation) as exc:
        raise SpecError(f"{value!r} is not a {data_type.simpleString()}") from exc
    return F.lit(text)
