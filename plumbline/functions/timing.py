"""Clock arithmetic on zone-free timestamps in UTC."""

from __future__ import annotations

from datetime import date, datetime, timezone

from pyspark.sql import Column, functions as F
from pyspark.sql import types as T


def utc_moment(as_of: datetime | date | str | None) -> datetime:
    """The given moment, or now, as a zone-free UTC datetime."""
    if as_of is None:
        return datetime.now(timezone.utc).replace(tzinfo=None)
    if isinstance(as_of, str):
        as_of = datetime.fromisoformat(as_of)
    if not isinstance(as_of, datetime):
        as_of = datetime(as_of.year, as_of.month, as_of.day)
    return as_of.astimezone(timezone.utc).replace(tzinfo=None) if as_of.tzinfo else as_of


def moment_literal(moment: datetime) -> Column:
    return F.to_timestamp_ntz(F.lit(moment.strftime("%Y-%m-%d %H:%M:%S.%f")))


def wall_time(col: Column, data_type: T.DataType) -> Column:
    """A date, timestamp or text column as a zone-free UTC timestamp."""
    if isinstance(data_type, T.TimestampNTZType):
        return col
    if isinstance(data_type, T.TimestampType):
        return F.convert_timezone(None, F.lit("UTC"), col.cast("timestamp_ntz"))
    return col.try_cast("timestamp_ntz")


def hours_between(start: Column, end: Column) -> Column:
    """Hour boundaries passed from start to end: 00:59 to 01:01 is one hour."""
    return F.timestamp_diff("HOUR", F.date_trunc("HOUR", start), F.date_trunc("HOUR", end))
