"""Table profiles: one row per column.

A profile is two passes over the table.  The first is one aggregate for the
counts, bounds and moments of all columns.  The second counts the distinct
values of all columns in one grouping and yields distinct counts, top values and
value samples.  Long texts are grouped by a digest; those that end up among the top
values and samples are read again.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import is_nested, quoted, type_category
from plumbline.functions.predicates import count_where
from plumbline.plans.measure import MAX_SLOTS, local_frame

# Limits of the profile.
TOP_CUTOFF = 100        # columns with more distinct values have no top values
TOP_VALUES = 50
SAMPLE_VALUES = 20

_HASH_RANGE = float(2**64)
# The smallest hashes kept per column before the sample is cut to SAMPLE_VALUES.
# Of d distinct values about 200 fall below the limit; fewer than 20 would do so
# once in 10**60 tables.
_SAMPLE_POOL = 200.0
_COLUMN_GROUPS = 8
# Longer texts take part in the grouping as two 64-bit hashes.
_SHORT_TEXT = 32


def profile(
    df: DataFrame, table: str = "table", distinct: str = "exact",
    hidden: Iterable[str] = (), top_values: int = TOP_VALUES,
) -> DataFrame:
    """Profile every column of a table.

    ``distinct="exact"`` counts distinct values exactly, which shuffles them.
    ``distinct="approx"`` estimates the count of columns with clearly more than
    100 values, and then shuffles only the values of the others and the samples.
    Of ``hidden`` columns only the number of values present is read: they have no
    distinct count, bounds, moments, top values or samples.
    """
    if distinct not in ("exact", "approx"):
        raise ValueError("distinct must be 'exact' or 'approx'")
    spark = df.sparkSession
    fields = df.schema.fields
    barred = {name.lower() for name in hidden}
    shown = [f.name.lower() not in barred for f in fields]
    plain = [i for i, f in enumerate(fields) if shown[i] and not is_nested(f.dataType)]
    facts = _facts(df, fields, shown)
    estimates = _estimates(df, fields, plain) if distinct == "approx" and plain else None
    listed = local_frame(spark, {
        "ordinal": (range(len(fields)), pa.int32()),
        "column": ([f.name for f in fields], pa.string()),
        "dtype": ([f.dataType.simpleString() for f in fields], pa.string()),
        "category": ([type_category(f.dataType) for f in fields], pa.string()),
        "nested": ([is_nested(f.dataType) or not s for f, s in zip(fields, shown)], pa.bool_()),
    })
    # A local list of one row per column.
    out = facts.join(F.broadcast(listed), "ordinal")
    if plain:
        out = out.join(_values(df, fields, plain, estimates, top_values), "ordinal", "left")
    else:
        out = out.select("*", F.lit(None).cast("bigint").alias("unique_count"),
                         F.lit(None).cast("array<struct<n:bigint,v:string>>").alias("top"),
                         F.lit(None).cast("array<string>").alias("sample_values"))
    rows = F.col("row_count")
    null_rate = F.coalesce((rows - F.col("present")) / F.nullif(rows.cast("double"), F.lit(0.0)), F.lit(0.0))
    unique = F.when(~F.col("nested"), F.coalesce("unique_count", F.lit(0)))
    top = F.when(
        ~F.col("nested") & (rows > 0) & (unique <= TOP_CUTOFF),
        F.coalesce(
            F.map_from_entries(F.transform("top", lambda t: F.struct(t["v"], t["n"] / rows.cast("double")))),
            F.create_map().cast("map<string,double>"),
        ),
    )
    return out.select(
        F.lit(table).alias("table"), "column", "ordinal", "dtype", "category", "row_count",
        null_rate.alias("null_rate"),
        unique.alias("unique_count"),
        (unique / F.greatest(rows, F.lit(1)).cast("double")).alias("cardinality_ratio"),
        top.alias("top_values"),
        "min_value", "max_value", "mean", "stddev",
        F.coalesce("sample_values", F.array().cast("array<string>")).alias("sample_values"),
        (null_rate > 0).alias("is_nullable"),
    ).orderBy("ordinal")


def profile_tables(tables: Mapping[str, DataFrame], distinct: str = "exact") -> DataFrame:
    """The profiles of several tables as one frame."""
    out = None
    for name, df in tables.items():
        one = profile(df, name, distinct)
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no tables to profile")
    return out


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def schema_listing(df: DataFrame, table: str = "table") -> DataFrame:
    """Column names and types in order; reads no data."""
    fields = df.schema.fields
    return local_frame(df.sparkSession, {
        "table": ([table] * len(fields), pa.string()),
        "ordinal": (range(len(fields)), pa.int32()),
        "column": ([f.name for f in fields], pa.string()),
        "dtype": ([f.dataType.simpleString() for f in fields], pa.string()),
        "category": ([type_category(f.dataType) for f in fields], pa.string()),
    })


def sample_rows(df: DataFrame, share: float = 0.20, max_rows: int = 50, seed: int = 42) -> DataFrame:
    """Random rows: the share asked for, at most max_rows, at least one.

    About 20 * max_rows rows (at least 1000) pass a filter first, so that the task
    that picks among them gets few rows however many tasks read the table.  The order is
    a hash of the row, so the sample does not depend on how the table is split.
    """
    rows = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    place = F.pmod(F.xxhash64(F.to_json(F.struct("*")), F.lit(seed)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    picked = df.withColumn("__order", place).where(F.col("__order") < F.lit(float(max(20 * max_rows, 1000))) / rows)
    size = F.greatest(F.lit(1), F.least(F.lit(max_rows), F.floor(rows * F.lit(share))))
    few = picked.orderBy("__order").limit(max_rows).withColumn("__size", size)
    numbered = few.withColumn("__rank", F.row_number().over(Window.orderBy("__order")))    # max_rows rows
    return numbered.where(F.col("__rank") <= F.col("__size")).drop("__order", "__size", "__rank")


# -- first pass ---------------------------------------------------------------

def _facts(df: DataFrame, fields: list[T.StructField], shown: list[bool]) -> DataFrame:
    """Counts, bounds and moments.  Wide tables take several parts, each over its own columns."""
    costs = {"int": 8, "float": 8, "datetime": 3}
    parts: list[list[int]] = []
    used = MAX_SLOTS
    for i, f in enumerate(fields):
        cost = costs.get(type_category(f.dataType), 1)
        if used + cost > MAX_SLOTS - 1:
            parts.append([])
            used = 0
        parts[-1].append(i)
        used += cost
    out = None
    for part in parts:
        aggregates, entries = [F.count(F.lit(1)).alias("n")], []
        for i in part:
            named = _column_facts(fields[i], shown[i])
            aggregates += [c.alias(f"{name}{i}") for name, c in named.items()]
            entries.append(F.struct(
                F.lit(i).alias("ordinal"), F.col("n").alias("row_count"),
                *[F.col(f"{name}{i}").alias(name) for name in named],
            ))
        one = df.agg(*aggregates).select(F.inline(F.array(*entries)))
        out = one if out is None else out.unionByName(one)
    return out


def _column_facts(f: T.StructField, shown: bool) -> dict[str, Column]:
    col, kind = F.col(quoted(f.name)), type_category(f.dataType) if shown else "hidden"
    nothing, no_text = F.lit(None).cast("double"), F.lit(None).cast("string")
    facts = {"present": F.count(col), "min_value": no_text, "max_value": no_text, "mean": nothing, "stddev": nothing}
    if kind in ("int", "float", "datetime"):
        low, high = F.min(col), F.max(col)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            zero = F.lit(0.0).cast(f.dataType)
            low, high = low + zero, high + zero      # -0.0 and 0.0 are one value
        facts |= {"min_value": low.cast("string"), "max_value": high.cast("string")}
    if kind in ("int", "float"):
        value = col.cast("double")
        facts |= {"mean": F.avg(value), "stddev": F.stddev_samp(value)}
    return facts


def _estimates(df: DataFrame, fields: list[T.StructField], plain: list[int]) -> Column:
    """Estimated distinct counts by ordinal, as one scalar subquery."""
    counts = [F.approx_count_distinct(F.col(quoted(fields[i].name))) for i in plain]
    pairs = [x for i, c in zip(plain, counts) for x in (F.lit(i), c)]
    return df.agg(F.create_map(*pairs).alias("estimates")).scalar()


# -- second pass --------------------------------------------------------------

def _cell(i: int, f: T.StructField) -> Column:
    """A value in the slot of its kind, so that grouping needs no text of numbers and no long text."""
    col = F.col(quoted(f.name))
    whole, real, text = F.lit(None).cast("bigint"), F.lit(None).cast("double"), F.lit(None).cast("string")
    if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        whole = col.cast("bigint")
    elif isinstance(f.dataType, (T.FloatType, T.DoubleType)):
        real = col.cast("double")
    else:
        text = _text(f)
    long = F.char_length(text) > _SHORT_TEXT
    return F.struct(
        F.lit(i).alias("ordinal"), whole.alias("whole"), real.alias("real"), F.when(~long, text).alias("text"),
        *[F.when(long, h).alias(f"h{k}") for k, h in enumerate(_digest(text))],
    )


_KEYS = ("ordinal", "whole", "real", "text", "h0", "h1")


def _text(f: T.StructField) -> Column:
    col = F.col(quoted(f.name))
    return F.base64(col) if isinstance(f.dataType, T.BinaryType) else col.cast("string")


def _digest(text: Column) -> list[Column]:
    return [F.xxhash64(text), F.xxhash64(F.lit(1), text)]


def _long_texts(df: DataFrame, fields: list[T.StructField], plain: list[int], wanted: DataFrame) -> DataFrame:
    """(ordinal, h0, h1, long_text) for the long texts of `wanted`, read again from the table."""
    whole = [i for i in plain if isinstance(fields[i].dataType, (T.StringType, T.VarcharType, T.CharType, T.BinaryType))]
    cells = [F.struct(F.lit(i).alias("ordinal"), _text(fields[i]).alias("long_text")) for i in whole]
    read = df.select(F.inline(F.array(*cells))).where(F.char_length("long_text") > _SHORT_TEXT)
    read = read.select("ordinal", *[h.alias(f"h{k}") for k, h in enumerate(_digest(F.col("long_text")))], "long_text")
    # A few hundred rows per column.
    found = read.join(F.broadcast(wanted), ["ordinal", "h0", "h1"])
    return found.groupBy("ordinal", "h0", "h1").agg(F.min("long_text").alias("long_text"))


def _cells(df: DataFrame, fields: list[T.StructField], plain: list[int]) -> DataFrame:
    """All non-NULL values, one row each.

    A few reads of some columns each, together one read of the table: a task then
    combines the values of few columns, which keeps its hash table small.
    """
    size = -(-len(plain) // _COLUMN_GROUPS)
    groups = [plain[i:i + size] for i in range(0, len(plain), size)]
    frames = [df.select(F.inline(F.array(*[_cell(i, fields[i]) for i in g]))) for g in groups]
    return reduce(DataFrame.unionByName, frames).where("whole IS NOT NULL OR real IS NOT NULL OR text IS NOT NULL OR h0 IS NOT NULL")


def _values(df: DataFrame, fields: list[T.StructField], plain: list[int], estimates: Column | None, most_values: int) -> DataFrame:
    """Per column: distinct count, top values, 20 sampled values."""
    cells = _cells(df, fields, plain)
    low_hash = F.coalesce(F.col("h0"), F.xxhash64("whole", "real", "text"))
    pool = lambda many: low_hash.cast("double") + F.lit(_HASH_RANGE / 2) <= F.lit(_SAMPLE_POOL * _HASH_RANGE) / many
    if estimates is not None:
        # Keep all values of columns that may have top values, and of the others
        # just those that may enter the sample.
        many = F.element_at(F.col("estimates"), F.col("ordinal")).cast("double")
        cells = (
            cells.withColumn("estimates", estimates)
            .where((many <= 2 * TOP_CUTOFF) | pool(many))
        )
        groups = cells.groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("n"))
        counted = groups.groupBy("ordinal").agg(count_where(F.col("n") > 0).alias("counted"))
        estimate = F.element_at(F.col("estimates"), F.col("ordinal"))
        unique = counted.withColumn("estimates", estimates).select(
            "ordinal", F.when(estimate <= 2 * TOP_CUTOFF, F.col("counted")).otherwise(estimate).alias("unique_count")
        )
    else:
        groups = cells.groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("n"))
        # Reading n here too makes both uses of the groups share one shuffle.
        unique = groups.groupBy("ordinal").agg(count_where(F.col("n") > 0).alias("unique_count"))

    # One row per column of the table, so its size is known.
    known = groups.join(F.broadcast(unique), "ordinal")
    is_top = F.col("unique_count") <= TOP_CUTOFF
    sampled = pool(F.col("unique_count").cast("double"))
    value = F.coalesce(_texts(fields, plain), F.col("text"))
    kept = known.where(is_top | sampled).select("ordinal", "unique_count", "n", value.alias("v"), "h0", "h1",
                                                low_hash.alias("h"), is_top.alias("is_top"), sampled.alias("sampled"))
    if any(type_category(fields[i].dataType) == "str" for i in plain):
        long = _long_texts(df, fields, plain, kept.where("h0 IS NOT NULL").select("ordinal", "h0", "h1"))
        kept = kept.join(long, ["ordinal", "h0", "h1"], "left").withColumn("v", F.coalesce("v", "long_text"))
    # Lists of at most 100 and a few hundred values.
    gathered = kept.groupBy("ordinal", "unique_count").agg(
        F.collect_list(F.when(F.col("is_top"), F.struct((-F.col("n")).alias("n"), "v"))).alias("top"),
        F.collect_list(F.when(F.col("sampled"), F.struct("h", "v"))).alias("pool"),
    )
    most = F.slice(F.array_sort("top"), 1, most_values)
    return gathered.select(
        "ordinal", "unique_count",
        F.transform(most, lambda t: F.struct((-t["n"]).alias("n"), t["v"].alias("v"))).alias("top"),
        F.transform(F.slice(F.array_sort("pool"), 1, SAMPLE_VALUES), lambda t: t["v"]).alias("sample_values"),
    )


def _texts(fields: list[T.StructField], plain: list[int]) -> Column:
    """The text of a number as its own column type prints it."""
    singles = [i for i in plain if isinstance(fields[i].dataType, T.FloatType)]
    real = F.col("real").cast("string")
    if singles:
        real = F.when(F.col("ordinal").isin(*singles), F.col("real").cast("float").cast("string")).otherwise(real)
    return F.coalesce(F.col("whole").cast("string"), real)
