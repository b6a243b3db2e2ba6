"""Synthetic tables from profiles.

Columns are drawn independently from the profile of each, so keys and foreign
keys of the original are not kept.  A row is a function of its number and the
seed: the table comes out the same however it is split over tasks.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.functions.randoms import normal, uniform
from plumbline.operators.profile import TOP_CUTOFF, profile
from plumbline.sources.tables import Source, Tables
from plumbline.spec import CheckSpec, as_specs

DEFAULT_ROWS = 10_000
SEED = 42
ROWS_PER_TASK = 2_000_000

# Ranges of columns whose profile has no bounds.
_NUMBER_RANGE = (0.0, 1_000_000.0)
_FIRST_DATE = datetime(2020, 1, 1)


def synthesize(
    spark: SparkSession,
    profiled: DataFrame,
    rows: int = DEFAULT_ROWS,
    seed: int = SEED,
    allow_sample_values: bool = False,
) -> DataFrame:
    """A table of ``rows`` rows drawn from the profile of one table.

    Text columns with few values are drawn from their top values.  Other text
    columns hold made-up tokens; with ``allow_sample_values`` they hold values
    sampled from the original.
    """
    columns = profiled.orderBy("ordinal").collect()      # one row per column
    partitions = max(spark.sparkContext.defaultParallelism, -(-rows // ROWS_PER_TASK))
    numbered = spark.range(0, rows, 1, partitions).withColumnRenamed("id", "__row")
    # The random numbers come first, as columns, so that a choice among many
    # values does not draw its number again for each of them.
    row_id = F.col("__row")
    draws = {f"__u{c['ordinal']}": uniform(row_id, c["column"], seed) for c in columns}
    draws |= {f"__n{c['ordinal']}": uniform(row_id, c["column"] + ":null", seed) for c in columns}
    drawn = []
    for c in columns:
        value = _value(c, row_id, F.col(f"__u{c['ordinal']}"), seed, allow_sample_values).cast(c["dtype"])
        missing = F.col(f"__n{c['ordinal']}") < F.lit(float(c["null_rate"]))
        drawn.append(F.when(~missing, value).alias(c["column"]))
    return numbered.withColumns(draws).select(*drawn)


def _value(c: Mapping[str, Any], row_id: Column, u: Column, seed: int, allow_samples: bool) -> Column:
    name, category = c["column"], c["category"]
    if c["top_values"]:
        return _weighted(u, c["top_values"], c["dtype"])
    if category in ("int", "float"):
        return _number(c, u, normal(row_id, name, seed))
    if category == "bool":
        return u < 0.5
    if category == "datetime":
        first = _moment(c["min_value"]) or _FIRST_DATE
        last = _moment(c["max_value"]) or datetime.now()
        start = F.to_timestamp_ntz(F.lit(str(first)))
        span = max((last - first).total_seconds(), 1.0)
        return F.timestamp_add("MICROSECOND", (u * F.lit(span * 1e6)).cast("bigint"), start)
    if _is_nested_name(c["dtype"]):
        return F.lit(None)
    if allow_samples and c["sample_values"]:
        options = F.array(*[F.lit(v) for v in c["sample_values"]])
        return F.get(options, F.floor(u * F.lit(float(len(c["sample_values"])))).cast("int"))
    token = F.lower(F.hex(F.xxhash64(row_id, F.lit(name), F.lit(seed))))
    return F.concat(F.lit("val_"), F.left(token, F.lit(8)))


def _is_nested_name(dtype: str) -> bool:
    return dtype.startswith(("array", "map", "struct", "variant"))


def _weighted(u: Column, frequencies: Mapping[str, float], dtype: str) -> Column:
    """One of the values, each as often as in the original."""
    total, reached = sum(frequencies.values()), 0.0
    ordered = sorted(frequencies.items(), key=lambda item: (-item[1], item[0]))
    # The literals have the type of the column, so that no row parses text.
    literal = {value: F.lit(value).cast(dtype) for value in frequencies}
    choice = None
    for value, weight in ordered[:-1]:
        reached += weight / total
        hit = u < F.lit(reached)
        choice = F.when(hit, literal[value]) if choice is None else choice.when(hit, literal[value])
    last = literal[ordered[-1][0]]
    return last if choice is None else choice.otherwise(last)


def _number(c: Mapping[str, Any], u: Column, z: Column) -> Column:
    """Normal with the column's mean and deviation inside its bounds, else uniform.

    The cast to a whole column type cuts the fraction of a normal value; whole
    uniform values are all equally likely.
    """
    low = float(c["min_value"]) if c["min_value"] is not None else _NUMBER_RANGE[0]
    high = float(c["max_value"]) if c["max_value"] is not None else _NUMBER_RANGE[1]
    if c["mean"] is not None and c["stddev"]:
        raw = F.lit(float(c["mean"])) + z * F.lit(float(c["stddev"]))
        return F.least(F.greatest(raw, F.lit(low)), F.lit(high))
    flat = F.lit(low) + u * F.lit(high - low)
    return F.floor(flat) if c["category"] == "int" else flat


def _moment(text: str | None) -> datetime | None:
    try:
        return datetime.fromisoformat(text).replace(tzinfo=None) if text else None
    except ValueError:
        return None


def referenced_tables(specs: Iterable[CheckSpec | Mapping[str, Any]]) -> list[str]:
    return sorted({t for s in as_specs(specs) for t in s.named_tables()})


def clone_tables(
    spark: SparkSession,
    specs: Iterable[CheckSpec | Mapping[str, Any]],
    tables: Tables | Mapping[str, Source],
    rows: int = DEFAULT_ROWS,
    seed: int = SEED,
    allow_sample_values: bool = False,
    distinct: str = "approx",
    protected: Iterable[tuple[str, str]] = (),
) -> Tables:
    """A resolver that gives a clone for every table the specs name.

    ``protected`` are (table, column) pairs with personal data: the profile reads
    nothing of them but how many values are present, and the clone holds made-up
    values whatever ``allow_sample_values`` says.
    """
    barred = {(t.lower(), c.lower()) for t, c in protected}
    originals = Tables.of(spark, tables)
    clones = Tables(spark)
    for name in referenced_tables(specs):
        hidden = [c for t, c in barred if t == name.lower()]
        profiled = profile(originals.frame(name), name, distinct, hidden=hidden, top_values=TOP_CUTOFF)
        clones.add(name, synthesize(spark, profiled, rows, seed, allow_sample_values))
    return clones
