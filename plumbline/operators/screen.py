"""Screening columns for personal data: by their names, then by their values."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import is_nested, is_text, quoted, type_category
from plumbline.functions.masking import mask_value
from plumbline.functions.pii_values import EXACT_NAMES, NAME_PARTS, VALUE_PATTERNS
from plumbline.functions.predicates import count_where
from plumbline.plans.measure import MAX_SLOTS, local_frame
from plumbline.sources.tables import Source, Tables
from plumbline.spec import as_specs

MASKED_SAMPLES = 3


class PIIBlocked(RuntimeError):
    """Personal data was found and the screen is set to block the scan."""


@dataclass(frozen=True)
class ScreenConfig:
    """``sample_size`` values per flagged column are tested; None tests all of them.

    ``scan_all_text`` also tests text columns whose names say nothing;
    ``categories`` keeps the findings of some categories. Samples follow a hash of the
    row; ``sample_key`` names, by table, columns that tell its rows apart, and then only
    these are read and hashed.
    """

    enabled: bool = True
    sample_size: int | None = 100
    on_pii_detected: str = "exclude"
    categories: tuple[str, ...] = ()
    scan_all_text: bool = False
    seed: int = 42
    sample_key: Mapping[str, tuple[str, ...]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.on_pii_detected not in ("block", "exclude", "synthetic"):
            raise ValueError("on_pii_detected must be 'block', 'exclude' or 'synthetic'")

    @classmethod
    def from_dict(cls, raw: Mapping[str, Any]) -> "ScreenConfig":
        known = {k: v for k, v in raw.items() if k in cls.__dataclass_fields__ and v is not None}
        if "categories" in known:
            known["categories"] = tuple(known["categories"])
        return cls(**known)


# -- names --------------------------------------------------------------------

def column_listing(spark: SparkSession, tables: Mapping[str, DataFrame]) -> DataFrame:
    """All columns of the tables: table, ordinal, column."""
    listed = [(t, i, c) for t, df in tables.items() for i, c in enumerate(df.columns)]
    return local_frame(spark, {
        "table": ([r[0] for r in listed], pa.string()),
        "ordinal": ([r[1] for r in listed], pa.int32()),
        "column": ([r[2] for r in listed], pa.string()),
    })


def name_scan(columns: DataFrame) -> DataFrame:
    """Judge columns by name alone: a known name is HIGH, a telling part of one MEDIUM."""
    name = F.lower("column")

    def finding(status: str, confidence: float, category: str, pii_type: str) -> Column:
        return F.struct(
            F.lit(status).alias("status"), F.lit(confidence).alias("confidence"),
            F.lit(category).cast("string").alias("category"), F.lit(pii_type).cast("string").alias("pii_type"),
            F.lit("name_match" if category else "none").alias("detected_via"),
        )

    exact = [F.when(name == kw, finding("HIGH", 0.95, *kind)) for kw, kind in EXACT_NAMES.items()]
    parts = [F.when(F.contains(name, F.lit(kw)), finding("MEDIUM", 0.5, *kind)) for kw, kind in NAME_PARTS.items()]
    found = F.coalesce(*exact, *parts, finding("CLEAR", 0.0, None, None))
    return columns.withColumn("found", found).select(*columns.columns, "found.*")


# -- values -------------------------------------------------------------------

def matches(text: Column, name: str) -> Column:
    """Whether a whole value has the pattern.

    Flags d and U: only a newline ends a line, and digits and blanks are those
    of Unicode, as the patterns are meant.
    """
    pattern, ignore_case, _, _ = VALUE_PATTERNS[name]
    return text.rlike(f"(?{'i' if ignore_case else ''}dU)" + pattern)


def _present(df: DataFrame, columns: Iterable[str]) -> dict[str, Column]:
    """Number of non-NULL values by column, as one scalar subquery for all columns."""
    columns = list(columns)
    counts = [F.count(F.col(quoted(c))).alias(f"c{i}") for i, c in enumerate(columns)]
    known = df.agg(F.struct(*counts).alias("present")).scalar()
    return {c: known.getField(f"c{i}") for i, c in enumerate(columns)}


def _place(df: DataFrame, seed: int, key: Iterable[str] | None) -> Column:
    """A number from 0 to 1 by a hash of the row's key, by default of all its plain columns."""
    names = list(key) if key else [f.name for f in df.schema.fields if not is_nested(f.dataType)]
    parts = [F.coalesce(F.col(quoted(c)).cast("string"), F.lit("")) for c in names]
    digits = F.substring(F.md5(F.concat_ws("\x1f", F.lit(str(seed)), *parts)), 1, 13)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 52))


def _sampled(df: DataFrame, column: str, size: int, seed: int, present: Column, key: Iterable[str] | None = None) -> DataFrame:
    """``size`` random non-NULL values with their rank: the first in the order of a hash of the row, then of the value,
    so they do not depend on how the table is split, and a smaller sample is the start of a larger one.

    About 20 * size values (at least 1000) pass a filter first, so that thousands
    of tasks do not send size values each to the task that picks among them.
    """
    value = F.col(quoted(column)).cast("string")
    enough = F.lit(float(max(20 * size, 1000))) / present
    few = (
        df.select(value.alias("value"), _place(df, seed, key).alias("order")).where("value IS NOT NULL")
        .where(F.col("order") < enough).orderBy("order", "value").limit(size)
    )
    return few.withColumn("rank", F.row_number().over(Window.orderBy("order", "value")))    # size rows


def _shown() -> Column:
    """The first MASKED_SAMPLES values by rank; no more are collected."""
    first = F.when(F.col("rank") <= MASKED_SAMPLES, F.struct("rank", "value"))
    return F.transform(F.array_sort(F.collect_list(first)), lambda x: x["value"])


def _hits(text: Column) -> list[Column]:
    return [count_where(matches(text, p)).alias(p) for p in VALUE_PATTERNS]


def sample_hits(df: DataFrame, table: str, columns: Iterable[str], size: int, seed: int, key: Iterable[str] | None = None) -> DataFrame:
    """Pattern hits among sampled values: table, column, sample_count, hits by pattern, samples."""
    columns = list(columns)
    present = _present(df, columns)
    samples = [_sampled(df, c, size, seed, present[c], key).withColumn("column", F.lit(c)) for c in columns]
    return (
        reduce(DataFrame.unionByName, samples).groupBy("column")
        .agg(F.count(F.lit(1)).alias("sample_count"), _shown().alias("samples"), *_hits(F.col("value")))
        .select(F.lit(table).alias("table"), "column", "sample_count", F.array(*VALUE_PATTERNS).alias("hits"), "samples")
    )


def full_hits(df: DataFrame, table: str, columns: Iterable[str]) -> DataFrame:
    """Pattern hits among all values, several columns in one scan."""
    per_pass = MAX_SLOTS // (len(VALUE_PATTERNS) + 1)
    columns = list(columns)
    frames = []
    for start in range(0, len(columns), per_pass):
        part = columns[start:start + per_pass]
        aggregates = []
        for i, c in enumerate(part):
            text = F.col(quoted(c)).cast("string")
            aggregates.append(F.count(text).alias(f"n{i}"))
            aggregates += [h.alias(f"{p}{i}") for p, h in zip(VALUE_PATTERNS, _hits(text))]
        rows = [
            F.struct(
                F.lit(table).alias("table"), F.lit(c).alias("column"), F.col(f"n{i}").alias("sample_count"),
                F.array(*[F.col(f"{p}{i}") for p in VALUE_PATTERNS]).alias("hits"),
            )
            for i, c in enumerate(part)
        ]
        frames.append(df.agg(*aggregates).select(F.inline(F.array(*rows))).where("sample_count > 0"))
    return reduce(DataFrame.unionByName, frames)


def masked_samples(df: DataFrame, table: str, columns: Iterable[str], seed: int, key: Iterable[str] | None = None) -> DataFrame:
    """Three values per column, still to be masked by their category."""
    columns = list(columns)
    present = _present(df, columns)
    frames = [
        _sampled(df, c, MASKED_SAMPLES, seed, present[c], key)
        .agg(_shown().alias("samples")).select(F.lit(table).alias("table"), F.lit(c).alias("column"), "samples")
        for c in columns
    ]
    return reduce(DataFrame.unionByName, frames)


def best_pattern(hits: Column) -> Column:
    """Number, category and type of the pattern with most hits, the earlier of equals; NULL without hits."""
    options = [
        F.struct(
            F.get(hits, F.lit(i)).alias("hits"), F.lit(-i).alias("earlier"),
            F.lit(name).alias("pattern"), F.lit(kind[2]).alias("category"), F.lit(kind[3]).alias("pii_type"),
        )
        for i, (name, kind) in enumerate(VALUE_PATTERNS.items())
    ]
    best = F.greatest(*options)
    return F.when(best["hits"] > 0, best)


def apply_values(named: DataFrame) -> DataFrame:
    """Revise the findings by name with the hit ratios of the values.

    Needs the columns of :func:`name_scan`, sample_count (NULL: not tested) and hits.
    """
    best = best_pattern(F.col("hits"))
    share = F.coalesce(best["hits"] / F.col("sample_count").cast("double"), F.lit(0.0))
    tested = F.col("sample_count").isNotNull()
    is_high, is_medium, is_clear = (F.col("status") == s for s in ("HIGH", "MEDIUM", "CLEAR"))
    sure, likely = tested & (share >= 0.8), tested & (share >= 0.4) & (share < 0.8)
    denied = tested & (share < 0.4) & is_medium
    via = F.when(is_clear & (sure | likely), F.lit("regex")).when(
        sure | likely, F.concat("detected_via", F.lit("+regex"))
    ).when(denied, F.concat("detected_via", F.lit("+no_regex"))).otherwise(F.col("detected_via"))
    # A clear name has no category of its own, so a likely pattern gives it one.
    renamed = sure | (likely & is_clear)
    return named.select(
        "table", "ordinal", "column",
        F.when(sure, "HIGH").when(likely & ~is_high, "MEDIUM").when(denied, "REVIEW")
        .otherwise(F.col("status")).alias("status"),
        F.when(renamed, best["category"]).otherwise(F.col("category")).alias("category"),
        F.when(renamed, best["pii_type"]).otherwise(F.col("pii_type")).alias("pii_type"),
        F.when(sure, F.least(F.lit(0.99), F.lit(0.5) + share * 0.5))
        .when(likely & is_clear, F.lit(0.5)).otherwise(F.col("confidence")).alias("confidence"),
        via.alias("detected_via"),
        F.coalesce("sample_count", F.lit(0)).alias("sample_count"),
        F.when(tested, F.coalesce(best["hits"], F.lit(0))).otherwise(F.lit(0)).alias("match_count"),
        *[c for c in named.columns if c == "samples"],
    )


def _mask_all(findings: DataFrame) -> DataFrame:
    category = F.coalesce("category", F.lit("other"))
    masked = F.transform("samples", lambda v: mask_value(v, category))
    return findings.withColumn(
        "masked_samples", F.when(F.col("sample_count") > 0, masked).otherwise(F.array().cast("array<string>"))
    ).drop("samples")


def screen_columns(
    spark: SparkSession, tables: Mapping[str, DataFrame], config: ScreenConfig = ScreenConfig()
) -> DataFrame:
    """One row per column with status, category, confidence and masked samples."""
    named = name_scan(column_listing(spark, tables))
    # The names alone decide which columns are read, so this looks at no data.
    flagged = {(r["table"], r["column"]) for r in named.where("status <> 'CLEAR'").select("table", "column").collect()}
    tested = []
    for table, df in tables.items():
        chosen = [
            f.name for f in df.schema.fields
            if not is_nested(f.dataType)
            and ((table, f.name) in flagged or (config.scan_all_text and is_text(f.dataType)))
        ]
        if not chosen:
            continue
        size = config.sample_size
        key = config.sample_key.get(table)
        if size is not None:
            tested.append(sample_hits(df, table, chosen, size, config.seed, key))
        else:
            shown = masked_samples(df, table, chosen, config.seed, key)
            tested.append(full_hits(df, table, chosen).join(shown, ["table", "column"]))
    if tested:
        # One row per tested column on the right.
        named = named.join(reduce(DataFrame.unionByName, tested), ["table", "column"], "left")
    else:
        named = named.select(
            "*", F.lit(None).cast("bigint").alias("sample_count"), F.lit(None).cast("array<bigint>").alias("hits"),
            F.lit(None).cast("array<string>").alias("samples"),
        )
    out = _mask_all(apply_values(named))
    if config.categories:
        out = of_categories(out, config.categories)
    return out


def of_categories(findings: DataFrame, categories: Iterable[str]) -> DataFrame:
    """Treat findings of other categories as clear."""
    kept = F.col("category").isin(*categories) | (F.col("status") == "CLEAR")
    none = F.lit(None).cast("string")
    blank = {"status": F.lit("CLEAR"), "confidence": F.lit(0.0), "category": none, "pii_type": none}
    return findings.select(*[
        F.when(kept, F.col(c)).otherwise(blank[c]).alias(c) if c in blank else F.col(c) for c in findings.columns
    ])


# -- manifests and gate -------------------------------------------------------

_GATE_ORDER = ("CLEAR", "PROCEED_EXCLUDE", "SYNTHETIC_MODE", "BLOCK")


def gate_decision(on_pii_detected: str) -> Column:
    """What to do with a table, from high_count, medium_count and review_count."""
    for_high = {"block": "BLOCK", "synthetic": "SYNTHETIC_MODE", "exclude": "PROCEED_EXCLUDE"}[on_pii_detected]
    return (
        F.when(F.col("high_count") > 0, for_high)
        .when((F.col("medium_count") > 0) | (F.col("review_count") > 0), "PROCEED_EXCLUDE")
        .otherwise("CLEAR")
    )


def gate_reason(on_pii_detected: str) -> Column:
    high, medium, review = F.col("high_count"), F.col("medium_count"), F.col("review_count")
    for_high = {
        "block": F.format_string("Not scanned: personal data is certain in %d columns.", high),
        "synthetic": F.format_string("Only a clone is scanned: personal data is certain in %d columns.", high),
        "exclude": F.format_string(
            "Left out of the scan: %d columns with certain and %d with likely personal data.", high, medium
        ),
    }[on_pii_detected]
    return (
        F.when(high > 0, for_high)
        .when((medium > 0) | (review > 0), F.format_string("To be looked at: %d columns with likely and %d with possible personal data.", medium, review))
        .otherwise("Nothing looks like personal data.")
    )


def manifests(findings: DataFrame, on_pii_detected: str = "exclude", row_counts: DataFrame | None = None) -> DataFrame:
    """One row per table: counts by status, gate, and the findings of its columns."""
    counts = {f"{s.lower()}_count": count_where(F.col("status") == s) for s in ("HIGH", "MEDIUM", "REVIEW", "CLEAR")}
    fields = [c for c in findings.columns if c not in ("table", "ordinal")]
    tested = F.max(F.col("detected_via") != "none")
    per_table = findings.groupBy("table").agg(
        *[c.alias(n) for n, c in counts.items()],
        F.when(tested, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))).alias("passes_run"),
        F.array_sort(F.collect_list(F.struct("ordinal", *fields))).alias("columns"),
    )
    if row_counts is not None:
        per_table = per_table.join(row_counts, "table", "left")
    return (
        per_table.withColumn("gate_decision", gate_decision(on_pii_detected))
        .withColumn("gate_reason", gate_reason(on_pii_detected))
        .withColumn("screened_at", F.current_timestamp())
        .withColumn("scan_id", F.uuid())
    )


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(t).alias("table"), "row_count")
        for t, df in tables.items()
    ])


def worst_gate(per_table: DataFrame) -> DataFrame:
    """The strictest decision of all tables."""
    rank = F.array_position(F.array(*[F.lit(g) for g in _GATE_ORDER]), F.col("gate_decision"))
    return per_table.agg(F.coalesce(F.max_by("gate_decision", rank), F.lit("CLEAR")).alias("gate_decision"))


def excluded_columns(findings: DataFrame) -> DataFrame:
    """Columns that checks must leave alone."""
    return findings.where("status IN ('HIGH', 'MEDIUM')").select("table", "column")


@dataclass
class Screening:
    """What a screen found: findings per column, a manifest per table, the gate of all."""

    findings: DataFrame
    manifests: DataFrame
    gate: str
    excluded: set[tuple[str, str]] = field(default_factory=set)


def screen(
    spark: SparkSession, tables: Mapping[str, DataFrame], config: ScreenConfig = ScreenConfig()
) -> Screening:
    """Screen tables, decide the gate and list the excluded columns.

    Raises :class:`PIIBlocked` when the gate is closed.
    """
    lazy = screen_columns(spark, tables, config)
    rows = lazy.collect()       # one row per column of the tables
    findings = spark.createDataFrame(rows, lazy.schema)
    per_table = manifests(findings, config.on_pii_detected, table_counts(tables))
    gate = worst_gate(manifests(findings, config.on_pii_detected)).first()["gate_decision"]
    if gate == "BLOCK":
        high = sorted(f"{r['table']}.{r['column']}" for r in rows if r["status"] == "HIGH")
        raise PIIBlocked("personal data in " + ", ".join(high))
    barred = {(r["table"], r["column"]) for r in rows if r["status"] in ("HIGH", "MEDIUM")}
    return Screening(findings, per_table, gate, barred)


def tables_of_specs(spark: SparkSession, specs: Iterable[Any], tables: Tables | Mapping[str, Source]) -> dict[str, DataFrame]:
    """The tables that the specs name and that can be opened."""
    resolver = Tables.of(spark, tables)
    data_tables = ("table", "child_table", "parent_table", "source_table", "reference_table",
                   "target_table", "today_table", "prior_table")
    named = {getattr(s, n) for s in as_specs(specs) for n in data_tables} - {None}
    found = {}
    for name in sorted(named):
        if resolver.has(name):
            found[name] = resolver.frame(name)
    return found


# -- further rules, off by default --------------------------------------------

def extra_rule_scan(df: DataFrame, table: str) -> DataFrame:
    """Shares of values that pass the Luhn test of card numbers, and of dates before 2006."""
    aggregates, rows = [], []
    for i, f in enumerate(df.schema.fields):
        col = F.col(quoted(f.name))
        if is_text(f.dataType):
            digits = F.regexp_replace(col, "[ -]", "")
            hit = digits.rlike("^[0-9]{13,19}$") & F.call_function("luhn_check", digits)
            rule = "luhn_card"
        elif isinstance(f.dataType, T.LongType):
            hit = col.cast("string").rlike("^[0-9]{13,19}$") & F.call_function("luhn_check", col.cast("string"))
            rule = "luhn_card"
        elif type_category(f.dataType) == "datetime":
            hit = F.to_date(col) < F.lit("2006-01-01").cast("date")
            rule = "date_before_2006"
        else:
            continue
        aggregates += [F.count(col).alias(f"n{i}"), count_where(hit).alias(f"hits{i}")]
        rows.append(F.struct(
            F.lit(table).alias("table"), F.lit(f.name).alias("column"), F.lit(rule).alias("rule"),
            F.col(f"n{i}").alias("values"), F.col(f"hits{i}").alias("hits"),
            (F.col(f"hits{i}") / F.nullif(F.col(f"n{i}").cast("double"), F.lit(0.0))).alias("hit_ratio"),
        ))
    if not rows:
        raise ValueError(f"table {table!r} has no column the rules look at")
    return df.agg(*aggregates).select(F.inline(F.array(*rows)))
