"""Duplicate checks: one grouping of the key columns, shared by all checks on that key."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.functions.columns import is_text
from plumbline.functions.predicates import count_where, label, share
from plumbline.operators.fuzzy import fuzzy_groups
from plumbline.operators.registry import plans_check
from plumbline.plans.measure import Measure, ScanContext, aggregate_measures
from plumbline.spec import CheckSpec


def key_pass(ctx: ScanContext, key: tuple, measures) -> DataFrame:
    """Rows per key value; counts are combined in each task before the shuffle.  Texts are grouped by two 64-bit hashes,
    so that long ones are not shuffled; a missing value stays missing."""
    table, normalised, names = key
    parts = [ctx.col(table, n) for n in names]
    if normalised:
        parts = [label(p) for p in parts]
    hashed = [normalised or is_text(ctx.type_of(table, n)) for n in names]
    parts = [F.when(p.isNotNull(), F.struct(F.xxhash64(p), F.xxhash64(F.lit(1), p))) if h else p for p, h in zip(parts, hashed)]
    keyed = ctx.frame(table).select(*[p.alias(f"k{i}") for i, p in enumerate(parts)])
    groups = keyed.groupBy(*keyed.columns).agg(F.count(F.lit(1)).alias("n"))
    return aggregate_measures(groups, measures)


def _over_key(ctx: ScanContext, table: str, names: tuple[str, ...], normalised: bool, metric, text: str) -> Measure:
    for name in names:
        ctx.type_of(table, name)
    return Measure(key_pass, (table, normalised, names), metric, f"{text} of {table}({', '.join(names)})")


def _duplicates(distinct):
    return share(F.sum("n") - distinct, F.sum("n"))


@plans_check(5)
def pk_duplicate_ratio(spec: CheckSpec, ctx: ScanContext) -> Measure:
    """Rows beyond the distinct keys; a NULL key is no key, so its row counts as one of them."""
    name = spec.need("pk_column", "column")
    return _over_key(ctx, spec.need("table"), (name,), False, _duplicates(F.count("k0")), "duplicate rows")


@plans_check(6)
def business_duplicate_ratio(spec: CheckSpec, ctx: ScanContext) -> Measure:
    """As check 5 for a tuple of columns, where a tuple with NULL parts is a value."""
    names = spec.need("business_key_columns", "column")
    names = (names,) if isinstance(names, str) else tuple(names)
    distinct = F.count("k0") if len(names) == 1 else F.count(F.lit(1))
    return _over_key(ctx, spec.need("table"), names, False, _duplicates(distinct), "duplicate rows")


def fuzzy_pass(ctx: ScanContext, key: tuple, measures) -> DataFrame:
    """Groups of values within some edits of each other.  Pairs and groups are found while the pass is planned."""
    table, names, edits = key
    groups = fuzzy_groups(ctx.frame(table), [ctx.col(table, n) for n in names], edits)
    return aggregate_measures(groups.groupBy("group").agg(F.sum("rows").alias("n")), measures)


@plans_check(7)
def near_duplicate_count(spec: CheckSpec, ctx: ScanContext) -> Measure:
    """Groups of rows that are equal but for case and outer blanks, and for as many edits as ``extra.max_edits`` says."""
    names = spec.need("columns", "column")
    names = (names,) if isinstance(names, str) else tuple(names)
    edits = int(spec.extra.get("max_edits") or 0)
    if edits:
        for name in names:
            ctx.type_of(spec.need("table"), name)
        text = f"groups within {edits} edits of {spec.table}({', '.join(names)})"
        return Measure(fuzzy_pass, (spec.need("table"), names, edits), count_where(F.col("n") > 1), text)
    return _over_key(ctx, spec.need("table"), names, True, count_where(F.col("n") > 1), "near-duplicate groups")
