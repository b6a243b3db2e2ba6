"""Checks that look at one row at a time and share one scan of the table."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import is_text, typed_literal
from plumbline.functions.predicates import as_number, count_where, fails_cast, finite, label, ratio, rows, share
from plumbline.functions.timing import hours_between, wall_time
from plumbline.operators.registry import over_table, plans_check
from plumbline.plans.measure import Measure, ScanContext
from plumbline.spec import CheckSpec


def _columns(spec: CheckSpec) -> tuple[str, ...]:
    named = spec.need("columns", "column")
    return (named,) if isinstance(named, str) else named


# -- completeness -----------------------------------------------------------

@plans_check(1)
def null_ratio(spec: CheckSpec, ctx: ScanContext) -> Measure:
    table, name = spec.need("table"), spec.need("column")
    missing = rows() - F.count(ctx.col(table, name))
    return over_table(table, share(missing, rows()), name)


@plans_check(2)
def critical_null_ratio(spec: CheckSpec, ctx: ScanContext) -> Measure:
    table, names = spec.need("table"), _columns(spec)
    cells = rows() * len(names)
    present = sum((F.count(ctx.col(table, c)) for c in names), F.lit(0))
    return over_table(table, share(cells - present, cells), names[0], slots=len(names))


@plans_check(3)
def empty_row_count(spec: CheckSpec, ctx: ScanContext) -> Measure:
    table, names = spec.need("table"), _columns(spec)
    empty = reduce(and_, [ctx.col(table, c).isNull() for c in names])
    return over_table(table, count_where(empty), names[0])


@plans_check(4)
def conditional_missing_ratio(spec: CheckSpec, ctx: ScanContext) -> Measure:
    """Rows that meet the condition but lack the dependent value, among all rows."""
    table, condition = spec.need("table"), F.expr(spec.need("condition"))
    name = spec.need("dependent_column", "column")
    return over_table(table, ratio(condition & ctx.col(table, name).isNull()), name)


# -- validity ---------------------------------------------------------------

@plans_check(8)
def type_error_ratio(spec: CheckSpec, ctx: ScanContext) -> Measure:
    table, name = spec.need("table"), spec.need("column")
    target = spec.extra.get("expected_type") or "DOUBLE"
    return over_table(table, ratio(fails_cast(ctx.col(table, name), ctx.type_of(table, name), target)), name)


@plans_check(9, 15)
def outside_domain_ratio(spec: CheckSpec, ctx: ScanContext) -> Measure:
    """Values outside the allowed ones: of any column (9), of a unit or currency (15)."""
    table, name = spec.need("table"), spec.need("column")
    kind = ctx.type_of(table, name)
    allowed = [typed_literal(v, kind) for v in spec.need("allowed_values")]
    return over_table(table, ratio(~ctx.col(table, name).isin(*allowed)), name)


@plans_check(10)
def format_violation_ratio(spec: CheckSpec, ctx: ScanContext) -> Measure:
    table, name = spec.need("table"), spec.need("column")
    text = ctx.col(table, name).cast("string")
    return over_table(table, ratio(~text.rlike(spec.need("pattern"))), name)


@plans_check(11)
def range_violation_ratio(spec: CheckSpec, ctx: ScanContext) -> Measure:
    table, name = spec.need("table"), spec.need("column")
    spec.need("min_value", "max_value")
    kind = ctx.type_of(table, name)
    value = as_number(ctx.col(table, name), kind)
    limit = lambda v: F.lit(v).cast(kind) if isinstance(kind, T.FloatType) else F.lit(v)
    outside = F.lit(False)
    if spec.min_value is not None:
        outside = outside | (value < limit(spec.min_value))
    if spec.max_value is not None:
        outside = outside | (value > limit(spec.max_value))
    return over_table(table, ratio(outside), name)


@plans_check(12)
def negative_value_ratio(spec: CheckSpec, ctx: ScanContext) -> Measure:
    table, name = spec.need("table"), spec.need("column")
    value = as_number(ctx.col(table, name), ctx.type_of(table, name))
    return over_table(table, ratio(value < 0), name)


# -- consistency and accuracy -----------------------------------------------

@plans_check(13)
def cross_field_error_ratio(spec: CheckSpec, ctx: ScanContext) -> Measure:
    """Rows for which the condition, which describes the violation, is true."""
    return over_table(spec.need("table"), ratio(F.expr(spec.need("condition"))), spec.condition)


@plans_check(16)
def standardization_issue_ratio(spec: CheckSpec, ctx: ScanContext) -> Measure:
    table, name = spec.need("table"), spec.need("column")
    canonical = [label(F.lit(str(v))) for v in spec.need("allowed_values")]
    return over_table(table, ratio(~label(ctx.col(table, name)).isin(*canonical)), name)


@plans_check(26)
def business_rule_error_ratio(spec: CheckSpec, ctx: ScanContext) -> Measure:
    """Rows that break the rule: a condition, or revenue = price * quantity to the cent."""
    table = spec.need("table")
    if spec.condition:
        return over_table(table, ratio(~F.expr(spec.condition)), spec.condition)
    price, quantity, revenue = (
        ctx.col(table, spec.need(p, "condition"))
        for p in ("price_column", "quantity_column", "revenue_column")
    )
    return over_table(table, ratio(F.abs(revenue - price * quantity) > F.lit(0.01)), spec.revenue_column)


# -- freshness --------------------------------------------------------------

@plans_check(20)
def freshness_lag_hours(spec: CheckSpec, ctx: ScanContext) -> Measure:
    table, name = spec.need("table"), spec.need("timestamp_column")
    return over_table(table, hours_between(_latest(ctx, table, name), ctx.now()), name)


@plans_check(21)
def stale_table_flag(spec: CheckSpec, ctx: ScanContext) -> Measure:
    """1 if the newest row is older than the allowed days, to the second."""
    table, name = spec.need("table"), spec.need("timestamp_column")
    days = 1.0 if spec.stale_days is None else float(spec.stale_days)
    window = F.make_dt_interval(secs=F.lit(days * 86400.0).cast("decimal(18,6)"))
    flag = F.when(_latest(ctx, table, name) < ctx.now() - window, 1).otherwise(0)
    return over_table(table, flag, name)


@plans_check(22)
def late_arrival_ratio(spec: CheckSpec, ctx: ScanContext) -> Measure:
    table = spec.need("table")
    event = spec.need("event_timestamp_column")
    load = spec.need("load_timestamp_column", "timestamp_column")
    allowed = 24.0 if spec.late_arrival_hours is None else float(spec.late_arrival_hours)
    delay = hours_between(ctx.time(table, event), ctx.time(table, load))
    return over_table(table, ratio(delay > F.lit(allowed)), load)


def _latest(ctx: ScanContext, table: str, name: str) -> Column:
    if is_text(ctx.type_of(table, name)):
        return F.max(ctx.time(table, name))
    # Take the maximum of the stored value and convert that one value.
    return wall_time(F.max(ctx.col(table, name)), ctx.type_of(table, name))


# -- volume inside one table, and coefficient of variation -------------------

@plans_check(23)
def volume_change_pct(spec: CheckSpec, ctx: ScanContext) -> Measure:
    """Change of the row count against a prior table, or against the rows that
    do not meet the condition."""
    from plumbline.operators.joins import against_table

    today = spec.need("today_table", "table")
    if spec.prior_table:
        return against_table(today, spec.prior_table, None, None, _relative_count_change)
    condition = spec.need("condition", "prior_table")
    meets, fails = count_where(F.expr(condition)), count_where(~F.expr(condition))
    return over_table(today, share(F.abs(meets - fails), fails), condition, slots=2)


def _relative_count_change(left: Column, right: Column) -> Column:
    return share(F.abs(F.count(left) - F.count(right)), F.count(right))


def drift_without_baseline(table: str, name: str, ctx: ScanContext) -> Measure:
    value = finite(ctx.col(table, name))
    spread = F.stddev_samp(value) / F.nullif(F.abs(F.avg(value)), F.lit(0.0))
    return over_table(table, spread, name, slots=5)
