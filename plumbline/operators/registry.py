"""Check id -> function that plans the check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column

from plumbline.catalog import CHECKS, DIMENSION_WEIGHTS, CheckDef
from plumbline.plans.measure import Measure, ScanContext, aggregate_measures, describe
from plumbline.spec import CheckSpec

Builder = Callable[[CheckSpec, ScanContext], Measure]

BUILDERS: dict[int, Builder] = {}


def plans_check(*check_ids: int) -> Callable[[Builder], Builder]:
    def add(build: Builder) -> Builder:
        for check_id in check_ids:
            BUILDERS[check_id] = build
        return build
    return add


def table_pass(ctx: ScanContext, key: tuple, measures) -> "DataFrame":
    """All aggregates over one table, in one scan."""
    return aggregate_measures(ctx.frame(key[0]), measures)


def over_table(table: str, metric: Column, affinity: str = "", slots: int = 1) -> Measure:
    return Measure(
        table_pass, (table,), metric, f"SELECT {describe(metric)} FROM {table}",
        slots=slots, affinity=affinity,
    )


def register_check(
    definition: CheckDef,
    metric: Callable[[CheckSpec, ScanContext], Column],
) -> None:
    """Add a check of your own.

    ``metric`` returns an aggregate column over the table of the spec; the check
    then shares the scan of all other checks on that table.
    """
    if definition.check_id in CHECKS:
        raise ValueError(f"check {definition.check_id} exists")
    if definition.dimension not in DIMENSION_WEIGHTS:
        raise ValueError(f"unknown dimension {definition.dimension!r}")
    CHECKS[definition.check_id] = definition

    def build(spec: CheckSpec, ctx: ScanContext) -> Measure:
        return over_table(spec.need("table"), metric(spec, ctx), spec.column_label or "", slots=4)

    BUILDERS[definition.check_id] = build
