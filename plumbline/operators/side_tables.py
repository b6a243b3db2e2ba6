"""Checks that read a table kept next to the data: schema baseline, catalog, pipeline runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.functions.columns import find_field
from plumbline.functions.predicates import count_where, share, spark_type_name, spark_type_names
from plumbline.operators.registry import over_table, plans_check
from plumbline.plans.measure import Measure, ScanContext, aggregate_measures
from plumbline.spec import CheckSpec


def _last_part(table: str) -> str:
    return table.split(".")[-1].strip('"`')


def drift_pass(ctx: ScanContext, key: tuple, measures) -> DataFrame:
    table, baseline = key
    rows = ctx.frame(baseline).where(F.lower("table_name") == _last_part(table).lower())
    schema = [p.strip('"`').lower() for p in table.split(".")[-2:-1]]
    if schema and find_field(rows.schema, "table_schema"):      # two schemas may have tables of one name
        rows = rows.where(F.lower("table_schema") == schema[0])
    return aggregate_measures(rows, measures)


@plans_check(30)
def schema_drift_events(spec: CheckSpec, ctx: ScanContext) -> Measure:
    """Columns added, removed or of another type than in the baseline.

    The current schema is known while planning, so it enters as literals and the
    baseline is read once.
    """
    table, baseline = spec.need("table"), spec.need("reference_table")
    for name in ("table_name", "column_name", "data_type"):
        ctx.field(baseline, name)
    current = {f.name.lower(): spark_type_name(f.dataType.simpleString()) for f in ctx.schema(table).fields}
    pairs = [F.lit(x) for item in current.items() for x in item]
    name = F.lower("column_name")
    now = F.try_element_at(F.create_map(*pairs), name)
    then = spark_type_names(F.col("data_type"))
    # A baseline that says no more than "timestamp" leaves the zone open.
    same = (now == then) | ((then == "timestamp") & (F.trim(F.lower("data_type")) == "timestamp") & now.isin("timestamp", "timestamp_ntz"))
    known = F.count_distinct(F.when(now.isNotNull(), name))
    added = F.lit(len(current)) - known
    removed = count_where(now.isNull())
    changed = count_where(~same)
    return Measure(
        drift_pass, (table, baseline), added + removed + changed,
        f"added, removed and changed columns of {table} against {baseline}",
    )


@plans_check(31)
def metadata_gap_ratio(spec: CheckSpec, ctx: ScanContext) -> Measure:
    """Catalog rows, of one table or of all, without a description or an owner."""
    catalog = spec.need("metadata_catalog_table")
    gap = ctx.col(catalog, "description").isNull() | ctx.col(catalog, "owner").isNull()
    mine = F.lit(True)
    if spec.table:
        mine = F.lower(ctx.col(catalog, "table_name")) == _last_part(spec.table).lower()
    return over_table(catalog, share(count_where(mine & gap), count_where(mine)), slots=2)


@plans_check(32)
def pipeline_failure_ratio(spec: CheckSpec, ctx: ScanContext) -> Measure:
    """Failed runs among the runs of one dataset, or of all; ``extra.since`` bounds their time."""
    runs = spec.need("pipeline_runs_table")
    dataset = spec.dataset_name or (_last_part(spec.table) if spec.table else None)
    mine = F.lit(True)
    if dataset:
        mine = F.lower(ctx.col(runs, "dataset_name")) == dataset.lower()
    if spec.extra.get("since"):
        mine = mine & (ctx.time(runs, "run_ts") >= F.lit(str(spec.extra["since"])).cast("timestamp_ntz"))
    failed = F.lower(ctx.col(runs, "run_status")) == "failed"
    return over_table(runs, share(count_where(mine & failed), count_where(mine)), slots=2)
