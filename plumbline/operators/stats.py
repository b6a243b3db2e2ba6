"""Outliers: by distance from the mean (two passes over any number of columns of a table), from the quartiles, or from
the median (exact quantiles of all columns together, then one count)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from plumbline.functions.predicates import count_where, finite, share
from plumbline.operators.order_stats import as_row, quantiles
from plumbline.operators.registry import plans_check
from plumbline.plans.measure import Measure, ScanContext, long_rows
from plumbline.spec import CheckSpec, SpecError

# Usual limits: the fences' distance in quartile ranges, and the median's in deviations (scaled to the normal one).
_FACTORS = {"iqr": 1.5, "mad": 3.5}
_NORMAL = 0.6745


def outlier_pass(ctx: ScanContext, key: tuple, measures) -> DataFrame:
    """Mean and deviation of all columns as one scalar subquery, then one count of all columns."""
    (table,) = key
    df = ctx.frame(table)
    names = sorted({m.payload[0] for m in measures})
    at = {name: i for i, name in enumerate(names)}
    values = {name: finite(ctx.col(table, name)) for name in names}
    facts = []
    for name, i in at.items():
        facts.append(F.avg(values[name]).alias(f"mean{i}"))
        # NULL for a constant column: it has no outliers
        facts.append(F.nullif(F.stddev_samp(values[name]), F.lit(0.0)).alias(f"deviation{i}"))
    known = df.agg(F.struct(*facts).alias("known")).scalar()

    def outliers(name: str, z: float):
        i = at[name]
        distance = F.abs(values[name] - known.getField(f"mean{i}")) / known.getField(f"deviation{i}")
        return share(count_where(distance > F.lit(z)), F.count(values[name]))

    wide = df.agg(*[outliers(*m.payload).alias(f"m{m.seq}") for m in measures])
    return long_rows(wide, [m.seq for m in measures])


def fence_pass(ctx: ScanContext, key: tuple, measures) -> DataFrame:
    """Values beyond the quartiles by more than `factor` quartile ranges, for all columns together."""
    (table,) = key
    df, shares = ctx.frame(table), (0.25, 0.75)
    names = sorted({m.payload[0] for m in measures})
    values = [finite(ctx.col(table, name)) for name in names]
    known = as_row(quantiles(df, values, shares), len(names), shares)

    def outside(name: str, factor: float):
        i = names.index(name)
        low, high = known.getField(f"q{i}_0"), known.getField(f"q{i}_1")
        beyond = (values[i] < low - factor * (high - low)) | (values[i] > high + factor * (high - low))
        return share(count_where(beyond), F.count(values[i]))

    wide = df.agg(*[outside(*m.payload).alias(f"m{m.seq}") for m in measures])
    return long_rows(wide, [m.seq for m in measures])


def median_pass(ctx: ScanContext, key: tuple, measures) -> DataFrame:
    """Values whose distance from the median is more than `factor` times the median of these distances."""
    (table,) = key
    df, half = ctx.frame(table), (0.5,)
    names = sorted({m.payload[0] for m in measures})
    values = [finite(ctx.col(table, name)) for name in names]
    middle = as_row(quantiles(df, values, half), len(names), half)
    distances = [F.abs(v - middle.getField(f"q{i}_0")) for i, v in enumerate(values)]
    usual = as_row(quantiles(df, distances, half), len(names), half)

    def far(name: str, factor: float):
        i = names.index(name)
        # NULL where half of the values are equal: there are no outliers by this rule
        beyond = _NORMAL * distances[i] / F.nullif(usual.getField(f"q{i}_0"), F.lit(0.0)) > factor
        return share(count_where(beyond), F.count(values[i]))

    wide = df.agg(*[far(*m.payload).alias(f"m{m.seq}") for m in measures])
    return long_rows(wide, [m.seq for m in measures])


@plans_check(28)
def outlier_ratio(spec: CheckSpec, ctx: ScanContext) -> Measure:
    """``extra.method`` is ``z`` (distance from the mean), ``iqr`` or ``mad``; ``extra.factor`` is the limit of the last two,
    whose quantiles are found while the pass is planned."""
    table, name = spec.need("table"), spec.need("metric_column", "column")
    ctx.type_of(table, name)
    method = str(spec.extra.get("method") or "z").lower()
    if method in _FACTORS:
        factor = float(spec.extra.get("factor") or _FACTORS[method])
        compute = fence_pass if method == "iqr" else median_pass
        return Measure(compute, (table,), (name, factor), f"{name} beyond {factor} {method} FROM {table}", affinity=name)
    if method != "z":
        raise SpecError(f"check 28 has no method {method!r}")
    z = float(spec.outlier_z_threshold or 3.0)
    return Measure(
        outlier_pass, (table,), (name, z), f"ABS({name} - mean) / deviation > {z} FROM {table}",
        slots=5, affinity=name,
    )
