"""From metrics to scores."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.plans.measure import local_frame

# Limit of a zero threshold: any violation then scores 0.
_SMALLEST_LIMIT = 1e-9


def spec_frame(plan) -> DataFrame:
    """What is known of each check before it runs, one row per check."""
    rows = plan.rows
    of = lambda pick: [pick(r) for r in rows]
    return local_frame(plan.ctx.spark, {
        "seq": (of(lambda r: r.seq), pa.int32()),
        "check_id": (of(lambda r: r.spec.check_id), pa.int32()),
        "check_name": (of(lambda r: r.spec.definition.check_name), pa.string()),
        "dimension": (of(lambda r: r.spec.definition.dimension), pa.string()),
        "dimension_weight": (of(lambda r: r.spec.definition.dimension_weight), pa.float64()),
        "metric_name": (of(lambda r: r.spec.definition.metric_name), pa.string()),
        "threshold": (of(lambda r: r.spec.effective_threshold), pa.float64()),
        "higher_is_better": (of(lambda r: r.spec.definition.higher_is_better), pa.bool_()),
        "effective_weight": (of(lambda r: r.spec.definition.effective_weight), pa.float64()),
        "table": (of(lambda r: r.spec.table_label), pa.string()),
        "column": (of(lambda r: r.spec.column_label), pa.string()),
        "skip_reason": (of(lambda r: r.skip), pa.string()),
        "plan_error": (of(lambda r: r.error), pa.string()),
        "executed": (of(lambda r: r.measure.text if r.measure else None), pa.string()),
        "runs": (of(lambda r: bool(r.measure) and not r.error), pa.bool_()),
    })


def pass_score(metric: Column, threshold: Column, higher_is_better: Column) -> Column:
    """1 within the threshold; outside it, falling linearly to 0 with the distance."""
    limit = F.greatest(threshold, F.lit(_SMALLEST_LIMIT))
    above = F.when(metric >= threshold, 1.0).otherwise(F.greatest(F.lit(0.0), metric / limit))
    below = F.when(metric <= threshold, 1.0).otherwise(
        F.greatest(F.lit(0.0), F.lit(1.0) - (metric - threshold) / limit)
    )
    return F.when(higher_is_better, above).otherwise(below)


def within_threshold(metric: Column, threshold: Column, higher_is_better: Column) -> Column:
    return F.when(higher_is_better, metric >= threshold).otherwise(metric <= threshold)


def verdicts(measured: DataFrame) -> DataFrame:
    """Add skipped, passed, pass_score and weighted_score to rows with metric_value,
    threshold, higher_is_better, effective_weight, error and skip_reason."""
    metric, threshold = F.col("metric_value"), F.col("threshold")
    advisory, failed_to_run = threshold.isNull(), F.col("error").isNotNull()
    excluded = F.col("skip_reason").isNotNull()
    no_value = ~advisory & ~failed_to_run & metric.isNull()
    skipped = excluded | no_value
    passed = (
        F.when(skipped, False).when(advisory, True).when(failed_to_run, False)
        .otherwise(within_threshold(metric, threshold, F.col("higher_is_better")))
    )
    points = (
        F.when(skipped | advisory, 1.0).when(failed_to_run, 0.0)
        .otherwise(pass_score(metric, threshold, F.col("higher_is_better")))
    )
    return (
        measured.withColumn("skipped", skipped)
        .withColumn("passed", passed)
        .withColumn("pass_score", points)
        .withColumn("weighted_score", F.col("effective_weight") * F.col("pass_score"))
    )


def score_checks(plan, metrics: DataFrame) -> DataFrame:
    specs = spec_frame(plan)
    value = F.when(~F.isnan("metric_value"), F.col("metric_value")).alias("metric_value")
    # The spec frame is a local list of one row per check, so its size is known.
    ran = metrics.join(F.broadcast(specs.where("runs")), "seq").select(
        *specs.columns, value, F.col("error"),
    )
    idle = specs.where("NOT runs").select(
        *specs.columns,
        F.lit(None).cast("double").alias("metric_value"),
        F.coalesce("plan_error", F.when(F.col("skip_reason") == "pii_excluded", F.col("skip_reason"))).alias("error"),
    )
    return verdicts(ran.unionByName(idle)).select(
        "seq", "dimension", "dimension_weight", "check_id", "check_name", "metric_name",
        "metric_value", "threshold", "passed", "pass_score", "effective_weight",
        "weighted_score", "table", "column", "error", "skipped", "executed",
    )


def score_dimensions(checks: DataFrame) -> DataFrame:
    """Weighted mean of the pass scores per dimension, 0 to 100, heaviest dimension first."""
    counted = ~F.col("skipped")
    weight = F.sum(F.when(counted, F.col("effective_weight")))
    points = F.sum(F.when(counted, F.col("weighted_score")))
    score = F.when(weight > 0, points / weight * 100).otherwise(F.lit(100.0))
    return (
        checks.groupBy("dimension", "dimension_weight")
        .agg(
            F.round(score, 2).alias("dimension_score"),
            F.count_if(counted & F.col("passed")).alias("checks_passed"),
            F.count_if(counted & ~F.col("passed")).alias("checks_failed"),
            F.count_if(F.col("skipped")).alias("checks_skipped"),
        )
        .orderBy(F.desc("dimension_weight"), "dimension")
    )


def score_overall(dimensions: DataFrame) -> DataFrame:
    """Mean of the dimension scores, weighted by dimension, over the dimensions covered."""
    weight = F.sum("dimension_weight")
    mean = F.sum(F.col("dimension_score") * F.col("dimension_weight")) / weight
    count = lambda name: F.coalesce(F.sum(name), F.lit(0)).alias(name)
    return dimensions.agg(
        F.when(weight > 0, F.round(mean, 2)).otherwise(F.lit(100.0)).alias("overall_score"),
        F.coalesce(
            F.sum(F.col("checks_passed") + F.col("checks_failed") + F.col("checks_skipped")), F.lit(0)
        ).alias("total_checks"),
        count("checks_passed"), count("checks_failed"), count("checks_skipped"),
    )


def flatten(result) -> DataFrame:
    """Checks with the scores of their dimension and of the whole scan.

    Called on a materialized result, whose frames are one row per check.
    """
    scores = result.dimensions.select("dimension", "dimension_score")
    overall = result.overall.select("overall_score").scalar()
    return (
        result.checks.join(F.broadcast(scores), "dimension")
        .select(
            F.lit(result.scan_name).alias("scan_name"),
            F.lit(result.mode).alias("mode"),
            F.lit(result.source).alias("source"),
            overall.alias("overall_score"),
            "dimension", "dimension_weight", "dimension_score",
            "check_id", "check_name", "metric_name", "metric_value", "threshold",
            "passed", "pass_score", "effective_weight", "weighted_score",
            "table", "column", "error", "skipped",
            F.current_timestamp().alias("timestamp"), "executed", "seq",
        )
    )
