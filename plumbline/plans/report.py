"""Roll-ups of check rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

READY_SCORE = 90.0

# Urgency of a failing check; all others have 1.
_TIER_3 = (9, 11, 15, 16, 26, 13)
_TIER_2 = (4, 22, 23, 25, 1, 5, 17, 18)


def failed_checks(checks: DataFrame) -> DataFrame:
    return checks.where(~F.col("passed") & ~F.col("skipped"))


def check_type_rollup(checks: DataFrame) -> DataFrame:
    """Counts and mean score per kind of check, with the table that failed first."""
    failing = ~F.col("passed") & ~F.col("skipped")
    first = F.min(F.when(failing, F.struct("seq", F.col("table").alias("table"))))
    return checks.groupBy("dimension", "check_id", "check_name").agg(
        F.count_if(~F.col("skipped") & F.col("passed")).alias("n_passed"),
        F.count_if(failing).alias("n_failed"),
        F.count_if(F.col("skipped")).alias("n_skipped"),
        F.coalesce(F.avg(F.when(~F.col("skipped"), F.col("pass_score"))) * 100, F.lit(100.0)).alias("avg_score"),
        first["table"].alias("worst_table"),
    )


def impact(check_id: Column, dimension_weight: Column, points: Column) -> Column:
    tier = F.when(check_id.isin(*_TIER_3), 3).when(check_id.isin(*_TIER_2), 2).otherwise(1)
    return tier * dimension_weight * (F.lit(1.0) - points)


def priorities(checks: DataFrame, top: int = 5) -> DataFrame:
    """The failing checks that matter most, the worst one of each kind."""
    ranked = (
        failed_checks(checks).where(F.col("error").isNull())
        .withColumn("impact", impact(F.col("check_id"), F.col("dimension_weight"), F.col("pass_score")))
    )
    worst_first = Window.partitionBy("check_id").orderBy(F.desc("impact"), "seq")
    return (
        ranked.withColumn("rank", F.row_number().over(worst_first)).where("rank = 1").drop("rank")
        .orderBy(F.desc("impact"), "seq").limit(top)
        .select("check_id", "check_name", "dimension", "table", "column", "metric_value", "threshold", "impact")
    )


def readiness(overall: DataFrame) -> DataFrame:
    """Points missing to a ready score, and the share of it that is reached."""
    score = F.col("overall_score")
    return overall.select(
        "overall_score",
        F.greatest(F.lit(0.0), F.lit(READY_SCORE) - score).alias("gap_to_ready"),
        F.least(F.lit(100), F.floor(score / READY_SCORE * 100).cast("int")).alias("ready_pct"),
        score_band(score).alias("band"),
    )


def score_band(score: Column) -> Column:
    return F.when(score >= 90, "Excellent").when(score >= 70, "Good").when(score >= 50, "Fair").otherwise("Poor")
