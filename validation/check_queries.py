"""Check and scoring queries, with their SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline import CHECKS, CheckSpec, ScanResult, scan
from plumbline.plans import report
from validation.cases import AS_OF, CASES, QUERY_NAMES, Case, cases_of
from validation.views import frames, with_views

Query = Callable[[SparkSession, str], DataFrame]


def run_cases(spark: SparkSession, sf_dir: str, cases: Iterable[Case], **options) -> ScanResult:
    return scan(spark, [c.spec for c in cases], frames(spark, sf_dir), as_of=AS_OF, **options)


def _metric_query(name: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return run_cases(spark, sf_dir, cases_of(name)).checks.select(
            "seq", "check_id", "metric_name", F.col("table").alias("table_name"),
            F.col("column").alias("column_name"), F.round("metric_value", 10).alias("metric_value"),
        )
    return query


def _text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def _number(value: float | None) -> str:
    return "CAST(NULL AS DOUBLE)" if value is None else f"CAST({value!r} AS DOUBLE)"


def _metric_rows(cases: Iterable[Case]) -> str:
    """A row per case: what is known of the check, and its metric by SQL."""
    rows = []
    for seq, case in enumerate(cases):
        spec = CheckSpec.from_dict(case.spec)
        d = CHECKS[case.check_id]
        rows.append(
            f"SELECT CAST({seq} AS INTEGER) AS seq, CAST({case.check_id} AS INTEGER) AS check_id,"
            f" {_text(d.metric_name)} AS metric_name, {_text(d.dimension)} AS dimension,"
            f" {_number(d.dimension_weight)} AS dimension_weight, {_number(d.effective_weight)} AS effective_weight,"
            f" {_number(spec.effective_threshold)} AS threshold, {str(d.higher_is_better).upper()} AS higher,"
            f" CAST({_text(spec.table_label)} AS VARCHAR) AS table_name,"
            f" CAST({_text(spec.column_label)} AS VARCHAR) AS column_name, ({case.sql}) AS metric_value"
        )
    return " UNION ALL ".join(rows)


def _metric_sql(name: str) -> str:
    return with_views(
        "SELECT seq, check_id, metric_name, table_name, column_name, round(metric_value, 10) AS metric_value"
        f" FROM ({_metric_rows(cases_of(name))}) m"
    )


# -- scores over all cases ------------------------------------------------------

def _scored_sql(cases: Iterable[Case]) -> str:
    return (
        "SELECT *, CASE WHEN threshold IS NULL THEN TRUE WHEN higher THEN metric_value >= threshold"
        " ELSE metric_value <= threshold END AS passed,"
        " CASE WHEN threshold IS NULL THEN 1.0::DOUBLE"
        " WHEN higher THEN least(1.0::DOUBLE, metric_value / threshold)"
        " WHEN metric_value <= threshold THEN 1.0::DOUBLE"
        " ELSE greatest(0.0::DOUBLE, 1 - (metric_value - threshold) / greatest(threshold, 1e-9)) END AS pass_score"
        f" FROM ({_metric_rows(cases)}) m"
    )


def _dimensions_sql(cases: Iterable[Case]) -> str:
    return (
        "SELECT dimension, dimension_weight,"
        " round(100 * sum(effective_weight * pass_score) / sum(effective_weight), 2) AS dimension_score,"
        " count(*) FILTER (WHERE passed) AS checks_passed, count(*) FILTER (WHERE NOT passed) AS checks_failed,"
        f" CAST(0 AS BIGINT) AS checks_skipped FROM ({_scored_sql(cases)}) s GROUP BY dimension, dimension_weight"
    )


def scan_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_cases(spark, sf_dir, CASES).checks.select(
        "seq", "check_id", "dimension", F.round("metric_value", 10).alias("metric_value"), "threshold", "passed",
        F.round("pass_score", 8).alias("pass_score"), F.round("weighted_score", 8).alias("weighted_score"), "skipped",
    )


def scan_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_cases(spark, sf_dir, CASES).dimensions


def scan_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_cases(spark, sf_dir, CASES).overall


def scan_first_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = ("completeness", "validity", "consistency")
    return run_cases(spark, sf_dir, CASES, mvp_only=True, dimensions=chosen).dimensions


def scan_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The export of a scan.  Reads the tables once and then works on a row per check."""
    return run_cases(spark, sf_dir, CASES, scan_name="all").flat().select(
        "scan_name", "mode", "source", "overall_score", "dimension", "dimension_score", "check_id", "check_name",
        "metric_name", F.round("metric_value", 10).alias("metric_value"), "passed",
        F.col("table").alias("table_name"), F.col("column").alias("column_name"), "error", "skipped",
    )


def report_failed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.failed_checks(run_cases(spark, sf_dir, CASES).checks).select("seq", "check_id", "dimension")


def report_check_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    rolled = report.check_type_rollup(run_cases(spark, sf_dir, CASES).checks)
    return rolled.withColumn("avg_score", F.round("avg_score", 6))


def report_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = report.priorities(run_cases(spark, sf_dir, CASES).checks)
    return top.select("check_id", "dimension", F.col("table").alias("table_name"), F.round("impact", 8).alias("impact"))


def report_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = report.readiness(run_cases(spark, sf_dir, CASES).overall)
    return out.withColumn("gap_to_ready", F.round("gap_to_ready", 2))


def _first_phase_cases() -> list[Case]:
    chosen = ("completeness", "validity", "consistency")
    return [c for c in CASES if CHECKS[c.check_id].phase == "mvp" and CHECKS[c.check_id].dimension in chosen]


def _overall_sql() -> str:
    return (
        "SELECT round(sum(dimension_score * dimension_weight) / sum(dimension_weight), 2) AS overall_score,"
        " CAST(sum(checks_passed + checks_failed) AS BIGINT) AS total_checks,"
        " CAST(sum(checks_passed) AS BIGINT) AS checks_passed, CAST(sum(checks_failed) AS BIGINT) AS checks_failed,"
        f" CAST(0 AS BIGINT) AS checks_skipped FROM ({_dimensions_sql(CASES)}) d"
    )


def _flat_sql() -> str:
    names = " ".join(f"WHEN {d.check_id} THEN {_text(d.check_name)}" for d in CHECKS.values())
    return (
        f"SELECT 'all' AS scan_name, 'live' AS mode, 'spark' AS source,"
        f" (SELECT overall_score FROM ({_overall_sql()}) o) AS overall_score, s.dimension, d.dimension_score,"
        f" s.check_id, CASE s.check_id {names} END AS check_name, s.metric_name,"
        " round(s.metric_value, 10) AS metric_value, s.passed, s.table_name, s.column_name,"
        " CAST(NULL AS VARCHAR) AS error, FALSE AS skipped"
        f" FROM ({_scored_sql(CASES)}) s JOIN ({_dimensions_sql(CASES)}) d ON s.dimension = d.dimension"
    )


def _check_types_sql() -> str:
    names = " ".join(f"WHEN {d.check_id} THEN {_text(d.check_name)}" for d in CHECKS.values())
    return (
        f"SELECT dimension, check_id, CASE check_id {names} END AS check_name,"
        " count(*) FILTER (WHERE passed) AS n_passed, count(*) FILTER (WHERE NOT passed) AS n_failed,"
        " CAST(0 AS BIGINT) AS n_skipped, round(avg(pass_score) * 100, 6) AS avg_score,"
        " arg_min_null(table_name, seq) FILTER (WHERE NOT passed) AS worst_table"
        f" FROM ({_scored_sql(CASES)}) s GROUP BY dimension, check_id"
    )


def _priorities_sql() -> str:
    impact = (
        "(CASE WHEN check_id IN (9, 11, 13, 15, 16, 26) THEN 3 WHEN check_id IN (1, 4, 5, 17, 18, 22, 23, 25) THEN 2"
        " ELSE 1 END) * dimension_weight * (1 - pass_score)"
    )
    ranked = (
        f"SELECT *, {impact} AS impact FROM ({_scored_sql(CASES)}) s WHERE NOT passed"
    )
    return (
        "SELECT check_id, dimension, table_name, round(impact, 8) AS impact FROM"
        f" (SELECT *, row_number() OVER (PARTITION BY check_id ORDER BY impact DESC, seq) AS place FROM ({ranked}) r) p"
        " WHERE place = 1 ORDER BY p.impact DESC, p.seq LIMIT 5"
    )


def _readiness_sql() -> str:
    return (
        "SELECT overall_score, round(greatest(0.0, 90 - overall_score), 2) AS gap_to_ready,"
        " CAST(least(100, floor(overall_score / 90 * 100)) AS INTEGER) AS ready_pct,"
        " CASE WHEN overall_score >= 90 THEN 'Excellent' WHEN overall_score >= 70 THEN 'Good'"
        f" WHEN overall_score >= 50 THEN 'Fair' ELSE 'Poor' END AS band FROM ({_overall_sql()}) o"
    )


def queries() -> dict[str, Query]:
    return {name: _metric_query(name) for name in QUERY_NAMES} | {
        "scan_checks": scan_checks,
        "scan_dimensions": scan_dimensions,
        "scan_overall": scan_overall,
        "scan_first_phase": scan_first_phase,
        "scan_flat": scan_flat,
        "report_failed": report_failed,
        "report_check_types": report_check_types,
        "report_priorities": report_priorities,
        "report_readiness": report_readiness,
    }


def oracle_sql() -> dict[str, str]:
    scores = (
        "SELECT seq, check_id, dimension, round(metric_value, 10) AS metric_value, threshold, passed,"
        " round(pass_score, 8) AS pass_score, round(effective_weight * pass_score, 8) AS weighted_score,"
        f" FALSE AS skipped FROM ({_scored_sql(CASES)}) s"
    )
    return {name: _metric_sql(name) for name in QUERY_NAMES} | {
        "scan_checks": with_views(scores),
        "scan_dimensions": with_views(_dimensions_sql(CASES)),
        "scan_overall": with_views(_overall_sql()),
        "scan_first_phase": with_views(_dimensions_sql(_first_phase_cases())),
        "scan_flat": with_views(_flat_sql()),
        "report_failed": with_views(f"SELECT seq, check_id, dimension FROM ({_scored_sql(CASES)}) s WHERE NOT passed"),
        "report_check_types": with_views(_check_types_sql()),
        "report_priorities": with_views(_priorities_sql()),
        "report_readiness": with_views(_readiness_sql()),
    }
