"""The check catalog: names, weights, thresholds, phases and directions.

Weights have two levels.  A dimension has a weight among all dimensions, a
check has a weight inside its dimension, and the product of the two is the
weight with which one executed check enters a score.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class CheckDef:
    check_id: int
    dimension: str
    metric_name: str
    check_name: str
    within_weight: float
    threshold: float | None      # None: advisory, recorded but never failed
    phase: str
    higher_is_better: bool = False

    @property
    def dimension_weight(self) -> float:
        return DIMENSION_WEIGHTS[self.dimension]

    @property
    def effective_weight(self) -> float:
        return self.dimension_weight * self.within_weight


# Weight of each dimension.  They sum to 1.
DIMENSION_WEIGHTS = {
    "completeness": 0.20,
    "uniqueness": 0.14,
    "validity": 0.14,
    "integrity": 0.12,
    "accuracy": 0.10,
    "freshness": 0.09,
    "consistency": 0.08,
    "volume": 0.05,
    "anomaly": 0.03,
    "schema": 0.02,
    "pipeline": 0.01,
    "time_series": 0.01,
    "metadata": 0.01,
}

# One line per check.  Inside a dimension the weights sum to 1.
_DEFINITIONS = (
    CheckDef(1, "completeness", "null_ratio", "Null Ratio by Column", 0.30, 0.05, "mvp"),
    CheckDef(2, "completeness", "critical_null_ratio", "Null Ratio in Critical Columns", 0.40, 0.01, "mvp"),
    CheckDef(3, "completeness", "empty_row_count", "Empty Row Check", 0.10, 0.0, "mvp"),
    CheckDef(4, "completeness", "conditional_missing_ratio", "Conditional Completeness", 0.20, 0.01, "mvp"),
    CheckDef(5, "uniqueness", "pk_duplicate_ratio", "Primary Key Duplicate Ratio", 0.55, 0.0, "mvp"),
    CheckDef(6, "uniqueness", "business_duplicate_ratio", "Business Key Duplicate Ratio", 0.35, 0.005, "mvp"),
    CheckDef(7, "uniqueness", "near_duplicate_count", "Near-Duplicate Candidate Check", 0.10, None, "mvp"),
    CheckDef(8, "validity", "type_error_ratio", "Data Type Conformance", 0.30, 0.005, "mvp"),
    CheckDef(9, "validity", "domain_violation_ratio", "Allowed Value / Domain Check", 0.25, 0.0, "mvp"),
    CheckDef(10, "validity", "format_violation_ratio", "Format Validation", 0.20, 0.005, "mvp"),
    CheckDef(11, "validity", "range_violation_ratio", "Range Validation", 0.15, 0.005, "mvp"),
    CheckDef(12, "validity", "negative_value_ratio", "Negative Value Check", 0.10, 0.0, "mvp"),
    CheckDef(13, "consistency", "cross_field_error_ratio", "Cross-Field Consistency", 0.35, 0.0, "phase2"),
    CheckDef(14, "consistency", "cross_table_mismatch_ratio", "Cross-Table Consistency", 0.35, 0.005, "phase2"),
    CheckDef(15, "consistency", "unit_mismatch_ratio", "Unit/Currency Consistency", 0.20, 0.0, "phase2"),
    CheckDef(16, "consistency", "standardization_issue_ratio", "Standardization Check", 0.10, 0.01, "phase2"),
    CheckDef(17, "integrity", "fk_violation_ratio", "Foreign Key Violation Check", 0.50, 0.0, "mvp"),
    CheckDef(18, "integrity", "orphan_ratio", "Orphan Record Check", 0.35, 0.0, "mvp"),
    CheckDef(19, "integrity", "join_coverage_ratio", "Broken Join Coverage", 0.15, 0.99, "mvp", True),
    CheckDef(20, "freshness", "freshness_lag_hours", "Freshness Lag Hours", 0.50, 24.0, "mvp"),
    CheckDef(21, "freshness", "stale_table_flag", "Stale Table Check", 0.30, 0.0, "mvp"),
    CheckDef(22, "freshness", "late_arrival_ratio", "Late-Arriving Data Check", 0.20, 0.01, "mvp"),
    CheckDef(23, "volume", "volume_change_pct", "Row Count Volume Change", 0.65, 0.30, "mvp"),
    CheckDef(24, "volume", "missing_partition_count", "Missing Partition / Date Slice Check", 0.35, 0.0, "mvp"),
    CheckDef(25, "accuracy", "reconciliation_variance_pct", "Source-to-Target Reconciliation", 0.45, 0.005, "phase2"),
    CheckDef(26, "accuracy", "business_rule_error_ratio", "Business Rule Validation", 0.35, 0.005, "phase2"),
    CheckDef(27, "accuracy", "reference_mismatch_ratio", "Reference Data Validation", 0.20, 0.005, "phase2"),
    CheckDef(28, "anomaly", "outlier_ratio", "Outlier Detection", 0.60, None, "phase2"),
    CheckDef(29, "anomaly", "distribution_drift_score", "Distribution Drift Check", 0.40, None, "phase2"),
    CheckDef(30, "schema", "schema_drift_events", "Schema Drift Detection", 1.00, 0.0, "phase2"),
    CheckDef(31, "metadata", "metadata_gap_ratio", "Metadata Completeness", 1.00, 0.05, "later"),
    CheckDef(32, "pipeline", "pipeline_failure_ratio", "Pipeline Failure Indicator", 1.00, 0.01, "phase2"),
    CheckDef(33, "time_series", "time_integrity_ratio", "Timestamp Sequence Integrity", 1.00, 0.005, "later"),
)

CHECKS: dict[int, CheckDef] = {d.check_id: d for d in _DEFINITIONS}


def catalog_frame(spark: SparkSession) -> DataFrame:
    """The catalog as a frame, one row per check (custom checks included)."""
    defs = sorted(CHECKS.values(), key=lambda d: d.check_id)
    return spark.createDataFrame(pa.table({
        "check_id": pa.array([d.check_id for d in defs], pa.int32()),
        "check_name": pa.array([d.check_name for d in defs], pa.string()),
        "dimension": pa.array([d.dimension for d in defs], pa.string()),
        "metric_name": pa.array([d.metric_name for d in defs], pa.string()),
        "dimension_weight": pa.array([d.dimension_weight for d in defs], pa.float64()),
        "within_weight": pa.array([d.within_weight for d in defs], pa.float64()),
        "effective_weight": pa.array([d.effective_weight for d in defs], pa.float64()),
        "threshold": pa.array([d.threshold for d in defs], pa.float64()),
        "phase": pa.array([d.phase for d in defs], pa.string()),
        "higher_is_better": pa.array([d.higher_is_better for d in defs], pa.bool_()),
    }))
