"""Checks on the test tables, each with its metric written in SQL.

The SQL says what the metric means in the plainest way (filters, joins, windows
over the rows); the library computes it in another way.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

AS_OF = "2024-02-01 00:00:00"
_NOW = f"TIMESTAMP '{AS_OF}'"

EMAIL = r"^[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[a-z]{2,}$"


@dataclass(frozen=True)
class Case:
    query: str
    spec: dict[str, Any]
    sql: str

    @property
    def check_id(self) -> int:
        return self.spec["check_id"]


def _share(where: str, table: str) -> str:
    return f"SELECT count(*) FILTER (WHERE {where})::DOUBLE / nullif(count(*), 0) FROM {table}"


def _hours(a: str, b: str) -> str:
    return f"date_diff('hour', {a}, {b})"


def _cases() -> list[Case]:
    out: list[Case] = []

    def add(query: str, sql: str, check_id: int, **parameters: Any) -> None:
        out.append(Case(query, {"check_id": check_id, **parameters}, sql))

    # completeness
    for table, column in (("orders_dirty", "o_custkey"), ("customer_dirty", "phone"), ("lineitem_copy", "l_extendedprice"),
                          ("events", "value")):
        add("c01_null_ratio", _share(f"{column} IS NULL", table), 1, table=table, column=column)
    add("c02_critical_null_ratio",
        "SELECT (count(*) FILTER (WHERE o_custkey IS NULL) + count(*) FILTER (WHERE o_totalprice IS NULL)"
        " + count(*) FILTER (WHERE o_orderdate IS NULL))::DOUBLE / (3 * count(*)) FROM orders_dirty",
        2, table="orders_dirty", columns=["o_custkey", "o_totalprice", "o_orderdate"])
    add("c02_critical_null_ratio", _share("phone IS NULL", "customer_dirty"), 2, table="customer_dirty", column="phone")
    add("c03_empty_row_count", "SELECT count(*)::DOUBLE FROM lineitem_copy WHERE l_extendedprice IS NULL",
        3, table="lineitem_copy", columns=["l_extendedprice"])
    add("c03_empty_row_count", "SELECT count(*)::DOUBLE FROM customer_dirty WHERE phone IS NULL AND email IS NULL",
        3, table="customer_dirty", columns=["phone", "email"])
    add("c04_conditional_missing_ratio", _share("o_orderstatus = 'P' AND o_custkey IS NULL", "orders_dirty"),
        4, table="orders_dirty", condition="o_orderstatus = 'P'", dependent_column="o_custkey")

    # uniqueness
    add("c05_pk_duplicate_ratio", "SELECT (count(*) - count(DISTINCT c_custkey))::DOUBLE / count(*) FROM customer_dirty",
        5, table="customer_dirty", pk_column="c_custkey")
    add("c05_pk_duplicate_ratio", "SELECT (count(*) - count(DISTINCT o_custkey))::DOUBLE / count(*) FROM orders_dirty",
        5, table="orders_dirty", pk_column="o_custkey")
    add("c05_pk_duplicate_ratio", "SELECT (count(*) - count(DISTINCT text))::DOUBLE / count(*) FROM documents",
        5, table="documents", pk_column="text")
    add("c06_business_duplicate_ratio",
        "SELECT (count(*) - count(DISTINCT (l_orderkey, l_linenumber)))::DOUBLE / count(*) FROM lineitem",
        6, table="lineitem", business_key_columns=["l_orderkey", "l_linenumber"])
    add("c06_business_duplicate_ratio",
        "SELECT (count(*) - count(DISTINCT (o_custkey, o_orderstatus)))::DOUBLE / count(*) FROM orders_dirty",
        6, table="orders_dirty", business_key_columns=["o_custkey", "o_orderstatus"])
    add("c06_business_duplicate_ratio", "SELECT (count(*) - count(DISTINCT phone))::DOUBLE / count(*) FROM customer_dirty",
        6, table="customer_dirty", business_key_columns=["phone"])
    add("c07_near_duplicate_count",
        "SELECT count(*)::DOUBLE FROM (SELECT 1 FROM customer_dirty GROUP BY upper(trim(c_name)) HAVING count(*) > 1) g",
        7, table="customer_dirty", columns=["c_name"])
    add("c07_near_duplicate_count",
        "SELECT count(*)::DOUBLE FROM (SELECT 1 FROM orders_dirty"
        " GROUP BY upper(trim(o_orderpriority)), upper(trim(o_orderstatus)) HAVING count(*) > 1) g",
        7, table="orders_dirty", columns=["o_orderpriority", "o_orderstatus"])

    # validity
    add("c08_type_error_ratio", _share("balance_text IS NOT NULL AND try_cast(balance_text AS DOUBLE) IS NULL", "customer_dirty"),
        8, table="customer_dirty", column="balance_text")
    add("c08_type_error_ratio", _share("try_cast(props AS INTEGER) IS NULL", "events"),
        8, table="events", column="props", extra={"expected_type": "INTEGER"})
    add("c09_domain_violation_ratio", _share("o_orderstatus NOT IN ('O', 'F', 'P')", "orders_dirty"),
        9, table="orders_dirty", column="o_orderstatus", allowed_values=["O", "F", "P"])
    add("c09_domain_violation_ratio", _share("p_size NOT IN (1, 2, 3, 5, 8, 13)", "part"),
        9, table="part", column="p_size", allowed_values=["1", 2, 3, 5, 8, 13])
    add("c10_format_violation_ratio", _share(f"NOT regexp_matches(email, '{EMAIL}')", "customer_dirty"),
        10, table="customer_dirty", column="email", pattern=EMAIL)
    add("c10_format_violation_ratio", _share("NOT regexp_matches(props, '[0-9]5')", "events"),
        10, table="events", column="props", pattern="[0-9]5")
    add("c11_range_violation_ratio", _share("l_quantity < 3 OR l_quantity > 45", "lineitem"),
        11, table="lineitem", column="l_quantity", min_value=3, max_value=45)
    add("c11_range_violation_ratio", _share("o_totalprice < 1000", "orders_dirty"),
        11, table="orders_dirty", column="o_totalprice", min_value=1000)
    add("c12_negative_value_ratio", _share("o_totalprice < 0", "orders_dirty"), 12, table="orders_dirty", column="o_totalprice")
    add("c12_negative_value_ratio", _share("c_acctbal < 0", "customer"), 12, table="customer", column="c_acctbal")

    # consistency
    add("c13_cross_field_error_ratio", _share("o_totalprice < 0 AND o_orderstatus = 'F'", "orders_dirty"),
        13, table="orders_dirty", condition="o_totalprice < 0 AND o_orderstatus = 'F'")
    add("c13_cross_field_error_ratio", _share("l_discount < l_tax", "lineitem"), 13, table="lineitem", condition="l_discount < l_tax")
    add("c14_cross_table_mismatch_ratio",
        "SELECT count(*) FILTER (WHERE s.l_extendedprice <> r.l_extendedprice)::DOUBLE / count(*)"
        " FROM lineitem s JOIN lineitem_copy r ON s.l_orderkey = r.l_orderkey",
        14, source_table="lineitem", reference_table="lineitem_copy", source_column="l_extendedprice",
        reference_column="l_extendedprice", extra={"join_key": "l_orderkey"})
    add("c14_cross_table_mismatch_ratio",
        "SELECT count(*) FILTER (WHERE s.o_orderstatus <> r.o_orderstatus)::DOUBLE / count(*)"
        " FROM orders s JOIN orders_dirty r ON s.o_orderkey = r.o_orderkey",
        14, source_table="orders", reference_table="orders_dirty", source_column="o_orderstatus",
        reference_column="o_orderstatus", extra={"join_key": "o_orderkey"})
    add("c15_unit_mismatch_ratio", _share("l_returnflag NOT IN ('A', 'N')", "lineitem"),
        15, table="lineitem", column="l_returnflag", allowed_values=["A", "N"])
    add("c16_standardization_issue_ratio", _share("upper(trim(o_orderpriority)) NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')", "orders_dirty"),
        16, table="orders_dirty", column="o_orderpriority", allowed_values=["1-urgent", " 2-HIGH", "3-Medium"])

    # integrity
    for child, child_key, parent, parent_key in (
        ("orders_dirty", "o_custkey", "customer", "c_custkey"),
        ("orders_dirty", "o_custkey", "customer_dirty", "c_custkey"),
        ("documents", "doc_id", "labels", "doc_id"),
        ("orders", "o_orderkey", "lineitem", "l_orderkey"),
    ):
        pair = dict(child_table=child, child_column=child_key, parent_table=parent, parent_column=parent_key)
        missing = f"NOT EXISTS (SELECT 1 FROM {parent} p WHERE p.{parent_key} = c.{child_key})"
        rows = f"(SELECT count(*) FROM {child})"
        add("c17_fk_violation_ratio",
            f"SELECT count(*)::DOUBLE / {rows} FROM {child} c WHERE c.{child_key} IS NOT NULL AND {missing}", 17, **pair)
        add("c18_orphan_ratio", f"SELECT count(*)::DOUBLE / {rows} FROM {child} c WHERE {missing}", 18, **pair)
        add("c19_join_coverage_ratio",
            f"SELECT count(p.{parent_key})::DOUBLE / count(*) FROM {child} c LEFT JOIN {parent} p ON c.{child_key} = p.{parent_key}",
            19, source_table=child, source_column=child_key, reference_table=parent, reference_column=parent_key)

    # freshness
    for table, column in (("events", "ts"), ("events_load", "load_ts"), ("orders", "o_orderdate")):
        add("c20_freshness_lag_hours", f"SELECT {_hours(f'max({column})', _NOW)}::DOUBLE FROM {table}",
            20, table=table, timestamp_column=column)
        add("c21_stale_table_flag", f"SELECT (max({column}) < {_NOW} - to_seconds(216000))::INT::DOUBLE FROM {table}",
            21, table=table, timestamp_column=column, stale_days=2.5)
    add("c22_late_arrival_ratio", _share(f"{_hours('ts', 'load_ts')} > 24", "events_load"),
        22, table="events_load", event_timestamp_column="ts", load_timestamp_column="load_ts")
    add("c22_late_arrival_ratio", _share(f"{_hours('ts', 'load_ts')} > 40.5", "events_load"),
        22, table="events_load", event_timestamp_column="ts", load_timestamp_column="load_ts", late_arrival_hours=40.5)

    # volume
    add("c23_volume_change_pct",
        "SELECT abs((SELECT count(*) FROM orders) - count(*))::DOUBLE / count(*) FROM lineitem",
        23, today_table="orders", prior_table="lineitem")
    add("c23_volume_change_pct",
        "SELECT abs(count(*) FILTER (WHERE event_type = 'view') - count(*) FILTER (WHERE NOT event_type = 'view'))::DOUBLE"
        " / count(*) FILTER (WHERE NOT event_type = 'view') FROM events",
        23, table="events", condition="event_type = 'view'", volume_change_band=0.5)
    add("c24_missing_partition_count",
        "SELECT count(*)::DOUBLE FROM order_days e WHERE NOT EXISTS (SELECT 1 FROM ship_days a WHERE a.partition_key = e.partition_key)",
        24, expected_partitions_table="order_days", actual_partitions_table="ship_days")
    add("c24_missing_partition_count",
        "SELECT count(*)::DOUBLE FROM known_customers e LEFT JOIN ordering_customers a ON e.custkey = a.custkey WHERE a.custkey IS NULL",
        24, expected_partitions_table="known_customers", actual_partitions_table="ordering_customers", partition_key="custkey")

    # accuracy
    add("c25_reconciliation_variance_pct",
        "SELECT abs((SELECT sum(l_quantity) FROM lineitem) - sum(o_totalprice)) / abs((SELECT sum(l_quantity) FROM lineitem)) FROM orders",
        25, source_table="lineitem", target_table="orders", source_column="l_quantity", target_column="o_totalprice")
    add("c25_reconciliation_variance_pct",
        "SELECT abs((SELECT sum(l_extendedprice) FROM lineitem) - sum(l_extendedprice)) / abs((SELECT sum(l_extendedprice) FROM lineitem))"
        " FROM lineitem_copy",
        25, source_table="lineitem", target_table="lineitem_copy", column="l_extendedprice")
    add("c26_business_rule_error_ratio", _share("NOT (l_extendedprice >= l_quantity * 900)", "lineitem_copy"),
        26, table="lineitem_copy", condition="l_extendedprice >= l_quantity * 900")
    add("c26_business_rule_error_ratio", _share("abs(l_extendedprice - l_quantity * l_discount) > 0.01", "lineitem_copy"),
        26, table="lineitem_copy", price_column="l_quantity", quantity_column="l_discount", revenue_column="l_extendedprice")
    add("c26_business_rule_error_ratio", _share("abs(revenue - l_quantity * l_discount) > 0.01", "lineitem_copy"),
        26, table="lineitem_copy", price_column="l_quantity", quantity_column="l_discount", revenue_column="revenue")
    add("c27_reference_mismatch_ratio",
        "SELECT count(*) FILTER (WHERE f.segment <> r.segment)::DOUBLE / count(*) FROM segment_facts f JOIN segment_codes r ON f.code = r.code",
        27, table="segment_facts", reference_table="segment_codes", column="segment")

    # anomaly
    for table, column, z in (("lineitem", "l_extendedprice", 1.7), ("events", "value", 3.0), ("orders_dirty", "o_totalprice", 1.5)):
        add("c28_outlier_ratio",
            f"SELECT count(*) FILTER (WHERE abs(t.{column} - s.m) / s.d > {z})::DOUBLE / count(t.{column}) FROM {table} t,"
            f" (SELECT avg({column}) m, stddev_samp({column}) d FROM {table}) s",
            28, table=table, column=column, outlier_z_threshold=z)
    add("c29_distribution_drift_score",
        "SELECT abs((SELECT avg(l_extendedprice) FROM lineitem_copy) - avg(l_extendedprice)) / abs(avg(l_extendedprice)) FROM lineitem",
        29, table="lineitem_copy", reference_table="lineitem", column="l_extendedprice")
    for table, column in (("events", "value"), ("lineitem", "l_extendedprice")):
        add("c29_distribution_drift_score", f"SELECT stddev_samp({column}) / abs(avg({column})) FROM {table}", 29, table=table, column=column)

    # side tables
    add("c30_schema_drift_events",
        "SELECT ((SELECT count(*) FROM (VALUES ('p_partkey'), ('p_name'), ('p_brand'), ('p_type'), ('p_size'), ('p_retailprice')) c(n)"
        " WHERE n NOT IN (SELECT lower(column_name) FROM schema_baseline WHERE table_name = 'PART'))"
        " + count(*) FILTER (WHERE column_name LIKE 'gone%') + count(*) FILTER (WHERE column_name = 'p_size'))::DOUBLE"
        " FROM schema_baseline WHERE table_name = 'PART'",
        30, table="part", reference_table="schema_baseline")
    add("c31_metadata_gap_ratio", _share("description IS NULL OR owner IS NULL", "metadata_catalog"),
        31, metadata_catalog_table="metadata_catalog")
    add("c31_metadata_gap_ratio",
        _share("description IS NULL OR owner IS NULL", "metadata_catalog WHERE lower(table_name) = 'brand#2'"),
        31, table="brand#2", metadata_catalog_table="metadata_catalog")
    add("c32_pipeline_failure_ratio", _share("lower(run_status) = 'failed'", "pipeline_runs"), 32, pipeline_runs_table="pipeline_runs")
    add("c32_pipeline_failure_ratio", _share("lower(run_status) = 'failed'", "pipeline_runs WHERE dataset_name = '1-URGENT'"),
        32, pipeline_runs_table="pipeline_runs", dataset_name="1-urgent")

    # time series
    for entity, part in (("user_id", "PARTITION BY user_id"), (None, "")):
        for order in (None, "arrival"):
            by = "arrival, ts" if order else "ts"
            add("c33_time_integrity_ratio",
                f"SELECT count(*) FILTER (WHERE ts < before)::DOUBLE / count(*) FROM"
                f" (SELECT ts, lag(ts) OVER ({part} ORDER BY {by}) AS before FROM events_load) o",
                33, table="events_load", timestamp_column="ts", entity_column=entity,
                **({"extra": {"order_column": order}} if order else {}))
    return out


CASES = _cases()


def cases_of(query: str) -> list[Case]:
    return [c for c in CASES if c.query == query]


QUERY_NAMES = sorted({c.query for c in CASES})
