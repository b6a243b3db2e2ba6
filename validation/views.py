"""Dirty versions of the test tables.

The test tables have no missing values and no broken keys.  Each view below
plants defects by expressions over whole tables; one text serves both engines,
apart from the few spellings in which they differ.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from plumbline import Tables

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

VIEWS = {
    # missing and unknown customers, negative prices, odd statuses, untidy priorities
    "orders_dirty": """
        SELECT o_orderkey,
               CASE WHEN o_orderkey % 10 = 0 THEN NULL
                    WHEN o_orderkey % 20 = 5 THEN -o_custkey - 1
                    ELSE o_custkey END AS o_custkey,
               CASE WHEN o_orderkey % 50 = 1 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
               CASE WHEN o_orderkey % 15 = 0 THEN -99.99 ELSE o_totalprice END AS o_totalprice,
               o_orderdate,
               CASE WHEN o_orderkey % 7 = 0 THEN lower(o_orderpriority) || ' '
                    ELSE o_orderpriority END AS o_orderpriority
        FROM {orders}""",
    # repeated keys, near-equal names, broken addresses, values that are not numbers
    "customer_dirty": """
        SELECT CASE WHEN c_custkey % 30 = 7 THEN c_custkey - 1 ELSE c_custkey END AS c_custkey,
               CASE WHEN c_custkey % 30 = 7 THEN ' customer#' || lpad('' || (c_custkey - 1), 9, '0') || ' '
                    ELSE c_name END AS c_name,
               c_nationkey, c_acctbal, c_mktsegment,
               'user' || c_custkey || CASE WHEN c_custkey % 9 = 0 THEN '(at)' ELSE '@' END || 'example.com' AS email,
               CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE '+1' || (2000000000 + c_custkey) END AS phone,
               CASE WHEN c_custkey % 8 = 3 THEN 'n/a' ELSE c_nationkey || '.50' END AS balance_text,
               'Given' || c_nationkey || ' Family' || c_custkey AS full_name,
               '4' || lpad('' || c_custkey, 15, '0') AS credit_card,
               CASE WHEN c_custkey % 2 = 0 THEN '10.0.' || c_nationkey || '.7' ELSE 'unknown' END AS ship_location
        FROM {customer}""",
    # late loads, and an arrival order that is not the order of time
    "events_load": """
        SELECT event_id, ts, user_id, event_type, value, props,
               {load_ts} AS load_ts,
               event_id + CASE WHEN event_id % 13 = 0 THEN 20 ELSE 0 END AS arrival
        FROM {events}""",
    # prices of a second system: some lines are a little off, some lack a value
    "lineitem_copy": """
        SELECT l_orderkey, l_linenumber, l_quantity,
               CASE WHEN l_orderkey % 11 = 0 THEN NULL
                    WHEN l_orderkey % 12 = 0 THEN l_extendedprice * 1.5
                    ELSE l_extendedprice END AS l_extendedprice,
               l_returnflag, l_discount, l_quantity * l_discount AS revenue
        FROM {lineitem}""",
    "segment_codes": """
        SELECT c_custkey AS code, CASE WHEN c_custkey % 6 = 0 THEN 'OTHER' ELSE c_mktsegment END AS segment
        FROM {customer}""",
    "segment_facts": "SELECT c_custkey AS code, c_mktsegment AS segment FROM {customer}",
    "order_days": "SELECT DISTINCT CAST(o_orderdate AS DATE) AS partition_key FROM {orders}",
    "ship_days": "SELECT CAST(l_shipdate AS DATE) AS partition_key FROM {lineitem}",
    "known_customers": "SELECT c_custkey AS custkey FROM {customer}",
    "ordering_customers": "SELECT o_custkey AS custkey FROM ({orders_dirty}) o",
    # tables kept next to the data, derived from it
    "schema_baseline": """
        SELECT CASE WHEN p_size % 2 = 0 THEN 'PART' ELSE 'other' END AS table_name,
               CASE p_size % 10 WHEN 0 THEN 'P_PARTKEY' WHEN 2 THEN 'p_name' WHEN 4 THEN 'p_size'
                                ELSE 'gone_' || p_size END AS column_name,
               CASE p_size % 10 WHEN 0 THEN 'BIGINT' WHEN 2 THEN 'VARCHAR' WHEN 4 THEN 'BIGINT'
                                ELSE 'INTEGER' END AS data_type
        FROM {part}""",
    "metadata_catalog": """
        SELECT p_brand AS table_name, p_name AS column_name,
               CASE WHEN p_size < 3 THEN NULL ELSE p_type END AS description,
               CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_brand END AS owner
        FROM {part}""",
    "pipeline_runs": """
        SELECT o_orderpriority AS dataset_name,
               CASE o_orderstatus WHEN 'F' THEN 'Failed' WHEN 'O' THEN 'success' ELSE 'running' END AS run_status,
               o_orderdate AS run_ts
        FROM {orders}""",
}

_SPELLING = {
    "spark": {"load_ts": "timestampadd(HOUR, CAST((event_id * 7) % 60 AS INT), ts)"},
    "duckdb": {"load_ts": "ts + to_hours(CAST((event_id * 7) % 60 AS BIGINT))"},
}


def _text(name: str, engine: str, names: dict[str, str]) -> str:
    fill = names | _SPELLING[engine]
    nested = {v: VIEWS[v].format(**fill) for v in ("orders_dirty",)}
    return VIEWS[name].format(**fill, **nested)


def frames(spark: SparkSession, sf_dir: str) -> Tables:
    """Every test table and every view by name, opened when first needed."""
    tables = Tables(spark, {name: f"{sf_dir.rstrip('/')}/{name}.parquet" for name in TABLES})

    def view(name: str):
        text = _text(name, "spark", {t: "{" + t + "}" for t in TABLES})
        used = [t for t in TABLES if "{" + t + "}" in text]
        return lambda: spark.sql(text, **{t: tables.frame(t) for t in used})

    for name in VIEWS:
        tables.add(name, view(name))
    return tables


def with_views(sql: str) -> str:
    """A DuckDB query that may name the views."""
    used = [v for v in VIEWS if v in sql]
    heads = [f"{v} AS ({_text(v, 'duckdb', {t: t for t in TABLES})})" for v in used]
    return f"WITH {', '.join(heads)} {sql}" if heads else sql
