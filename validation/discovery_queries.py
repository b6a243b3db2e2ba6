"""Keys, references and bounds found in the data, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline import column_roles, foreign_keys, inclusions, key_frame, profile, suggest_checks, table_entries, unique_sets
from plumbline.operators.suggest import specs_frame
from plumbline.sources.footers import bounds
from validation.column_queries import COLUMNS
from validation.views import TABLES, frames, with_views

Query = Callable[[SparkSession, str], DataFrame]

RELATED = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "labels", "conversations", "pages")
DIRTY = (*RELATED, "orders_dirty", "customer_dirty")


def _kinds(table: str) -> list[tuple[str, str]]:
    return [tuple(c.split(":")) for c in COLUMNS[table].split()]


def inclusions_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of columns of which one holds at least 95 % of the other's values."""
    tables = frames(spark, sf_dir)
    found = inclusions(spark, {t: tables.frame(t) for t in DIRTY}, least=0.95)
    return found.withColumn("coverage", F.round("coverage", 10))


def _values_sql(tables: tuple[str, ...]) -> str:
    text = {"i": "{c}::BIGINT::VARCHAR", "t": "strftime({c}::TIMESTAMP, '%Y-%m-%d %H:%M:%S.%f')", "s": "{c}"}
    return " UNION ALL ".join(
        f"SELECT DISTINCT '{t}' AS t, '{c}' AS c, '{kind}' AS kind, {text[kind].format(c=c)} AS v FROM {t} WHERE {c} IS NOT NULL"
        for t in tables for c, kind in _kinds(t) if kind in text
    )


def _inclusions_sql(tables: tuple[str, ...], least: float) -> str:
    return f"""
      WITH vals AS MATERIALIZED ({_values_sql(tables)}),
      sizes AS (SELECT t, c, count(*) AS n FROM vals GROUP BY ALL),
      shared AS (SELECT a.t AS ta, a.c AS ca, b.t AS tb, b.c AS cb, count(*) AS n FROM vals a JOIN vals b ON a.kind = b.kind AND a.v = b.v
                 AND (a.t <> b.t OR a.c <> b.c) GROUP BY ALL)
      SELECT ta AS child_table, ca AS child_column, tb AS parent_table, cb AS parent_column, x.n AS n_values, s.n AS n_shared,
        s.n::DOUBLE / x.n AS coverage, y.n AS parent_values
      FROM shared s JOIN sizes x ON x.t = ta AND x.c = ca JOIN sizes y ON y.t = tb AND y.c = cb WHERE s.n::DOUBLE / x.n >= {least}"""


def foreign_keys_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References in the tables as they are."""
    tables = frames(spark, sf_dir)
    return foreign_keys(spark, {t: tables.frame(t) for t in RELATED}).select("child_table", "child_column", "parent_table", "parent_column", "n_values")


def _foreign_keys_sql() -> str:
    """Every pair of columns by an anti-join of its own."""
    pairs = []
    for bt in RELATED:
        for bc, kind in _kinds(bt):
            core = bc.split("_", 1)[1] if "_" in bc else bc
            for at in RELATED:
                for ac, other in _kinds(at):
                    if kind in "its" and kind == other and (at, ac) != (bt, bc) and (ac == bc or ac.endswith(core) and len(core) > 2):
                        pairs.append(
                            f"SELECT '{at}' AS child_table, '{ac}' AS child_column, '{bt}' AS parent_table, '{bc}' AS parent_column, count(DISTINCT {ac}) AS n_values FROM {at}"
                            f" HAVING (SELECT count(*) FROM {at} x WHERE x.{ac} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {bt} y WHERE y.{bc} = x.{ac})) = 0"
                            f" AND (SELECT count(DISTINCT {bc}) = count(*) FROM {bt}) AND count({ac}) > 0")
    return " UNION ALL ".join(pairs)


KEYED = ("lineitem", "orders", "customer_dirty", "nation", "conversations", "events", "part", "lineitem_lines")


def _frame(tables, name: str) -> DataFrame:
    """lineitem_lines has no key of fewer than two columns, and NULLs in one of them."""
    if name == "lineitem_lines":
        return tables.frame("lineitem_copy").select("l_orderkey", "l_linenumber", "l_returnflag", F.col("l_extendedprice").cast("long").alias("whole"))
    return tables.frame(name)


_LINES = "(SELECT l_orderkey, l_linenumber, l_returnflag, trunc(l_extendedprice)::BIGINT AS whole FROM lineitem_copy)"


def keys_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minimal keys of up to three columns."""
    tables = frames(spark, sf_dir)
    found = key_frame(spark, {t: unique_sets(_frame(tables, t)) for t in KEYED})
    return found.select(F.col("table").alias("table_name"), F.array_join("columns", ",").alias("key_columns"))


def _keys_sql() -> str:
    """Every set of columns by a count of its own."""
    parts = []
    for t in KEYED:
        names = ["l_orderkey", "l_linenumber", "l_returnflag", "whole"] if t == "lineitem_lines" else [c for c, kind in _kinds(t) if kind in "its"]
        source = _LINES if t == "lineitem_lines" else t
        for size in (1, 2, 3):
            for group in combinations(names, size):
                whole = " AND ".join(f"count({c}) = count(*)" for c in group)
                parts.append(f"SELECT '{t}' AS table_name, {size} AS size, '{','.join(group)}' AS key_columns, count(DISTINCT ({', '.join(group)},)) = count(*) AND {whole} AS ok FROM {source}"
                             if size > 1 else f"SELECT '{t}' AS table_name, 1 AS size, '{group[0]}' AS key_columns, count(DISTINCT {group[0]}) = count(*) AND {whole} AS ok FROM {source}")
    found = " UNION ALL ".join(parts)
    return with_views(f"SELECT table_name, key_columns FROM ({found}) f WHERE ok QUALIFY size = min(size) OVER (PARTITION BY table_name)")


def table_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and bounds of all columns of the tables, from the files' footers."""
    found = bounds(spark, {t: f"{sf_dir.rstrip('/')}/{t}.parquet" for t in TABLES})
    return found.select(F.col("table").alias("table_name"), F.col("column").alias("column_name"), "row_count", "null_count", "low", "high")


def _bounds_sql() -> str:
    low = lambda f, c, kind: f"{f}({c})::VARCHAR" if kind == "i" else "CAST(NULL AS VARCHAR)"
    return " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS null_count, {low('min', c, kind)} AS low, {low('max', c, kind)} AS high FROM {t}"
        for t in TABLES for c, kind in _kinds(t) if kind != "n"
    )


def suggest_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference checks that follow from the foreign keys in the data."""
    tables = frames(spark, sf_dir)
    related = {t: tables.frame(t) for t in RELATED}
    roles = None
    for t in ("orders", "lineitem", "customer"):
        own = column_roles(profile(related[t], t))
        roles = own if roles is None else roles.unionByName(own)
    specs = [s for s in suggest_checks(table_entries(roles, foreign_keys(spark, related))) if s.check_id in (17, 18, 19)]
    named = {"child_table": "source_table", "child_column": "source_column", "parent_table": "reference_table", "parent_column": "reference_column"}
    return specs_frame(spark, specs).select("check_id", *[
        F.coalesce(*[F.get_json_object("parameters", f"$.{n}") for n in (name, other)]).alias(name) for name, other in named.items()])


def _references_sql() -> str:
    return (
        f"SELECT k AS check_id, child_table, child_column, parent_table, parent_column FROM ({_foreign_keys_sql()}) f, (VALUES (17::INT), (18::INT), (19::INT)) v(k)"
        " WHERE child_table IN ('orders', 'lineitem', 'customer')"
    )


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (inclusions_found, foreign_keys_found, keys_found, table_bounds, suggest_references)}


def oracle_sql() -> dict[str, str]:
    return {
        "inclusions_found": with_views(f"SELECT * REPLACE (round(coverage, 10) AS coverage) FROM ({_inclusions_sql(DIRTY, 0.95)}) i"),
        "foreign_keys_found": _foreign_keys_sql(),
        "keys_found": _keys_sql(),
        "table_bounds": _bounds_sql(),
        "suggest_references": _references_sql(),
    }
