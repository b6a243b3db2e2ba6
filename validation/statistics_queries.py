"""Fuzzy duplicates, exact quantiles, fences and distances of distributions, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline import scan
from plumbline.operators.fuzzy import fuzzy_groups
from plumbline.operators.order_stats import quantiles
from validation.views import frames, with_views

Query = Callable[[SparkSession, str], DataFrame]

FUZZY = (("customer_dirty", "c_name", 1), ("pages", "url", 2), ("part", "p_name", 3), ("events", "props", 1))


def fuzzy_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of values within some edits, of four columns."""
    tables, out = frames(spark, sf_dir), None
    for table, name, edits in FUZZY:
        found = fuzzy_groups(tables.frame(table), [F.col(name)], edits).select(
            F.lit(table).alias("table_name"), F.lit(name).alias("column_name"), "value", F.col("rows").alias("n_rows"), F.col("group").alias("group_name"))
        out = found if out is None else out.unionByName(found)
    return out


def _fuzzy_groups_sql(table: str, name: str, edits: int) -> str:
    return f"""
      WITH RECURSIVE v AS (SELECT upper(trim({name})) AS value, count(*) AS n FROM {table} GROUP BY 1),
      near AS (SELECT a.value AS a, b.value AS b FROM v a JOIN v b ON a.value <> b.value AND abs(length(a.value) - length(b.value)) <= {edits}
               AND levenshtein(a.value, b.value) <= {edits}),
      reach(a, b) AS (SELECT a, a FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON n.a = r.b),
      least AS (SELECT a, min(b) AS b FROM reach GROUP BY 1)
      SELECT '{table}' AS table_name, '{name}' AS column_name, v.value, v.n AS n_rows, coalesce(l.b, v.value) AS group_name
      FROM v LEFT JOIN least l ON l.a = v.value WHERE l.b IS NOT NULL OR v.n > 1"""


# -- quantiles --------------------------------------------------------------------

NUMBERS = {
    "lineitem": ("l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"),
    "orders_dirty": ("o_custkey", "o_totalprice"),
    "events": ("value", "user_id"),
    "documents": ("n_chars",),
}
SHARES = (0.0, 0.01, 0.25, 0.5, 0.75, 0.9, 0.999, 1.0)


def quantiles_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of number columns of four tables."""
    tables, out = frames(spark, sf_dir), None
    for table, names in NUMBERS.items():
        found = quantiles(tables.frame(table), [F.col(n).cast("double") for n in names], SHARES).select(
            F.lit(table).alias("table_name"), F.element_at(F.array(*[F.lit(n) for n in names]), F.col("c") + 1).alias("column_name"),
            "share", F.round("value", 6).alias("value"))
        out = found if out is None else out.unionByName(found)
    return out


def _quantiles_sql() -> str:
    return with_views(" UNION ALL ".join(
        f"SELECT '{table}' AS table_name, '{n}' AS column_name, {s}::DOUBLE AS share, round(quantile_cont({n}::DOUBLE, {s}), 6) AS value FROM {table}"
        for table, names in NUMBERS.items() for n in names for s in SHARES
    ))


# -- checks with other methods ---------------------------------------------------------

def _fences_sql(table: str, name: str, factor: float) -> str:
    return (
        f"SELECT count(*) FILTER (WHERE v < q1 - {factor} * (q3 - q1) OR v > q3 + {factor} * (q3 - q1))::DOUBLE / count(v)"
        f" FROM (SELECT {name}::DOUBLE AS v FROM {table}) t, (SELECT quantile_cont({name}::DOUBLE, 0.25) AS q1, quantile_cont({name}::DOUBLE, 0.75) AS q3 FROM {table}) q"
    )


def _median_sql(table: str, name: str, factor: float) -> str:
    return (
        f"SELECT count(*) FILTER (WHERE 0.6745 * abs(v - m) / nullif(d, 0) > {factor})::DOUBLE / count(v) FROM (SELECT {name}::DOUBLE AS v FROM {table}) t,"
        f" (SELECT m, quantile_cont(abs({name}::DOUBLE - m), 0.5) AS d FROM {table}, (SELECT quantile_cont({name}::DOUBLE, 0.5) AS m FROM {table}) x GROUP BY m) q"
    )


def _psi_sql(table: str, base: str, name: str, bins: int) -> str:
    edges = ", ".join(f"quantile_cont({name}::DOUBLE, {k / bins!r}) AS e{k}" for k in range(1, bins))
    held = " + ".join(f"(v > e{k})::INT" for k in range(1, bins))
    return (
        f"SELECT sum((p1 - p0) * ln(p1 / p0)) FROM (SELECT greatest(coalesce(n1, 0)::DOUBLE / sum(n1) OVER (), 1e-4) AS p1, greatest(coalesce(n0, 0)::DOUBLE / sum(n0) OVER (), 1e-4) AS p0"
        f" FROM (SELECT bin, sum(side) AS n1, sum(1 - side) AS n0 FROM (SELECT {held} AS bin, side FROM (SELECT {name}::DOUBLE AS v, 1 AS side FROM {table} UNION ALL SELECT {name}::DOUBLE, 0 FROM {base}) t,"
        f" (SELECT {edges} FROM {base}) e WHERE v IS NOT NULL) b GROUP BY bin) c) p"
    )


def _ks_sql(table: str, base: str, name: str) -> str:
    return (
        f"SELECT max(abs(f1 - f0)) FROM (SELECT sum(n1) OVER (ORDER BY v)::DOUBLE / sum(n1) OVER () AS f1, sum(n0) OVER (ORDER BY v)::DOUBLE / sum(n0) OVER () AS f0"
        f" FROM (SELECT v, sum(side) AS n1, sum(1 - side) AS n0 FROM (SELECT {name}::DOUBLE AS v, 1 AS side FROM {table} UNION ALL SELECT {name}::DOUBLE, 0 FROM {base}) t WHERE v IS NOT NULL GROUP BY v) c) f"
    )


def _method_cases() -> list[tuple[dict, str]]:
    out = [({"check_id": 7, "table": t, "column": c, "extra": {"max_edits": k}},
            f"SELECT count(*)::DOUBLE FROM (SELECT group_name FROM ({_fuzzy_groups_sql(t, c, k)}) g GROUP BY group_name HAVING sum(n_rows) > 1) x") for t, c, k in FUZZY[2:]]
    for table, name in (("lineitem", "l_extendedprice"), ("lineitem", "l_quantity"), ("orders_dirty", "o_totalprice"), ("events", "value"), ("documents", "n_chars")):
        out.append(({"check_id": 28, "table": table, "column": name, "extra": {"method": "iqr"}}, _fences_sql(table, name, 1.5)))
        out.append(({"check_id": 28, "table": table, "column": name, "extra": {"method": "iqr", "factor": 0.25}}, _fences_sql(table, name, 0.25)))
        out.append(({"check_id": 28, "table": table, "column": name, "extra": {"method": "mad", "factor": 1.0}}, _median_sql(table, name, 1.0)))
    for table, base, name in (("lineitem_copy", "lineitem", "l_extendedprice"), ("lineitem_copy", "lineitem", "l_quantity"), ("orders_dirty", "orders", "o_totalprice"), ("orders_dirty", "orders", "o_custkey")):
        out.append(({"check_id": 29, "table": table, "reference_table": base, "column": name, "extra": {"method": "psi"}}, _psi_sql(table, base, name, 10)))
        out.append(({"check_id": 29, "table": table, "reference_table": base, "column": name, "extra": {"method": "ks"}}, _ks_sql(table, base, name)))
    out.append(({"check_id": 29, "table": "orders_dirty", "reference_table": "orders", "column": "o_custkey", "extra": {"method": "psi", "bins": 4}}, _psi_sql("orders_dirty", "orders", "o_custkey", 4)))
    return out


def checks_by_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks 7, 28 and 29 by edits, fences, medians, PSI and Kolmogorov-Smirnov."""
    found = scan(spark, [spec for spec, _ in _method_cases()], frames(spark, sf_dir)).checks
    return found.select("seq", "check_id", F.col("table").alias("table_name"), F.round("metric_value", 8).alias("metric_value"))


def _methods_sql() -> str:
    return with_views(" UNION ALL ".join(
        f"SELECT CAST({k} AS INTEGER) AS seq, CAST({spec['check_id']} AS INTEGER) AS check_id, '{spec['table']}' AS table_name, round(({sql}), 8) AS metric_value"
        for k, (spec, sql) in enumerate(_method_cases())
    ))


def queries() -> dict[str, Query]:
    return {"fuzzy_duplicate_groups": fuzzy_duplicate_groups, "quantiles_numeric": quantiles_numeric, "checks_by_method": checks_by_method}


def oracle_sql() -> dict[str, str]:
    return {
        "fuzzy_duplicate_groups": with_views(" UNION ALL ".join(f"SELECT * FROM ({_fuzzy_groups_sql(*f)}) f{k}" for k, f in enumerate(FUZZY))),
        "quantiles_numeric": _quantiles_sql(),
        "checks_by_method": _methods_sql(),
    }
