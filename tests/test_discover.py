import datetime as dt
import random
from decimal import Decimal
from itertools import combinations

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from plumbline import Tables, column_roles, foreign_keys, inclusions, profile, suggest_checks, table_entries, unique_sets
from plumbline.operators import discover
from plumbline.sources import footers


def slow_inclusions(tables, least):
    values = {(t, c): {r[c] for r in df.select(c).collect() if r[c] is not None} for t, df in tables.items() for c in df.columns}
    kinds = {(t, c): {int: "int", str: "str", dt.date: "time", dt.datetime: "time", Decimal: "int"}[type(next(iter(v)))] for (t, c), v in values.items() if v}
    plain = lambda x: dt.datetime(x.year, x.month, x.day) if type(x) is dt.date else int(x) if isinstance(x, Decimal) else x
    values = {k: {plain(x) for x in v} for k, v in values.items()}
    return {(*a, *b, len(values[a]), len(values[a] & values[b]), len(values[b])) for a in kinds for b in kinds
            if a != b and kinds[a] == kinds[b] and values[a] & values[b] and len(values[a] & values[b]) / len(values[a]) >= least}


def test_inclusions_of_all_columns(spark):
    """More columns than a word has bits, NULLs, and kinds that do not mix."""
    rng = random.Random(4)
    wide = [f"c{i}" for i in range(70)]
    spans = [rng.choice((2, 5, 20, 60)) for _ in wide]
    rows = [tuple(rng.randrange(s) if rng.random() < 0.9 else None for s in spans) for _ in range(80)]
    day = dt.date(2024, 1, 1)
    mixed = [(i, str(i % 5), Decimal(i % 7), day + dt.timedelta(days=i % 3), dt.datetime(2024, 1, 1 + i % 4), 1.0 * i, None) for i in range(30)]
    tables = {
        "wide": spark.createDataFrame(rows, ", ".join(f"{c} long" for c in wide)),
        "mixed": spark.createDataFrame(mixed, "id int, text string, `big num` decimal(20,0), day date, at timestamp_ntz, real double, none int").drop("real"),
    }
    for least in (1.0, 0.6):
        got = {(r.child_table, r.child_column, r.parent_table, r.parent_column, r.n_values, r.n_shared, r.parent_values) for r in inclusions(spark, tables, least).collect()}
        assert got == slow_inclusions(tables, least) and len(got) > 100
    assert ("mixed", "day", "mixed", "at", 3, 3, 4) in got and not any(r[1] == "text" or r[3] == "none" for r in got)
    assert inclusions(spark, {"t": spark.range(3).select(F.col("id") * 1.5)}).count() == 0


def test_references_complete_the_entries(spark):
    tables = {
        "customer": spark.range(50).selectExpr("id AS c_custkey", "id % 4 AS c_region"),
        "orders": spark.range(200).selectExpr("id AS o_orderkey", "id % 37 AS o_custkey", "id % 3 AS o_flag"),
        "notes": spark.range(20).selectExpr("id * 5 AS o_orderkey", "CASE WHEN id = 3 THEN 999 ELSE id END AS n_custkey"),
    }
    found = foreign_keys(spark, tables)
    assert {tuple(r)[:4] for r in found.collect()} == {("orders", "o_custkey", "customer", "c_custkey"), ("notes", "o_orderkey", "orders", "o_orderkey")}
    assert foreign_keys(spark, tables, by_name=False).count() > 5
    assert ("notes", "n_custkey") in {(r.child_table, r.child_column) for r in foreign_keys(spark, tables, least=0.9).collect()}
    roles = column_roles(profile(tables["orders"], "orders")).unionByName(column_roles(profile(tables["notes"], "notes")))
    specs = suggest_checks(table_entries(roles, found))
    assert {(s.check_id, s.child_table, s.parent_table) for s in specs if s.check_id in (17, 18)} == {(k, c, p) for k in (17, 18) for c, p in (("orders", "customer"), ("notes", "orders"))}
    assert not [s for s in suggest_checks(table_entries(roles)) if s.check_id == 17]


def slow_keys(rows, names, most, all_levels):
    found = []
    for size in range(1, most + 1):
        for group in combinations(range(len(names)), size):
            cells = [tuple(r[i] for i in group) for r in rows]
            if not any(set(k) <= set(group) for k in found) and len(set(cells)) == len(rows) and not any(None in c for c in cells):
                found.append(group)
        if found and not all_levels:
            break
    return {tuple(names[i] for i in k) for k in found}


@pytest.mark.parametrize("all_levels", [False, True])
def test_unique_sets(spark, all_levels):
    rng = random.Random(9)
    for trial in range(3):
        names = ["a", "b", "c d", "e", "f"]
        spans = [rng.choice((3, 8, 30)) for _ in names]
        rows = list({tuple(rng.randrange(s) for s in spans) for _ in range(120)})
        if trial == 2:
            rows.append((None, *rows[0][1:]))
        df = spark.createDataFrame(rows, ", ".join(f"`{n}` int" for n in names))
        assert set(unique_sets(df, all_levels=all_levels)) == slow_keys(rows, names, 3, all_levels)
    twice = spark.createDataFrame([*rows, rows[0]], df.schema)
    assert unique_sets(twice) == []


def test_keys_of_many_rows_and_of_none(spark):
    lines = spark.range(60_000).selectExpr("id DIV 7 AS l_orderkey", "id % 7 AS l_linenumber", "id % 3 AS other", "CAST(id AS DOUBLE) AS price")
    assert unique_sets(lines) == [("l_orderkey", "l_linenumber")]
    assert unique_sets(lines, ["price", "other"]) == [("price",)]
    assert unique_sets(lines.union(lines.limit(1))) == []
    assert unique_sets(lines.select("price")) == []
    assert unique_sets(spark.createDataFrame([], "a int, b int")) in ([("a",), ("b",)], [])


def test_few_sets_are_verified_over_all_rows(spark, monkeypatch):
    """Sets with a few repeats are refuted by some of the keys; one repeat is found at last."""
    whole = []
    monkeypatch.setattr(discover, "kept", lambda df: whole.append(df.columns) or df)
    lines = spark.range(40_000).selectExpr("id AS a", "id - id % 40 DIV 39 AS b", "IF(id < 20000, id % 10000, id) AS c", "IF(id = 7, 8L, id) AS d", "1 AS e")
    assert unique_sets(lines) == [("a",)] and 1 <= len(whole) <= 2
    assert unique_sets(lines, ["d", "e"]) == [] and unique_sets(lines, ["b", "c"]) == slow_pair(lines)


def slow_pair(df):
    rows = df.select("b", "c").collect()
    return [("b", "c")] if len(set(rows)) == len(rows) else []


# -- footers --------------------------------------------------------------------

@pytest.fixture(scope="module")
def files(tmp_path_factory):
    folder = tmp_path_factory.mktemp("footers")
    day = dt.date(2020, 1, 1)
    columns = {
        "i": pa.array([5, None, -3, 8] * 50, pa.int64()), "s": pa.array(["x", None, "yy", None] * 50), "d": pa.array([day, day + dt.timedelta(days=9), None, day] * 50),
        "x": pa.array([1.0, float("nan"), None, 2.0] * 50), "none": pa.array([None] * 200, pa.int32()), "l": pa.array([[1], None, [2, 3], []] * 50),
        "t": pa.array([dt.datetime(2021, 1, 1), None, None, dt.datetime(2022, 1, 1)] * 50, pa.timestamp("us")), "b": pa.array([True, None, False, True] * 50),
    }
    for part in range(3):
        (folder / "full.parquet").mkdir(exist_ok=True)
        pq.write_table(pa.table(columns), folder / "full.parquet" / f"{part}.parquet", row_group_size=64)
    pq.write_table(pa.table(columns), folder / "bare.parquet", write_statistics=["s", "x"])
    return folder


def test_counts_and_bounds_of_footers(spark, files):
    wanted = {("i", 600, 150, "-3", "8"), ("s", 600, 300, None, None), ("d", 600, 150, "2020-01-01", "2020-01-10"), ("x", 600, 150, None, None), ("none", 600, 600, None, None),
              ("t", 600, 300, None, None), ("b", 600, 150, None, None)}
    got = footers.bounds(spark, {"full": str(files / "full.parquet")}).collect()
    assert {tuple(r)[1:6] for r in got} == wanted
    bare = footers.bounds(spark, {"bare": str(files / "bare.parquet")}).collect()
    assert {(r.column, r.row_count * 3, r.null_count * 3, r.low, r.high) for r in bare} == wanted
    flags = {r.column: r.from_footers for r in bare}
    assert flags["s"] and not flags["i"] and not flags["t"]
    assert {r.column for r in footers.bounds(spark, {"full": str(files / "full.parquet")}, ["I", "zz"]).collect()} == {"i"}


def test_nothing_but_footers_is_read(spark, files):
    session = footers.footer_session(spark)
    df = session.read.parquet(str(files / "full.parquet"))
    fields = [f for f in df.schema.fields if f.name in ("i", "s", "d", "x", "t", "b")]
    plan = footers.pushed(df, fields)._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT(*), COUNT(i), MIN(i), MAX(i), COUNT(s)" in plan and "MAX(d)" in plan and "MAX(x)" not in plan
    assert "PushedAggregation: []" not in plan
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"      # the caller's session is as it was


def test_paths_of_tables(spark):
    tables = Tables(spark, {"a": "/x/a.parquet", "b": "/x/b.csv", "c": {"path": "/x/c", "format": "parquet"}, "d": spark.range(1), "e": {"path": "/x/e.parquet", "schema": "a int"}})
    assert [tables.parquet_path(t) for t in "abcdef"] == ["/x/a.parquet", None, "/x/c", None, None, None]
