"""Profiles, row samples and synthetic tables."""

import datetime as dt
import decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline import CheckSpec, profile, run_scan, synthesize
from plumbline.functions.columns import type_category
from plumbline.operators.profile import _cells, sample_rows, schema_listing
from plumbline.operators.synth import clone_tables


@pytest.fixture(scope="module")
def table(spark):
    schema = (
        "i int, f double, s string, b boolean, d date, ts timestamp_ntz, dec decimal(9,2), big decimal(20,0),"
        " bin binary, many string, arr array<int>, m map<string,int>, fl float"
    )
    rows = [
        (
            n % 3 if n % 4 else None, -0.0 if n % 2 else 0.0, None, bool(n % 2), dt.date(2024, 1, 1 + n % 5),
            dt.datetime(2024, 1, 1, n % 24, 30), decimal.Decimal(n % 7) / 4, decimal.Decimal(10**15 + n),
            b"\xff" if n % 2 else b"\xfe", f"v{n}", [n], {"a": n}, 0.1,
        )
        for n in range(300)
    ]
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.mark.parametrize("distinct", ["exact", "approx"])
def test_profile(spark, table, distinct):
    p = {r["column"]: r for r in profile(table, "t", distinct).collect()}
    assert [p[c]["ordinal"] for c in table.columns] == list(range(13))
    i = p["i"]
    assert (i["row_count"], i["null_rate"], i["unique_count"], i["cardinality_ratio"]) == (300, 0.25, 3, 0.01)
    assert (i["min_value"], i["max_value"], i["mean"], i["is_nullable"]) == ("0", "2", 1.0, True)
    assert i["top_values"] == {"0": 0.25, "1": 0.25, "2": 0.25} and sorted(i["sample_values"]) == ["0", "1", "2"]
    assert p["f"]["unique_count"] == 1 and p["fl"]["top_values"] == {"0.1": 1.0}
    assert (p["s"]["unique_count"], p["s"]["top_values"], p["s"]["null_rate"]) == (0, {}, 1.0)
    assert p["b"]["top_values"] == {"false": 0.5, "true": 0.5} and p["b"]["category"] == "bool"
    assert (p["d"]["min_value"], p["d"]["max_value"]) == ("2024-01-01", "2024-01-05")
    assert p["ts"]["unique_count"] == 24 and p["ts"]["max_value"] == "2024-01-01 23:30:00"
    assert (p["dec"]["category"], p["big"]["category"]) == ("float", "int")
    assert p["dec"]["unique_count"] == 7 and p["bin"]["unique_count"] == 2
    assert p["many"]["top_values"] is None and len(set(p["many"]["sample_values"])) == 20
    assert p["many"]["unique_count"] == 300 if distinct == "exact" else abs(p["many"]["unique_count"] - 300) < 60
    for nested in ("arr", "m"):
        assert (p[nested]["unique_count"], p[nested]["top_values"], p[nested]["null_rate"]) == (None, None, 0.0)


def test_profile_does_not_depend_on_partitions(spark, table):
    first = [r.asDict() for r in profile(table).collect()]
    again = [r.asDict() for r in profile(table.repartition(7)).collect()]
    strip = lambda rows: [{k: v for k, v in r.items() if k not in ("mean", "stddev")} for r in rows]
    assert strip(first) == strip(again)


def test_profile_of_nothing(spark, table):
    p = profile(table.where("i > 5")).collect()
    assert all(r["row_count"] == 0 and r["null_rate"] == 0 and r["top_values"] is None for r in p)
    nested_only = profile(spark.createDataFrame([([1],)], "a array<int>")).collect()
    assert nested_only[0]["row_count"] == 1 and nested_only[0]["sample_values"] == []


def test_wide_table_takes_several_passes(spark):
    wide = spark.range(50).select(*[(F.col("id") % k).alias(f"c{k}") for k in range(1, 41)])
    p = profile(wide).collect()
    assert [r["unique_count"] for r in p] == list(range(1, 41)) and {r["row_count"] for r in p} == {50}


def test_top_values_are_cut_at_fifty(spark):
    p = profile(spark.range(1000).selectExpr("id % 80 AS k")).first()
    assert p["unique_count"] == 80 and len(p["top_values"]) == 50


@pytest.mark.parametrize(
    ("kind", "want"),
    [
        (T.LongType(), "int"), (T.DecimalType(10, 0), "int"), (T.DecimalType(10, 2), "float"), (T.FloatType(), "float"),
        (T.BooleanType(), "bool"), (T.DateType(), "datetime"), (T.TimestampNTZType(), "datetime"),
        (T.StringType(), "str"), (T.BinaryType(), "str"), (T.ArrayType(T.LongType()), "str"),
    ],
)
def test_type_category(kind, want):
    assert type_category(kind) == want


def test_schema_listing(table):
    rows = schema_listing(table, "t").collect()
    assert (rows[0]["column"], rows[0]["dtype"], rows[10]["category"]) == ("i", "int", "str")


def test_sample_rows(spark):
    big = spark.range(0, 100_000, 1, 20)
    assert sample_rows(big).count() == 50 and sample_rows(big).distinct().count() == 50
    assert {r["id"] for r in sample_rows(big).collect()} == {r["id"] for r in sample_rows(big).collect()}
    assert sample_rows(spark.range(100)).count() == 20
    assert sample_rows(spark.range(2)).count() == 1 and sample_rows(spark.range(0)).count() == 0


def test_clone_follows_the_profile(spark, table):
    p = profile(table, "t")
    clone = synthesize(spark, p, rows=20_000)
    assert [f.dataType for f in clone.schema] == [f.dataType for f in table.schema]
    c = {r["column"]: r for r in profile(clone, "c").collect()}
    assert c["i"]["null_rate"] == pytest.approx(0.25, abs=0.02)
    assert c["i"]["top_values"]["1"] == pytest.approx(0.25, abs=0.02)
    assert c["s"]["null_rate"] == 1.0
    assert c["b"]["top_values"]["true"] == pytest.approx(0.5, abs=0.02)
    assert c["d"]["unique_count"] == 5
    assert clone.where("many LIKE 'val\\_________'").count() == 20_000
    assert clone.where("many IN ('v1', 'v2')").count() == 0
    copied = synthesize(spark, p, rows=500, allow_sample_values=True)
    assert copied.join(table, "many", "left_anti").count() == 0


def test_clone_of_numbers(spark):
    base = spark.range(5000).selectExpr(
        "id AS whole", "CAST(id % 997 AS DOUBLE) / 10 AS real", "CAST(id AS DECIMAL(9,2)) / 100 AS cents",
        "timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id * 60) AS ts", "id % 2000 - 1000 AS centred",
    )
    want = {r["column"]: r for r in profile(base).collect()}
    got = {r["column"]: r for r in profile(synthesize(spark, profile(base), rows=20_000)).collect()}
    for c in ("whole", "real", "cents", "centred"):
        spread = float(want[c]["stddev"])
        assert got[c]["mean"] == pytest.approx(want[c]["mean"], abs=0.05 * spread)
        assert got[c]["stddev"] == pytest.approx(spread, rel=0.12)     # the tails are cut at the bounds
        assert float(got[c]["min_value"]) >= float(want[c]["min_value"])
        assert float(got[c]["max_value"]) <= float(want[c]["max_value"])
    assert want["ts"]["min_value"] <= got["ts"]["min_value"] <= got["ts"]["max_value"] <= want["ts"]["max_value"]


def test_clone_is_the_same_however_it_is_split(spark, table):
    p = profile(table, "t").cache()
    small = synthesize(spark, p, rows=100).drop("m", "arr")
    large = synthesize(spark, p, rows=100).drop("m", "arr").repartition(9)
    assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))
    assert synthesize(spark, p, rows=100, seed=1).drop("m", "arr").exceptAll(small).count() > 0


def test_constant_and_unbounded_columns(spark):
    p = profile(spark.sql("SELECT CAST(NULL AS INT) AS none, 7 AS seven"))
    drawn = synthesize(spark, p, rows=50)
    assert drawn.where("none IS NULL AND seven = 7").count() == 50


def test_scan_of_clones(spark, table):
    specs = [CheckSpec(1, table="db.t", column="i"), CheckSpec(9, table="db.t", column="b", allowed_values=(True,))]
    clones = clone_tables(spark, specs, {"db.t": table}, rows=2000)
    assert clones.frame("db.t").count() == 2000
    run = run_scan(
        spark, {"checks": [s.to_dict() for s in specs], "mode": "synthetic", "synthetic_row_count": 2000}, {"db.t": table}
    )
    rows = {r["check_id"]: r["metric_value"] for r in run.result.checks.collect()}
    assert run.result.mode == "synthetic"
    assert rows[1] == pytest.approx(0.25, abs=0.04) and rows[9] == pytest.approx(0.5, abs=0.04)


def test_clones_hold_no_protected_values(spark):
    from plumbline.operators.synth import clone_tables

    t = spark.sql("SELECT concat('user', id, '@example.com') AS mail, 5550000 + id AS phone, id % 3 AS kind FROM range(80)")
    clones = clone_tables(spark, [{"check_id": 1, "table": "t", "column": "kind"}], {"t": t}, rows=500, allow_sample_values=True,
                          protected=[("t", "mail"), ("T", "PHONE")])
    clone = clones.frame("t").cache()
    assert clone.join(t, "mail").count() == 0 == clone.join(t, "phone").count()
    assert {r["kind"] for r in clone.select("kind").distinct().collect()} == {0, 1, 2}


def test_clones_draw_from_all_values_of_a_category(spark):
    from plumbline.operators.synth import clone_tables

    t = spark.sql("SELECT concat('v', id % 90) AS v FROM range(900)")
    clone = clone_tables(spark, [{"check_id": 1, "table": "t", "column": "v"}], {"t": t}, rows=5000).frame("t")
    assert clone.select("v").distinct().count() == 90


def test_row_samples_do_not_depend_on_the_layout(spark):
    from plumbline.operators.profile import sample_rows

    t = spark.range(3000).selectExpr("id", "id * 7 % 11 AS v")
    one, other = (sorted(map(tuple, sample_rows(d, max_rows=30).collect())) for d in (t.repartition(1), t.repartition(7)))
    assert one == other and len(one) == 30
    assert sample_rows(t.limit(3)).count() == 1 and sample_rows(t.limit(0)).count() == 0


def test_long_texts_are_grouped_by_digest(spark):
    """Their counts, top values and samples are those of the texts; the shuffle of values holds no long text."""
    rows = [(i, f"{'long text ' * 20}{i % 3}", f"{'other ' * 30}{i}" if i % 5 else None, "short" if i % 2 else "s" * 33) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, few string, many string, mixed string")
    got = {r["column"]: r for r in profile(df).collect()}
    assert got["few"]["unique_count"] == 3 and got["few"]["top_values"] == {f"{'long text ' * 20}{k}": pytest.approx(1 / 3) for k in range(3)}
    assert got["mixed"]["top_values"] == {"short": 0.5, "s" * 33: 0.5}
    assert got["many"]["unique_count"] == 240 and len(got["many"]["sample_values"]) == 20 and set(got["many"]["sample_values"]) < {r[2] for r in rows}
    cells = _cells(df, df.schema.fields, [0, 1, 2, 3]).collect()
    assert len(cells) == 300 * 4 - 60 and max(len(c["text"] or "") for c in cells) == 5
