"""Suggested checks, table sources, configurations and sinks."""

import json

import pytest

from plumbline import CheckSpec, ScanConfig, Tables, column_roles, load_scan, run_scan, scan, suggest_checks, table_entries
from plumbline.operators.suggest import checks_from_constraints, specs_frame
from plumbline.sources import write_flat, write_nested
from plumbline.sources.tables import path_format, path_table_name


def profile_rows(spark, rows):
    return spark.createDataFrame(
        [("sales", i, c, k, n, u, top, lo, hi) for i, (c, k, n, u, top, lo, hi) in enumerate(rows)],
        "table string, ordinal int, column string, category string, row_count bigint, unique_count bigint,"
        " top_values map<string,double>, min_value string, max_value string",
    )


@pytest.fixture(scope="module")
def roles(spark):
    few = {"b": 0.6, "a": 0.4}
    return column_roles(profile_rows(spark, [
        ("item_sk", "int", 1000, 1000, None, "1", "1000"),
        ("item_id", "str", 1000, 1000, None, None, None),
        ("list_price", "float", 1000, 800, None, "0.5", "99.0"),
        ("sales_tax", "str", 1000, 800, None, None, None),           # numeric by its name
        ("currency_code", "str", 1000, 2, few, None, None),
        ("color", "str", 1000, 2, few, None, None),
        ("notes", "str", 1000, 900, None, None, None),
        ("quantity", "int", 1000, 100, None, "1", "100"),
        ("loaded_at", "datetime", 1000, 900, None, "2024-01-01", "2024-02-01"),
        ("created", "str", 1000, 10, few, None, None),
        ("sold_date_sk", "int", 1000, 300, None, "1", "300"),
        ("state", "str", 100000, 60, None, None, None),               # 60 values, 0.06 % of the rows
        ("empty", "str", 1000, 0, None, None, None),
    ]))


def test_roles(roles):
    got = {r["column"]: r for r in roles.collect()}
    want = {
        "item_sk": ["pk"], "item_id": ["bk"], "list_price": ["monetary"], "sales_tax": ["monetary"],
        "currency_code": ["bk"], "color": ["categorical"], "notes": [], "quantity": ["numeric"],
        "loaded_at": ["timestamp"], "created": ["timestamp"], "sold_date_sk": ["pk"], "state": ["categorical"], "empty": [],
    }
    assert {c: r["roles"] for c, r in got.items()} == want
    assert got["color"]["valid_values"] == ["b", "a"] and got["quantity"]["max"] == 100.0
    assert got["loaded_at"]["min"] is None and got["list_price"]["currency_column"] == "currency_code"


def ids(specs):
    return sorted((s.check_id, s.column or s.pk_column or "") for s in specs)


def test_checks_of_roles(roles):
    (entry,) = table_entries(roles)
    specs = suggest_checks([entry])
    by = lambda i: [s.column or s.pk_column for s in specs if s.check_id == i]
    assert by(1) == [
        "list_price", "sales_tax", "color", "state", "quantity", "loaded_at", "created", "item_id", "currency_code",
    ]
    critical = ("list_price", "sales_tax", "item_sk", "item_id", "currency_code", "sold_date_sk")
    assert [s.columns for s in specs if s.check_id in (2, 3)] == [critical, critical]
    assert by(5) == ["item_sk", "sold_date_sk"]
    assert [s.business_key_columns for s in specs if s.check_id == 6] == [("item_id", "currency_code")]
    assert by(8) == by(12) == ["list_price", "sales_tax"]
    assert by(28) == ["quantity", "list_price", "sales_tax"] and by(29) == ["quantity"]
    assert by(9) == ["color"] and by(11) == ["quantity"]
    assert not {s.check_id for s in specs} & {4, 10, 13, 14, 15, 16, 17, 18, 19, 20, 21, 22, 23, 24, 25, 26, 27, 30, 31, 32, 33}


def test_checks_of_answers(roles):
    (entry,) = table_entries(roles)
    entry["foreign_keys"] = [{"column": "sold_date_sk", "references_table": "dates", "references_column": "d_sk"}]
    entry["business_rules"] = ["list_price >= 0", " "]
    entry["conditional_completeness"] = [{"condition": "color = 'b'", "column_must_not_be_null": "state"}]
    entry["monetary_columns"][0]["valid_currencies"] = ["USD"]
    entry["monetary_columns"][1]["must_be_positive"] = False
    entry["categorical_columns"][0]["standardize"] = True
    entry["numeric_columns"][0]["must_be_positive"] = True
    entry["timestamp_columns"][0] |= {"freshness_sla_hours": 36, "is_event_time": True, "late_arrival_hours": 6, "must_be_after": "created"}
    entry["volume"] = {"max_daily_change_pct": 20, "prior_table": "sales_old"}
    specs = suggest_checks([entry])
    one = lambda i: next(s for s in specs if s.check_id == i)
    assert one(17).child_table == one(18).child_table == one(19).source_table == "sales"
    assert one(19).reference_column == "d_sk"
    assert one(15).column == "currency_code" and one(15).allowed_values == ("USD",)
    assert one(16).column == "color" and one(13).condition == "loaded_at < created"
    assert [s.column for s in specs if s.check_id == 12] == ["list_price", "quantity"]
    assert (one(20).freshness_sla_hours, one(21).stale_days) == (36, 1.5)
    assert (one(22).event_timestamp_column, one(22).load_timestamp_column) == ("loaded_at", "created")
    assert one(4).dependent_column == "state" and [s.condition for s in specs if s.check_id == 26] == ["list_price >= 0"]
    assert (one(23).prior_table, one(23).volume_change_band) == ("sales_old", 0.2)
    entry["volume"] = {"max_daily_change_pct": 20, "is_date_partitioned": True, "partition_column": "day"}
    assert next(s for s in suggest_checks([entry]) if s.check_id == 23).condition == "day = current_date()"


def test_checks_of_constraints():
    columns = [
        ("sales", "ss_sk", "INTEGER"), ("sales", "store_id", "VARCHAR"), ("sales", "price", "DOUBLE"),
        ("sales", "cost", "DOUBLE"), ("sales", "amount", "DOUBLE"), ("keys", "k_sk", "INTEGER"),
    ]
    links = [("sales", "ss_sk", "keys", "k_sk")]
    assert len(checks_from_constraints(columns, {"sales": ["ss_sk"]}, links)) > 6      # no column is left out
    specs = checks_from_constraints(columns, {"sales": ["ss_sk"]}, links, per_check={1: 1, 6: 1, 12: 2})
    assert ids(specs) == [(1, "store_id"), (5, "ss_sk"), (6, ""), (12, "cost"), (12, "price"), (17, "")]
    assert next(s for s in specs if s.check_id == 17).parent_column == "k_sk"


def test_specs_as_rows_and_back(spark):
    specs = [CheckSpec(9, table="t", column="c", allowed_values=(1, "a")), CheckSpec(6, table="t", business_key_columns=("a", "b"))]
    rows = specs_frame(spark, specs).orderBy("seq").collect()
    assert [CheckSpec.from_dict(json.loads(r["parameters"])) for r in rows] == specs
    assert CheckSpec.from_dict({"check_id": 7, "columns": "name"}).columns == ("name",)
    assert CheckSpec.from_dict({"check_id": 1, "made_up": 5, "table": None}) == CheckSpec(1)


def test_path_names():
    assert [path_format(p) for p in ("a/b.parquet", "a/b.PQ", "a/b.csv", "a/b.txt")] == ["parquet", "parquet", "csv", "csv"]
    assert path_table_name("s3a://bucket/dir/orders.parquet") == path_table_name("orders.csv") == "orders"


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, None)], "id int, v string")
    df.write.parquet(str(tmp_path / "p.parquet"))
    df.write.option("header", True).option("sep", "|").csv(str(tmp_path / "c.csv"))
    df.write.csv(str(tmp_path / "bare.csv"))
    df.createOrReplaceTempView("in_catalog")
    opened = []
    tables = Tables(spark, {
        "frame": df, "path": str(tmp_path / "p.parquet"), "piped": {"path": str(tmp_path / "c.csv"), "delim": "|"},
        "bare": {"path": str(tmp_path / "bare.csv"), "header": False, "schema": "id int, v string"},
        "other": {"table": "in_catalog"}, "lazy": lambda: opened.append(1) or df,
    })
    assert not opened
    for name in (*tables.names(), "in_catalog"):
        assert tables.has(name)
        assert tables.frame(name).orderBy("id").collect() == [(1, "x"), (2, None)], name
    tables.frame("lazy")
    assert len(opened) == 1 and not tables.has("nowhere")
    assert set(Tables.from_paths(spark, str(tmp_path / "p.parquet")).names()) == {"p"}


def test_config_file_and_sinks(spark, tmp_path):
    spark.createDataFrame([(1, "x"), (2, None)], "id int, v string").write.parquet(str(tmp_path / "t.parquet"))
    path = tmp_path / "scan.yaml"
    path.write_text(f"""
scan_name: nightly
checks:
  - {{check_id: 1, table: t, column: v}}
  - {{check_id: 5, table: t, pk_column: id, unknown_setting: 3}}
  - {{check_id: 31, metadata_catalog_table: absent}}
sources:
  t: {tmp_path}/t.parquet
""")
    config = load_scan(str(path))
    assert (config.scan_name, config.mode, len(config.checks), config.screener) == ("nightly", "live", 3, None)
    result = run_scan(spark, config).result.materialize()
    flat = result.flat()
    assert flat.count() == 3 and flat.first()["scan_name"] == "nightly"
    write_flat(flat, str(tmp_path / "out.csv"))
    back = spark.read.csv(str(tmp_path / "out.csv"), header=True, inferSchema=True)
    assert back.columns == flat.columns and back.where("check_id = 1").first()["metric_value"] == 0.5
    write_flat(flat, str(tmp_path / "out.parquet"), "parquet")
    write_nested(flat, str(tmp_path / "out.json"))
    (document,) = [json.loads(line) for f in (tmp_path / "out.json").glob("part-*") for line in f.read_text().splitlines()]
    assert [d["dimension"] for d in document["dimensions"]] == ["completeness", "uniqueness", "metadata"]
    assert document["dimensions"][0]["checks"][0]["metric_value"] == 0.5
    assert document["dimensions"][2]["checks"][0]["error"]
    with pytest.raises(ValueError, match="mode"):
        ScanConfig.from_dict({"mode": "other"})


def test_flat_columns(spark):
    flat = scan(spark, [CheckSpec(1, table="t", column="id")], {"t": spark.range(3)}).flat()
    assert flat.columns[:21] == [
        "scan_name", "mode", "source", "overall_score", "dimension", "dimension_weight", "dimension_score",
        "check_id", "check_name", "metric_name", "metric_value", "threshold", "passed", "pass_score",
        "effective_weight", "weighted_score", "table", "column", "error", "skipped", "timestamp",
    ]


def test_configurations_survive_writing(tmp_path):
    from plumbline.sources.config import save_scan

    raw = {"scan_name": "s", "mode": "synthetic", "mvp_only": True, "sources": {"t": "t.parquet"}, "screener": {"enabled": True},
           "checks": [{"check_id": 1, "table": "t", "column": "a"}, {"check_id": 9, "table": "t", "column": "b", "allowed_values": ["x", "y"]}]}
    config = ScanConfig.from_dict(raw)
    assert ScanConfig.from_dict(config.to_dict()) == config
    pytest.importorskip("yaml")
    save_scan(config, str(tmp_path / "scan.yaml"))
    assert load_scan(str(tmp_path / "scan.yaml")) == config


def test_a_report_has_a_header(spark):
    t = spark.sql("SELECT concat('user', id, '@example.com') AS email, id FROM range(30)")
    config = {"checks": [{"check_id": 1, "table": "t", "column": "id"}], "screener": {"enabled": True, "on_pii_detected": "synthetic"},
              "synthetic_row_count": 50}
    run = run_scan(spark, config, {"t": t}).materialize()
    row = run.report().collect()[0]
    assert row["is_synthetic"] and row["gate"] == "SYNTHETIC_MODE" and row["duration_seconds"] >= 0
    assert len(row["manifests"]) == 1 and row["dimensions"][0]["checks"]
