"""Two-table and key checks on skewed data, against plain joins."""

import random

import pytest

from plumbline import CheckSpec, scan


@pytest.fixture(scope="module")
def sides(spark):
    rng = random.Random(11)

    def rows(n, keys, values):
        for _ in range(n):
            hot = rng.random() < 0.34
            yield (
                0 if hot else (None if rng.random() < 0.05 else rng.randrange(keys)),
                None if rng.random() < 0.1 else (0.0 if rng.random() < 0.3 else float(rng.randrange(values))),
            )

    left = spark.createDataFrame(list(rows(1500, 60, 9)), "k int, v double").cache()
    right = spark.createDataFrame(list(rows(400, 45, 9)), "k bigint, v double").cache()
    left.createOrReplaceTempView("left_rows")
    right.createOrReplaceTempView("right_rows")
    return {"l": left, "r": right}


def test_matches_plain_joins(spark, sides):
    joined = "left_rows l JOIN right_rows r ON l.k = r.k"
    child = dict(child_table="l", child_column="k", parent_table="r", parent_column="k")
    cases = [
        (CheckSpec(14, source_table="l", reference_table="r", column="v", extra={"join_key": "k"}),
         f"SELECT count_if(l.v <> r.v) / count(*) FROM {joined}"),
        (CheckSpec(17, **child),
         "SELECT count_if(l.k IS NOT NULL) / (SELECT count(*) FROM left_rows) FROM left_rows l LEFT ANTI JOIN right_rows r ON l.k = r.k"),
        (CheckSpec(18, **child),
         "SELECT count(*) / (SELECT count(*) FROM left_rows) FROM left_rows l LEFT ANTI JOIN right_rows r ON l.k = r.k"),
        (CheckSpec(19, source_table="l", column="k", reference_table="r", reference_column="k"),
         "SELECT count(r.k) / count(*) FROM left_rows l LEFT JOIN right_rows r ON l.k = r.k"),
        (CheckSpec(24, expected_partitions_table="l", actual_partitions_table="r", partition_key="k"),
         "SELECT count(*) FROM left_rows l LEFT ANTI JOIN right_rows r ON l.k = r.k"),
        (CheckSpec(5, table="l", pk_column="k"), "SELECT (count(*) - count(DISTINCT k)) / count(*) FROM left_rows"),
        (CheckSpec(6, table="l", business_key_columns=("k", "v")),
         "SELECT (count(*) - count(DISTINCT struct(k, v))) / count(*) FROM left_rows"),
    ]
    got = scan(spark, [spec for spec, _ in cases], sides).checks.orderBy("seq").collect()
    for row, (_, sql) in zip(got, cases):
        want = float(spark.sql(sql).first()[0])
        assert want > 0 and row["metric_value"] == pytest.approx(want, rel=1e-12), row["metric_name"]


def test_no_pass_joins_or_ranks_raw_rows(spark, sides):
    specs = [
        CheckSpec(14, source_table="l", reference_table="r", column="v", extra={"join_key": "k"}),
        CheckSpec(17, table="l", column="k", parent_table="r", parent_column="k"),
        CheckSpec(25, source_table="l", target_table="r", column="v"),
        CheckSpec(28, table="l", column="v"),
    ]
    for frame, _ in scan(spark, specs, sides).plan.passes:
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and "CartesianProduct" not in plan and "Window" not in plan


def test_keys_of_different_types(spark):
    tables = {
        "days": spark.sql("SELECT explode(sequence(DATE'2024-01-01', DATE'2024-01-04')) AS d, '2' AS t, 2 AS i, 1.50BD AS c"),
        "times": spark.sql("SELECT TIMESTAMP_NTZ'2024-01-02 00:00:00' AS d, 2L AS t, 2.0D AS i, 1.5D AS c"),
    }
    specs = [CheckSpec(18, table="days", column=c, parent_table="times", parent_column=c) for c in ("d", "t", "i", "c")]
    got = scan(spark, specs, tables).checks.orderBy("seq").collect()
    assert [(r["metric_value"], r["error"]) for r in got] == [(0.75, None), (0.0, None), (0.0, None), (0.0, None)]


def test_cells_are_counted_in_slices(spark):
    """Few shuffle partitions: keys are dealt to more tasks, and numbers are not kept as text."""
    odd = "nullif(id % 7, 3)", "CASE id % 5 WHEN 0 THEN -0.0D WHEN 1 THEN 0.0D WHEN 2 THEN double('nan') ELSE id % 9 + 0.5D END"
    left = spark.range(300).selectExpr(f"{odd[0]} AS i", f"{odd[1]} AS k", f"{odd[1]} AS v", "cast(id % 4 AS string) AS t")
    right = spark.range(100).selectExpr(f"{odd[0]} AS i", f"-({odd[1]}) AS k", f"-({odd[1]}) AS v", "cast(id % 3 AS string) AS t")
    left.createOrReplaceTempView("odd_left")
    right.createOrReplaceTempView("odd_right")
    pairs = [("i", "v"), ("k", "v"), ("k", "t"), ("k", "i"), ("i", "t")]
    specs = [CheckSpec(14, source_table="l", reference_table="r", column=v, extra={"join_key": k}) for k, v in pairs]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "12")
        one = scan(spark, specs[:1], {"l": left, "r": right}).plan.passes[0][0]
        plan = one._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("xxhash64(v") == 2 * plan.count("sum(on_left") == 8 and "as string" not in plan
        got = scan(spark, specs, {"l": left, "r": right}).checks.orderBy("seq").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for row, (k, v) in zip(got, pairs):
        want = spark.sql(f"SELECT count_if(l.{v} <> r.{v}) / count(*) FROM odd_left l JOIN odd_right r ON l.{k} = r.{k}").first()[0]
        assert row["metric_value"] == pytest.approx(float(want), rel=1e-12), (k, v)
