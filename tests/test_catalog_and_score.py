"""Weights, selection and scoring."""

import pytest
from pyspark.sql import functions as F

from plumbline import CHECKS, CheckDef, CheckSpec, catalog_frame, register_check, scan
from plumbline.catalog import DIMENSION_WEIGHTS
from plumbline.operators.registry import BUILDERS
from plumbline.plans import report, score
from plumbline.spec import select_specs


def test_weights_sum_to_one():
    assert sum(DIMENSION_WEIGHTS.values()) == pytest.approx(1)
    for dimension in DIMENSION_WEIGHTS:
        within = [d.within_weight for d in CHECKS.values() if d.dimension == dimension]
        assert sum(within) == pytest.approx(1)
    assert sum(d.effective_weight for d in CHECKS.values()) == pytest.approx(1)


def test_phases_and_builders():
    phases = [d.phase for d in CHECKS.values()]
    assert (phases.count("mvp"), phases.count("phase2"), phases.count("later")) == (20, 11, 2)
    assert set(BUILDERS) == set(CHECKS) == set(range(1, 34))


def test_catalog_frame(spark):
    rows = {r["check_id"]: r for r in catalog_frame(spark).collect()}
    assert len(rows) == 33
    assert rows[19]["higher_is_better"] and rows[7]["threshold"] is None
    assert rows[5]["effective_weight"] == pytest.approx(0.14 * 0.55)


# metric, threshold, higher is better -> score to two decimals
GOLDEN = [
    (0.000, 0.0, False, 1.00), (0.005, 0.0, False, 0.00), (0.030, 0.05, False, 1.00), (0.070, 0.05, False, 0.60),
    (0.100, 0.05, False, 0.00), (0.032, 0.0, False, 0.00), (0.985, 0.99, True, 0.99), (18.0, 24.0, False, 1.00),
    (0.5, 0.05, False, 0.00), (0.0, 0.99, True, 0.00), (1.2, 0.99, True, 1.00),
]


def test_pass_score(spark):
    df = spark.createDataFrame([(i, *g) for i, g in enumerate(GOLDEN)], "i int, m double, t double, h boolean, want double")
    got = df.select("want", F.round(score.pass_score(F.col("m"), F.col("t"), F.col("h")), 2).alias("s")).collect()
    assert [r["s"] for r in got] == [r["want"] for r in got]


def rows_of(df, *names):
    return [tuple(r[n] for n in names) for r in df.orderBy("seq").collect()]


def test_skips_errors_and_advisory(spark):
    t = spark.createDataFrame([(1, "a"), (2, None)], "id int, name string")
    empty = t.where("id > 5")
    specs = [
        CheckSpec(1, table="t", column="name", enabled=False),
        CheckSpec(1, table="t", column="id"),
        CheckSpec(1, table="t", column="name"),
        CheckSpec(1, table="e", column="id"),                 # no rows: no value, so skipped
        CheckSpec(1, table="t", column="nothing"),             # error
        CheckSpec(28, table="t", column="nothing"),            # advisory error counts as passed
        CheckSpec(28, table="e", column="id"),                 # advisory without a value
        CheckSpec(9, table="t", column="name"),                # parameter missing
        CheckSpec(1, table="absent", column="id"),
        CheckSpec(99, table="t"),                              # unknown checks are ignored
    ]
    r = scan(spark, specs, {"t": t, "e": empty}, excluded={("t", "id")})
    got = rows_of(r.checks, "skipped", "passed", "pass_score")
    assert got == [
        (True, False, 1.0), (True, False, 1.0), (False, False, 0.0), (True, False, 1.0), (False, False, 0.0),
        (False, True, 1.0), (False, True, 1.0), (False, False, 0.0), (False, False, 0.0),
    ]
    errors = [e for (e,) in rows_of(r.checks, "error")]
    assert errors[1] == "pii_excluded" and errors[0] is None and errors[3] is None
    assert "nothing" in errors[4] and errors[5] and "allowed_values" in errors[7] and "absent" in errors[8]
    dims = {d["dimension"]: d for d in r.dimensions.collect()}
    assert (dims["completeness"]["checks_passed"], dims["completeness"]["checks_failed"],
            dims["completeness"]["checks_skipped"]) == (0, 3, 3)
    assert (dims["anomaly"]["checks_passed"], dims["anomaly"]["checks_failed"]) == (2, 0)
    overall = r.overall.first()
    assert overall["total_checks"] == 9
    want = (0 * 0.20 + 100 * 0.03 + 0 * 0.14) / (0.20 + 0.03 + 0.14)
    assert overall["overall_score"] == pytest.approx(round(want, 2))


def test_no_checks_and_all_skipped(spark):
    t = spark.createDataFrame([(1,)], "id int")
    none = scan(spark, [], {"t": t})
    assert none.overall.first()["overall_score"] == 100.0 and none.overall.first()["total_checks"] == 0
    off = scan(spark, [CheckSpec(1, table="t", column="id", enabled=False)], {"t": t})
    assert off.dimensions.first()["dimension_score"] == 100.0
    assert off.overall.first()["overall_score"] == 100.0


def test_strict_exclusion(spark):
    t = spark.createDataFrame([(1, 1)], "id int, other int")
    spec = [CheckSpec(2, table="t", columns=("id", "other"))]
    assert not scan(spark, spec, {"t": t}, excluded={("t", "id")}).checks.first()["skipped"]
    assert scan(spark, spec, {"t": t}, excluded={("t", "id")}, strict_pii=True).checks.first()["skipped"]


def test_selection():
    specs = [CheckSpec(i, table="t", column="c") for i in (1, 13, 19, 31)]
    assert [s.check_id for s in select_specs(specs, mvp_only=True)] == [1, 19]
    assert [s.check_id for s in select_specs(specs, dimensions=["consistency", "metadata"])] == [13, 31]


def test_thresholds_of_sla_and_band():
    assert CheckSpec(20).effective_threshold == 24.0
    assert CheckSpec(20, freshness_sla_hours=6).effective_threshold == 6.0
    assert CheckSpec(20, freshness_sla_hours=6, threshold=1).effective_threshold == 1.0
    assert CheckSpec(23, volume_change_band=0.5).effective_threshold == 0.5


def test_error_at_run_time_stays_with_its_check(spark):
    t = spark.createDataFrame([("1",), ("x",)], "v string")
    specs = [
        CheckSpec(13, table="t", condition="CAST(v AS INT) > 0"),
        CheckSpec(13, table="t", condition="v = 'x'"),
        CheckSpec(5, table="t", pk_column="v"),
    ]
    r = scan(spark, specs, {"t": t}).materialize()
    assert rows_of(r.checks, "metric_value") == [(None,), (0.5,), (0.0,)]
    assert "CAST_INVALID_INPUT" in rows_of(r.checks, "error")[0][0]
    assert r.checks.count() == 3 and r.materialize() is r


def test_fused_equals_one_by_one(spark):
    t = spark.range(1000).selectExpr("id", *[f"nullif(id % {k}, 0) AS c{k}" for k in range(2, 60)])
    specs = [CheckSpec(i, table="t", column=f"c{k}", max_value=1) for k in range(2, 60) for i in (1, 11, 28)]
    together = scan(spark, specs, {"t": t})
    tables_read = {m.compute for _, ms in together.plan.passes for m in ms}
    assert len(tables_read) == 2 and len(together.plan.passes) < 10
    fused = rows_of(together.checks, "metric_value")
    few = [0, 1, 2, 88, 89, 90, 171, 172, 173]
    for i in few:
        alone = scan(spark, [specs[i]], {"t": t}).checks.first()["metric_value"]
        assert alone == pytest.approx(fused[i][0], abs=1e-12)


def test_result_does_not_depend_on_partitions(spark):
    t = spark.range(500).selectExpr("id % 37 AS k", "id % 11 AS v", "timestamp_ntz'2024-01-01' + make_dt_interval(0,0,0,id%97) AS ts", "id AS o")
    specs = [
        CheckSpec(5, table="t", pk_column="k"), CheckSpec(28, table="t", column="v", outlier_z_threshold=1.0),
        CheckSpec(33, table="t", timestamp_column="ts", entity_column="k", extra={"order_column": "o"}),
        CheckSpec(19, table="t", column="k", reference_table="t", reference_column="v"),
    ]
    results = set()
    for n in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        for parts in (1, 5):
            results.add(tuple(rows_of(scan(spark, specs, {"t": t.repartition(parts)}).checks, "metric_value")))
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert len(results) == 1


def test_registered_check(spark):
    register_check(
        CheckDef(101, "validity", "odd_ratio", "Odd values", 0.1, 0.1, "later"),
        lambda spec, ctx: F.avg((ctx.col(spec.table, spec.column) % 2).cast("double")),
    )
    try:
        got = scan(spark, [CheckSpec(101, table="t", column="id")], {"t": spark.range(4)}).checks.first()
        assert (got["metric_value"], got["passed"]) == (0.5, False)
    finally:
        CHECKS.pop(101), BUILDERS.pop(101)


def test_reports(spark):
    checks = spark.createDataFrame(
        [
            (0, "validity", 0.14, 9, "D", "t1", "a", 0.5, 0.0, False, 0.0, None, False),
            (1, "validity", 0.14, 9, "D", "t2", "b", 0.4, 0.0, False, 0.5, None, False),
            (2, "completeness", 0.20, 1, "N", "t1", "a", 0.06, 0.05, False, 0.8, None, False),
            (3, "completeness", 0.20, 1, "N", "t1", "b", 0.0, 0.05, True, 1.0, None, False),
            (4, "completeness", 0.20, 2, "C", "t1", None, None, 0.05, False, 0.0, "broken", False),
            (5, "uniqueness", 0.14, 5, "P", "t3", None, None, 0.0, False, 1.0, None, True),
        ],
        "seq int, dimension string, dimension_weight double, check_id int, check_name string, table string, column string,"
        " metric_value double, threshold double, passed boolean, pass_score double, error string, skipped boolean",
    )
    assert {r["seq"] for r in report.failed_checks(checks).collect()} == {0, 1, 2, 4}
    types = {r["check_id"]: r for r in report.check_type_rollup(checks).collect()}
    assert (types[9]["n_failed"], types[9]["avg_score"], types[9]["worst_table"]) == (2, 25.0, "t1")
    assert (types[1]["n_passed"], types[1]["n_failed"]) == (1, 1) and types[1]["avg_score"] == pytest.approx(90)
    assert (types[5]["n_skipped"], types[5]["avg_score"], types[5]["worst_table"]) == (1, 100.0, None)
    top = report.priorities(checks).collect()
    assert [(r["check_id"], round(r["impact"], 6)) for r in top] == [(9, 0.42), (1, 0.08)]
    ready = {
        v: (g, p, b) for v, g, p, b in
        report.readiness(spark.createDataFrame([(95.0,), (72.5,), (50.0,), (10.0,)], "overall_score double")).collect()
    }
    assert ready == {95.0: (0.0, 100, "Excellent"), 72.5: (17.5, 80, "Good"), 50.0: (40.0, 55, "Fair"), 10.0: (80.0, 11, "Poor")}
