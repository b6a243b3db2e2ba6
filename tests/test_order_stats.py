import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline import scan
from plumbline.functions.predicates import finite
from plumbline.operators import drift, order_stats


def columns_of(rng, n):
    long_tail = np.exp(rng.normal(size=n) * 9) * np.sign(rng.normal(size=n))
    return {
        "even": rng.random(n), "tail": long_tail, "ties": rng.integers(-3, 4, n).astype(float),
        "hot": np.where(rng.random(n) < 0.6, 7.0, rng.normal(size=n)), "close": 1e9 + rng.integers(0, 50, n) / 8,
        "one": np.full(n, -2.5), "far": np.where(np.arange(n) == 5, 1e300, rng.random(n) * 1e-3),
    }


def frame(spark, columns):
    names = list(columns)
    rows = [tuple(None if i % 11 == 3 else float(columns[c][i]) for c in names) for i in range(len(columns[names[0]]))]
    return spark.createDataFrame([*rows, tuple(float("nan") for _ in names), (None,) * len(names)], ", ".join(f"{c} double" for c in names))


def values_of(columns):
    return {c: np.array([x for i, x in enumerate(v) if i % 11 != 3]) for c, v in columns.items()}


@pytest.mark.parametrize("bins", [4096, 3])
def test_quantiles_of_all_columns_are_exact(spark, monkeypatch, bins):
    """Also with so few bins that the last pass has to tell many values apart."""
    monkeypatch.setattr(order_stats, "BINS", bins)
    columns = columns_of(np.random.default_rng(1), 700)
    df, shares = frame(spark, columns), (0.0, 0.003, 0.25, 0.5, 1 / 3, 0.75, 0.99, 1.0)
    got = {(r.c, r.share): r.value for r in order_stats.quantiles(df, [finite(F.col(c)) for c in columns], shares).collect()}
    for c, (name, values) in enumerate(values_of(columns).items()):
        for s in shares:
            assert got[c, s] == pytest.approx(float(np.quantile(values, s)), rel=1e-12, abs=1e-300), (name, s)


def test_infinite_values_and_columns_without_any(spark):
    inf = math.inf
    df = spark.createDataFrame([(-inf, None), (1.0, None), (2.0, None), (inf, None), (inf, None)], "a double, b double")
    got = {(r.c, r.share): r.value for r in order_stats.quantiles(df, [F.col("a"), F.col("b")], (0.0, 0.25, 0.5, 1.0)).collect()}
    assert got == {(0, 0.0): -inf, (0, 0.25): 1.0, (0, 0.5): 2.0, (0, 1.0): inf}
    assert order_stats.quantiles(df.limit(0), [F.col("a")], (0.5,)).count() == 0


def test_one_pass_a_step_reads_all_columns(spark):
    """The counting pass shuffles counts, not rows, and reads the table once for all columns."""
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    values = [F.col(c).cast("double") for c in ("l_quantity", "l_tax", "l_discount", "l_extendedprice")]
    cells = order_stats.long_values(df, values)
    plan = order_stats._binned(cells, order_stats.ranges(cells)).groupBy("c", "bin").count()._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and plan.count("FileScan") == 2        # bounds and counts


def slow_psi(now, then, bins):
    edges = np.quantile(then, [k / bins for k in range(1, bins)])
    p = [np.bincount((x[:, None] > edges).sum(axis=1), minlength=bins) / len(x) for x in (now, then)]
    p1, p0 = (np.maximum(x, drift.LEAST_SHARE) for x in p)
    return float(((p1 - p0) * np.log(p1 / p0)).sum())


def slow_ks(now, then):
    grid = np.unique(np.concatenate((now, then)))
    return float(max(abs((now <= g).mean() - (then <= g).mean()) for g in grid))


def test_distances_of_all_columns(spark, monkeypatch):
    monkeypatch.setattr(drift, "BUCKETS", 16)
    rng = np.random.default_rng(2)
    now, then = columns_of(rng, 500), columns_of(rng, 800)
    then["ties"] = then["ties"] + 1
    then["even"] = then["even"] ** 2
    a, b = frame(spark, now), frame(spark, then)
    values = [finite(F.col(c)) for c in now]
    psi = {r.c: r.psi for r in drift.stability_index(a, b, values, values).collect()}
    ks = {r.c: r.ks for r in drift.kolmogorov_smirnov(a, b, values, values).collect()}
    x, y = values_of(now), values_of(then)
    for c, name in enumerate(now):
        assert psi[c] == pytest.approx(slow_psi(x[name], y[name], 10), abs=1e-9), name
        assert ks[c] == pytest.approx(slow_ks(x[name], y[name]), abs=1e-12), name


def test_a_hot_value_is_one_row(spark):
    a = spark.range(200_000).select(F.when(F.col("id") % 3 > 0, 5.0).otherwise(F.col("id") % 40).alias("v"))
    b = spark.range(1000).select((F.col("id") % 40).cast("double").alias("v"))
    ks = drift.kolmogorov_smirnov(a, b, [F.col("v")], [F.col("v")])
    assert ks.first().ks == pytest.approx(slow_ks(np.array([r.v for r in a.collect()]), np.array([r.v for r in b.collect()])))
    counted = drift._both(a, b, [F.col("v")], [F.col("v")]).groupBy("c", "x", "now").count()
    assert counted.count() <= 80 and "partial_count" in counted._jdf.queryExecution().executedPlan().toString()


def test_checks_by_method(spark):
    rng = np.random.default_rng(3)
    now = {"v": np.concatenate((rng.normal(size=300), [40.0, -40.0])), "flat": np.full(302, 1.0)}
    then = {"v": rng.normal(size=200) + 1, "flat": np.full(200, 1.0)}
    tables = {"t": frame(spark, now), "base": frame(spark, then), "none": frame(spark, now).limit(0)}
    v = values_of(now)["v"]
    q1, m, q3 = np.quantile(v, [0.25, 0.5, 0.75])
    far = 0.6745 * abs(v - m) / np.quantile(abs(v - m), 0.5)
    specs = [
        ({"check_id": 28, "extra": {"method": "iqr"}}, ((v < q1 - 1.5 * (q3 - q1)) | (v > q3 + 1.5 * (q3 - q1))).mean()),
        ({"check_id": 28, "extra": {"method": "mad", "factor": 2}}, (far > 2).mean()),
        ({"check_id": 28, "column": "flat", "extra": {"method": "mad"}}, 0.0),
        ({"check_id": 28, "column": "flat", "extra": {"method": "iqr"}}, 0.0),
        ({"check_id": 29, "reference_table": "base", "extra": {"method": "psi", "bins": 5}}, slow_psi(v, values_of(then)["v"], 5)),
        ({"check_id": 29, "reference_table": "base", "extra": {"method": "KS"}}, slow_ks(v, values_of(then)["v"])),
        ({"check_id": 29, "reference_table": "none", "extra": {"method": "ks"}}, None),
        ({"check_id": 28, "table": "none", "extra": {"method": "iqr"}}, None),
    ]
    rows = scan(spark, [{"table": "t", "column": "v", **spec} for spec, _ in specs], tables).materialize().checks.orderBy("seq").collect()
    for row, (spec, want) in zip(rows, specs):
        assert row.error is None and (row.metric_value is None) == (want is None), (spec, row)
        assert want is None or row.metric_value == pytest.approx(want), (spec, row)
    wrong = scan(spark, [{"check_id": 28, "table": "t", "column": "v", "extra": {"method": "x"}}, {"check_id": 29, "table": "t", "column": "v", "extra": {"method": "ks"}}], tables)
    assert [("method" in r.error) for r in wrong.checks.collect()] == [True, True]
