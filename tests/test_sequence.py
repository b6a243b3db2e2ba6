"""Order of timestamps, against one global window over the rows."""

import random

import pytest
from pyspark.sql import Window, functions as F

import plumbline.operators.sequence as sequence
from plumbline import CheckSpec, scan


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    data = []
    for i in range(3000):
        entity = 0 if rng.random() < 0.4 else rng.randrange(20)       # one entity holds much of the rows
        pos = 500 if rng.random() < 0.3 else rng.randrange(800)        # so does one position
        data.append((
            None if rng.random() < 0.02 else entity,
            None if rng.random() < 0.05 else rng.randrange(1000),
            None if rng.random() < 0.05 else pos,
        ))
    return spark.createDataFrame(data, "entity int, ts int, pos int").cache()


@pytest.mark.parametrize("rows_per_bucket", [1, 40, 10**9])
@pytest.mark.parametrize("with_entity", [True, False])
def test_matches_one_window(spark, rows, monkeypatch, rows_per_bucket, with_entity):
    monkeypatch.setattr(sequence, "ORDER_BUCKETS", 64)
    window = (Window.partitionBy("entity") if with_entity else Window.partitionBy(F.lit(0))).orderBy("pos", "ts")
    want = rows.withColumn("before", F.lag("ts").over(window)).where("ts < before").count() / 3000
    spec = CheckSpec(
        33, table="t", timestamp_column="ts", entity_column="entity" if with_entity else None,
        extra={"order_column": "pos"},
    )
    got = scan(spark, [spec], {"t": rows}, rows_per_bucket=rows_per_bucket).checks.first()["metric_value"]
    assert want > 0 and got == pytest.approx(want)


def test_buckets_are_small_enough_to_sort(spark):
    """One entity with most rows is cut; small entities, and a missing one, stay whole."""
    df = spark.range(700_000).selectExpr("CASE WHEN id % 10 > 0 THEN -1L WHEN id % 20 = 0 THEN NULL ELSE id % 97 END AS entity", "id AS ts", "id AS pos")
    found = sequence.positions(df).groupBy("entity", "bucket").count().collect()
    assert sequence.ROWS_PER_BUCKET <= 1_000_000 and max(r["count"] for r in found) <= 1.5 * sequence.ROWS_PER_BUCKET
    assert len([r for r in found if r.entity == -1]) >= 3
    others = [r.entity for r in found if r.entity != -1]
    assert len(others) == len(set(others)) > 50 and None in others
    got = sequence.backward_steps(df.withColumn("ts", -df.ts)).first()
    assert (got.n, got.backward) == (700_000, 700_000 - len(set(others)) - 1)


def test_order_by_time(spark):
    t = spark.sql(
        "SELECT timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, id) AS arrived,"
        " timestamp_ntz'2024-01-01' + make_dt_interval(0, 0, 0, (id * 7) % 10) AS ts FROM range(10)"
    )
    spec = CheckSpec(33, table="t", timestamp_column="ts", extra={"order_column": "arrived"})
    assert scan(spark, [spec], {"t": t}, rows_per_bucket=2).checks.first()["metric_value"] == pytest.approx(0.6)


def test_order_by_text_is_an_error(spark):
    t = spark.createDataFrame([("a", 1)], "o string, ts int")
    spec = CheckSpec(33, table="t", timestamp_column="ts", extra={"order_column": "o"})
    assert "order_column" in scan(spark, [spec], {"t": t}).checks.first()["error"]
