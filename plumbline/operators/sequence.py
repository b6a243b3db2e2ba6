"""Order of timestamps.

Comparing each row with the one before it needs sorted rows.  One entity may
hold a third of them, or there may be no entity at all, and many rows may share
one position.  Rows of one position are therefore combined first, and the
positions of an entity with many rows are cut into buckets of about equal size.
Positions are compared inside a bucket of an entity, and the buckets' ends are
compared afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from plumbline.functions.predicates import count_where, ratio, share
from plumbline.functions.timing import wall_time
from plumbline.operators.registry import over_table, plans_check
from plumbline.plans.measure import Measure, ScanContext, long_rows
from plumbline.spec import CheckSpec, SpecError

ORDER_BUCKETS = 4096             # at most; a power of two
ROWS_PER_BUCKET = 250_000        # sorted in one task, at about 180 bytes each
_SAMPLED_POSITIONS = 10_000_000


def _order_number(pos: Column, kind: T.DataType) -> Column:
    """The order column as a number of the same order."""
    if isinstance(kind, T.NumericType):
        return pos.cast("double")
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        epoch = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))
        return F.timestamp_diff("MICROSECOND", epoch, wall_time(pos, kind)).cast("double")
    raise SpecError("order_column must be a number, a date or a timestamp")


def _bounds(positions: DataFrame, rows: Column) -> Column:
    """Estimated quantiles of the positions, as one scalar subquery.

    They only balance the buckets, so a sample of the rows is enough; it keeps
    the sketches that meet in one task small.
    """
    # One text literal, folded to an array: thousands of literals would slow the planning.
    steps = F.split(F.lit(",".join(str(i / ORDER_BUCKETS) for i in range(1, ORDER_BUCKETS))), ",").cast("array<double>")
    sampled = positions.where(F.rand(7) < F.lit(float(_SAMPLED_POSITIONS)) / rows)
    return sampled.agg(F.percentile_approx("pos_number", steps, 10 * ORDER_BUCKETS).alias("bounds")).scalar()


def _place(df: DataFrame, bounds: Column, rows: Column, rows_per_bucket: int) -> DataFrame:
    """Add the bucket of each position: as few buckets as the row count needs, and one for an entity that is not large."""
    out = df.withColumn("bounds", bounds).withColumn("place", F.lit(0))
    jump = ORDER_BUCKETS // 2
    while jump:  # binary search for the number of bounds <= pos_number
        reached = F.get("bounds", F.col("place") + F.lit(jump - 1)) <= F.col("pos_number")
        out = out.withColumn("place", F.when(reached, F.col("place") + F.lit(jump)).otherwise(F.col("place")))
        jump //= 2
    joined = F.greatest(F.lit(1.0), F.floor(F.lit(float(ORDER_BUCKETS) * rows_per_bucket) / rows))
    # Rows without a position come first, in a bucket of their own.
    cut = F.when(F.col("pos_number").isNull(), F.lit(-1)).otherwise(F.floor(F.col("place") / joined).cast("int"))
    bucket = F.when(F.col("large"), cut).otherwise(F.lit(0))
    return out.withColumn("bucket", bucket).drop("bounds", "place")


def positions(df: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """(entity, pos, n, first_ts, last_ts, pos_number, large, bucket): the rows of a position combined, and its bucket."""
    number = _order_number(F.col("pos"), df.schema["pos"].dataType).alias("pos_number")
    rows = df.agg(F.count(F.lit(1)).alias("n")).scalar().cast("double")
    bounds = _bounds(df.select(number), rows)
    # Rows of one position are in order of ts among themselves.  Those without a
    # ts come first, and nothing is compared with them.
    per_position = df.groupBy("entity", "pos").agg(
        F.count(F.lit(1)).alias("n"),
        F.when(F.count("ts") == F.count(F.lit(1)), F.min("ts")).alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )
    # Few entities have more rows than a bucket, no more than there are buckets to fill.
    large = df.groupBy("entity").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > rows_per_bucket)
    large = F.broadcast(large.select(F.col("entity").alias("large_entity"), F.lit(True).alias("large")))
    sized = per_position.join(large, F.col("entity").eqNullSafe(F.col("large_entity")), "left").drop("large_entity")
    return _place(sized.select("*", number), bounds, rows, rows_per_bucket)


def backward_steps(df: DataFrame, rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """Count rows whose ts lies before that of the row before them.

    ``df`` has the columns entity, ts and pos.  Rows are ordered by pos and then
    by ts.  Gives one row with n and backward.
    """
    inside = Window.partitionBy("entity", "bucket").orderBy("pos")
    per_bucket = (
        positions(df, rows_per_bucket)
        .withColumn("before", F.lag("last_ts").over(inside))
        .groupBy("entity", "bucket")
        .agg(
            F.sum("n").alias("n"),
            count_where(F.col("first_ts") < F.col("before")).alias("backward"),
            F.min_by(F.struct("first_ts"), F.struct("pos")).alias("first"),
            F.max_by(F.struct("last_ts"), F.struct("pos")).alias("last"),
        )
    )
    # At most ORDER_BUCKETS + 1 rows per entity from here on.
    across = Window.partitionBy("entity").orderBy("bucket")
    joined = per_bucket.withColumn("before", F.lag("last.last_ts").over(across))
    crossing = F.when(F.col("first.first_ts") < F.col("before"), 1).otherwise(0)
    return joined.agg(F.sum("n").alias("n"), F.sum(F.col("backward") + crossing).alias("backward"))


def sequence_pass(ctx: ScanContext, key: tuple, measures) -> DataFrame:
    table, ts_name, entity, order_name = key
    df = ctx.frame(table).select(
        (ctx.col(table, entity) if entity else F.lit(0)).alias("entity"),
        ctx.col(table, ts_name).alias("ts"),
        ctx.col(table, order_name).alias("pos"),
    )
    counted = backward_steps(df, ctx.rows_per_bucket)
    metric = share(F.col("backward"), F.col("n"))
    return long_rows(counted.select(*[metric.alias(f"m{m.seq}") for m in measures]), [m.seq for m in measures])


@plans_check(33)
def time_integrity_ratio(spec: CheckSpec, ctx: ScanContext) -> Measure:
    """Rows that lie before their predecessor in time.

    Without ``extra.order_column`` rows are ordered by the very timestamp that is
    tested.  No row can then be before its predecessor, so the share is 0 without
    sorting anything, and NULL for an empty table.
    """
    table, name = spec.need("table"), spec.need("timestamp_column")
    order = spec.extra.get("order_column")
    if spec.entity_column:
        ctx.type_of(table, spec.entity_column)
    if not order:
        ts = ctx.col(table, name)
        return over_table(table, ratio(ts < ts), name)
    _order_number(F.lit(None), ctx.type_of(table, order))
    ctx.type_of(table, name)
    return Measure(
        sequence_pass, (table, name, spec.entity_column, order), None,
        f"{name} < LAG({name}) OVER (PARTITION BY {spec.entity_column or '()'} ORDER BY {order}) FROM {table}",
    )
