"""Checks over two tables.

None of them joins raw rows.  Both tables are put under each other and grouped
by the key, so a key is one row per task before anything is shuffled: a key
that holds a third of all rows costs no more than any other, and no pairs of
rows are formed.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from plumbline.functions.columns import quoted, type_category
from plumbline.functions.predicates import finite, share
from plumbline.operators.drift import METHODS, PSI_BINS, drift_measure
from plumbline.operators.registry import plans_check
from plumbline.operators.rows import drift_without_baseline
from plumbline.plans.measure import Measure, ScanContext, aggregate_measures, describe, long_rows
from plumbline.spec import CheckSpec, SpecError


def _comparable(a: Column, a_type: T.DataType, b: Column, b_type: T.DataType) -> tuple[Column, Column]:
    """Two keys in one type.  Numbers widen by themselves, and so do dates and
    timestamps; other mixed kinds meet as text."""
    kinds = {type_category(t) for t in (a_type, b_type)}
    if a_type == b_type or kinds <= {"int", "float"} or kinds == {"datetime"}:
        return a, b
    return a.cast("string"), b.cast("string")


# -- foreign keys -----------------------------------------------------------

def foreign_key_pass(ctx: ScanContext, key: tuple, measures) -> DataFrame:
    """Rows of child and parent per key value, then weighted sums over the key values.

    ``children`` and ``parents`` are doubles: their product may pass 2**63.
    """
    child, child_col, parent, parent_col = key
    c_key, p_key = _comparable(
        ctx.col(child, child_col), ctx.type_of(child, child_col),
        ctx.col(parent, parent_col), ctx.type_of(parent, parent_col),
    )
    children = ctx.frame(child).select(c_key.alias("key"), F.lit(1).alias("children"), F.lit(0).alias("parents"))
    parents = (
        ctx.frame(parent)
        .select(p_key.alias("key"), F.lit(0).alias("children"), F.lit(1).alias("parents"))
        .where(F.col("key").isNotNull())
    )
    per_key = children.unionByName(parents).groupBy("key").agg(
        F.sum("children").cast("double").alias("children"),
        F.sum("parents").cast("double").alias("parents"),
    )
    return aggregate_measures(per_key, measures)


def _unmatched_children() -> Column:
    return F.when(F.col("parents") == 0, F.col("children")).otherwise(F.lit(0.0))


def _foreign_key(spec: CheckSpec, ctx: ScanContext, metric: Column, text: str, names: dict) -> Measure:
    child, parent = spec.need(*names["child"]), spec.need(*names["parent"])
    child_col, parent_col = spec.need(*names["child_col"]), spec.need(*names["parent_col"])
    ctx.type_of(child, child_col), ctx.type_of(parent, parent_col)
    return Measure(
        foreign_key_pass, (child, child_col, parent, parent_col), metric,
        f"{text}: {child}.{child_col} -> {parent}.{parent_col}",
    )


_CHILD_TO_PARENT = {
    "child": ("child_table", "table"), "parent": ("parent_table", "reference_table"),
    "child_col": ("child_column", "column"), "parent_col": ("parent_column", "reference_column"),
}
_SOURCE_TO_REFERENCE = {
    "child": ("source_table", "table"), "parent": ("reference_table", "parent_table"),
    "child_col": ("source_column", "column"), "parent_col": ("reference_column", "parent_column"),
}


@plans_check(17)
def fk_violation_ratio(spec: CheckSpec, ctx: ScanContext) -> Measure:
    """Child rows whose key is present but has no parent."""
    broken = F.sum(F.when(F.col("key").isNotNull(), _unmatched_children()).otherwise(F.lit(0.0)))
    return _foreign_key(spec, ctx, share(broken, F.sum("children")), "rows with an unknown key", _CHILD_TO_PARENT)


@plans_check(18)
def orphan_ratio(spec: CheckSpec, ctx: ScanContext) -> Measure:
    """Child rows without a parent; a missing key has no parent."""
    orphans = F.sum(_unmatched_children())
    return _foreign_key(spec, ctx, share(orphans, F.sum("children")), "rows without a parent", _CHILD_TO_PARENT)


@plans_check(19)
def join_coverage_ratio(spec: CheckSpec, ctx: ScanContext) -> Measure:
    """Matched rows of the left join, where a key with two parents gives two rows."""
    matched = F.sum(F.col("children") * F.col("parents"))
    joined = F.sum(F.col("children") * F.greatest(F.col("parents"), F.lit(1.0)))
    return _foreign_key(spec, ctx, share(matched, joined), "matched rows of the left join", _SOURCE_TO_REFERENCE)


# -- values that must agree under a key --------------------------------------

# Counts whose products are summed: doubles would lose single pairs beyond 2**53.
_COUNT = "decimal(18,0)"

# A task holds its cells in a hash table.  With fewer shuffle partitions than this, keys are counted in slices.
CELL_PARTITIONS = 48

# xxhash64 of one value of these types is one-to-one, and a number takes less room than its text.
_ONE_TO_ONE = (
    T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DateType, T.TimestampType, T.TimestampNTZType,
)


def _slices(ctx: ScanContext) -> int:
    return -(-CELL_PARTITIONS // max(1, int(ctx.spark.conf.get("spark.sql.shuffle.partitions"))))


def agreement_pass(ctx: ScanContext, key: tuple, measures) -> DataFrame:
    """Share of joined pairs whose values differ, without forming the pairs.

    Under one key, the joined pairs are (rows left) * (rows right), the pairs
    that can be compared are (values left) * (values right), and the pairs that
    agree are the sum over values of (left with it) * (right with it).  All pairs
    of columns of two tables under one key share the pass: a row gives a cell per pair.
    """
    left, right, join_key = key
    l_type, r_type = ctx.type_of(left, join_key), ctx.type_of(right, join_key)
    l_key, r_key = _comparable(ctx.col(left, join_key), l_type, ctx.col(right, join_key), r_type)
    columns = list(dict.fromkeys(m.payload for m in measures))
    types = [(ctx.type_of(left, lc), ctx.type_of(right, rc)) for lc, rc in columns]
    values = [
        _comparable(ctx.col(left, lc), l, ctx.col(right, rc), r) for (lc, rc), (l, r) in zip(columns, types)
    ]
    # Both values of a pair have one type, so equal values have equal text.
    plain = _number if all(l == r and isinstance(l, _ONE_TO_ONE) for l, r in types) else _plain_text
    several, slices = len(values) > 1, _slices(ctx)
    per = ["key", "pair"] if several else ["key"]

    def side(table: str, k: Column, of_side: int) -> DataFrame:
        cells = [F.struct(F.lit(i).alias("pair"), plain(v[of_side]).alias("value")) for i, v in enumerate(values)]
        cell = [F.inline(F.array(*cells))] if several else [plain(values[0][of_side]).alias("value")]
        return ctx.frame(table).select(
            k.alias("key"), F.lit(1 - of_side).alias("on_left"), F.lit(of_side).alias("on_right"), *cell,
        ).where(F.col("key").isNotNull())

    present = F.col("value").isNotNull()
    of = lambda name, i: F.sum(F.when(F.col("pair") == i, F.col(name)) if several else F.col(name))

    # Under each other the keys have one type, so equal keys are in one slice.
    both = side(left, l_key, 0).unionByName(side(right, r_key, 1))

    def counted(number: int) -> DataFrame:
        rows = both if slices == 1 else both.where(F.pmod(F.xxhash64("key"), F.lit(slices)) == number)
        per_value = (
            rows.groupBy(*per, "value")
            .agg(F.sum("on_left").cast(_COUNT).alias("l"), F.sum("on_right").cast(_COUNT).alias("r"))
        )
        per_key = per_value.groupBy(*per).agg(
            (F.sum("l") * F.sum("r")).alias("joined"),
            (_sum_if(present, F.col("l")) * _sum_if(present, F.col("r"))
             - _sum_if(present, F.col("l") * F.col("r"))).alias("differing"),
        )
        return per_key.agg(*[of(name, i).alias(f"{name}{i}") for i in range(len(columns)) for name in ("differing", "joined")])

    wide = reduce(DataFrame.unionByName, map(counted, range(slices))).agg(*[
        share(F.sum(f"differing{i}"), F.sum(f"joined{i}")).alias(f"m{m.seq}")
        for m in measures for i in [columns.index(m.payload)]
    ])
    return long_rows(wide, [m.seq for m in measures])


def _number(value: Column) -> Column:
    """A number that stands for the value: -0.0 and 0.0 are one, and so are all NaN."""
    return F.when(value.isNotNull(), F.xxhash64(value))


def _plain_text(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text == "-0.0", F.lit("0.0")).otherwise(text)


def _sum_if(condition: Column, value: Column) -> Column:
    return F.sum(F.when(condition, value).otherwise(F.lit(0).cast(_COUNT)))


def _agreement(ctx: ScanContext, left: str, left_col: str, right: str, right_col: str, join_key: str) -> Measure:
    for table, name in ((left, left_col), (left, join_key), (right, right_col), (right, join_key)):
        ctx.type_of(table, name)
    return Measure(
        agreement_pass, (left, right, join_key), (left_col, right_col),
        f"{left}.{left_col} <> {right}.{right_col} where {join_key} is equal",
    )


@plans_check(14)
def cross_table_mismatch_ratio(spec: CheckSpec, ctx: ScanContext) -> Measure:
    return _agreement(
        ctx, spec.need("source_table", "table"), spec.need("source_column", "column"),
        spec.need("reference_table"), spec.need("reference_column", "column"),
        spec.extra.get("join_key", "id"),
    )


@plans_check(27)
def reference_mismatch_ratio(spec: CheckSpec, ctx: ScanContext) -> Measure:
    return _agreement(
        ctx, spec.need("table"), spec.need("column", "source_column"),
        spec.need("reference_table"), spec.need("reference_column", "column"),
        spec.extra.get("join_key", "code"),
    )


# -- one aggregate of each table, compared ------------------------------------

@dataclass(frozen=True)
class Comparison:
    left: Column
    right: Column
    metric: Callable[[Column, Column], Column]


def comparison_pass(ctx: ScanContext, key: tuple, measures) -> DataFrame:
    """Both tables under each other, each value in a column of its own, one aggregate."""
    left, right = key
    l_cols = [m.payload.left.alias(f"l{m.seq}") for m in measures]
    r_cols = [m.payload.right.alias(f"r{m.seq}") for m in measures]
    l_frame, r_frame = ctx.frame(left).select(*l_cols), ctx.frame(right).select(*r_cols)
    both = l_frame.unionByName(r_frame, allowMissingColumns=True)
    wide = both.agg(*[
        m.payload.metric(F.col(f"l{m.seq}"), F.col(f"r{m.seq}")).alias(f"m{m.seq}") for m in measures
    ])
    return long_rows(wide, [m.seq for m in measures])


def against_table(left: str, right: str, left_value: Column | None, right_value: Column | None, metric, slots: int = 2) -> Measure:
    one = F.lit(1)
    l_value = one if left_value is None else left_value
    r_value = one if right_value is None else right_value
    shown = describe(metric(F.col(quoted(left)), F.col(quoted(right))))
    return Measure(
        comparison_pass, (left, right), Comparison(l_value, r_value, metric), shown, slots=slots,
    )


@plans_check(25)
def reconciliation_variance_pct(spec: CheckSpec, ctx: ScanContext) -> Measure:
    source, target = spec.need("source_table"), spec.need("target_table", "table")
    s_col, t_col = spec.need("source_column", "column"), spec.need("target_column", "column")

    def variance(left: Column, right: Column) -> Column:
        return share(F.abs(F.sum(left) - F.sum(right)), F.abs(F.sum(left)))

    def amount(table: str, name: str) -> Column:
        """Whole numbers as decimals, whose sums do not overflow."""
        col = ctx.col(table, name)
        return col.cast("decimal(20,0)") if isinstance(ctx.type_of(table, name), T.IntegralType) else col

    return against_table(source, target, amount(source, s_col), amount(target, t_col), variance)


@plans_check(29)
def distribution_drift_score(spec: CheckSpec, ctx: ScanContext) -> Measure:
    """Shift of the mean against a baseline table, else the coefficient of variation.

    ``extra.method`` asks for another distance from the baseline: ``psi`` (with ``extra.bins``) or ``ks``.
    """
    table, name = spec.need("table"), spec.need("metric_column", "column")
    method = str(spec.extra.get("method") or "mean").lower()
    if method not in ("mean", *METHODS) or (method != "mean" and not spec.reference_table):
        raise SpecError(f"check 29 has no method {method!r}" + (" without a baseline" if method in METHODS else ""))
    if not spec.reference_table:
        return drift_without_baseline(table, name, ctx)
    base = spec.reference_table
    if method in METHODS:
        ctx.type_of(table, name), ctx.type_of(base, name)
        return drift_measure(table, base, name, method, int(spec.extra.get("bins") or PSI_BINS))

    def shift(now: Column, then: Column) -> Column:
        return F.abs(F.avg(now) - F.avg(then)) / F.nullif(F.abs(F.avg(then)), F.lit(0.0))

    return against_table(
        table, base, finite(ctx.col(table, name)), finite(ctx.col(base, name)), shift, slots=4,
    )


# -- partitions ---------------------------------------------------------------

def missing_partition_pass(ctx: ScanContext, key: tuple, measures) -> DataFrame:
    """Expected keys that the table does not have.  A NULL key is never there."""
    expected, actual, name = key
    e_key, a_key = _comparable(
        ctx.col(expected, name), ctx.type_of(expected, name),
        ctx.col(actual, name), ctx.type_of(actual, name),
    )
    wanted = ctx.frame(expected).select(e_key.alias("key"), F.lit(1).alias("wanted"), F.lit(0).alias("loaded"))
    loaded = (
        ctx.frame(actual).select(a_key.alias("key"), F.lit(0).alias("wanted"), F.lit(1).alias("loaded"))
        .where(F.col("key").isNotNull())
    )
    per_key = wanted.unionByName(loaded).groupBy("key").agg(
        F.sum("wanted").alias("wanted"), F.max("loaded").alias("loaded")
    )
    return aggregate_measures(per_key, measures)


@plans_check(24)
def missing_partition_count(spec: CheckSpec, ctx: ScanContext) -> Measure:
    expected = spec.need("expected_partitions_table")
    actual = spec.need("actual_partitions_table", "table")
    name = spec.first("partition_key", "pk_column") or "partition_key"
    ctx.type_of(expected, name), ctx.type_of(actual, name)
    missing = F.coalesce(F.sum(F.when(F.col("loaded") == 0, F.col("wanted"))), F.lit(0))
    return Measure(
        missing_partition_pass, (expected, actual, name), missing,
        f"{name} of {expected} that {actual} lacks",
    )
