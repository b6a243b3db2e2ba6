"""Distances between the distributions of a column in two tables.

PSI: the baseline's quantiles cut both tables into bins, counted in one pass over both
for all columns; the index sums (p - q) * ln(p / q) over the bins.

Kolmogorov-Smirnov: the largest distance between the two distribution functions.  Both tables
are counted by value; values fall into ordered buckets, the buckets' totals are summed up
in front of each, and the sums go on inside a bucket.  So nothing is sorted as a
whole, and a frequent value is one row, however many rows have it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.functions.predicates import finite
from plumbline.operators.order_stats import long_values, place, quantiles, ranges
from plumbline.plans.measure import Measure, ScanContext, long_rows

PSI_BINS = 10
#: The least share of a bin, so that an empty one has a logarithm.
LEAST_SHARE = 1e-4
#: Buckets of the sums; one row each in the window over a column.
BUCKETS = 1 << 20


def _both(now: DataFrame, then: DataFrame, now_values: Sequence[Column], then_values: Sequence[Column]) -> DataFrame:
    """(c, x, now): the values of both tables, now being 1 or 0."""
    return long_values(now, now_values).withColumn("now", F.lit(1)).union(long_values(then, then_values).withColumn("now", F.lit(0)))


def _sides(prefix: str = "") -> list[Column]:
    return [F.sum(F.when(F.col("now") == side, F.col("n"))).alias(f"{prefix}n{side}") for side in (0, 1)]


def stability_index(now: DataFrame, then: DataFrame, now_values: Sequence[Column], then_values: Sequence[Column], bins: int = PSI_BINS) -> DataFrame:
    """(c, psi) for each column (c is its place) with values in both tables.

    A bin holds the values above one quantile of ``then`` and not above the next.  Runs the jobs that find the quantiles.
    """
    shares = [k / bins for k in range(1, bins)]
    edge = lambda k, s: F.max(F.when(F.col("share") == s, F.col("value"))).alias(f"e{k}")
    edges = quantiles(then, then_values, shares).groupBy("c").agg(*[edge(k, s) for k, s in enumerate(shares)])
    placed = _both(now, then, now_values, then_values).join(F.broadcast(edges), "c")     # a row per column
    held = sum(((F.col("x") > F.col(f"e{k}")).cast("int") for k in range(len(shares))), F.lit(0))
    counts = placed.select("c", "now", held.alias("bin")).groupBy("c", "bin", "now").agg(F.count(F.lit(1)).alias("n"))
    per_bin = counts.groupBy("c", "bin").agg(*_sides())
    of_column = Window.partitionBy("c")                                                  # as many rows as there are bins
    part = [F.greatest(F.coalesce(F.col(f"n{s}"), F.lit(0)) / F.sum(f"n{s}").over(of_column), F.lit(LEAST_SHARE)).alias(f"p{s}") for s in (0, 1)]
    terms = per_bin.select("c", *part)
    return terms.groupBy("c").agg(F.sum((F.col("p1") - F.col("p0")) * F.log(F.col("p1") / F.col("p0"))).alias("psi")).where("psi IS NOT NULL")


def kolmogorov_smirnov(now: DataFrame, then: DataFrame, now_values: Sequence[Column], then_values: Sequence[Column]) -> DataFrame:
    """(c, ks) for each column (c is its place) with values in both tables."""
    cells = _both(now, then, now_values, then_values)
    bounds = ranges(cells.select("c", "x"))
    counted = cells.groupBy("c", "x", "now").agg(F.count(F.lit(1)).alias("n"))
    bucket = F.least(F.floor(place(BUCKETS)), F.lit(BUCKETS - 1)).cast("int")
    placed = counted.join(F.broadcast(bounds.select("c", "low", "high")), "c").select("c", bucket.alias("bucket"), "x", "now", "n")   # a row per column
    values = placed.groupBy("c", "bucket", "x").agg(*[F.coalesce(s, F.lit(0)).alias(f"n{k}") for k, s in enumerate(_sides())])
    totals = placed.groupBy("c", "bucket").agg(*[F.coalesce(s, F.lit(0)).alias(f"t{k}") for k, s in enumerate(_sides())])
    ahead, whole = Window.partitionBy("c").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("c")
    fronts = totals.select(
        "c", "bucket", *[F.coalesce(F.sum(f"t{k}").over(ahead), F.lit(0)).alias(f"before{k}") for k in (0, 1)],
        *[F.nullif(F.sum(f"t{k}").over(whole), F.lit(0)).alias(f"all{k}") for k in (0, 1)],
    )
    upto = Window.partitionBy("c", "bucket").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    reached = [(F.col(f"before{k}") + F.sum(f"n{k}").over(upto)) / F.col(f"all{k}") for k in (0, 1)]
    apart = values.join(fronts, ["c", "bucket"]).select("c", F.abs(reached[1] - reached[0]).alias("apart"))
    return apart.groupBy("c").agg(F.max("apart").alias("ks")).where("ks IS NOT NULL")


_METHODS = {"psi": stability_index, "ks": kolmogorov_smirnov}
METHODS = tuple(_METHODS)


def drift_pass(ctx: ScanContext, key: tuple, measures) -> DataFrame:
    table, base, method, bins = key
    values = [[finite(ctx.col(t, m.payload)) for m in measures] for t in (table, base)]
    options = {"bins": bins} if method == "psi" else {}
    found = _METHODS[method](ctx.frame(table), ctx.frame(base), *values, **options)
    wide = found.agg(*[F.max(F.when(F.col("c") == i, F.col(method))).alias(f"m{m.seq}") for i, m in enumerate(measures)])
    return long_rows(wide, [m.seq for m in measures])


def drift_measure(table: str, base: str, name: str, method: str, bins: int) -> Measure:
    return Measure(drift_pass, (table, base, method, bins), name, f"{method} of {name} in {table} against {base}", affinity=name)
