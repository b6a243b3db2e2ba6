"""Exact quantiles of many columns of a table, without sorting it.

Each column's range is cut into BINS bins, the bins that hold a wanted rank into BINS
more, and only the values in those are told apart: one pass for the ranges, two that
count, one that reads off the values, for all columns and quantiles together.  What is
shuffled is one count per column, bin and task.  Bins are even on a logarithmic scale
(of the distance from zero), which follows long tails; they decide
only how much the last pass has to tell apart, never the result.  Equal values are
counted, so a frequent value costs no more than a rare one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.sources.scratch import kept

BINS = 4096
_LARGEST = 1.7976931348623157e308


def scaled(x: Column) -> Column:
    """A monotonic scale that is logarithmic far from zero."""
    held = F.greatest(F.lit(-_LARGEST), F.least(F.lit(_LARGEST), x))
    return F.signum(held) * F.log1p(F.abs(held))


def long_values(df: DataFrame, values: Sequence[Column]) -> DataFrame:
    """(c, x): the values of all columns that are not NULL, c being the column's place."""
    cells = F.array(*[F.struct(F.lit(i).alias("c"), v.alias("x")) for i, v in enumerate(values)])
    return df.select(F.explode(cells).alias("cell")).select("cell.*").where("x IS NOT NULL")


def ranges(cells: DataFrame) -> DataFrame:
    """(c, low, high, n), with the bounds on the scale of `scaled`; one row per column."""
    bounds = cells.groupBy("c").agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count(F.lit(1)).alias("n"))
    return bounds.select("c", scaled(F.col("low")).alias("low"), scaled(F.col("high")).alias("high"), "n")


def place(bins: int) -> Column:
    """Where x lies between low and high, from 0 to bins.  Never falls as x rises."""
    width = F.col("high") - F.col("low")
    return F.when(width > 0, (scaled(F.col("x")) - F.col("low")) / width * bins).otherwise(F.lit(0.0))


def _binned(cells: DataFrame, bounds: DataFrame) -> DataFrame:
    at = cells.join(F.broadcast(bounds), "c").withColumn("at", place(BINS))
    at = at.withColumn("bin", F.least(F.floor("at"), F.lit(BINS - 1)).cast("int"))
    fine = F.least(F.floor((F.col("at") - F.col("bin")) * BINS), F.lit(BINS - 1))
    return at.select("c", "x", "bin", fine.cast("int").alias("fine"))


def _found(counts: DataFrame, wanted: DataFrame, by: list[str], step: str) -> DataFrame:
    """wanted (by, share, side, rank) with the step that holds the rank, and the rank inside it."""
    inside = Window.partitionBy(*by).orderBy(step).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = counts.withColumn("upto", F.sum("n").over(inside)).withColumn("before", F.col("upto") - F.col("n"))
    joined = wanted.join(summed.select(*by, step, "before", "upto"), by)
    return joined.where("rank >= before AND rank < upto").select(*by, step, "share", "side", (F.col("rank") - F.col("before")).alias("rank"), "part")


def quantiles(df: DataFrame, values: Sequence[Column], shares: Sequence[float]) -> DataFrame:
    """(c, share, value): for each column (c is its place) and share the quantile, interpolated between the two nearest
    values.  NULL is left out, and a column without values has no rows.  This runs jobs; the result is small."""
    cells = long_values(df, values)
    bounds = kept(ranges(cells))
    at = F.col("share") * (F.col("n") - 1)
    sides = F.array(F.struct(F.lit(0).alias("side"), F.floor(at).alias("rank")), F.struct(F.lit(1).alias("side"), F.ceil(at).alias("rank")))
    asked = bounds.withColumn("share", F.explode(F.array(*[F.lit(float(s)) for s in shares])))
    asked = asked.select("c", "share", F.explode(sides).alias("s"), (at - F.floor(at)).alias("part")).select("c", "share", "s.*", "part")
    binned = _binned(cells, bounds)

    def narrowed(to: DataFrame, by: list[str]) -> DataFrame:
        return binned.join(F.broadcast(to.select(*by).distinct()), by)   # one row per column, share and side at most

    coarse = kept(_found(binned.groupBy("c", "bin").agg(F.count(F.lit(1)).alias("n")), asked, ["c"], "bin"))
    fine_counts = narrowed(coarse, ["c", "bin"]).groupBy("c", "bin", "fine").agg(F.count(F.lit(1)).alias("n"))
    fine = kept(_found(fine_counts, coarse, ["c", "bin"], "fine"))
    at_last = narrowed(fine, ["c", "bin", "fine"]).groupBy("c", "bin", "fine", "x").agg(F.count(F.lit(1)).alias("n"))
    ends = _found(at_last, fine, ["c", "bin", "fine"], "x")
    below, above = F.max(F.when(F.col("side") == 0, F.col("x"))), F.max(F.when(F.col("side") == 1, F.col("x")))
    both = ends.groupBy("c", "share").agg(below.alias("below"), above.alias("above"), F.first("part").alias("part"))
    value = F.when(F.col("below") == F.col("above"), F.col("below")).otherwise(F.col("below") + (F.col("above") - F.col("below")) * F.col("part"))
    return kept(both.select("c", "share", value.alias("value")))


def as_row(found: DataFrame, n: int, shares: Sequence[float]) -> Column:
    """The quantiles as one scalar: a struct with a field q<column>_<number of the share> each."""
    picked = [
        F.max(F.when((F.col("c") == c) & (F.col("share") == float(s)), F.col("value"))).alias(f"q{c}_{k}")
        for c in range(n) for k, s in enumerate(shares)
    ]
    return found.agg(F.struct(*picked).alias("known")).scalar()
