"""Writing results: flat rows for tables and CSV, nested documents for JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def write_flat(flat: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists") -> None:
    """One row per check.  Results are as many rows as checks, so one file is enough."""
    writer = flat.coalesce(1).write.format(fmt).mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(path)


def nest(flat: DataFrame) -> DataFrame:
    """The nested report: a scan with its dimensions, each with its checks."""
    of_scan = ["scan_name", "mode", "source", "overall_score"]
    of_dimension = ["dimension", "dimension_weight", "dimension_score"]
    of_check = [c for c in flat.columns if c not in of_scan + of_dimension]
    dimensions = flat.groupBy(*of_scan, *of_dimension).agg(
        F.array_sort(F.collect_list(F.struct("seq", *[c for c in of_check if c != "seq"]))).alias("checks")
    )
    ordered = F.struct((-F.col("dimension_weight")).alias("order"), *of_dimension, "checks")
    return (
        dimensions.groupBy(*of_scan)
        .agg(F.array_sort(F.collect_list(ordered)).alias("dimensions"))
        .withColumn("dimensions", F.transform("dimensions", lambda d: d.dropFields("order")))
    )


def write_nested(flat: DataFrame, path: str, mode: str = "errorifexists") -> None:
    nest(flat).coalesce(1).write.mode(mode).option("ignoreNullFields", False).json(path)
