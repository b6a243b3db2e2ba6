"""A whole run: screen, then scan the tables or clones of them."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.operators.screen import ScreenConfig, Screening, screen, tables_of_specs
from plumbline.operators.synth import clone_tables
from plumbline.plans.scan import ScanResult, scan
from plumbline.sources.config import ScanConfig
from plumbline.sources.sinks import nest
from plumbline.sources.tables import Source, Tables
from plumbline.spec import select_specs


@dataclass
class Run:
    """A result with what was found before it, and when the run began and ended.

    The run ends when its result is materialised; a lazy result has no end.
    """

    result: ScanResult
    screening: Screening | None
    started: datetime | None = None
    ended: datetime | None = None

    def materialize(self) -> "Run":
        result = self.result.materialize()
        return replace(self, result=result, ended=self.ended or datetime.now(timezone.utc))

    def report(self) -> DataFrame:
        """The nested report with its header: times, whether clones were scanned, and the tables' manifests."""
        out = nest(self.result.flat())
        seconds = (self.ended - self.started).total_seconds() if self.ended and self.started else None
        header = out.withColumns({
            "started": F.lit(self.started), "ended": F.lit(self.ended).cast("timestamp"),
            "duration_seconds": F.lit(seconds).cast("double"), "is_synthetic": F.lit(self.result.mode == "synthetic"),
        })
        if self.screening is None:
            return header
        manifests = self.screening.manifests        # one row per table
        listed = manifests.agg(F.collect_list(F.struct(*manifests.columns)).alias("manifests"))
        return header.withColumn("gate", F.lit(self.screening.gate)).withColumn("manifests", listed.scalar())


def run_scan(
    spark: SparkSession,
    config: ScanConfig | Mapping[str, Any],
    tables: Tables | Mapping[str, Source] | None = None,
    *,
    as_of: datetime | str | None = None,
    skip_screener: bool = False,
    strict_pii: bool = False,
    allow_sample_values: bool = False,
) -> Run:
    """Run a scan configuration.

    The screen runs if the configuration has a ``screener`` block.  It may raise
    PIIBlocked, exclude columns, or turn the run into one on synthetic clones.
    """
    started = datetime.now(timezone.utc)
    if not isinstance(config, ScanConfig):
        config = ScanConfig.from_dict(config)
    resolver = Tables.of(spark, tables if tables is not None else (config.sources or {}))
    specs = select_specs(config.checks, config.mvp_only, config.dimensions)
    mode, screening, excluded = config.mode, None, set()
    if config.screener is not None and not skip_screener:
        settings = ScreenConfig.from_dict(config.screener)
        if settings.enabled:
            screening = screen(spark, tables_of_specs(spark, config.checks, resolver), settings)
            excluded = screening.excluded
            if screening.gate == "SYNTHETIC_MODE":
                mode = "synthetic"
    if mode == "synthetic":
        resolver = clone_tables(
            spark, specs, resolver, config.synthetic_row_count, allow_sample_values=allow_sample_values,
            protected=excluded,
        )
    result = scan(
        spark, specs, resolver, as_of=as_of, scan_name=config.scan_name, mode=mode,
        excluded=excluded, strict_pii=strict_pii,
    )
    return Run(result, screening, started)
