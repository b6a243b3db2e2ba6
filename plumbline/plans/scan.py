"""Planning and running a scan.

Specs become measures, measures with one pass and key become one DataFrame, and
the union of those is one Spark job whose result has a row per check.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from datetime import datetime
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.operators import BUILDERS
from plumbline.operators.sequence import ROWS_PER_BUCKET
from plumbline.functions.timing import utc_moment
from plumbline.plans import score
from plumbline.plans.measure import Measure, ScanContext, chunks, local_frame
from plumbline.sources.tables import Source, Tables
from plumbline.spec import CheckSpec, SpecError, select_specs

_PLANNING_ERRORS = (SpecError, PySparkException, ValueError, TypeError, KeyError)

_PLANNERS = 8
_JOBS = 16           # passes that run at a time

METRICS_SCHEMA = "seq INT, metric_value DOUBLE, error STRING"


@dataclass
class Planned:
    """One row of the result: a spec with its measure, or the reason it has none."""

    seq: int
    spec: CheckSpec
    measure: Measure | None = None
    skip: str | None = None      # "disabled" or "pii_excluded"
    error: str | None = None


def _message(exc: Exception) -> str:
    text = getattr(exc, "getMessage", lambda: None)() if isinstance(exc, PySparkException) else None
    return (text or str(exc)).strip().split("\n")[0]


class ScanPlan:
    """The passes of a scan, in the order of their first check."""

    def __init__(self, ctx: ScanContext, rows: list[Planned]) -> None:
        self.ctx = ctx
        self.rows = rows
        groups: dict[tuple, list[Measure]] = defaultdict(list)
        for row in rows:
            if row.measure is not None:
                groups[row.measure.compute, row.measure.key].append(row.measure)
        parts = [part for measures in groups.values() for part in chunks(measures)]
        # Building a frame is analysis inside the JVM, so several are built at a time.
        with ThreadPoolExecutor(_PLANNERS) as pool:
            self.passes: list[tuple[DataFrame, list[Measure]]] = [p for p in pool.map(self._pass, parts) if p]

    def _build(self, measures: list[Measure]) -> DataFrame:
        first = measures[0]
        return first.compute(self.ctx, first.key, measures)

    def _pass(self, measures: list[Measure]) -> tuple[DataFrame, list[Measure]] | None:
        """Keep the measures that Spark can analyse; the others become errors."""
        try:
            return self._build(measures), measures
        except _PLANNING_ERRORS as exc:
            if len(measures) == 1:
                self.rows[measures[0].seq].error = _message(exc)
                return None
        good = []
        for m in measures:
            try:
                self._build([m])
                good.append(m)
            except _PLANNING_ERRORS as exc:
                self.rows[m.seq].error = _message(exc)
        return self._pass(good) if good else None

    def metrics(self) -> DataFrame:
        """Rows (seq, metric_value, error) of all passes, as one lazy frame."""
        frames = [df for df, _ in self.passes]
        if not frames:
            return self.ctx.spark.createDataFrame([], METRICS_SCHEMA)
        union = reduce(DataFrame.unionByName, frames)
        return union.select("seq", "metric_value", F.lit(None).cast("string").alias("error"))

    def run(self) -> DataFrame:
        """Compute the metrics now.

        Passes are jobs of their own, several at a time, and what has succeeded is
        kept.  A failing pass is halved until the error (such as a cast in a
        condition) stays with the check that caused it.  A failure that is not about
        the data, such as a lost cluster, is raised.  The values kept are one row per
        check.
        """
        with ThreadPoolExecutor(_JOBS) as pool:
            found = sorted(row for rows in pool.map(lambda p: self._run_pass(*p), self.passes) for row in rows)
        return local_frame(self.ctx.spark, {
            "seq": ([f[0] for f in found], pa.int32()),
            "metric_value": ([f[1] for f in found], pa.float64()),
            "error": ([f[2] for f in found], pa.string()),
        })

    def _run_pass(self, df: DataFrame, measures: list[Measure]) -> list[tuple]:
        try:
            return [(r.seq, r.metric_value, None) for r in df.collect()]
        except PySparkException as exc:
            if exc.getCondition() is None:
                raise
            if len(measures) == 1:
                return [(measures[0].seq, None, _message(exc))]
        middle = len(measures) // 2
        return [row for half in (measures[:middle], measures[middle:]) for row in self._run_pass(self._build(half), half)]


@dataclass
class ScanResult:
    """A scan as frames.  They are lazy: every action on them scans the tables.

    ``materialize()`` scans once and gives a result whose frames hold the rows.
    """

    plan: ScanPlan
    scan_name: str
    mode: str
    source: str
    metrics: DataFrame
    done: bool = False

    @property
    def checks(self) -> DataFrame:
        """One row per check with metric, verdict and score.

        Unless the result is materialised, an error in the data of one check fails
        the action on this frame as a whole.
        """
        return score.score_checks(self.plan, self.metrics)

    @property
    def dimensions(self) -> DataFrame:
        return score.score_dimensions(self.checks)

    @property
    def overall(self) -> DataFrame:
        return score.score_overall(self.dimensions)

    def materialize(self) -> "ScanResult":
        return self if self.done else replace(self, metrics=self.plan.run(), done=True)

    def flat(self) -> DataFrame:
        """One row per check with the scores of its dimension and of the scan."""
        kept = self.materialize()
        return score.flatten(kept)


def plan_scan(
    ctx: ScanContext,
    specs: Iterable[CheckSpec],
    excluded: Iterable[tuple[str, str]] = (),
    strict_pii: bool = False,
) -> ScanPlan:
    barred = set(excluded)
    rows: list[Planned] = []
    for spec in _expanded(specs, ctx):
        row = Planned(len(rows), spec)
        rows.append(row)
        if not spec.enabled:
            row.skip = "disabled"
        elif _touches(spec, barred, strict_pii):
            row.skip = "pii_excluded"
        else:
            try:
                row.measure = replace(BUILDERS[spec.check_id](spec, ctx), seq=row.seq)
            except _PLANNING_ERRORS as exc:
                row.error = _message(exc)
    return ScanPlan(ctx, rows)


def _expanded(specs: Iterable[CheckSpec], ctx: ScanContext) -> Iterable[CheckSpec]:
    """A null check without a column is a null check of every column."""
    for spec in specs:
        every = spec.check_id == 1 and spec.enabled and spec.table and spec.column in (None, "*")
        if not every:
            yield spec
            continue
        try:
            names = ctx.schema(spec.table).names
        except _PLANNING_ERRORS:
            names = []
        if not names:
            yield spec
        for name in names:
            yield spec.with_column(name)


def _touches(spec: CheckSpec, barred: set[tuple[str, str]], strict: bool) -> bool:
    if not barred:
        return False
    if strict:
        return any((t, c) in barred for t in spec.named_tables() for c in spec.named_columns())
    return (spec.table, spec.column) in barred


def scan(
    spark: SparkSession,
    specs: Iterable[CheckSpec | Mapping[str, Any]],
    tables: Tables | Mapping[str, Source],
    *,
    as_of: datetime | str | None = None,
    scan_name: str = "scan",
    mode: str = "live",
    source: str = "spark",
    mvp_only: bool = False,
    dimensions: Iterable[str] = (),
    excluded: Iterable[tuple[str, str]] = (),
    strict_pii: bool = False,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> ScanResult:
    """Plan a scan.  Nothing is read before an action on one of the result's frames.

    ``as_of`` stands for the present in checks of freshness.  ``excluded`` are
    (table, column) pairs to leave alone; ``strict_pii`` applies them to every
    column a check names.  ``rows_per_bucket`` bounds the rows that one task sorts
    for the check of timestamp order.
    """
    ctx = ScanContext(spark, Tables.of(spark, tables), utc_moment(as_of), rows_per_bucket)
    plan = plan_scan(ctx, select_specs(specs, mvp_only, dimensions), excluded, strict_pii)
    return ScanResult(plan, scan_name, mode, source, plan.metrics())
