"""Check specifications: what to measure, on which table, with which limits."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field, fields, replace
from typing import Any

from plumbline.catalog import CHECKS, CheckDef


class SpecError(ValueError):
    """A specification lacks a parameter or names something that is not there."""


@dataclass(frozen=True)
class CheckSpec:
    """One check to run.

    Only ``check_id`` and the parameters of that check need values.  Several
    parameters have a general and a specific name (``table`` / ``child_table``);
    the specific one wins.
    """

    check_id: int
    table: str | None = None
    column: str | None = None
    columns: tuple[str, ...] = ()
    enabled: bool = True
    threshold: float | None = None
    extra: Mapping[str, Any] = field(default_factory=dict)

    # keys
    pk_column: str | None = None
    business_key_columns: tuple[str, ...] = ()
    # predicates and value rules
    condition: str | None = None
    dependent_column: str | None = None
    allowed_values: tuple[Any, ...] = ()
    pattern: str | None = None
    min_value: float | None = None
    max_value: float | None = None
    price_column: str | None = None
    quantity_column: str | None = None
    revenue_column: str | None = None
    # time
    timestamp_column: str | None = None
    event_timestamp_column: str | None = None
    load_timestamp_column: str | None = None
    entity_column: str | None = None
    freshness_sla_hours: float | None = None
    stale_days: float | None = None
    late_arrival_hours: float | None = None
    # second table
    child_table: str | None = None
    child_column: str | None = None
    parent_table: str | None = None
    parent_column: str | None = None
    source_table: str | None = None
    source_column: str | None = None
    target_table: str | None = None
    target_column: str | None = None
    reference_table: str | None = None
    reference_column: str | None = None
    # volume
    today_table: str | None = None
    prior_table: str | None = None
    volume_change_band: float | None = None
    expected_partitions_table: str | None = None
    actual_partitions_table: str | None = None
    partition_key: str | None = None
    # statistics
    metric_column: str | None = None
    outlier_z_threshold: float | None = None
    # side tables
    metadata_catalog_table: str | None = None
    pipeline_runs_table: str | None = None
    dataset_name: str | None = None

    @classmethod
    def from_dict(cls, raw: Mapping[str, Any]) -> "CheckSpec":
        """Build a spec from a parsed config entry; unknown entries are ignored."""
        known = {f.name for f in fields(cls)}
        given = {k: v for k, v in raw.items() if k in known and v is not None}
        for name in ("columns", "business_key_columns", "allowed_values"):
            if name in given:
                value = given[name]
                given[name] = (value,) if isinstance(value, str) else tuple(value)
        return cls(**given)

    def with_column(self, column: str) -> "CheckSpec":
        return replace(self, column=column)

    def to_dict(self) -> dict[str, Any]:
        """The parameters that differ from the defaults."""
        out: dict[str, Any] = {}
        for f in fields(self):
            value = getattr(self, f.name)
            empty = value is None or (isinstance(value, (tuple, dict)) and not value)
            if f.name == "check_id" or not (empty or (f.name == "enabled" and value)):
                out[f.name] = list(value) if isinstance(value, tuple) else value
        return out

    # -- labels and limits -------------------------------------------------

    @property
    def definition(self) -> CheckDef:
        return CHECKS[self.check_id]

    @property
    def table_label(self) -> str | None:
        return self.table or self.child_table or self.source_table or self.today_table

    @property
    def column_label(self) -> str | None:
        return self.column or self.child_column or self.source_column or self.pk_column

    @property
    def effective_threshold(self) -> float | None:
        """Explicit threshold, else the SLA or band of the check, else the default."""
        if self.threshold is not None:
            return float(self.threshold)
        specific = {20: self.freshness_sla_hours, 23: self.volume_change_band}.get(self.check_id)
        return float(specific) if specific is not None else self.definition.threshold

    def first(self, *names: str) -> Any:
        """The first of the named parameters that has a value."""
        for name in names:
            value = getattr(self, name)
            if value is not None and value != ():
                return value
        return None

    def need(self, *names: str) -> Any:
        value = self.first(*names)
        if value is None:
            raise SpecError(f"check {self.check_id} needs {' or '.join(repr(n) for n in names)}")
        return value

    def named_columns(self) -> set[str]:
        """Every column the spec names, for strict exclusion of personal data."""
        single = (
            self.column, self.pk_column, self.dependent_column, self.price_column,
            self.quantity_column, self.revenue_column, self.timestamp_column,
            self.event_timestamp_column, self.load_timestamp_column, self.entity_column,
            self.child_column, self.parent_column, self.source_column, self.target_column,
            self.reference_column, self.partition_key, self.metric_column,
        )
        return {c for c in (*single, *self.columns, *self.business_key_columns) if c}

    def named_tables(self) -> set[str]:
        """Every table the spec names."""
        return {t for t in (
            self.table, self.child_table, self.parent_table, self.source_table,
            self.target_table, self.reference_table, self.today_table, self.prior_table,
            self.expected_partitions_table, self.actual_partitions_table,
            self.metadata_catalog_table, self.pipeline_runs_table,
        ) if t}


def as_specs(specs: Iterable[CheckSpec | Mapping[str, Any]]) -> list[CheckSpec]:
    return [s if isinstance(s, CheckSpec) else CheckSpec.from_dict(s) for s in specs]


def select_specs(
    specs: Iterable[CheckSpec | Mapping[str, Any]],
    mvp_only: bool = False,
    dimensions: Iterable[str] = (),
) -> list[CheckSpec]:
    """Keep known checks, and on request one phase or some dimensions."""
    wanted = set(dimensions)
    return [
        s for s in as_specs(specs)
        if s.check_id in CHECKS
        and (not mvp_only or s.definition.phase == "mvp")
        and (not wanted or s.definition.dimension in wanted)
    ]
