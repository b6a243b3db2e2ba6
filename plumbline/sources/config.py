"""Scan configurations kept in YAML or as dictionaries."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, fields
from pathlib import Path
from typing import Any

from plumbline.spec import CheckSpec, as_specs


@dataclass(frozen=True)
class ScanConfig:
    """A whole scan: the checks, what to select of them, and how to run.

    ``sources`` maps table names to the sources of :class:`Tables`; tables that
    are not in it come from the session catalog.
    """

    checks: tuple[CheckSpec, ...]
    scan_name: str = "scan"
    mode: str = "live"
    dimensions: tuple[str, ...] = ()
    mvp_only: bool = False
    synthetic_row_count: int = 10_000
    screener: Mapping[str, Any] | None = None
    sources: Mapping[str, Any] | None = None

    @classmethod
    def from_dict(cls, raw: Mapping[str, Any]) -> "ScanConfig":
        mode = raw.get("mode", "live")
        if mode not in ("live", "synthetic"):
            raise ValueError(f"mode must be 'live' or 'synthetic', not {mode!r}")
        return cls(
            checks=tuple(as_specs(raw.get("checks") or ())),
            scan_name=raw.get("scan_name", "scan"),
            mode=mode,
            dimensions=tuple(raw.get("dimensions") or ()),
            mvp_only=bool(raw.get("mvp_only", False)),
            synthetic_row_count=int(raw.get("synthetic_row_count", 10_000)),
            screener=raw.get("screener"),
            sources=raw.get("sources"),
        )

    def to_dict(self) -> dict[str, Any]:
        """The mapping that from_dict reads, without what equals the defaults.

        Sources that are frames or functions cannot be written; name them in the run instead.
        """
        out: dict[str, Any] = {"scan_name": self.scan_name, "mode": self.mode}
        for f in fields(self)[3:]:
            value = getattr(self, f.name)
            if value is not None and value != f.default:
                out[f.name] = list(value) if isinstance(value, tuple) else value
        odd = [t for t, s in (self.sources or {}).items() if not isinstance(s, (str, Mapping))]
        if odd:
            raise ValueError(f"sources that have no written form: {', '.join(sorted(odd))}")
        return out | {"checks": [c.to_dict() for c in self.checks]}


def save_scan(config: ScanConfig, path: str) -> None:
    """Write a scan configuration as YAML, for load_scan.  Needs PyYAML."""
    try:
        import yaml
    except ImportError as exc:  # pragma: no cover
        raise ImportError("save_scan needs PyYAML; write ScanConfig.to_dict instead") from exc
    Path(path).write_text(yaml.safe_dump(config.to_dict(), sort_keys=False, allow_unicode=True), encoding="utf-8")


def load_scan(path: str) -> ScanConfig:
    """Read a YAML scan configuration.  Needs PyYAML."""
    try:
        import yaml
    except ImportError as exc:  # pragma: no cover
        raise ImportError("load_scan needs PyYAML; use ScanConfig.from_dict instead") from exc
    return ScanConfig.from_dict(yaml.safe_load(Path(path).read_text(encoding="utf-8")))
