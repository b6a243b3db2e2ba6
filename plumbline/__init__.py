"""Data quality checks, profiles and scores on Apache Spark."""

from plumbline.catalog import CHECKS, CheckDef, catalog_frame
from plumbline.operators import register_check
from plumbline.operators.discover import foreign_keys, inclusions, key_frame, unique_sets
from plumbline.operators.fuzzy import fuzzy_groups, fuzzy_pairs
from plumbline.operators.profile import profile, profile_tables
from plumbline.operators.screen import PIIBlocked, ScreenConfig, screen
from plumbline.operators.suggest import column_roles, suggest_checks, table_entries
from plumbline.operators.synth import synthesize
from plumbline.plans.run import run_scan
from plumbline.plans.scan import ScanResult, scan
from plumbline.sources.config import ScanConfig, load_scan, save_scan
from plumbline.sources.tables import Tables
from plumbline.spec import CheckSpec, SpecError

__all__ = [
    "CHECKS", "CheckDef", "CheckSpec", "PIIBlocked", "ScanConfig", "ScanResult", "ScreenConfig",
    "SpecError", "Tables", "catalog_frame", "column_roles",
    "foreign_keys", "fuzzy_groups", "fuzzy_pairs", "inclusions", "key_frame", "load_scan", "profile", "profile_tables",
    "register_check", "run_scan", "save_scan", "scan", "screen", "suggest_checks", "synthesize", "table_entries", "unique_sets",
]
