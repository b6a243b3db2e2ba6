"""The checks, and the profiling, screening, cloning and suggestion operators."""

from plumbline.operators import joins, keys, rows, sequence, side_tables, stats  # noqa: F401  (fill the registry)
from plumbline.operators.registry import BUILDERS, register_check

__all__ = ["BUILDERS", "register_check"]
