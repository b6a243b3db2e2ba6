"""Random numbers that are functions of a row number.

They do not depend on how the rows are split over tasks, and a task that is run
again on another executor gives the same rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

_MANTISSA = float(1 << 53)


def uniform(row_id: Column, name: str, seed: int) -> Column:
    """A double in [0, 1), independent for each name."""
    bits = F.shiftrightunsigned(F.xxhash64(row_id, F.lit(name), F.lit(seed)), 11)
    return bits.cast("double") / F.lit(_MANTISSA)


def normal(row_id: Column, name: str, seed: int) -> Column:
    """A standard normal value, from two uniform ones."""
    radius = F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - uniform(row_id, name + ":radius", seed)))
    return radius * F.cos(F.lit(2.0 * math.pi) * uniform(row_id, name + ":angle", seed))
