"""Rounding, shares and distances as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan_to_null(x: Column) -> Column:
    """Spark orders NaN above every number; as NULL it drops out of comparisons."""
    return F.when(~F.isnan(x), x)


def share_pct(part: Column, whole: Column) -> Column:
    """Share in percent, 3 decimals, ties to even; NULL when ``whole`` is 0 or NULL."""
    return F.bround(F.try_divide(part, whole) * F.lit(100.0), 3)


def cap_distance(px: Column, cell_m: float, cap_m: float) -> Column:
    """Cells to metres, at most ``cap_m``, 1 decimal; nothing found means the cap."""
    metres = F.least(px * F.lit(float(cell_m)), F.lit(float(cap_m)))
    return F.coalesce(F.bround(metres, 1), F.lit(float(cap_m)))
