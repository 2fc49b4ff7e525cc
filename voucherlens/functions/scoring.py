"""Column expressions used by the vendor score."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from voucherlens import schema as S


def minmax_100(x: Column, lo: Column, hi: Column) -> Column:
    """``x`` on a 0-100 scale between ``lo`` and ``hi``, clamped; 0 when the range is empty.

    A missing ``x`` counts as 0, and missing bounds (no vendor has the signal) as 0 and 1.
    """
    x = F.coalesce(x, F.lit(0.0))
    lo = F.coalesce(lo, F.lit(0.0))
    hi = F.coalesce(hi, F.lit(1.0))
    scaled = (x - lo) / F.nullif(hi - lo, F.lit(0.0)) * 100
    return F.when(hi == lo, F.lit(0.0)).otherwise(
        F.least(F.lit(100.0), F.greatest(F.lit(0.0), scaled)))


def risk_tier(composite: Column, high: float = 35.0, medium: float = 20.0) -> Column:
    return (F.when(composite >= high, S.HIGH)
            .when(composite >= medium, S.MEDIUM)
            .otherwise(S.LOW))
