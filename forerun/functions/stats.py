"""Statistics as Column expressions: normal distribution, tail tests, confidence interval."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Abramowitz & Stegun 26.2.17.
NORMAL_P = 0.2316419
NORMAL_B = [0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429]


def normal_cdf(x: Column) -> Column:
    t = 1 / (1 + NORMAL_P * F.abs(x))
    poly = F.lit(0.0)
    for b in reversed(NORMAL_B):
        poly = (poly + b) * t
    upper = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(x >= 0, 1 - upper).otherwise(upper)


def poisson_tail(count: Column, mean: Column) -> Column:
    """Upper tail by the normal approximation, without continuity correction; 1 where nothing is expected."""
    safe = F.when(mean > 0, mean).otherwise(1.0)
    return F.when(mean > 0, normal_cdf((mean - count) / F.sqrt(safe))).otherwise(1.0)


def sign_test(k: Column, n: Column) -> Column:
    """Two-sided, continuity-corrected; 1 without trials. An exact 0 is a value, not a missing one."""
    safe = F.when(n > 0, n).otherwise(1).cast("double")
    d = F.greatest(F.lit(0.0), F.abs(k - safe / 2) - 0.5)
    return F.when(n > 0, 2 * (1 - normal_cdf(d / F.sqrt(safe / 4)))).otherwise(1.0)


def wilson(k: Column, n: Column, z: float) -> tuple[Column, Column]:
    """Interval of a share; (0, 1) without trials."""
    safe = F.when(n > 0, n).otherwise(1).cast("double")
    p = k / safe
    den = 1 + z * z / safe
    centre = (p + z * z / (2 * safe)) / den
    half = z / den * F.sqrt(p * (1 - p) / safe + z * z / (4 * safe * safe))
    return F.when(n > 0, centre - half).otherwise(0.0), F.when(n > 0, centre + half).otherwise(1.0)
