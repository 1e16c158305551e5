"""Standard normal distribution as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SQRT_2PI = math.sqrt(2 * math.pi)

# Hart's rational approximation of the normal tail, highest power first.
HART_NUMERATOR = [
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871,
    221.213596169931, 220.206867912376,
]
HART_DENOMINATOR = [
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674,
    637.333633378831, 793.826512519948, 440.413735824752,
]
HART_LIMIT = 7.07106781186547


def horner(x: Column, highest_first: list) -> Column:
    total = F.lit(0.0)
    for c in highest_first:
        total = total * x + c
    return total


def normal_cdf(z: Column) -> Column:
    """P(Z <= z), within 1e-15 (continued fraction beyond the rational range)."""
    a = F.least(F.abs(z), F.lit(38.0))
    density = F.exp(-a * a / 2)
    rational = density * horner(a, HART_NUMERATOR) / horner(a, HART_DENOMINATOR)
    fraction = a + 0.65
    for k in (4, 3, 2, 1):
        fraction = a + F.lit(float(k)) / fraction
    tail = F.when(a < HART_LIMIT, rational).otherwise(density / fraction / SQRT_2PI)
    return F.when(z > 0, 1 - tail).otherwise(tail)
