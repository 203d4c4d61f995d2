"""Special functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EULER = 0.5772156649015329


def digamma(x: Column) -> Column:
    """Recurrence to x + 8, then the asymptotic series."""
    y = x + 8
    near = F.log(y) - 1 / (2 * y) - 1 / (12 * y**2) + 1 / (120 * y**4) - 1 / (252 * y**6) + 1 / (240 * y**8)
    for k in range(8):
        near = near - 1 / (x + k)
    return near


def lgamma(x: Column) -> Column:
    """Logarithm of the gamma function: recurrence to x + 8, then Stirling's series."""
    y = x + 8
    near = (y - 0.5) * F.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    for k in range(8):
        near = near - F.log(x + k)
    return near


def harmonic(n: Column) -> Column:
    """1 + 1/2 + ... + 1/n; 0 for n = 0."""
    return digamma(n + 1.0) + EULER


def xlog2x(n: Column) -> Column:
    return F.when(n > 0, n * F.log2(n)).otherwise(0.0)
