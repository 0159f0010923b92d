"""Spectral kernels as Column functions ``(x, lmax, t) -> Column``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def heat(x, lmax, t) -> Column:
    """K2: exp(-t · x / lmax)."""
    return F.exp(-_c(t) * _c(x) / _c(lmax))


def self_defined(x, lmax, t) -> Column:
    """K3: u = x + 1, m = lmax + 1; t < 0: u/m · exp(-t·u/m), else m/u · exp(-t·u/m)."""
    u, m = _c(x) + F.lit(1.0), _c(lmax) + F.lit(1.0)
    e = F.exp(-_c(t) * u / m)
    return F.when(_c(t) < 0, u / m * e).otherwise(m / u * e)


KERNELS = {"heat": heat, "self_defined": self_defined}


def canonical_dual(values: Column) -> Column:
    """Per frequency, g_n / Σ_m g_m² for an array of filter values."""
    s = F.aggregate(values, F.lit(0.0), lambda a, g: a + g * g)
    return F.transform(values, lambda g: F.try_divide(g, s))
