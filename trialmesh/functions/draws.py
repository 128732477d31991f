"""Repeatable random draws from key hashes.

A draw depends only on the key and the seed, never on partitioning, task order or a retry, and DuckDB can
compute the same value from the same text.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def key_hash(*parts) -> Column:
    """md5 text over the parts joined by ``|``; its text order is a random order of the keys."""
    columns = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in columns]))


def leading_number(hexadecimal: Column, digits: int = 8) -> Column:
    """The first ``digits`` hexadecimal digits as a number; keeps the text order."""
    return F.conv(F.substring(hexadecimal, 1, digits), 16, 10).cast("bigint")


def hash32(*parts) -> Column:
    return leading_number(key_hash(*parts))


def uniform(*parts) -> Column:
    """Uniform draw in [0, 1)."""
    return hash32(*parts) / F.lit(4294967296.0)


def normal(first: Column, second: Column) -> Column:
    """Standard normal draw from two uniform draws."""
    radius = F.sqrt(F.lit(-2.0) * F.log(F.greatest(first, F.lit(1e-12))))
    return radius * F.cos(F.lit(2.0 * math.pi) * second)


def symmetric_beta(first: Column, second: Column, shape: float) -> Column:
    """Beta(shape, shape) draw: projection of a rotation-symmetric point in the unit disc."""
    radius = F.sqrt(F.lit(1.0) - F.pow(first, F.lit(1.0 / (shape - 0.5))))
    return F.lit(0.5) + F.lit(0.5) * radius * F.cos(F.lit(2.0 * math.pi) * second)


def mix64(x) -> np.ndarray:
    """64-bit mixing of whole numbers, for draws inside tasks."""
    x = np.asarray(x).astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def uniform64(x) -> np.ndarray:
    """Uniform draws in [0, 1) from whole numbers."""
    return (mix64(x) >> np.uint64(11)) / float(2**53)


_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(17)])


def poisson64(x) -> np.ndarray:
    """Poisson draws with mean one."""
    return np.searchsorted(_POISSON, uniform64(x), side="right")
