"""Frequency grids, sub-bands, their names, and the band of a frequency."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def grid(low: float, high: float, n: int, scale: str = "linear") -> list[float]:
    """n frequencies from low to high: linear, log, or semilog (half linear up to the geometric mean, half log above)."""
    if n < 2:
        return [float(low)] * n
    line = lambda a, b, k: [a + (b - a) * i / (k - 1) for i in range(k)] if k > 1 else [a] * k
    power = lambda a, b, k: [math.exp(x) for x in line(math.log(a), math.log(b), k)]
    if scale == "linear":
        return line(float(low), float(high), n)
    if scale == "log":
        return power(low, high, n)
    if scale != "semilog":
        raise ValueError(f"no scale {scale}")
    middle, half = math.sqrt(low * high), n // 2
    return [*line(float(low), middle, half + 1)[:-1], *power(middle, high, n - half)]


def sub_bands(low: float, high: float, step: float) -> list[tuple[float, float]]:
    """Bands of width step from low to high that don't overlap; a rest that is narrower is the last."""
    n = math.ceil((high - low) / step - 1e-9)
    return [(low + i * step, min(low + (i + 1) * step, high)) for i in range(n)]


def band_name(main: str, low: float, high: float) -> str:
    return f"{main}_{low:g}_{high:g}"


def flat_bands(mains: dict[str, tuple[float, float]], step: float) -> list[tuple[str, str, float, float]]:
    """(main, name, low, high) of all sub-bands of the main bands."""
    return [(m, band_name(m, a, b), a, b) for m, (low, high) in mains.items() for a, b in sub_bands(low, high, step)]


def band_of(freq: Column, bands: list[tuple[str, float, float]]) -> Column:
    """Name of the first band [low, high) that holds the frequency, NULL if none does."""
    return F.coalesce(*(F.when((freq >= low) & (freq < high), F.lit(name)) for name, low, high in bands))
