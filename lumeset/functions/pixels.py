"""Luminance metrics from a histogram of 256 counts, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(hist: Column) -> Column:
    return F.aggregate(hist, F.lit(0.0), lambda s, x: s + x)


def entropy(hist: Column) -> Column:
    """Shannon entropy in bits; 0 for an empty histogram."""
    n = total(hist)
    return F.aggregate(hist, F.lit(0.0), lambda s, x: s - F.when(x > 0, x / n * F.log2(x / n)).otherwise(0.0))


def share(hist: Column, first: int, last: int) -> Column:
    """Share of the values from first to last."""
    return total(F.slice(hist, first + 1, last - first + 1)) / total(hist)


def dominant_tone(hist: Column, tones: int = 16) -> Column:
    """Largest share of one of ``tones`` equal ranges."""
    width = 256 // tones
    return F.array_max(F.array(*(total(F.slice(hist, k * width + 1, width)) for k in range(tones)))) / total(hist)
