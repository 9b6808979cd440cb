"""Distances as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle kilometres."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    chord = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(chord, F.lit(1.0))))


def planar(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Degrees, as k-means and the geometric median measure."""
    return F.sqrt(F.pow(lat2 - lat1, 2) + F.pow(lon2 - lon1, 2))


def weighted_mean(value: str, weight: Column) -> Column:
    return F.sum(F.col(value) * weight) / F.sum(weight)
