"""Distances, coarsened coordinates and grid cells as column expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
KM_PER_DEGREE = 111.195
CELL = 0.5


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance; null if any coordinate is."""
    north, east = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    a = north * north + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * (east * east)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.when(a > 1, 1.0).otherwise(a)))


def haversine_km_of(lat1, lon1, lat2, lon2):
    """``haversine_km`` of arrays."""
    north, east = np.sin(np.radians(lat2 - lat1) / 2), np.sin(np.radians(lon2 - lon1) / 2)
    a = north * north + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * (east * east)
    return 2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(a, 1.0)))


def coarsen(x: Column, places: int) -> Column:
    """Round the scaled double half away from zero."""
    f = float(10**places)
    return F.round(x * f) / f


def cell(x: Column, size: float = CELL) -> Column:
    return F.floor(x / size).cast("int")


def cell_centre(i: Column, size: float = CELL) -> Column:
    return (i + F.lit(0.5)) * size
