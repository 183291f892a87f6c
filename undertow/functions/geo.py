"""Distances on the globe."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RADIUS_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    up, along = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(up), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(along), 2)
    return 2 * RADIUS_KM * F.asin(F.sqrt(F.when(a > 1, 1.0).otherwise(a)))  # null if any is; least() would skip it


def mean_vertex(ring: Column) -> Column:
    """Mean of a ring's valid (lon, lat) vertices as a struct; null without any. The closing vertex counts."""
    fine = F.filter(ring, lambda p: F.coalesce((F.size(p) >= 2) & F.get(p, F.lit(0)).between(-180, 180) & F.get(p, F.lit(1)).between(-90, 90), F.lit(False)))
    total = lambda k: F.aggregate(fine, F.lit(0.0), lambda acc, p: acc + F.get(p, F.lit(k)))
    return F.when(F.size(fine) > 0, F.struct((total(1) / F.size(fine)).alias("lat"), (total(0) / F.size(fine)).alias("lon")))
