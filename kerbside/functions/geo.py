"""Geographic and rounding expressions, all built from column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
#: Metres of a degree of latitude, and of longitude at the city's latitude.
METRES_PER_DEGREE = 111_000.0
CITY_LAT = 12.97


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounding half up toward positive infinity (as JavaScript rounds)."""
    scale = float(10**digits)
    return F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def pct(part: Column, whole: Column, digits: int = 0) -> Column:
    """Percentage of a whole, null when the whole is 0."""
    return F.when(whole > 0, half_up(part / whole * F.lit(100.0), digits))


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    dlat, dlng = F.radians(lat2 - lat1), F.radians(lng2 - lng1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlng / 2), 2)
    return F.lit(EARTH_KM) * F.lit(2.0) * F.atan2(F.sqrt(a), F.sqrt(F.lit(1.0) - a))


def cell_index(x: Column, origin: float, size: float) -> Column:
    return F.floor((x - F.lit(origin)) / F.lit(size)).cast("long")


def to_xy(lat: Column, lng: Column, ref_lat: Column) -> tuple[Column, Column]:
    """Equirectangular metres."""
    return lng * F.lit(111_320.0) * F.cos(F.radians(ref_lat)), lat * F.lit(110_574.0)


def point_segment_m(px, py, ax, ay, bx, by) -> Column:
    """Distance of a point to a segment, in the units of the coordinates."""
    dx, dy = bx - ax, by - ay
    length2 = dx * dx + dy * dy
    t = F.when(length2 > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / length2))).otherwise(F.lit(0.0))
    return F.sqrt(F.pow(px - (ax + t * dx), 2) + F.pow(py - (ay + t * dy), 2))


def in_box(lat: Column, lng: Column, south: float, west: float, north: float, east: float) -> Column:
    return lat.between(F.lit(south), F.lit(north)) & lng.between(F.lit(west), F.lit(east))


def zone_by_bearing(lat: Column, lng: Column, centre_lat: float = 12.9716, centre_lng: float = 77.5946, core_km: float = 4.0) -> Column:
    """Central within the core, else the quadrant of the bearing from the centre."""
    dy = lat - F.lit(centre_lat)
    dx = (lng - F.lit(centre_lng)) * F.cos(F.radians(F.lit(centre_lat)))
    bearing = F.pmod(F.degrees(F.atan2(dx, dy)) + F.lit(360.0), F.lit(360.0))
    quadrant = F.when((bearing >= 315) | (bearing < 45), "North").when(bearing < 135, "East").when(bearing < 225, "South").otherwise("West")
    return F.when(haversine_km(lat, lng, F.lit(centre_lat), F.lit(centre_lng)) < core_km, "Central").otherwise(quadrant)


def traffic_factor(hour: Column) -> Column:
    """Rush hours, day, night and the rest (local time)."""
    rush = ((hour >= 8) & (hour < 11)) | ((hour >= 17) & (hour < 21))
    return F.when(rush, 1.5).when((hour >= 11) & (hour < 17), 1.25).when((hour >= 22) | (hour < 6), 1.0).otherwise(1.15)


def drive_minutes(km: Column, factor: Column) -> Column:
    """Road distance is 1.35 of the straight line, at 24 km/h without traffic."""
    return km * F.lit(1.35) / F.lit(24.0) * F.lit(60.0) * factor
