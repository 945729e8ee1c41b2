"""Distances, bearings, bins and grid cells as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Earth radii: fixed values; each formula below is defined with its own.
EARTH_KM = 6371.0088
EARTH_KM_ROUND = 6371.0
EARTH_M = 6_371_008.8
DIRECTIONS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _half_chord(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    up, side = F.sin((F.radians(lat2) - F.radians(lat1)) / 2), F.sin((F.radians(lon2) - F.radians(lon1)) / 2)
    return up * up + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * side * side


def haversine_km(lat1, lon1, lat2, lon2, radius: float = EARTH_KM) -> Column:
    a = _half_chord(_c(lat1), _c(lon1), _c(lat2), _c(lon2))
    return F.lit(2.0 * radius) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    a = _half_chord(_c(lat1), _c(lon1), _c(lat2), _c(lon2))
    return F.lit(2.0 * EARTH_M) * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), 1 - a)))


def bearing_deg(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing in [0, 360)."""
    p1, p2 = F.radians(_c(lat1)), F.radians(_c(lat2))
    turn = F.radians(_c(lon2)) - F.radians(_c(lon1))
    y, x = F.sin(turn) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(turn)
    return (F.degrees(F.atan2(y, x)) + 360.0) % 360.0


def direction_bin(bearing) -> Column:
    """Eight directions of 45 degrees, north from 337.5 to 22.5."""
    at = F.floor(((_c(bearing) + 22.5) % 360.0) / 45.0).cast("int")
    return F.when(_c(bearing).isNull(), None).otherwise(F.element_at(F.array(*[F.lit(d) for d in DIRECTIONS]), at + 1))


def right_closed_bins(value: Column, edges, unit: str, null_label: str | None = None) -> Column:
    """Labels 'a-b' with the upper edge inside (0 in the first bin), beyond the last 'e+'."""
    out = F.when(value.isNull(), F.lit(null_label))
    for lo, hi in zip((0, *edges), edges):
        out = out.when(value <= hi, f"{lo}-{hi}{unit}")
    return out.otherwise(f"{edges[-1]}+{unit}")


def distance_bin(metres, edges=(250, 500, 1000, 2000, 5000)) -> Column:
    return right_closed_bins(_c(metres), edges, "m")


def spatial_kernel(metres, tau_m: float = 500.0) -> Column:
    """exp(-d / tau); no distance counts as none."""
    return F.coalesce(F.exp(-_c(metres) / F.lit(tau_m)), F.lit(0.0))


def cell_id(lat, lon, resolution: int) -> Column:
    """Token of a square grid cell whose side halves about 1.4 times each level (0.7 km at 8, 0.27 km at 9).

    It stands where hexagonal cells would; a precomputed region column serves as well.
    """
    step = 360.0 / (1.0 * 7 ** (resolution / 2) * 2**3)
    y, x = F.floor((_c(lat) + 90.0) / F.lit(step)), F.floor((_c(lon) + 180.0) / F.lit(step))
    return F.concat_ws(":", F.lit(f"g{resolution}"), y.cast("long"), x.cast("long"))


def transverse_mercator(lat, lon, central: Column | float) -> tuple[Column, Column]:
    """Easting and northing in metres on the WGS84 ellipsoid (series to the fifth power; scale 0.9996)."""
    a, f = 6378137.0, 1 / 298.257223563
    e2 = f * (2 - f)
    ep = e2 / (1 - e2)
    p = F.radians(_c(lat))
    central = F.lit(central) if isinstance(central, float | int) else central
    s, c = F.sin(p), F.cos(p)
    n = F.lit(a) / F.sqrt(1 - e2 * s * s)
    t, g = (s / c) * (s / c), ep * c * c
    q = F.radians(_c(lon) - central) * c
    arc = a * ((1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256) * p - (3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024) * F.sin(2 * p) + (15 * e2**2 / 256 + 45 * e2**3 / 1024) * F.sin(4 * p) - (35 * e2**3 / 3072) * F.sin(6 * p))
    east = 0.9996 * n * (q + (1 - t + g) * q**3 / 6 + (5 - 18 * t + t * t + 72 * g - 58 * ep) * q**5 / 120) + 500000.0
    north = 0.9996 * (arc + n * (s / c) * (q**2 / 2 + (5 - t + 9 * g + 4 * g * g) * q**4 / 24 + (61 - 58 * t + t * t + 600 * g - 330 * ep) * q**6 / 720))
    return east, north
