"""Column functions of position, elevation and air."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import C


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def clip(x: Column, low: float, high: float) -> Column:
    """Limited to a range; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def haversine(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle metres."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * C.earth_m * F.asin(F.sqrt(clip(a, 0.0, 1.0)))


def local_xy(lat, lon, lat0, lon0) -> tuple[Column, Column]:
    """Metres east and north of an origin, on a plane."""
    lat, lon, lat0, lon0 = map(_c, (lat, lon, lat0, lon0))
    return (lon - lon0) * C.metres_per_degree * F.cos(F.radians(lat0)), (lat - lat0) * C.metres_per_degree


def point_to_segment(lat, lon, lat1, lon1, lat2, lon2) -> Column:
    """Metres from a point to a segment, on the plane around the point."""
    ax, ay = local_xy(lat1, lon1, lat, lon)
    bx, by = local_xy(lat2, lon2, lat, lon)
    dx, dy = bx - ax, by - ay
    long2 = dx * dx + dy * dy
    share = F.when(long2 > 0, clip(-(ax * dx + ay * dy) / F.when(long2 > 0, long2), 0.0, 1.0)).otherwise(F.lit(0.0))
    return F.sqrt(F.pow(ax + share * dx, 2) + F.pow(ay + share * dy, 2))


def metres_to_segments(lat: np.ndarray, lon: np.ndarray, lat1: np.ndarray, lon1: np.ndarray, lat2: np.ndarray, lon2: np.ndarray) -> np.ndarray:
    """``point_to_segment`` of arrays."""
    wide = np.cos(np.radians(lat))
    ax, ay = (lon1 - lon) * C.metres_per_degree * wide, (lat1 - lat) * C.metres_per_degree
    bx, by = (lon2 - lon) * C.metres_per_degree * wide, (lat2 - lat) * C.metres_per_degree
    dx, dy = bx - ax, by - ay
    long2 = dx * dx + dy * dy
    share = np.where(long2 > 0, np.clip(-(ax * dx + ay * dy) / np.where(long2 > 0, long2, 1.0), 0.0, 1.0), 0.0)
    return np.sqrt((ax + share * dx) ** 2 + (ay + share * dy) ** 2)


def bearing(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing in radians, -pi to pi."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    p1, p2, dl = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.atan2(F.sin(dl) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(dl))


def slippy_tile(lat, lon, zoom: int = 14) -> tuple[Column, Column]:
    """Fractional tile coordinates x, y of the web map scheme."""
    lat, lon = _c(lat), _c(lon)
    n, r = float(2**zoom), F.radians(_c(lat))
    return (lon + 180.0) / 360.0 * n, (1 - F.log(F.tan(r) + 1 / F.cos(r)) / F.lit(3.141592653589793)) / 2 * n


def terrain_rgb(r, g, b) -> Column:
    """Elevation of a terrain tile's pixel."""
    return _c(r) * 256.0 + _c(g) + _c(b) / 256.0 - 32768.0


def air_density(temp_c, pressure_hpa, elev=0.0) -> Column:
    """Density of dry air, the surface pressure taken to an elevation (below 0: 0)."""
    kelvin = _c(temp_c) + 273.15
    z = F.greatest(_c(elev), F.lit(0.0))
    pressure = _c(pressure_hpa) * 100.0 * F.pow(F.greatest(1 - 0.0065 * z / kelvin, F.lit(0.0)), F.lit(5.2559))
    return pressure / (287.05 * kelvin)


def plausible_elevation(elev, lat, lon, low: float = -200.0, high: float = 5000.0, uk_high: float = 1500.0) -> Column:
    """Elevation, or null outside the plausible range (narrower in the United Kingdom)."""
    e = _c(elev)
    return F.when((e >= low) & (e <= high) & (~in_uk(lat, lon) | (e <= uk_high)), e)


def in_uk(lat, lon) -> Column:
    return _c(lat).between(49.5, 61.0) & _c(lon).between(-8.7, 2.1)


# Airy 1830 and GRS80 axes, the seven Helmert parameters (m, ppm, seconds), the national grid's origin.
AIRY, GRS80 = (6377563.396, 6356256.909), (6378137.0, 6356752.3141)
HELMERT = (-446.448, 125.157, -542.060, 20.4894, -0.1502, -0.2470, -0.8421)
GRID = (0.9996012717, 49.0, -2.0, 400000.0, -100000.0)


def to_ecef(lat, lon, height=0.0, axes=GRS80) -> tuple[Column, Column, Column]:
    p, q = F.radians(_c(lat)), F.radians(_c(lon))
    a, b = axes
    e2 = 1 - b * b / (a * a)
    nu = a / F.sqrt(1 - e2 * F.sin(p) * F.sin(p))
    h = _c(height)
    return (nu + h) * F.cos(p) * F.cos(q), (nu + h) * F.cos(p) * F.sin(q), ((1 - e2) * nu + h) * F.sin(p)


def osgb36(lat, lon) -> tuple[Column, Column]:
    """Easting and northing on the British grid, by a Helmert shift and the transverse Mercator series."""
    x, y, z = to_ecef(lat, lon)
    tx, ty, tz, ppm, rx, ry, rz = HELMERT
    s, sec = 1 + ppm * 1e-6, 3.141592653589793 / (180 * 3600)
    rx, ry, rz = rx * sec, ry * sec, rz * sec
    x2, y2, z2 = tx + s * x - rz * y + ry * z, ty + rz * x + s * y - rx * z, tz - ry * x + rx * y + s * z
    a, b = AIRY
    e2 = 1 - b * b / (a * a)
    p = F.sqrt(x2 * x2 + y2 * y2)
    phi = F.atan2(z2, p * (1 - e2))
    for _ in range(3):
        phi = F.atan2(z2 + e2 * a / F.sqrt(1 - e2 * F.sin(phi) * F.sin(phi)) * F.sin(phi), p)
    return _mercator(phi, F.atan2(y2, x2))


def _mercator(phi: Column, lam: Column) -> tuple[Column, Column]:
    a, b = AIRY
    f0, lat0, lon0, e0, n0 = GRID
    p0, l0 = lat0 * 3.141592653589793 / 180, lon0 * 3.141592653589793 / 180
    e2, n = 1 - b * b / (a * a), (a - b) / (a + b)
    sin, cos, tan2 = F.sin(phi), F.cos(phi), F.tan(phi) * F.tan(phi)
    nu = a * f0 / F.sqrt(1 - e2 * sin * sin)
    rho = a * f0 * (1 - e2) / F.pow(1 - e2 * sin * sin, F.lit(1.5))
    eta = nu / rho - 1
    d, s = phi - p0, phi + p0
    arc = b * f0 * (
        (1 + n + 1.25 * n**2 + 1.25 * n**3) * d
        - (3 * n + 3 * n**2 + 2.625 * n**3) * F.sin(d) * F.cos(s)
        + (1.875 * n**2 + 1.875 * n**3) * F.sin(2 * d) * F.cos(2 * s)
        - 35 / 24 * n**3 * F.sin(3 * d) * F.cos(3 * s)
    )
    dl = lam - l0
    north = arc + n0 + nu / 2 * sin * cos * dl * dl + nu / 24 * sin * F.pow(cos, 3) * (5 - tan2 + 9 * eta) * F.pow(dl, 4) + nu / 720 * sin * F.pow(cos, 5) * (61 - 58 * tan2 + tan2 * tan2) * F.pow(dl, 6)
    east = (
        e0 + nu * cos * dl + nu / 6 * F.pow(cos, 3) * (nu / rho - tan2) * F.pow(dl, 3)
        + nu / 120 * F.pow(cos, 5) * (5 - 18 * tan2 + tan2 * tan2 + 14 * eta - 58 * tan2 * eta) * F.pow(dl, 5)
    )
    return east, north
