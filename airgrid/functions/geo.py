"""Geodesy as Column expressions: spheres, Web Mercator and local planes, all inside codegen."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Web Mercator sphere, the sphere of airspace arcs (metres), the haversine sphere (miles), unit factors.
MERCATOR_R = 6378137.0
ARC_R = 6371000.0
MILES_R = 3958.8
NM_TO_M = 1852.0
NM_TO_KM = 1.852
FT_TO_M = 0.3048
M_TO_FT = 3.28084
KM_PER_LAT_DEGREE = 110.574
KM_PER_LON_DEGREE = 111.320


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def mercator_x(lon) -> Column:
    return F.radians(_c(lon)) * MERCATOR_R


def mercator_y(lat) -> Column:
    return F.log(F.tan(F.lit(math.pi / 4) + F.radians(_c(lat)) / 2)) * MERCATOR_R


def mercator_lon(x) -> Column:
    return F.degrees(_c(x) / MERCATOR_R)


def mercator_lat(y) -> Column:
    return F.degrees(F.atan(F.exp(_c(y) / MERCATOR_R)) * 2 - math.pi / 2)


def project(points: Column, inverse: bool = False) -> Column:
    """An array of (x, y) structs, lon/lat to metres or back."""
    fx, fy = (mercator_lon, mercator_lat) if inverse else (mercator_x, mercator_y)
    return F.transform(points, lambda p: F.struct(fx(p["x"]).alias("x"), fy(p["y"]).alias("y")))


def haversine_miles(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = (_c(v) for v in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.asin(F.least(F.lit(1.0), F.sqrt(h))) * (2 * MILES_R)


def equirectangular_m(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = (_c(v) for v in (lat1, lon1, lat2, lon2))
    mid = F.cos(F.radians((lat1 + lat2) / 2))
    return F.hypot(F.radians(lat2 - lat1), F.radians(lon2 - lon1) * mid) * ARC_R


def bearing_deg(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing, 0 to 360."""
    a, b, d = F.radians(_c(lat1)), F.radians(_c(lat2)), F.radians(_c(lon2) - _c(lon1))
    angle = F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)))
    return F.pmod(angle + 360.0, F.lit(360.0))


def destination(lat, lon, radius_m, bearing) -> tuple[Column, Column]:
    """(lat, lon) at a distance and bearing on the arc sphere."""
    a, r, t = F.radians(_c(lat)), _c(radius_m) / ARC_R, F.radians(_c(bearing))
    to = F.asin(F.sin(a) * F.cos(r) + F.cos(a) * F.sin(r) * F.cos(t))
    turn = F.atan2(F.sin(t) * F.sin(r) * F.cos(a), F.cos(r) - F.sin(a) * F.sin(to))
    return F.degrees(to), _c(lon) + F.degrees(turn)


def bounding_box(lat, lon, radius_nm) -> dict[str, Column]:
    km = _c(radius_nm) * NM_TO_KM
    up, side = km / KM_PER_LAT_DEGREE, km / (F.cos(F.radians(_c(lat))) * KM_PER_LON_DEGREE)
    return {"south": _c(lat) - up, "north": _c(lat) + up, "west": _c(lon) - side, "east": _c(lon) + side}


def local_xy(lat, lon, lat0, lon0) -> tuple[Column, Column]:
    """Metres east and north of an origin, on the arc sphere's local plane."""
    return F.radians(_c(lon) - _c(lon0)) * F.cos(F.radians(_c(lat0))) * ARC_R, F.radians(_c(lat) - _c(lat0)) * ARC_R


def from_local_xy(x, y, lat0, lon0) -> tuple[Column, Column]:
    return _c(lat0) + F.degrees(_c(y) / ARC_R), _c(lon0) + F.degrees(_c(x) / (F.cos(F.radians(_c(lat0))) * ARC_R))


def east_line_circle(lat, lat0, lon0, radius_m) -> tuple[Column, Column]:
    """Where a parallel meets a circle east of its centre; raises if it does not."""
    _, y = local_xy(lat, lon0, lat0, lon0)
    rest = F.pow(_c(radius_m), F.lit(2.0)) - y * y
    x = F.when(rest >= 0, F.sqrt(rest)).otherwise(F.raise_error(F.lit("the line does not meet the circle")).cast("double"))
    return from_local_xy(x, y, lat0, lon0)


def circle_crossings(x0, y0, r0, x1, y1, r1) -> Column:
    """The points, none to two, where two circles of a plane cross, as an array of structs."""
    x0, y0, r0, x1, y1, r1 = (_c(v) for v in (x0, y0, r0, x1, y1, r1))
    d = F.hypot(x1 - x0, y1 - y0)
    a = F.try_divide(r0 * r0 - r1 * r1 + d * d, d * 2)
    h2 = r0 * r0 - a * a
    ex, ey = F.try_divide(x1 - x0, d), F.try_divide(y1 - y0, d)
    mx, my, ox, oy = x0 + a * ex, y0 + a * ey, F.sqrt(h2) * ey, F.sqrt(h2) * ex
    both = F.array(F.struct((mx + ox).alias("x"), (my - oy).alias("y")), F.struct((mx - ox).alias("x"), (my + oy).alias("y")))
    return F.when((d > 0) & (d <= r0 + r1) & (d >= F.abs(r0 - r1)) & (h2 >= 0), both).otherwise(F.slice(both, 1, 0))


def straight_line(x1, y1, x2, y2) -> Column:
    """A line from one point to another, as geometries are held: its two ends."""
    return F.array(*[F.struct(_c(x).alias("x"), _c(y).alias("y")) for x, y in ((x1, y1), (x2, y2))])


def ring_label(lat, lon, radius_m, away_m=250.0) -> tuple[Column, Column]:
    """(lat, lon) of a circle's label: due north of its centre, away_m outside it, by the metres of a degree of latitude."""
    return _c(lat) + (_c(radius_m) + _c(away_m)) / 111_320.0, _c(lon)


# ---- the same on the driver, for configuration only --------------------------------------------------------------------


def xy(lat: float, lon: float) -> tuple[float, float]:
    return MERCATOR_R * math.radians(lon), MERCATOR_R * math.log(math.tan(math.pi / 4 + math.radians(lat) / 2))
