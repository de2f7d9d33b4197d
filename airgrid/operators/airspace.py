"""Airspace: rings from published points and arcs, membership and distance of points, and the risks that follow.

Rings are configuration, a few hundred segments, built on the driver and sent as a broadcast relation; what meets them, any
number of points, stays distributed. Membership counts directed crossings of an eastward ray, so that the one ring that crosses
itself keeps its dominant sense (winding), while simple rings give the same by parity.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airgrid.functions import geo
from airgrid.functions.names import free
from airgrid.sources import constants as K

Point = tuple[float, float]


# ---- rings (driver side configuration) -------------------------------------------------------------------------------


def _bearing(a: Point, b: Point) -> float:
    p, q, d = math.radians(a[0]), math.radians(b[0]), math.radians(b[1] - a[1])
    return math.degrees(math.atan2(math.sin(d) * math.cos(q), math.cos(p) * math.sin(q) - math.sin(p) * math.cos(q) * math.cos(d))) % 360


def _travel(a: Point, metres: float, bearing: float) -> Point:
    p, r, t = math.radians(a[0]), metres / geo.ARC_R, math.radians(bearing)
    q = math.asin(math.sin(p) * math.cos(r) + math.cos(p) * math.sin(r) * math.cos(t))
    return math.degrees(q), a[1] + math.degrees(math.atan2(math.sin(t) * math.sin(r) * math.cos(p), math.cos(r) - math.sin(p) * math.sin(q)))


def _arc(centre: Point, nm: float, a: Point, b: Point, sense: str, steps: int) -> list[Point]:
    """Points of an arc behind its first, from the bearing of a to that of b: the angle between them, clockwise or against it."""
    first, last = _bearing(centre, a), _bearing(centre, b)
    turn = (last - first) % 360.0 if sense == "cw" else -((first - last) % 360.0)
    return [_travel(centre, nm * geo.NM_TO_M, (first + turn * k / steps) % 360.0) for k in range(1, steps + 1)]


def ring_of(parts: list) -> list[Point]:
    out: list[Point] = []
    for k, part in enumerate(parts):
        if part[0] == "arc":
            _, centre, nm, sense, steps = part
            out += _arc(centre, nm, parts[k - 1], parts[k + 1], sense, steps)
        elif k == 0 or parts[k - 1][0] != "arc":
            out.append(part)
    return out


def circle(centre: Point, nm: float, steps: int) -> list[Point]:
    return [_travel(centre, nm * geo.NM_TO_M, 360.0 * k / steps) for k in range(steps)]


def sector(centre: Point, nm: float, first: float, last: float, steps: int) -> list[Point]:
    last += 360.0 if last < first else 0.0
    return [centre, *[_travel(centre, nm * geo.NM_TO_M, (first + (last - first) * k / steps) % 360.0) for k in range(steps + 1)]]


def rings() -> dict[str, list[Point]]:
    """Ring name to (x, y) in Mercator metres."""
    lat0, lon0 = K.MDW
    y = math.radians(K.SHORE_NORTH[0] - lat0) * geo.ARC_R
    reach = 10.0 * geo.NM_TO_M
    x = math.sqrt(reach * reach - y * y)
    lake_east = (K.SHORE_NORTH[0], lon0 + math.degrees(x / (math.cos(math.radians(lat0)) * geo.ARC_R)))
    degrees = {
        "area_a": ring_of(K.AREA_A),
        "area_b": ring_of(K.AREA_B),
        "core": circle(K.MDW, 5.0, K.CORE_STEPS),
        "land": ring_of(K.LAND_SHELF),
        "lake": [K.SHORE_NORTH, lake_east, *_arc(K.MDW, 10.0, lake_east, K.SHORE_SOUTH, "cw", K.LAKE_STEPS), K.SHORE_SOUTH],
        "lewis": circle(K.LEWIS, K.LEWIS_NM, K.LEWIS_STEPS),
        "wedge": sector(K.LEWIS, K.LEWIS_NM, *K.WEDGE),
    }
    return {name: [geo.xy(*p) for p in ring] for name, ring in degrees.items()}


def segments_of(named: dict[str, list[Point]]) -> list[tuple[str, float, float, float, float]]:
    """(ring, x1, y1, x2, y2), closed, without steps of length 0."""
    out = []
    for name, ring in named.items():
        for a, b in zip(ring, [*ring[1:], ring[0]], strict=True):
            if a != b:
                out.append((name, a[0], a[1], b[0], b[1]))
    return out


def _windings(p: Point, ring: list[Point]) -> int:
    n = 0
    for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if (y1 <= p[1]) != (y2 <= p[1]) and x1 + (p[1] - y1) * (x2 - x1) / (y2 - y1) > p[0]:
            n += 1 if y2 > y1 else -1
    return n


def _sense(ring: list[Point]) -> int:
    return 1 if sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, [*ring[1:], ring[0]], strict=True)) > 0 else -1


#: Regions as rings to unite and rings to take away.
REGIONS = {"area_a": (("area_a",), ()), "area_b": (("area_b",), ()), "core": (("core",), ("area_a", "area_b")), "shelf": (("land", "lake"), ("area_a", "area_b")), "lewis": (("lewis",), ("wedge",))}


def inside(p: Point, region: str, named: dict[str, list[Point]]) -> bool:
    plus, minus = REGIONS[region]
    hit = lambda r: _windings(p, named[r]) * _sense(named[r]) > 0
    return any(map(hit, plus)) and not any(map(hit, minus))


def boundary(region: str, named: dict[str, list[Point]]) -> list[tuple[float, float, float, float]]:
    """Segments of a region's boundary: all rings' segments cut wherever two cross; a piece stays if membership differs a
    centimetre to its two sides."""
    plus, minus = REGIONS[region]
    segs = [s[1:] for s in segments_of({r: named[r] for r in (*plus, *minus)})]
    out = []
    for x1, y1, x2, y2 in segs:
        cuts = {0.0, 1.0}
        for x3, y3, x4, y4 in segs:
            det = (x2 - x1) * (y4 - y3) - (y2 - y1) * (x4 - x3)
            if det:
                t = ((x3 - x1) * (y4 - y3) - (y3 - y1) * (x4 - x3)) / det
                u = ((x3 - x1) * (y2 - y1) - (y3 - y1) * (x2 - x1)) / det
                if 0 < t < 1 and -1e-9 <= u <= 1 + 1e-9:
                    cuts.add(t)
        ts = sorted(cuts)
        length = math.hypot(x2 - x1, y2 - y1)
        nx, ny = (y1 - y2) / length * 0.01, (x2 - x1) / length * 0.01
        for a, b in zip(ts, ts[1:], strict=False):
            if (b - a) * length < 1e-6:
                continue
            mx, my = x1 + (x2 - x1) * (a + b) / 2, y1 + (y2 - y1) * (a + b) / 2
            if inside((mx + nx, my + ny), region, named) != inside((mx - nx, my - ny), region, named):
                out.append((x1 + (x2 - x1) * a, y1 + (y2 - y1) * a, x1 + (x2 - x1) * b, y1 + (y2 - y1) * b))
    return out


# ---- relations -------------------------------------------------------------------------------------------------------

SEGMENT = "name string, x1 double, y1 double, x2 double, y2 double"


def ring_segments(spark: SparkSession, named: dict[str, list[Point]] | None = None) -> DataFrame:
    return spark.createDataFrame(segments_of(named or rings()), SEGMENT)


def boundary_segments(spark: SparkSession, named: dict[str, list[Point]] | None = None) -> DataFrame:
    named = named or rings()
    return spark.createDataFrame([(r, *s) for r in REGIONS for s in boundary(r, named)], SEGMENT)


def windings(points: DataFrame, segments: DataFrame, key: str = "cell_id", x: str = "cx", y: str = "cy") -> DataFrame:
    """key, name, w: signed crossings of the ray to the east of each point with each polygon it lies within the heights of. The
    segments are a configuration relation of some hundred rows, sent to every task."""
    up = (F.col("y1") <= F.col(y)) & (F.col("y2") > F.col(y))
    down = (F.col("y2") <= F.col(y)) & (F.col("y1") > F.col(y))
    east = F.col("x1") + (F.col(y) - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")) > F.col(x)
    hits = points.select(key, x, y).join(F.broadcast(segments), (up | down) & east)
    return hits.groupBy(key, "name").agg(F.sum(F.when(up, 1).otherwise(-1)).alias("w"))


def segment_distance(x: Column, y: Column) -> Column:
    """From a point to the segment (x1, y1)-(x2, y2)."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((x - F.col("x1")) * dx + (y - F.col("y1")) * dy, dx * dx + dy * dy), F.lit(0.0))))
    return F.hypot(x - F.col("x1") - t * dx, y - F.col("y1") - t * dy)


def boundary_distances(points: DataFrame, segments: DataFrame, within: float | None = None, key: str = "cell_id", x: str = "cx", y: str = "cy") -> DataFrame:
    """key, name, d: least distance to each boundary; within drops farther ones early, by boxes."""
    on = F.lit(True)
    if within is not None:
        on = F.col(x).between(F.least("x1", "x2") - within, F.greatest("x1", "x2") + within) & F.col(y).between(F.least("y1", "y2") - within, F.greatest("y1", "y2") + within)
    out = points.select(key, x, y).join(F.broadcast(segments), on).groupBy(key, "name").agg(F.min(segment_distance(F.col(x), F.col(y))).alias("d"))
    return out if within is None else out.where(F.col("d") <= within)


def memberships(cells: DataFrame, segments: DataFrame, named: dict[str, list[Point]]) -> DataFrame:
    """cells with in_<region> flags."""
    inner = {r: free(f"ring_{r}", cells) for r in named}
    w = windings(cells, segments).groupBy("cell_id").pivot("name", list(named)).agg(F.first("w"))
    out = cells.join(w.select("cell_id", *[F.col(r).alias(n) for r, n in inner.items()]), "cell_id", "left")
    hit = {r: F.coalesce(F.col(n) * _sense(named[r]) > 0, F.lit(False)) for r, n in inner.items()}
    flags = {}
    for region, (plus, minus) in REGIONS.items():
        yes, no = hit[plus[0]], F.lit(False)
        for r in plus[1:]:
            yes = yes | hit[r]
        for r in minus:
            no = no | hit[r]
        flags[f"in_{region}"] = yes & ~no
    return out.withColumns(flags).drop(*inner.values())


def runway_uv(dx: Column, dy: Column, heading: Column) -> tuple[Column, Column]:
    """Along and across a runway."""
    t = F.radians(heading - 90.0)
    return F.cos(t) * dx + F.sin(t) * dy, F.cos(t) * dy - F.sin(t) * dx


def corridor(u: Column, v: Column, peak: Column, length: Column, width: Column) -> Column:
    return peak * F.exp(-F.abs(u) / length) * F.exp(-F.pow(v / width, 2))


def radial_decay(d: Column, peak: float, scale: float = 8000.0, cut: float = 1500.0) -> Column:
    return F.when(d <= cut, F.exp(-d / scale) * peak).otherwise(0.0)


def airports(spark: SparkSession) -> DataFrame:
    rows = [(n, *geo.xy(lat, lon), h, a, length, w) for n, lat, lon, h, a, length, w in K.AIRPORTS]
    return spark.createDataFrame(rows, "airport string, px double, py double, heading double, peak double, length_m double, width_m double")


def corridor_risk(cells: DataFrame, sites: DataFrame) -> DataFrame:
    """cell_id, airport_risk: the sum over runway sites, a configuration of a few rows."""
    u, v = runway_uv(F.col("cx") - F.col("px"), F.col("cy") - F.col("py"), F.col("heading"))
    each = cells.select("cell_id", "cx", "cy").join(F.broadcast(sites), F.lit(True))
    return each.groupBy("cell_id").agg(F.sum(corridor(u, v, F.col("peak"), F.col("length_m"), F.col("width_m"))).alias("airport_risk"))


def radial_shelves(cells: DataFrame, shelves: DataFrame, cut: float = 1500.0) -> DataFrame:
    """cell_id, high, med by rings (px, py, inner_m, outer_m) around sites: 1 within the inner, 0.6 within the outer, decaying
    outside it."""
    d = F.hypot(F.col("cx") - F.col("px"), F.col("cy") - F.col("py"))
    each = cells.select("cell_id", "cx", "cy").join(F.broadcast(shelves), F.lit(True)).withColumn("d", d)
    med = F.when(F.col("d") <= F.col("inner_m"), 0.0).when(F.col("d") <= F.col("outer_m"), 0.6).otherwise(radial_decay(F.col("d") - F.col("outer_m"), 0.6, cut=cut))
    return each.groupBy("cell_id").agg(F.max(F.when(F.col("d") <= F.col("inner_m"), 1.0).otherwise(0.0)).alias("high"), F.max(med).alias("med"))


def shelf_risk(flagged: DataFrame, distances: DataFrame) -> DataFrame:
    """flagged cells with airport_airspace_high, _med and _risk; distances within the cut per region (name, d)."""
    near = distances.groupBy("cell_id").pivot("name", ["area_b", "shelf", "lewis"]).agg(F.min("d"))
    out = flagged.join(near.select("cell_id", *[F.col(r).alias(f"d_{r}") for r in ("area_b", "shelf", "lewis")]), "cell_id", "left")
    decay = [F.when(~F.col(f"in_{r}") & F.col(f"d_{r}").isNotNull(), radial_decay(F.col(f"d_{r}"), 0.6)).otherwise(0.0) for r in ("area_b", "shelf", "lewis")]
    flat = [F.when(F.col("in_area_b") & ~F.col("in_area_a"), 0.6).otherwise(0.0), F.when(F.col("in_shelf") & ~F.col("in_core"), 0.6).otherwise(0.0)]
    high = F.when(F.col("in_area_a") | F.col("in_core") | F.col("in_lewis"), 1.0).otherwise(0.0)
    out = out.withColumns({"airport_airspace_high": high, "airport_airspace_med": F.greatest(*flat, *decay)})
    return out.withColumn("airport_airspace_risk", F.greatest("airport_airspace_high", "airport_airspace_med"))
