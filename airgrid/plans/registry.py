"""The core's queries over the driver tables, each with the SQL that must give the same rows.

Observations are derived from ``events`` (see sources.readers.observations); their gaps are hours, so horizons are counted in
days and steps in hours here. Results of transcendental functions are rounded, since engines differ in the last digit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from airgrid.functions import geo
from airgrid.functions import scalars as S
from airgrid.operators import airspace, graph, normalize, reports, risk, smoothing, tracks, traffic
from airgrid.operators import grid as grids
from airgrid.plans import routes
from airgrid.sources import constants as K
from airgrid.sources import readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

G = grids.Grid()
X0, Y0, X1, Y1 = G.corners
NX, NY = G.shape
DAY, HORIZON_DAYS = 86_400, (1, 3, 6, 9, 12, 24)

OBS = """obs AS (SELECT event_id, floor(epoch(ts))::BIGINT AS time, 41.48::DOUBLE + 0.73::DOUBLE * ((event_id * 7919) % 10007)::DOUBLE / 10007.0::DOUBLE AS lat,
  -88.34::DOUBLE + 0.82::DOUBLE * ((event_id * 104729) % 10009)::DOUBLE / 10009.0::DOUBLE AS lon, value * 6.0::DOUBLE AS baroaltitude, user_id AS icao24 FROM events)"""
MX = f"(radians(lon) * {geo.MERCATOR_R}::DOUBLE)"
MY = f"(ln(tan(pi() / 4 + radians(lat) / 2)) * {geo.MERCATOR_R}::DOUBLE)"
PLACED = f"""placed AS (SELECT *, CASE WHEN lon BETWEEN {K.WEST} AND {K.EAST} AND lat BETWEEN {K.SOUTH} AND {K.NORTH} THEN
  least(floor(({MX} - ({X0!r}::DOUBLE)) / 500.0::DOUBLE), {NX - 1})::BIGINT * {NY} + least(floor(({MY} - ({Y0!r}::DOUBLE)) / 500.0::DOUBLE), {NY - 1})::BIGINT END AS cell_id FROM obs)"""
CELLS = f"""boxes AS (SELECT id AS cell_id, id // {NY} AS ix, id % {NY} AS iy, (id // {NY})::DOUBLE * 500.0::DOUBLE + ({X0!r}::DOUBLE) AS xmin, (id % {NY})::DOUBLE * 500.0::DOUBLE + ({Y0!r}::DOUBLE) AS ymin,
  least(((id // {NY}) + 1)::DOUBLE * 500.0::DOUBLE + ({X0!r}::DOUBLE), {X1!r}::DOUBLE) AS xmax, least(((id % {NY}) + 1)::DOUBLE * 500.0::DOUBLE + ({Y0!r}::DOUBLE), {Y1!r}::DOUBLE) AS ymax FROM range({NX * NY}) r(id)),
cells AS (SELECT *, (xmin + xmax) / 2 AS cx, (ymin + ymax) / 2 AS cy, (xmax - xmin) * (ymax - ymin) AS area_m2 FROM boxes)"""
COUNTED = f"counted AS (SELECT c.*, coalesce(p.n, 0) AS traffic FROM cells c LEFT JOIN (SELECT cell_id, count(*) AS n FROM placed WHERE cell_id IS NOT NULL GROUP BY 1) p USING (cell_id))"
HORIZON = f"held AS (SELECT o.*, h.hours FROM obs o, (SELECT min(time) AS t0 FROM obs), (VALUES {', '.join(f'({h})' for h in HORIZON_DAYS)}) h(hours) WHERE o.time < t0 + h.hours * {DAY})"
AGL = "greatest(0.0::DOUBLE, baroaltitude * 3.28084::DOUBLE - 680.0::DOUBLE)"


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def observed(spark: SparkSession, d: str) -> DataFrame:
    return readers.observations(table(spark, d, "events"))


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# ---- flagship --------------------------------------------------------------------------------------------------------


@query(f"""WITH {OBS}, {PLACED}, {CELLS}, {COUNTED}, s AS (SELECT quantile_cont(ln(1 + traffic), 0.95) AS p FROM counted WHERE traffic > 0)
SELECT cell_id, ix, iy, traffic, round(power(least(1.0, ln(1 + traffic::DOUBLE) / (SELECT p FROM s)), 0.75), 6) AS traffic_norm FROM counted WHERE traffic > 0""")
def traffic_cost_top(spark, d):
    """Observations to cells, zero-filled counts, normalised as route costs are; the cells that saw traffic."""
    graph.checkpoints(spark)
    counted = traffic.counts(observed(spark, d), G.cells(spark), G).checkpoint()  # a row per cell; observations are scanned once
    out = normalize.normalize(counted, "traffic", "traffic_norm", percentile=95, log=True, power=0.75)
    return rounded(out.where("traffic > 0").select("cell_id", "ix", "iy", "traffic", "traffic_norm"), "traffic_norm")


# ---- scans and scalars -----------------------------------------------------------------------------------------------


@query(f"""WITH {OBS} SELECT time, lat, lon, baroaltitude, icao24 FROM obs WHERE (time // 3600) * 3600 BETWEEN 1704153600 AND 1705881600
AND lat BETWEEN 41.6 AND 42.1 AND lon BETWEEN -88.2 AND -87.6 AND baroaltitude < 3000 AND time % 5 = 0""")
def state_vector_scan(spark, d):
    vectors = observed(spark, d).withColumn("hour", S.hour_floor(F.col("time")))
    return traffic.scan(spark, vectors, start_epoch=1704153600, end_epoch=1705881600, south=41.6, north=42.1, west=-88.2, east=-87.6, max_altitude_m=3000.0, sample_seconds=5)


@query("""SELECT DISTINCT strftime(o_orderdate, '%Y-%m-%d') AS day, epoch(timezone('America/Chicago', o_orderdate::DATE::TIMESTAMP))::BIGINT AS start_epoch,
epoch(timezone('America/Chicago', (o_orderdate::DATE + 1)::TIMESTAMP))::BIGINT AS end_epoch,
((epoch(timezone('America/Chicago', o_orderdate::DATE::TIMESTAMP))::BIGINT // 3600) * 3600)::BIGINT AS start_hour FROM orders""")
def day_window(spark, d):
    start, end = S.day_window(F.col("day"), "America/Chicago")
    days = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return days.select(F.col("day").cast("string").alias("day"), start.alias("start_epoch"), end.alias("end_epoch"), S.hour_floor(start).alias("start_hour"))


@query("""WITH c AS (SELECT c_custkey, 41.0::DOUBLE + (c_custkey % 100)::DOUBLE / 100.0::DOUBLE AS lat, -88.0::DOUBLE + (c_custkey % 77)::DOUBLE / 77.0::DOUBLE AS lon, (5 + c_custkey % 40)::DOUBLE AS nm FROM customer)
SELECT c_custkey, round(lat - nm * 1.852 / 110.574, 9) AS south, round(lat + nm * 1.852 / 110.574, 9) AS north,
round(lon - nm * 1.852 / (cos(radians(lat)) * 111.320), 9) AS west, round(lon + nm * 1.852 / (cos(radians(lat)) * 111.320), 9) AS east FROM c""")
def bbox(spark, d):
    c = table(spark, d, "customer").select("c_custkey", (F.lit(41.0) + (F.col("c_custkey") % 100) / 100.0).alias("lat"), (F.lit(-88.0) + (F.col("c_custkey") % 77) / 77.0).alias("lon"), (F.col("c_custkey") % 40 + 5).cast("double").alias("nm"))
    return rounded(c.select("c_custkey", *[v.alias(k) for k, v in geo.bounding_box(F.col("lat"), F.col("lon"), F.col("nm")).items()]), "south", "north", "west", "east", digits=9)


@query(f"""WITH {OBS} SELECT event_id, round({AGL}, 6) AS altitude_agl_ft, CASE WHEN {AGL} < 1500 THEN '#2b83ba' WHEN {AGL} < 3000 THEN '#abdda4' WHEN {AGL} < 5000 THEN '#fdae61' ELSE '#d7191c' END AS color
FROM obs WHERE {AGL} <= 4000""")
def agl_altitude(spark, d):
    out = tracks.with_altitude(observed(spark, d), cap_ft=4000)
    return rounded(out.select("event_id", "altitude_agl_ft", S.band_color(F.col("altitude_agl_ft")).alias("color")), "altitude_agl_ft")


@query(f"""WITH {OBS} SELECT event_id, floor(({MX} - ({X0!r}::DOUBLE)) / 500.0::DOUBLE)::BIGINT AS ix, floor(({MY} - ({Y0!r}::DOUBLE)) / 500.0::DOUBLE)::BIGINT AS iy,
round(degrees({MX} / {geo.MERCATOR_R}), 6) AS lon_back, round(degrees(atan(exp({MY} / {geo.MERCATOR_R})) * 2 - pi() / 2), 6) AS lat_back FROM obs""")
def mercator_cells(spark, d):
    x, y = geo.mercator_x(F.col("lon")), geo.mercator_y(F.col("lat"))
    ix, iy = G.index(x, y)
    out = observed(spark, d).select("event_id", ix.alias("ix"), iy.alias("iy"), geo.mercator_lon(x).alias("lon_back"), geo.mercator_lat(y).alias("lat_back"))
    return rounded(out, "lon_back", "lat_back")


@query(f"""WITH {OBS} SELECT event_id, round(2 * 3958.8 * asin(least(1.0, sqrt(power(sin(radians(41.882 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(41.882)) * power(sin(radians(-87.6278 - lon) / 2), 2)))), 6) AS miles,
round(sqrt(power(radians(41.882 - lat), 2) + power(radians(-87.6278 - lon) * cos(radians((lat + 41.882) / 2)), 2)) * 6371000.0, 3) AS flat_m FROM obs""")
def haversine(spark, d):
    p = (F.col("lat"), F.col("lon"), 41.882, -87.6278)
    out = observed(spark, d).select("event_id", geo.haversine_miles(*p).alias("miles"), geo.equirectangular_m(*p).alias("flat_m"))
    return out.select("event_id", F.round("miles", 6).alias("miles"), F.round("flat_m", 3).alias("flat_m"))


@query(f"""WITH {OBS}, b AS (SELECT event_id, lat, lon, ((degrees(atan2(sin(radians(lon - (-87.7525))) * cos(radians(lat)), cos(radians(41.7861111111)) * sin(radians(lat)) - sin(radians(41.7861111111)) * cos(radians(lat)) * cos(radians(lon - (-87.7525))))) + 360.0) % 360.0) AS bearing FROM obs),
t AS (SELECT *, asin(sin(radians(lat)) * cos(5000.0 / 6371000.0) + cos(radians(lat)) * sin(5000.0 / 6371000.0) * cos(radians(bearing))) AS to_lat FROM b)
SELECT event_id, round(bearing, 6) AS bearing, round(degrees(to_lat), 6) AS to_lat,
round(lon + degrees(atan2(sin(radians(bearing)) * sin(5000.0 / 6371000.0) * cos(radians(lat)), cos(5000.0 / 6371000.0) - sin(radians(lat)) * sin(to_lat))), 6) AS to_lon,
round(radians(lon + 87.7525) * cos(radians(41.7861111111)) * 6371000.0, 3) AS local_x, round(radians(lat - 41.7861111111) * 6371000.0, 3) AS local_y FROM t""")
def bearings(spark, d):
    """Bearing from a centre, a point 5 km further on it, and local plane coordinates."""
    lat, lon = F.col("lat"), F.col("lon")
    rows = observed(spark, d).select("event_id", "lat", "lon", geo.bearing_deg(*K.MDW, lat, lon).alias("bearing"))
    to_lat, to_lon = geo.destination(lat, lon, 5000.0, F.col("bearing"))
    x, y = geo.local_xy(lat, lon, *K.MDW)
    return rows.select("event_id", F.round("bearing", 6).alias("bearing"), F.round(to_lat, 6).alias("to_lat"), F.round(to_lon, 6).alias("to_lon"), F.round(x, 3).alias("local_x"), F.round(y, 3).alias("local_y"))


@query("""WITH c AS (SELECT s_suppkey, (s_suppkey % 10)::DOUBLE AS x1, 3.0::DOUBLE + (s_suppkey % 7)::DOUBLE AS r1 FROM supplier), k AS (SELECT *, (36 - r1 * r1 + x1 * x1) / (2 * x1) AS a FROM c WHERE x1 > 0 AND x1 <= 6 + r1 AND x1 >= abs(6 - r1))
SELECT s_suppkey, round(a, 6) AS x, round(sqrt(36 - a * a), 6) AS half_chord FROM k WHERE 36 - a * a >= 0""")
def circle_crossings(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") % 10).cast("double").alias("x1"), (F.col("s_suppkey") % 7 + 3).cast("double").alias("r1"))
    p = geo.circle_crossings(0.0, 0.0, 6.0, F.col("x1"), 0.0, F.col("r1"))
    out = s.withColumn("p", p).where(F.size("p") > 0)
    return out.select("s_suppkey", F.round(F.col("p")[0]["x"], 6).alias("x"), F.round(F.abs(F.col("p")[0]["y"]), 6).alias("half_chord"))


# ---- traffic ---------------------------------------------------------------------------------------------------------


@query(f"WITH {OBS}, {PLACED}, {CELLS}, {COUNTED} SELECT cell_id, traffic FROM counted")
def traffic_counts(spark, d):
    return traffic.counts(observed(spark, d), G.cells(spark), G).select("cell_id", "traffic")


@query(f"WITH {OBS}, {PLACED}, {CELLS}, {COUNTED} SELECT cell_id, traffic, round(traffic / (greatest(area_m2, 1e-9) / 1e6), 4) AS traffic_density FROM counted WHERE traffic > 0")
def traffic_density(spark, d):
    out = traffic.densities(traffic.counts(observed(spark, d), G.cells(spark), G)).where("traffic > 0")
    return rounded(out.select("cell_id", "traffic", "traffic_density"), "traffic_density", digits=4)


@query(f"""WITH {OBS}, {HORIZON}, n AS (SELECT hours, floor(({MX} - ({X0!r}::DOUBLE)) / 5000.0::DOUBLE)::BIGINT AS ix, floor(({MY} - ({Y0!r}::DOUBLE)) / 5000.0::DOUBLE)::BIGINT AS iy, count(DISTINCT icao24) AS "count" FROM held GROUP BY 1, 2, 3 HAVING count(DISTINCT icao24) >= 2)
SELECT hours, ix, iy, "count", round("count" / (max("count") OVER (PARTITION BY hours))::DOUBLE, 6) AS intensity,
round(degrees(atan(exp(((iy + 0.5) * 5000.0 + ({Y0!r}::DOUBLE)) / {geo.MERCATOR_R})) * 2 - pi() / 2), 6) AS lat, round(degrees(((ix + 0.5) * 5000.0 + ({X0!r}::DOUBLE)) / {geo.MERCATOR_R}), 6) AS lon FROM n""")
def distinct_aircraft_heatmap(spark, d):
    out = traffic.aircraft_heatmap(observed(spark, d), grids.Grid(cell=5000.0), HORIZON_DAYS, DAY)
    return rounded(out.select("hours", "ix", "iy", "count", "intensity", "lat", "lon"), "intensity", "lat", "lon")


@query(f"""WITH {OBS}, e AS (SELECT min(lon) a, max(lon) b, min(lat) c, max(lat) d FROM obs)
SELECT least(179, floor((lon - a) / (b - a) * 180))::BIGINT AS bx, least(179, floor((lat - c) / (d - c) * 180))::BIGINT AS "by", count(*) AS n FROM obs, e GROUP BY 1, 2""")
def hist2d(spark, d):
    return traffic.histogram2d(observed(spark, d))


@query(f"WITH {OBS} SELECT count(*) AS n_rows, count(DISTINCT icao24) AS n_flights, min(time) AS first_time, max(time) AS last_time, round(min(lat), 9) AS south, round(max(lat), 9) AS north, round(min(lon), 9) AS west, round(max(lon), 9) AS east FROM obs")
def traffic_summary(spark, d):
    return rounded(traffic.summary(observed(spark, d)), "south", "north", "west", "east", digits=9)


BINS = f"""b AS (SELECT hours, round_even(lat / 0.05::DOUBLE, 0)::BIGINT AS lat_i, round_even(lon / 0.05::DOUBLE, 0)::BIGINT AS lon_i, floor({AGL} / 1000.0)::BIGINT AS alt_i, count(*) AS n FROM held GROUP BY 1, 2, 3, 4),
c AS (SELECT *, (sum(n) OVER (PARTITION BY hours, lat_i, lon_i))::BIGINT AS cost FROM b)"""


@query(f"""WITH {OBS}, {HORIZON}, {BINS} SELECT hours, lat_i, lon_i, alt_i, n AS "count", cost, alt_i * 1000.0::DOUBLE + 500.0::DOUBLE AS altitude_mid_ft, 2497 AS radius_m FROM c WHERE n >= 2""")
def density3d(spark, d):
    obs = tracks.with_altitude(observed(spark, d))
    return tracks.density3d(obs, HORIZON_DAYS, DAY, step_deg=0.05).select("hours", "lat_i", "lon_i", "alt_i", "count", "cost", "altitude_mid_ft", "radius_m")


@query(f"""WITH {OBS}, {HORIZON}, {BINS} SELECT hours::VARCHAR AS hours, round(lat_i * 0.05::DOUBLE, 6) AS lat, round(lon_i * 0.05::DOUBLE, 6) AS lon, alt_i * 1000.0::DOUBLE AS altitude_bottom_ft, (alt_i + 1) * 1000.0::DOUBLE AS altitude_top_ft, n AS observation_count, cost
FROM c WHERE n >= 2 AND (alt_i + 1) * 1000.0 <= 4000""")
def flatten_costs(spark, d):
    obs = tracks.with_altitude(observed(spark, d))
    flat = tracks.under_ceiling(tracks.flatten_costs(tracks.density3d(obs, HORIZON_DAYS, DAY, step_deg=0.05)), "altitude_top_ft", 4000.0)
    return rounded(flat.drop("altitude_mid_ft"), "lat", "lon")


@query(f"WITH {OBS}, {PLACED}, {CELLS}, {COUNTED} SELECT traffic_density_type, count(*) AS n FROM (SELECT CASE WHEN traffic / (greatest(area_m2, 1e-9) / 1e6) > 0 THEN 'air_traffic' ELSE 'none' END AS traffic_density_type FROM counted) GROUP BY 1")
def traffic_labels(spark, d):
    """The two-valued traffic label of every cell, counted."""
    out = traffic.labelled(traffic.densities(traffic.counts(observed(spark, d), G.cells(spark), G)))
    return out.groupBy("traffic_density_type").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {OBS}, {HORIZON}, {BINS} SELECT hours, row_number() OVER (PARTITION BY hours ORDER BY n DESC, lat_i, lon_i, alt_i) AS place, lat_i, lon_i, alt_i, n AS "count" FROM c WHERE n >= 2""")
def bins_by_count(spark, d):
    """Bins of each horizon from the fullest on, with their place."""
    bins = tracks.density3d(tracks.with_altitude(observed(spark, d)), HORIZON_DAYS, DAY, step_deg=0.05)
    place = F.row_number().over(Window.partitionBy("hours").orderBy(F.desc("count"), "lat_i", "lon_i", "alt_i"))
    return tracks.by_count(bins.withColumn("place", place)).select("hours", F.col("place").cast("long").alias("place"), "lat_i", "lon_i", "alt_i", "count")


# ---- trajectories ----------------------------------------------------------------------------------------------------


@query(f"""WITH {OBS}, a AS (SELECT *, {AGL} AS alt FROM obs), w AS (SELECT *, lead(time) OVER q AS t2, lead(lat) OVER q AS lat2, lead(lon) OVER q AS lon2, lead(alt) OVER q AS alt2 FROM a WINDOW q AS (PARTITION BY icao24 ORDER BY time, event_id)),
s AS (SELECT w.*, u.k FROM w, LATERAL (SELECT unnest(CASE WHEN t2 - time > 3600 AND t2 - time <= 86400 THEN range(0, t2 - time, 3600) ELSE [0] END) AS k) u)
SELECT icao24, time + k AS time, round(CASE WHEN k = 0 THEN lat ELSE lat + (lat2 - lat) * (k / (t2 - time)) END, 6) AS lat, round(CASE WHEN k = 0 THEN lon ELSE lon + (lon2 - lon) * (k / (t2 - time)) END, 6) AS lon,
round(CASE WHEN k = 0 THEN alt ELSE alt + (alt2 - alt) * (k / (t2 - time)) END, 4) AS altitude_agl_ft FROM s""")
def interpolate(spark, d):
    obs = tracks.with_altitude(observed(spark, d))
    out = tracks.interpolate(obs, 3600, DAY, order=("time", "event_id"))
    return out.select("icao24", "time", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), F.round("altitude_agl_ft", 4).alias("altitude_agl_ft"))


@query(f"WITH {OBS}, r AS (SELECT *, row_number() OVER (PARTITION BY icao24 ORDER BY time, event_id) - 1 AS n FROM obs) SELECT event_id, icao24, time, n FROM r WHERE n % 3 = 0")
def track_stride(spark, d):
    return tracks.stride(observed(spark, d), 3, order=("time", "event_id")).select("event_id", "icao24", "time", F.col("n").cast("long").alias("n"))


TRACKED = f"""r AS (SELECT *, {AGL} AS alt, row_number() OVER (PARTITION BY hours, icao24 ORDER BY time, event_id) - 1 AS n FROM held), sampled AS (SELECT *, n // 3 AS pos FROM r WHERE n % 3 = 0),
t AS (SELECT hours, icao24, count(*) AS samples, avg(alt) AS mean_alt, max(alt) AS max_alt FROM sampled GROUP BY 1, 2 HAVING count(*) >= 2)"""


def _tracks(spark, d):
    return tracks.tracks(tracks.with_altitude(observed(spark, d)), 3, HORIZON_DAYS, DAY, order=("time", "event_id"))


@query(f"""WITH {OBS}, {HORIZON}, {TRACKED} SELECT t.hours, t.icao24, t.samples, round(t.mean_alt, 4) AS mean_altitude_ft, round(t.max_alt, 4) AS max_altitude_ft, round(s.lon, 6) AS first_lon, round(s.lat, 6) AS first_lat,
CASE WHEN t.mean_alt < 1500 THEN '#2b83ba' WHEN t.mean_alt < 3000 THEN '#abdda4' WHEN t.mean_alt < 5000 THEN '#fdae61' ELSE '#d7191c' END AS color FROM t JOIN sampled s ON s.hours = t.hours AND s.icao24 = t.icao24 AND s.pos = 0""")
def track_summary(spark, d):
    o = F.get("path", F.lit(0))
    return _tracks(spark, d).select("hours", "icao24", "samples", F.round("mean_altitude_ft", 4).alias("mean_altitude_ft"), F.round("max_altitude_ft", 4).alias("max_altitude_ft"), F.round(o[0], 6).alias("first_lon"), F.round(o[1], 6).alias("first_lat"), "color")


@query(f"""WITH {OBS}, {HORIZON}, {TRACKED} SELECT s.hours, s.icao24, s.pos::INT AS pos, round(p.lon, 6) AS from_lon, round(s.lon, 6) AS to_lon, round(s.alt, 4) AS to_alt FROM sampled s JOIN t ON s.hours = t.hours AND s.icao24 = t.icao24
JOIN sampled p ON p.hours = s.hours AND p.icao24 = s.icao24 AND p.pos = s.pos - 1 WHERE s.pos >= 1 AND (s.pos - 1) % 6 = 0""")
def arrows(spark, d):
    a = tracks.arrows(_tracks(spark, d), 6)
    return a.select("hours", "icao24", "pos", F.round(F.col("source")[0], 6).alias("from_lon"), F.round(F.col("target")[0], 6).alias("to_lon"), F.round(F.col("target")[2], 4).alias("to_alt"))


@query(f"WITH {OBS}, {HORIZON}, {TRACKED} SELECT s.hours, s.icao24, round(s.lat, 6) AS lat, round(s.alt, 4) AS altitude_ft, 250.0::DOUBLE AS radius_m FROM sampled s JOIN t ON s.hours = t.hours AND s.icao24 = t.icao24 WHERE s.pos = 0 AND s.alt <= 3000")
def origins(spark, d):
    o = tracks.under_ceiling(tracks.origins(_tracks(spark, d)), "altitude_ft", 3000.0)
    return o.select("hours", "icao24", F.round(F.col("position")[1], 6).alias("lat"), F.round("altitude_ft", 4).alias("altitude_ft"), "radius_m")


@query(f"""WITH {OBS} SELECT event_id, round(lat + (baroaltitude * 0.3048 + 250) / 111320.0, 9) AS label_lat, lon AS label_lon, -87.6278 AS to_lon, 41.882 AS to_lat FROM obs""")
def labels_and_lines(spark, d):
    """Where a circle's label stands, and the straight line from a point to a destination."""
    lat, lon = geo.ring_label(F.col("lat"), F.col("lon"), F.col("baroaltitude") * 0.3048)
    line = geo.straight_line(F.col("lon"), F.col("lat"), -87.6278, 41.882)
    return observed(spark, d).select("event_id", F.round(lat, 9).alias("label_lat"), lon.alias("label_lon"), line[1]["x"].alias("to_lon"), line[1]["y"].alias("to_lat"))


# ---- population, risk ------------------------------------------------------------------------------------------------

PEOPLE = """g AS (SELECT c_custkey::VARCHAR AS GEOID, ((c_custkey % 13) * 250000)::BIGINT AS ALAND FROM customer), p AS (SELECT '1500000US' || c_custkey AS GEO_ID, CASE WHEN c_custkey % 17 = 0 THEN '1d' ELSE (c_custkey % 5000)::VARCHAR END AS B01003_001E FROM customer WHERE c_custkey % 11 <> 0 UNION ALL SELECT 'Geography', 'Total'),
j AS (SELECT g.GEOID, g.ALAND, CASE WHEN regexp_matches(B01003_001E, '^[0-9.]+$') THEN try_cast(B01003_001E AS DOUBLE) END AS population FROM g LEFT JOIN p ON g.GEOID = list_extract(string_split(p.GEO_ID, 'US'), -1) AND p.GEO_ID <> 'Geography'),
dens AS (SELECT *, CASE WHEN ALAND <> 0 THEN population / (ALAND / 1e6) END AS density_p_km2 FROM j)"""


def _population(spark, d):
    c = table(spark, d, "customer")
    groups = c.select(F.col("c_custkey").cast("string").alias("GEOID"), (F.col("c_custkey") % 13 * 250000).alias("ALAND"))
    people = c.where("c_custkey % 11 <> 0").select(F.concat(F.lit("1500000US"), "c_custkey").alias("GEO_ID"), F.when(F.col("c_custkey") % 17 == 0, "1d").otherwise((F.col("c_custkey") % 5000).cast("string")).alias("B01003_001E"))
    head = spark.createDataFrame([("Geography", "Total")], people.schema)
    return risk.population_join(groups, people.unionByName(head))


@query(f"WITH {PEOPLE} SELECT GEOID, ALAND, population, round(density_p_km2, 6) AS density_p_km2 FROM dens")
def population_join(spark, d):
    return rounded(_population(spark, d).select("GEOID", "ALAND", "population", "density_p_km2"), "density_p_km2")


@query(f"WITH {PEOPLE}, q AS (SELECT quantile_cont(density_p_km2, 0.7) AS a, quantile_cont(density_p_km2, 0.9) AS b FROM dens) SELECT GEOID, CASE WHEN density_p_km2 >= b THEN 'high' WHEN density_p_km2 >= a THEN 'medium' ELSE 'low' END AS density_risk FROM dens, q")
def quantile_risk(spark, d):
    return risk.quantile_risk(_population(spark, d)).select("GEOID", "density_risk")


@query(f"""WITH {PEOPLE} SELECT count(*) AS n_rows, count(*) FILTER (WHERE population IS NULL) AS n_missing, count(*) FILTER (WHERE population <> 0) AS n_nonzero, min(population) AS min_value, max(population) AS max_value, round(avg(population), 6) AS mean_value,
round(stddev_samp(population), 6) AS spread, round(quantile_cont(population, 0.25), 6) AS quartile_1, round(quantile_cont(population, 0.5), 6) AS median, round(quantile_cont(population, 0.75), 6) AS quartile_3 FROM dens""")
def population_profile(spark, d):
    return rounded(risk.profile(_population(spark, d), "population"), "mean_value", "spread", "quartile_1", "median", "quartile_3")


@query(f"WITH {PEOPLE}, q AS (SELECT quantile_cont(density_p_km2, 0.7) AS a, quantile_cont(density_p_km2, 0.9) AS b FROM dens) SELECT CASE WHEN density_p_km2 >= b THEN 'high' WHEN density_p_km2 >= a THEN 'medium' ELSE 'low' END AS value, count(*) AS n FROM dens, q GROUP BY 1")
def risk_value_counts(spark, d):
    return risk.value_counts(risk.quantile_risk(_population(spark, d)), "density_risk")


@query(f"WITH {CELLS} SELECT cell_id, ix, iy, round(xmin, 4) AS xmin, round(ymax, 4) AS ymax, round(cx, 4) AS cx, round(cy, 4) AS cy, round(area_m2, 3) AS area_m2 FROM cells")
def grid_cells(spark, d):
    c = G.cells(spark)
    return c.select("cell_id", "ix", "iy", *[F.round(n, 4).alias(n) for n in ("xmin", "ymax", "cx", "cy")], F.round("area_m2", 3).alias("area_m2"))


SITES = ", ".join(f"('{n.replace(chr(39), chr(39) * 2)}', {geo.xy(lat, lon)[0]!r}::DOUBLE, {geo.xy(lat, lon)[1]!r}::DOUBLE, {h}::DOUBLE, {a}::DOUBLE, {length}::DOUBLE, {w}::DOUBLE)" for n, lat, lon, h, a, length, w in K.AIRPORTS)
UV = "cos(radians(heading - 90)) * (cx - px) + sin(radians(heading - 90)) * (cy - py)", "cos(radians(heading - 90)) * (cy - py) - sin(radians(heading - 90)) * (cx - px)"
CORRIDOR = f"corr AS (SELECT cell_id, sum(peak * exp(-abs({UV[0]}) / len) * exp(-power(({UV[1]}) / width, 2))) AS airport_risk FROM cells, (VALUES {SITES}) s(name, px, py, heading, peak, len, width) GROUP BY cell_id)"


@query(f"WITH {CELLS}, {CORRIDOR} SELECT cell_id, round(airport_risk, 6) AS airport_risk FROM corr")
def corridor_risk(spark, d):
    return rounded(airspace.corridor_risk(G.cells(spark), airspace.airports(spark)), "airport_risk")


@query(f"""WITH {CELLS}, e AS (SELECT cell_id, i, o, sqrt(power(cx - px, 2) + power(cy - py, 2)) AS d FROM cells, (VALUES {SITES}) s(name, px, py, heading, peak, i, o))
SELECT cell_id, max(CASE WHEN d <= 4000 THEN 1.0 ELSE 0.0 END)::DOUBLE AS high, round(max(CASE WHEN d <= 4000 THEN 0.0 WHEN d <= 9000 THEN 0.6 WHEN d - 9000 <= 1500 THEN 0.6 * exp(-(d - 9000) / 8000) ELSE 0.0 END)::DOUBLE, 6) AS med FROM e GROUP BY 1""")
def radial_shelves(spark, d):
    shelves = airspace.airports(spark).select("px", "py", F.lit(4000.0).alias("inner_m"), F.lit(9000.0).alias("outer_m"))
    return rounded(airspace.radial_shelves(G.cells(spark), shelves), "med")


NAMED = airspace.rings()
VALUES = lambda rows: ", ".join("('" + r[0] + "', " + ", ".join(f"{v!r}::DOUBLE" for v in r[1:]) + ")" for r in rows)
EDGE_ROWS = [(r, *s) for r in ("area_b", "shelf", "lewis") for s in airspace.boundary(r, NAMED)]


def _ring_sql() -> str:
    """The rings' segments derived in SQL from the published points, arcs, circles and sectors alone."""
    east = f"(SELECT {K.MDW[1]!r} + degrees(sqrt(power(10.0 * {geo.NM_TO_M}, 2) - power(radians({K.SHORE_NORTH[0]!r} - {K.MDW[0]!r}) * {geo.ARC_R}, 2)) / (cos(radians({K.MDW[0]!r})) * {geo.ARC_R})))"
    lake = [K.SHORE_NORTH, (K.SHORE_NORTH[0], east), ("arc", K.MDW, 10.0, "cw", K.LAKE_STEPS), K.SHORE_SOUTH, K.SHORE_SOUTH]
    points, arcs = [], []
    for name, parts in (("area_a", K.AREA_A), ("area_b", K.AREA_B), ("land", K.LAND_SHELF), ("lake", lake)):
        for k, part in enumerate(parts):
            if part[0] == "arc":
                _, c, nm, sense, steps = part
                (alat, alon), (blat, blon) = parts[k - 1], parts[k + 1]
                arcs.append(f"('{name}', {k}, {c[0]!r}::DOUBLE, {c[1]!r}::DOUBLE, {nm}::DOUBLE, {alat}::DOUBLE, {alon}::DOUBLE, {blat}::DOUBLE, {blon}::DOUBLE, {1 if sense == 'cw' else -1}, {steps})")
            elif k == 0 or parts[k - 1][0] != "arc":
                points.append(f"('{name}', {k}::DOUBLE, {part[0]}::DOUBLE, {part[1]}::DOUBLE)")
    first, last, steps = K.WEDGE
    turns = [("core", K.MDW, 5.0, 0.0, 360.0, K.CORE_STEPS, K.CORE_STEPS), ("lewis", K.LEWIS, K.LEWIS_NM, 0.0, 360.0, K.LEWIS_STEPS, K.LEWIS_STEPS), ("wedge", K.LEWIS, K.LEWIS_NM, first, last + (360.0 if last < first else 0.0), steps, steps + 1)]
    points.append(f"('wedge', -1::DOUBLE, {K.LEWIS[0]!r}::DOUBLE, {K.LEWIS[1]!r}::DOUBLE)")
    swept = ", ".join(f"('{n}', 0, {c[0]!r}::DOUBLE, {c[1]!r}::DOUBLE, {nm}::DOUBLE, {a}::DOUBLE, {b - a}::DOUBLE, {m}, 0, {upto})" for n, c, nm, a, b, m, upto in turns)
    bearing = lambda p: f"degrees(atan2(sin(radians({p}lon - clon)) * cos(radians({p}lat)), cos(radians(clat)) * sin(radians({p}lat)) - sin(radians(clat)) * cos(radians({p}lat)) * cos(radians({p}lon - clon))))"
    return f"""given AS (SELECT * FROM (VALUES {", ".join(points)}) v(name, seq, lat, lon)), arcs AS (SELECT * FROM (VALUES {", ".join(arcs)}) v(name, seq, clat, clon, nm, alat, alon, blat, blon, sense, steps)),
turns AS (SELECT name, seq, clat, clon, nm, {bearing("a")} AS a, sense * ((sense * ({bearing("b")} - {bearing("a")}) + 720.0) % 360.0) AS turn, steps, 1 AS k0, steps + 1 AS k1 FROM arcs UNION ALL SELECT * FROM (VALUES {swept}) v(name, seq, clat, clon, nm, a, turn, steps, k0, k1)),
steps AS (SELECT name, seq + u.k / 10000.0 AS seq, radians(clat) AS c, clon, nm * {geo.NM_TO_M} / {geo.ARC_R} AS r, radians(a + turn * u.k / steps) AS t FROM turns, LATERAL (SELECT unnest(range(k0, k1)) AS k) u),
reached AS (SELECT *, asin(sin(c) * cos(r) + cos(c) * sin(r) * cos(t)) AS q FROM steps),
ringed AS (SELECT name, seq::DOUBLE AS seq, lat, lon FROM given UNION ALL SELECT name, seq::DOUBLE, degrees(q), clon + degrees(atan2(sin(t) * sin(r) * cos(c), cos(r) - sin(c) * sin(q))) FROM reached),
flat AS (SELECT name, seq, {MX} AS x, {MY} AS y FROM ringed),
segs AS (SELECT name, x AS x1, y AS y1, coalesce(lead(x) OVER w, first_value(x) OVER w) AS x2, coalesce(lead(y) OVER w, first_value(y) OVER w) AS y2 FROM flat WINDOW w AS (PARTITION BY name ORDER BY seq)),
senses AS (SELECT name, sign(sum(x1 * y2 - x2 * y1)) AS s FROM segs GROUP BY 1)"""


WINDING = f"""{_ring_sql()}, w AS (SELECT c.cell_id, s.name, sum(CASE WHEN y1 <= cy THEN 1 ELSE -1 END) AS w FROM cells c JOIN segs s
ON ((y1 <= cy AND y2 > cy) OR (y2 <= cy AND y1 > cy)) AND x1 + (cy - y1) * (x2 - x1) / (y2 - y1) > cx GROUP BY 1, 2)"""
FLAGS = f"""hit AS (SELECT w.cell_id, w.name FROM w JOIN senses g ON w.name = g.name WHERE w.w * g.s > 0),
ins AS (SELECT c.*, {", ".join(f"c.cell_id IN (SELECT cell_id FROM hit WHERE name = '{n}') AS h_{n}" for n in NAMED)} FROM cells c),
flagged AS (SELECT *, h_area_a AS in_area_a, h_area_b AS in_area_b, h_core AND NOT (h_area_a OR h_area_b) AS in_core, (h_land OR h_lake) AND NOT (h_area_a OR h_area_b) AS in_shelf, h_lewis AND NOT h_wedge AS in_lewis FROM ins)"""
NEAR = f"""dist AS (SELECT cell_id, name, min(sqrt(power(cx - x1 - t * (x2 - x1), 2) + power(cy - y1 - t * (y2 - y1), 2))) AS d FROM (SELECT c.cell_id, cx, cy, s.*, greatest(0.0, least(1.0, ((cx - x1) * (x2 - x1) + (cy - y1) * (y2 - y1)) / (power(x2 - x1, 2) + power(y2 - y1, 2)))) AS t
FROM cells c JOIN (VALUES {VALUES(EDGE_ROWS)}) s(name, x1, y1, x2, y2) ON cx BETWEEN least(x1, x2) - 1500 AND greatest(x1, x2) + 1500 AND cy BETWEEN least(y1, y2) - 1500 AND greatest(y1, y2) + 1500) GROUP BY 1, 2)"""


def _flagged(spark):
    return airspace.memberships(G.cells(spark), airspace.ring_segments(spark, NAMED), NAMED)


def _near(spark):
    return airspace.boundary_distances(G.cells(spark), spark.createDataFrame(EDGE_ROWS, airspace.SEGMENT), within=1500.0)


@query(f"WITH {CELLS}, {WINDING}, {FLAGS} SELECT cell_id, in_area_a, in_area_b, in_core, in_shelf, in_lewis FROM flagged")
def point_in_polygon(spark, d):
    return _flagged(spark).select("cell_id", *[f"in_{r}" for r in airspace.REGIONS])


@query(f"WITH {CELLS}, {NEAR} SELECT cell_id, name, round(d, 4) AS d FROM dist WHERE d <= 1500")
def boundary_distance(spark, d):
    return rounded(_near(spark), "d", digits=4)


LAYERS = f"""air AS (SELECT f.*, CASE WHEN in_area_a OR in_core OR in_lewis THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS high, greatest(CASE WHEN in_area_b AND NOT in_area_a THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END, CASE WHEN in_shelf AND NOT in_core THEN 0.6::DOUBLE ELSE 0.0::DOUBLE END,
{", ".join(f"CASE WHEN NOT in_{r} AND {r}.d <= 1500 THEN 0.6::DOUBLE * exp(-{r}.d / 8000.0) ELSE 0.0::DOUBLE END" for r in ("area_b", "shelf", "lewis"))}) AS med FROM flagged f {" ".join(f"LEFT JOIN (SELECT cell_id, d FROM dist WHERE name = '{r}') {r} ON f.cell_id = {r}.cell_id" for r in ("area_b", "shelf", "lewis"))})"""
PEOPLED = "peopled AS (SELECT a.*, c.airport_risk, greatest(a.high, a.med) AS airspace_risk, ((a.cell_id * 37) % 1500)::DOUBLE AS density_p_km2 FROM air a JOIN corr c USING (cell_id))"
CLASSED = """k AS (SELECT *, least(120.0, greatest(0.0, density_p_km2 / 10.0)) AS city_risk, airport_risk + airspace_risk * 70.0 AS combined FROM peopled),
classed AS (SELECT *, CASE WHEN city_risk > 90 THEN 'High' WHEN city_risk > 40 THEN 'Medium' ELSE 'Low' END AS pop_class, CASE WHEN combined > 70.0000000001 THEN 'High' WHEN combined > 30 THEN 'Medium' ELSE 'Low' END AS air_class, city_risk * 0.9 + combined * 1.4 AS risk_cost FROM k)"""


BLOCKS = [(gx, gy) for gx in range(-9830, -9740, 9) for gy in range(5090, 5170, 9)]


@query(f"WITH {CELLS} SELECT cell_id, gx || '/' || gy AS polygon_id FROM cells, (VALUES {', '.join(map(str, BLOCKS))}) b(gx, gy) WHERE abs(cx - gx * 1000.0) + abs(cy - gy * 1000.0) < 4100")
def cells_in_polygons(spark, d):
    """The block group that holds a cell's centre; diamonds stand for block groups, so the SQL needs no polygons."""
    corner = lambda dx, dy: F.struct((F.col("gx") * 1000.0 + dx).alias("x"), (F.col("gy") * 1000.0 + dy).alias("y"))
    blocks = spark.createDataFrame(BLOCKS, "gx long, gy long").select(F.concat_ws("/", "gx", "gy").alias("polygon_id"), F.array(corner(4100, 0), corner(0, 4100), corner(-4100, 0), corner(0, -4100)).alias("ring"))
    return routes.cells_in_polygons(G.cells(spark), blocks)


COARSE = grids.Grid(cell=2000.0)
QX, QY = COARSE.shape


@query(f"WITH {CELLS}, m AS (SELECT cell_id, least(floor((cx - ({X0!r}::DOUBLE)) / 2000.0::DOUBLE), {QX - 1})::BIGINT * {QY} + least(floor((cy - ({Y0!r}::DOUBLE)) / 2000.0::DOUBLE), {QY - 1})::BIGINT AS held FROM cells) SELECT cell_id, CASE WHEN held % 3 <> 0 THEN (held * 17 % 500)::DOUBLE END AS density_p_km2 FROM m")
def values_of_prior_grid(spark, d):
    """Densities taken over from an earlier grid of cells of another size."""
    prior = COARSE.cells(spark).where("cell_id % 3 <> 0").select("cell_id", F.pmod(F.col("cell_id") * 17, F.lit(500)).cast("double").alias("density_p_km2"))
    return grids.from_other(G.cells(spark), COARSE, prior, ["density_p_km2"]).select("cell_id", "density_p_km2")


def _risk_cells(spark):
    return routes.risk_cells(spark, G, F.pmod(F.col("cell_id") * 37, F.lit(1500)).cast("double"))


@query(f"WITH {CELLS}, {WINDING}, {FLAGS}, {NEAR}, {LAYERS} SELECT cell_id, high AS airport_airspace_high, round(med, 6) AS airport_airspace_med, round(greatest(high, med), 6) AS airport_airspace_risk FROM air")
def airspace_layers(spark, d):
    out = airspace.shelf_risk(_flagged(spark), _near(spark))
    return rounded(out.select("cell_id", "airport_airspace_high", "airport_airspace_med", "airport_airspace_risk"), "airport_airspace_med", "airport_airspace_risk")


@query(f"""WITH {CELLS}, {WINDING}, {FLAGS}, {NEAR}, {LAYERS}, {CORRIDOR}, {PEOPLED}, {CLASSED} SELECT cell_id, city_risk, round(combined, 6) AS airport_risk_combined, pop_class, CASE WHEN abs(combined - 70) < 1e-9 THEN 'edge' ELSE air_class END AS air_class,
CASE WHEN abs(combined - 70) < 1e-9 THEN 'edge' WHEN pop_class = 'Low' AND air_class = 'Low' THEN 'low' WHEN city_risk >= combined THEN 'population' ELSE 'airspace' END AS density_type, round(risk_cost, 6) AS risk_cost, CASE WHEN risk_cost > 70 THEN 'High' WHEN risk_cost > 30 THEN 'Medium' ELSE 'Low' END AS risk_class FROM classed""")
def risk_classes(spark, d):
    """The whole risk grid. Sums that differ from the High limit by rounding alone are named edge in both."""
    out = _risk_cells(spark)
    edge = F.abs(F.col("airport_risk_combined") - 70) < 1e-9
    out = out.withColumns({"air_class": F.when(edge, "edge").otherwise(F.col("air_class")), "density_type": F.when(edge, "edge").otherwise(F.col("density_type"))})
    return rounded(out.select("cell_id", "city_risk", "airport_risk_combined", "pop_class", "air_class", "density_type", "risk_cost", "risk_class"), "airport_risk_combined", "risk_cost")


NOFLY = ((-9790000.0, 5125000.0, 4000.0), (-9760000.0, 5140000.0, 2500.0))


@query(f"""WITH {CELLS}, c AS (SELECT *, ((cell_id * 37) % 90)::DOUBLE AS cost FROM cells), h AS (SELECT DISTINCT cell_id FROM c, (VALUES {", ".join(str(s) for s in NOFLY)}) s(sx, sy, r) WHERE sqrt(power(cx - sx, 2) + power(cy - sy, 2)) <= r),
k AS (SELECT c.cell_id, cost, CASE WHEN cost > 70 THEN 'High' WHEN cost > 30 THEN 'Medium' WHEN h.cell_id IS NOT NULL THEN 'No-Fly' ELSE 'Low' END AS risk_class FROM c LEFT JOIN h USING (cell_id)) SELECT cell_id, risk_class, CASE WHEN risk_class = 'No-Fly' THEN 9999.0 ELSE cost END::DOUBLE AS risk_cost FROM k""")
def no_fly(spark, d):
    cells = G.cells(spark).withColumn("risk_cost", F.pmod(F.col("cell_id") * 37, F.lit(90)).cast("double")).withColumn("risk_class", F.lit("Low"))
    return risk.no_fly(cells, spark.createDataFrame(list(NOFLY), "sx double, sy double, radius_m double")).select("cell_id", "risk_class", "risk_cost")


FEATURES = f"f AS (SELECT o.*, CASE WHEN event_id % 3 = 0 THEN 'No-Fly' ELSE 'Low' END AS risk_class, (event_id % 100)::DOUBLE AS city_risk, CASE WHEN event_id % 5 <> 0 THEN (event_id % 60)::DOUBLE END AS comb, (event_id % 30)::DOUBLE AS corr FROM obs o)"


@query(f"""WITH {OBS}, {FEATURES}, k AS (SELECT *, risk_class = 'No-Fly' AND sqrt(power(radians(41.8 - lat), 2) + power(radians(-87.9 - lon) * cos(radians((lat + 41.8) / 2)), 2)) * 6371000.0 <= 3400 AS demoted, city_risk * 0.9 + coalesce(comb, corr) * 1.4 AS cost FROM f)
SELECT event_id AS feature_id, demoted, CASE WHEN demoted THEN round(cost, 6) ELSE 9999.0 END::DOUBLE AS risk_cost, CASE WHEN demoted THEN CASE WHEN cost > 70 THEN 'High' WHEN cost > 30 THEN 'Medium' ELSE 'Low' END ELSE risk_class END AS risk_class FROM k""")
def demote_no_fly(spark, d):
    e = F.col("event_id")
    f = observed(spark, d).select(e.alias("feature_id"), "lat", "lon", F.when(e % 3 == 0, "No-Fly").otherwise("Low").alias("risk_class"), (e % 100).cast("double").alias("city_risk"), F.when(e % 5 != 0, (e % 60).cast("double")).alias("airport_risk_combined"), (e % 30).cast("double").alias("airport_risk"), F.lit(9999.0).alias("risk_cost"))
    labs = spark.createDataFrame([(41.8, -87.9, 3400.0)], "llat double, llon double, reach_m double")
    return rounded(risk.demote_no_fly(f, labs).select("feature_id", "demoted", "risk_cost", "risk_class"), "risk_cost")


@query(f"WITH {OBS}, {FEATURES}, k AS (SELECT risk_class = 'No-Fly' AND sqrt(power(radians(41.8 - lat), 2) + power(radians(-87.9 - lon) * cos(radians((lat + 41.8) / 2)), 2)) * 6371000.0 <= 3400 AS demoted FROM f) SELECT demoted, count(*) AS n FROM k GROUP BY 1")
def demoted_count(spark, d):
    return demote_no_fly(spark, d).groupBy("demoted").agg(F.count(F.lit(1)).alias("n"))


# ---- normalisation, graph --------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, round(least(1.0, l_extendedprice / (SELECT max(l_extendedprice) FROM lineitem)), 9) AS norm FROM lineitem")
def normalize_max(spark, d):
    return rounded(normalize.normalize(table(spark, d, "lineitem"), "l_extendedprice", "norm").select("l_orderkey", "l_linenumber", "norm"), "norm", digits=9)


@query("WITH v AS (SELECT o_orderkey, o_orderpriority, greatest(0.0, o_totalprice - 100000) AS x FROM orders), s AS (SELECT o_orderpriority, quantile_cont(CASE WHEN x > 0 THEN ln(1 + x) END, 0.95) AS p FROM v GROUP BY 1) SELECT o_orderkey, o_orderpriority, round(power(least(1.0, ln(1 + x) / p), 0.75), 6) AS norm FROM v JOIN s USING (o_orderpriority)")
def normalize_pctl(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", (F.col("o_totalprice") - 100000).alias("x"))
    out = normalize.normalize(o, "x", "norm", percentile=95, log=True, power=0.75, by=["o_orderpriority"])
    return rounded(out.select("o_orderkey", "o_orderpriority", "norm"), "norm")


EDGES = f"edges AS (SELECT a.cell_id AS src, b.cell_id AS dst, sqrt(power(a.cx - b.cx, 2) + power(a.cy - b.cy, 2)) AS distance_m FROM cells a, (VALUES (1, -1), (1, 0), (1, 1), (0, 1)) v(dx, dy), cells b WHERE b.ix = a.ix + v.dx AND b.iy = a.iy + v.dy)"


@query(f"WITH {CELLS}, {EDGES} SELECT src, dst, round(distance_m, 4) AS distance_m FROM edges")
def grid_edges(spark, d):
    return rounded(grids.edges(G.cells(spark)), "distance_m", digits=4)


TERMS = f"n AS (SELECT cell_id, ((cell_id * 13) % 101)::DOUBLE / 100 AS population, ((cell_id * 7) % 97)::DOUBLE / 96 AS airspace, ((cell_id * 3) % 89)::DOUBLE / 88 AS traffic FROM cells), terms AS (SELECT src, dst, distance_m / (SELECT max(distance_m) FROM edges) AS distance, (a.population + b.population) / 2 AS population, (a.airspace + b.airspace) / 2 AS airspace, (a.traffic + b.traffic) / 2 AS traffic FROM edges JOIN n a ON src = a.cell_id JOIN n b ON dst = b.cell_id)"
PRESET = "(VALUES " + ", ".join(f"('{n}', {a}, {b}, {c}, {e})" for n, _, a, b, c, e in K.PRESETS) + ") r(route_name, wd, wp, wa, wt)"


def _weighted(spark):
    c, pick = G.cells(spark), lambda k, m: F.pmod(F.col("cell_id") * k, F.lit(m)).cast("double") / (m - 1)
    nodes = c.select("cell_id", pick(13, 101).alias("population"), pick(7, 97).alias("airspace"), pick(3, 89).alias("traffic"))
    return graph.weigh(graph.edge_terms(grids.edges(c), nodes), graph.presets(spark))


def _cell_sql(lat: float, lon: float) -> str:
    x, y = f"radians({lon!r}) * {geo.MERCATOR_R}", f"ln(tan(pi() / 4 + radians({lat!r}) / 2)) * {geo.MERCATOR_R}"
    return f"least(floor(({x} - ({X0!r}::DOUBLE)) / 500), {NX - 1})::BIGINT * {NY} + least(floor(({y} - ({Y0!r}::DOUBLE)) / 500), {NY - 1})::BIGINT"


HOPS = "hops AS (" + " UNION ALL ".join(f"SELECT route_name, {a} AS a, {b} AS b, wd * distance + wp * population + wa * airspace + wt * traffic AS w FROM terms, {PRESET}" for a, b in (("src", "dst"), ("dst", "src"))) + ")"


@query(f"""WITH RECURSIVE {CELLS}, {EDGES}, {TERMS}, {HOPS}, least_cost(route_name, node, cost) USING KEY (route_name, node) AS (SELECT route_name, {_cell_sql(*K.START)} AS node, 0.0::DOUBLE AS cost FROM {PRESET}
UNION SELECT h.route_name, h.b, min(d.cost + h.w) FROM least_cost d JOIN hops h ON h.route_name = d.route_name AND h.a = d.node LEFT JOIN recurring.least_cost k ON k.route_name = h.route_name AND k.node = h.b GROUP BY h.route_name, h.b, k.cost HAVING k.cost IS NULL OR min(d.cost + h.w) < k.cost)
SELECT route_name, destination, round(cost, 6) AS total_cost FROM least_cost JOIN (VALUES {", ".join(f"('{n}', {_cell_sql(lat, lon)})" for n, lat, lon in K.DESTINATIONS)}) g(destination, node) USING (node)""")
def preset_routes(spark, d):
    """Least costs of every preset to every destination on the study grid, searched as routes are; the SQL relaxes edge by edge."""
    c, pick = G.cells(spark), lambda k, m: F.pmod(F.col("cell_id") * k, F.lit(m)).cast("double") / (m - 1)
    nodes = c.select("cell_id", pick(13, 101).alias("population"), pick(7, 97).alias("airspace"), pick(3, 89).alias("traffic"))
    terms = graph.edge_terms(grids.edges(c), nodes).withColumn("grid", F.lit("study"))
    out = graph.preset_paths(terms, graph.presets(spark), routes.ends(spark, G), ["grid"], G.centres)
    return rounded(out.select("route_name", "destination", "total_cost"), "total_cost")


@query(f"WITH {CELLS}, {EDGES}, {TERMS} SELECT src, dst, route_name, round(wd * distance + wp * population + wa * airspace + wt * traffic, 6) AS weight FROM terms, {PRESET}")
def edge_weights(spark, d):
    return rounded(_weighted(spark).select("src", "dst", "route_name", "weight"), "weight")


@query(f"""WITH p AS (SELECT c_custkey, 41.4::DOUBLE + 0.9::DOUBLE * ((c_custkey * 7919) % 997)::DOUBLE / 997.0::DOUBLE AS lat, -88.5::DOUBLE + 1.1::DOUBLE * ((c_custkey * 104729) % 991)::DOUBLE / 991.0::DOUBLE AS lon FROM customer), {CELLS},
m AS (SELECT *, {MX} AS x, {MY} AS y FROM p), best AS (SELECT c_custkey, arg_min(cell_id, (sqrt(power(cx - x, 2) + power(cy - y, 2)), cell_id)) AS near FROM m, cells GROUP BY 1)
SELECT m.c_custkey, CASE WHEN lon BETWEEN {K.WEST} AND {K.EAST} AND lat BETWEEN {K.SOUTH} AND {K.NORTH} THEN least(floor((x - ({X0!r}::DOUBLE)) / 500), {NX - 1})::BIGINT * {NY} + least(floor((y - ({Y0!r}::DOUBLE)) / 500), {NY - 1})::BIGINT ELSE near END AS cell_id,
lon BETWEEN {K.WEST} AND {K.EAST} AND lat BETWEEN {K.SOUTH} AND {K.NORTH} AS inside FROM m JOIN best USING (c_custkey)""")
def nearest_cell(spark, d):
    """Customers stand for endpoints, some of them outside the grid; the SQL compares each with every cell."""
    return _located(spark, table(spark, d, "customer"))


def _located(spark, customers):
    k = F.col("c_custkey")
    p = customers.select(k, (F.lit(41.4) + F.lit(0.9) * (k * 7919 % 997).cast("double") / 997.0).alias("lat"), (F.lit(-88.5) + F.lit(1.1) * (k * 104729 % 991).cast("double") / 991.0).alias("lon"))
    return grids.locate(p, G.cells(spark), G).select("c_custkey", "cell_id", "inside")


TOWN = "roads AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {w})" for a, b, w in [*K.ROADS, ("Darien", "Burr Ridge", 9)]) + ") e(a, b, w)), e AS (SELECT a, b, min(w) AS w FROM roads GROUP BY 1, 2), hop AS (SELECT a, b, w FROM e UNION ALL SELECT b, a, w FROM e)"


def _roads(spark):
    """The example roads, one of them twice: the lighter counts."""
    return graph.lightest(spark.createDataFrame([*K.ROADS, ("Darien", "Burr Ridge", 9)], "src string, dst string, weight int"))


@query(f"WITH RECURSIVE {TOWN}, walk AS (SELECT 'Bolingbrook' AS node, 0 AS cost UNION SELECT hop.b, walk.cost + hop.w FROM walk JOIN hop ON walk.node = hop.a WHERE walk.cost + hop.w <= 45) SELECT node, min(cost)::DOUBLE AS cost FROM walk GROUP BY 1")
def toy_distances(spark, d):
    """The relational search: least costs from one town to all."""
    return graph.relax(_roads(spark), "Bolingbrook")


@query(f"WITH RECURSIVE {TOWN}, walk AS (SELECT 'Bolingbrook' AS node, 0 AS cost UNION SELECT hop.b, walk.cost + hop.w FROM walk JOIN hop ON walk.node = hop.a WHERE walk.cost + hop.w <= 45) SELECT 'Chicago' AS destination, min(cost)::DOUBLE AS total_cost FROM walk WHERE node = 'Chicago'")
def toy_shortest_path(spark, d):
    ends = spark.createDataFrame([("Bolingbrook", "Chicago", "Chicago")], "start string, goal string, destination string")
    out = graph.shortest_paths(_roads(spark).withColumn("graph", F.lit("roads")), ends, ["graph"], node="string")
    return out.select("destination", "total_cost")


@query(f"WITH {TOWN} SELECT a AS src, b AS dst, w AS weight FROM e")
def parallel_edges(spark, d):
    return _roads(spark)


@query(f"""WITH {TOWN}, pos AS (SELECT * FROM (VALUES {", ".join(f"('{n}', {a}, {b})" for n, a, b in K.TOWNS)}) t(name, lat, lon)), p AS (SELECT e.a AS src, e.b AS dst, e.w, x.lat::DOUBLE AS la, x.lon::DOUBLE AS lo, y.lat::DOUBLE AS lb, y.lon::DOUBLE AS l2 FROM e JOIN pos x ON e.a = x.name JOIN pos y ON e.b = y.name)
SELECT src, dst, round(2 * 3958.8 * asin(sqrt(power(sin(radians(lb - la) / 2), 2) + cos(radians(la)) * cos(radians(lb)) * power(sin(radians(l2 - lo) / 2), 2))), 6) AS miles, w AS weight FROM p""")
def road_lengths(spark, d):
    """Edges with both ends' positions looked up, and the straight miles that a search may use as its bound."""
    t = spark.createDataFrame(K.TOWNS, "name string, lat double, lon double")
    end = lambda n: t.select(F.col("name").alias(n), F.col("lat").alias(f"{n}_lat"), F.col("lon").alias(f"{n}_lon"))
    e = _roads(spark).join(F.broadcast(end("src")), "src").join(F.broadcast(end("dst")), "dst")
    return e.select("src", "dst", F.round(geo.haversine_miles(F.col("src_lat"), F.col("src_lon"), F.col("dst_lat"), F.col("dst_lon")), 6).alias("miles"), "weight")


# paths made of cells that touch: from a start, n steps to the north-east
WALKS = f"paths AS (SELECT DISTINCT (o_custkey % 60) AS path_id, (20 + o_custkey % 60) AS x, (30 + o_custkey % 50) AS y, (3 + o_custkey % 20) AS n FROM orders), first AS (SELECT path_id, min(x) x, min(y) y, min(n) n FROM paths GROUP BY 1), hops AS (SELECT path_id, (x + k) * {NY} + y + k AS a, (x + k + 1) * {NY} + y + k + 1 AS b FROM first, LATERAL (SELECT unnest(range(0, n)) AS k) u)"


def _walks(spark, d):
    k = F.col("o_custkey")
    first = table(spark, d, "orders").groupBy((k % 60).alias("path_id")).agg(F.min(k % 60 + 20).alias("x"), F.min(k % 50 + 30).alias("y"), F.min(k % 20 + 3).alias("n"))
    return first.select("path_id", F.transform(F.sequence(F.lit(0).cast("long"), "n"), lambda i: (F.col("x") + i) * NY + F.col("y") + i).alias("path"))


@query(f"WITH {CELLS}, {EDGES}, {TERMS}, {WALKS} SELECT path_id, round(sum(0.6 * distance + 0.9 * population + 1.4 * airspace + 1.0 * traffic), 6) AS total_cost FROM hops JOIN terms ON src = a AND dst = b GROUP BY 1")
def path_cost(spark, d):
    combined = _weighted(spark).where("route_name = 'combined'")
    return rounded(graph.path_costs(_walks(spark, d), combined, ["path_id"]), "total_cost")


@query(f"WITH {CELLS}, {EDGES}, {TERMS}, {WALKS} SELECT path_id, route_name, round(sum(wd * distance), 6) AS distance_cost, round(sum(wp * population), 6) AS population_cost, round(sum(wa * airspace), 6) AS airspace_cost, round(sum(wt * traffic), 6) AS traffic_cost, round(sum(wd * distance + wp * population + wa * airspace + wt * traffic), 6) AS total_cost FROM hops JOIN terms ON src = a AND dst = b, {PRESET} GROUP BY 1, 2")
def cost_breakdown(spark, d):
    names = graph.presets(spark).select("route_name")
    paths = _walks(spark, d).join(F.broadcast(names))
    out = reports.checked(graph.breakdown(paths, _weighted(spark), ["path_id", "route_name"], ["route_name"]))
    return rounded(out, *[f"{t}_cost" for t in graph.TERMS], "total_cost")


@query(f"WITH {CELLS}, {WALKS}, nodes AS (SELECT path_id, 0 AS k, min(a) AS c FROM hops GROUP BY 1 UNION ALL SELECT path_id, row_number() OVER (PARTITION BY path_id ORDER BY a), b FROM hops) SELECT path_id, count(*) AS n_points, round(min(cx), 4) AS x_first, round(max(cy), 4) AS y_last FROM nodes JOIN cells ON c = cell_id GROUP BY 1")
def polylines(spark, d):
    g = graph.polylines(_walks(spark, d), G.cells(spark), ["path_id"])
    return g.select("path_id", F.size("geometry").cast("long").alias("n_points"), F.round(F.col("geometry")[0]["x"], 4).alias("x_first"), F.round(F.element_at("geometry", -1)["y"], 4).alias("y_last"))


# ---- smoothing -------------------------------------------------------------------------------------------------------

LINES = f"pts AS (SELECT icao24 AS line, row_number() OVER (PARTITION BY icao24 ORDER BY time, event_id) - 1 AS pos, count(*) OVER (PARTITION BY icao24) AS n, {MX} AS x, {MY} AS y FROM obs)"


def _lines(spark, d):
    w = Window.partitionBy("icao24").orderBy("time", "event_id")
    return observed(spark, d).select(F.col("icao24").alias("line"), (F.row_number().over(w) - 1).cast("long").alias("pos"), geo.mercator_x(F.col("lon")).alias("x"), geo.mercator_y(F.col("lat")).alias("y"))


def _spline(c: str) -> str:
    return f"0.5 * (2 * {c}1 + ({c}2 - {c}0) * t + (2 * {c}0 - 5 * {c}1 + 4 * {c}2 - {c}3) * t * t + (3 * {c}1 - {c}0 - 3 * {c}2 + {c}3) * t * t * t)"


@query(f"""WITH {OBS}, {LINES}, w AS (SELECT line, pos, n, x AS x1, y AS y1, coalesce(lag(x) OVER q, x) AS x0, coalesce(lag(y) OVER q, y) AS y0, lead(x) OVER q AS x2, lead(y) OVER q AS y2, coalesce(lead(x, 2) OVER q, lead(x) OVER q) AS x3, coalesce(lead(y, 2) OVER q, lead(y) OVER q) AS y3 FROM pts WINDOW q AS (PARTITION BY line ORDER BY pos)),
s AS (SELECT w.*, k, k / 6.0::DOUBLE AS t FROM w, (VALUES (1), (2), (3), (4), (5), (6)) v(k) WHERE n >= 4 AND pos < n - 1)
SELECT line, (pos * 6 + k)::BIGINT AS pos, round({_spline("x")}, 3) AS x, round({_spline("y")}, 3) AS y FROM s UNION ALL SELECT line, pos, round(x1, 3), round(y1, 3) FROM w WHERE pos = 0 OR n < 4""")
def catmull_rom(spark, d):
    return rounded(smoothing.catmull_rom(_lines(spark, d), ["line"]), "x", "y", digits=3)


@query(f"""WITH {OBS}, {LINES}, w AS (SELECT line, pos, x, y, lag(x) OVER q AS px, lag(y) OVER q AS py, lead(x) OVER q AS nx, lead(y) OVER q AS ny FROM pts WINDOW q AS (PARTITION BY line ORDER BY pos))
SELECT line, pos, round(1.5 * power(degrees(acos(greatest(-1.0, least(1.0, ((x - px) * (nx - x) + (y - py) * (ny - y)) / (sqrt(power(x - px, 2) + power(y - py, 2)) * sqrt(power(nx - x, 2) + power(ny - y, 2))))))) / 180, 2), 6) AS turn_cost FROM w WHERE px IS NOT NULL AND nx IS NOT NULL""")
def turn_penalty(spark, d):
    return _turns(_lines(spark, d))


def _turns(lines):
    w = Window.partitionBy("line").orderBy("pos")
    p = lines.withColumns({f"{c}{k}": F.lag(c, -k).over(w) for c in "xy" for k in (-1, 1)}).where(F.col("x-1").isNotNull() & F.col("x1").isNotNull())
    cost = graph.turn_penalty(F.col("x-1"), F.col("y-1"), F.col("x"), F.col("y"), F.col("x1"), F.col("y1"))
    return p.select("line", "pos", F.round(cost, 6).alias("turn_cost"))


@query(f"""WITH {OBS}, {LINES}, w AS (SELECT *, coalesce(sqrt(power(lead(x) OVER q - x, 2) + power(lead(y) OVER q - y, 2)), 0) AS len, lead(x) OVER q AS x2, lead(y) OVER q AS y2 FROM pts WINDOW q AS (PARTITION BY line ORDER BY pos)),
c AS (SELECT *, sum(len) OVER (PARTITION BY line ORDER BY pos) AS to_d FROM w), k AS (SELECT *, to_d - len AS at_d FROM c), s AS (SELECT k.*, u.i * 7500.0 AS d FROM k, LATERAL (SELECT unnest(range(ceil(at_d / 7500.0)::BIGINT, ceil(to_d / 7500.0)::BIGINT)) AS i) u WHERE x2 IS NOT NULL)
SELECT line, round(d, 3) AS d, round(x + (x2 - x) * ((d - at_d) / len), 3) AS x, round(y + (y2 - y) * ((d - at_d) / len), 3) AS y FROM s UNION ALL SELECT line, round(to_d, 3), round(x, 3), round(y, 3) FROM k WHERE x2 IS NULL""")
def line_sampling(spark, d):
    return rounded(smoothing.sample_lines(_lines(spark, d), ["line"], spacing=7500.0).withColumnRenamed("along", "d"), "d", "x", "y", digits=3)


@query(f"WITH {OBS}, {PLACED}, c AS (SELECT event_id, icao24, cell_id // ({NY} * 40) AS zone, lag(cell_id // ({NY} * 40)) OVER (PARTITION BY icao24 ORDER BY time, event_id) AS before FROM placed) SELECT event_id, icao24, zone FROM c WHERE before IS NULL OR before <> zone")
def consecutive_cells(spark, d):
    o = observed(spark, d)
    zone = F.floor(G.cell_id(F.col("lon"), F.col("lat")) / (NY * 40))
    ordered = o.withColumns({"zone": zone, "o": F.struct("time", "event_id")})
    return graph.cells_deduped(ordered, ["icao24"], "o", cell="zone").select("event_id", "icao24", "zone")


# ---- reports, viewer -------------------------------------------------------------------------------------------------

ROUTE = "routes AS (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'union_station' WHEN 1 THEN 'ohare' ELSE 'midway' END AS destination_slug, CASE o_custkey % 3 WHEN 0 THEN '2026-03-07' WHEN 1 THEN '2026-03-09' ELSE '2026-01-10' END AS dataset_slug, CASE o_orderkey % 5 WHEN 0 THEN 'combined' WHEN 1 THEN 'airspace_only' WHEN 2 THEN 'population_only' WHEN 3 THEN 'distance_only' ELSE 'air_traffic_only' END AS route_name, o_totalprice AS total_cost FROM orders)"


def _routes(spark, d):
    o = table(spark, d, "orders")
    pick = lambda c, values: F.get(F.array(*[F.lit(v) for v in values]), (F.col(c) % len(values)).cast("int"))
    return o.select("o_orderkey", pick("o_orderkey", [x[0] for x in K.DESTINATIONS]).alias("destination_slug"), pick("o_custkey", K.DATASETS[:3]).alias("dataset_slug"), pick("o_orderkey", [p[0] for p in K.PRESETS]).alias("route_name"), F.col("o_totalprice").alias("total_cost"))


@query(f"WITH {ROUTE}, m AS (SELECT destination_slug, dataset_slug, max(total_cost) AS total_cost, count(*) AS path_nodes FROM routes WHERE route_name = 'combined' GROUP BY 1, 2) SELECT destination_slug, CASE destination_slug WHEN 'union_station' THEN 'Chicago' WHEN 'ohare' THEN 'O''Hare' ELSE 'Midway' END AS destination, dataset_slug, strftime(dataset_slug::DATE, '%a %m/%d/%Y') AS dataset_label, total_cost, path_nodes FROM m")
def combined_costs(spark, d):
    best = _routes(spark, d).groupBy("destination_slug", "dataset_slug", "route_name").agg(F.max("total_cost").alias("total_cost"), F.count(F.lit(1)).alias("path_nodes"))
    return reports.combined_costs(best.withColumn("dataset_label", S.dataset_label(F.col("dataset_slug"))))


@query(f"WITH {ROUTE} SELECT dataset_slug, {', '.join(f'''max(total_cost) FILTER (WHERE route_name = '{p[0]}') AS {p[0]}''' for p in K.PRESETS)} FROM routes GROUP BY 1")
def cost_pivot(spark, d):
    best = _routes(spark, d).groupBy("dataset_slug", "route_name").agg(F.max("total_cost").alias("total_cost"))
    return reports.pivoted(reports.complete(best, K.DATASETS[:3], [p[0] for p in K.PRESETS]))


@query(f"WITH {ROUTE}, u AS (SELECT DISTINCT dataset_slug FROM routes), r AS (SELECT *, row_number() OVER (ORDER BY dataset_slug) - 1 AS n FROM u) SELECT dataset_slug, strftime(dataset_slug::DATE, '%a %m/%d/%Y') AS label, CASE n % 6 WHEN 0 THEN '#1f77b4' WHEN 1 THEN '#ff7f0e' WHEN 2 THEN '#2ca02c' WHEN 3 THEN '#d62728' WHEN 4 THEN '#9467bd' ELSE '#8c564b' END AS color FROM r")
def route_labels(spark, d):
    return reports.labelled(_routes(spark, d).select("dataset_slug").distinct())


@query(f"WITH {ROUTE}, k AS (SELECT route_name, o_orderkey, row_number() OVER (PARTITION BY route_name ORDER BY o_orderkey) AS n FROM routes) SELECT route_name AS label, o_orderkey FROM k WHERE n = 1")
def legend(spark, d):
    return reports.legend(_routes(spark, d).select(F.col("route_name").alias("label"), "o_orderkey"), "o_orderkey")


@query(f"""WITH {OBS}, c AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'High' WHEN 1 THEN 'Medium' WHEN 2 THEN 'Low' ELSE 'No-Fly' END AS k, event_id % 20 AS cost FROM obs)
SELECT event_id, CASE k WHEN 'High' THEN '#e31a1c' WHEN 'Medium' THEN '#feb24c' WHEN 'Low' THEN '#31a354' ELSE '#000000' END AS layer_color, CASE WHEN cost >= 12 THEN '#800026' WHEN cost >= 8 THEN '#bd0026' WHEN cost >= 5 THEN '#e31a1c' WHEN cost >= 3 THEN '#fd8d3c' ELSE '#fed976' END AS cost_color, CASE WHEN event_id % 7 = 0 THEN 'n/a' ELSE printf('%.1f', event_id / 4.0 + 0.01) END AS shown FROM c""")
def viewer_colors(spark, d):
    e = F.col("event_id")
    k = F.get(F.array(*[F.lit(x) for x in ("High", "Medium", "Low", "No-Fly")]), (e % 4).cast("int"))
    shown = S.formatted(F.when(e % 7 != 0, e / 4.0 + 0.01))
    return observed(spark, d).select("event_id", S.class_color(k).alias("layer_color"), S.cost_color(e % 20).alias("cost_color"), shown.alias("shown"))


@query(f"WITH {CELLS} SELECT cell_id, round((3 * xmin + 2 * xmax) / 5, 4) AS x, round((3 * ymin + 2 * ymax) / 5, 4) AS y FROM cells")
def ring_centres(spark, d):
    """Viewer centres of cells: the mean of a cell's ring, the closing vertex counted again."""
    return _centres(G.cells(spark))


def _centres(cells):
    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    ring = F.array(p("xmin", "ymin"), p("xmax", "ymin"), p("xmax", "ymax"), p("xmin", "ymax"), p("xmin", "ymin"))
    c = cells.withColumn("ring", ring).withColumn("c", reports.ring_centre())
    return c.select("cell_id", F.round("c.x", 4).alias("x"), F.round("c.y", 4).alias("y"))


@query("WITH f AS (SELECT '/data/opensky_' || CASE WHEN o_orderkey % 4 = 0 THEN 'x' ELSE strftime(o_orderdate, '%Y-%m-%d') END || '_' || o_orderkey || '.csv' AS path, CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate ELSE date_trunc('day', o_orderdate) END AS k FROM orders) SELECT arg_max(path, (k, path)) AS path FROM f")
def latest_file(spark, d):
    o = table(spark, d, "orders")
    day = F.when(F.col("o_orderkey") % 4 == 0, "x").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    files = o.select(F.concat(F.lit("/data/opensky_"), day, F.lit("_"), F.col("o_orderkey").cast("string"), F.lit(".csv")).alias("path"), F.col("o_orderdate").alias("modificationTime"))
    return readers.newest_of(files)


# ---- routing on the study grid: rows only, held against properties in the tests ---------------------------------------


@query()
def grid_routes(spark, d):
    """Least-cost routes per traffic date, preset and destination on the study grid."""
    return routes.grid_routes(spark, observed(spark, d), G).drop("path")


@query()
def turn_penalty_routes(spark, d):
    """The combined preset with turn penalties, splined and scored again on the base weights."""
    return routes.smoothed_routes(spark, observed(spark, d), G)
