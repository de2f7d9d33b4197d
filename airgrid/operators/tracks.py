"""Trajectories: gap filling, 3D bins, tracks, arrows and origins. Ties in time are broken by the columns in `order`."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airgrid.functions import scalars as S
from airgrid.operators.traffic import HORIZONS, carried, opened


def _window(order: tuple[str, ...]):
    return Window.partitionBy("icao24").orderBy(*order)


def with_altitude(obs: DataFrame, cap_ft: float | None = None) -> DataFrame:
    """altitude_agl_ft, and rows up to an inclusive cap (none if it is not positive)."""
    out = obs.withColumn("altitude_agl_ft", S.altitude_agl_ft(F.col("baroaltitude")))
    return out if not cap_ft or cap_ft <= 0 else out.where(F.col("altitude_agl_ft") <= cap_ft)


def interpolate(obs: DataFrame, step: int = 5, max_gap: int = 180, order: tuple[str, ...] = ("time",), columns: tuple[str, ...] = ("lat", "lon", "altitude_agl_ft")) -> DataFrame:
    """All rows, and points every step seconds on the line to the next row where the gap is over step and at most max_gap. A step
    or gap that is not positive turns filling off."""
    base = obs.select("icao24", "time", *columns)
    if step <= 0 or max_gap <= 0:
        return base
    w = _window(order)
    ahead = obs.select("icao24", "time", *columns, F.lead("time").over(w).alias("_t"), *[F.lead(c).over(w).alias(f"_{c}") for c in columns])
    gap = F.col("_t") - F.col("time")
    fills = F.when((gap > step) & (gap <= max_gap), F.sequence(F.lit(0).cast("long"), gap - 1, F.lit(step).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    rows = ahead.withColumn("_s", F.explode(fills))
    part = F.col("_s") / (F.col("_t") - F.col("time"))
    at = {c: F.when(F.col("_s") == 0, F.col(c)).otherwise(F.col(c) + (F.col(f"_{c}") - F.col(c)) * part) for c in columns}
    return rows.select("icao24", (F.col("time") + F.col("_s")).alias("time"), *[v.alias(c) for c, v in at.items()])


def density3d(obs: DataFrame, hours=HORIZONS, unit: int = 3600, step_deg: float = 0.01, step_ft: float = 1000.0, least: int = 2) -> DataFrame:
    """Observations per latitude, longitude and altitude bin and horizon, bins of at least `least`; cost counts the bin's whole
    column, dropped bins included. Keys are integers: half-even for degrees, floor for feet; sizes are multiplied in last. Rows are counted
    where their first horizon is, and the counts carried to the later ones."""
    keyed = opened(obs, hours, unit).select("hours", F.rint(F.col("lat") / step_deg).cast("long").alias("lat_i"), F.rint(F.col("lon") / step_deg).cast("long").alias("lon_i"), F.floor(F.col("altitude_agl_ft") / step_ft).alias("alt_i"))
    key = ["hours", "lat_i", "lon_i", "alt_i"]
    bins = carried(keyed.groupBy(*key).agg(F.count(F.lit(1)).alias("new")), hours).groupBy(*key).agg(F.sum("new").alias("count"))
    bins = bins.withColumn("cost", F.sum("count").over(Window.partitionBy("hours", "lat_i", "lon_i"))).where(F.col("count") >= least)
    bottom = F.col("alt_i") * step_ft
    # the radius follows from the steps alone
    radius = max(150, int(step_deg * 111000 * 0.45))
    return bins.withColumns({"lat": F.col("lat_i") * step_deg, "lon": F.col("lon_i") * step_deg, "altitude_bottom_ft": bottom, "altitude_top_ft": bottom + step_ft, "altitude_mid_ft": bottom + step_ft / 2, "radius_m": F.lit(radius)})


def by_count(bins: DataFrame) -> DataFrame:
    """Bins of each horizon from the fullest on, equal ones by place."""
    return bins.orderBy("hours", F.desc("count"), "lat_i", "lon_i", "alt_i")


def flatten_costs(bins: DataFrame) -> DataFrame:
    """The export: one table over horizons, hours as text."""
    return bins.select(F.col("hours").cast("string").alias("hours"), "lat", "lon", "altitude_bottom_ft", "altitude_top_ft", "altitude_mid_ft", F.col("count").alias("observation_count"), "cost")


def under_ceiling(bins: DataFrame, column: str, ceiling_ft: float) -> DataFrame:
    """Rows whose altitude column (a bin's top, a track's largest, an arrow's target, an origin's own) is at most the ceiling."""
    return bins.where(F.col(column) <= ceiling_ft)


def stride(obs: DataFrame, every: int, order: tuple[str, ...] = ("time",)) -> DataFrame:
    """Every n-th row of each aircraft from its first, with its 0-based place `n`."""
    return obs.withColumn("n", F.row_number().over(_window(order)) - 1).where(F.col("n") % max(1, every) == 0)


def tracks(obs: DataFrame, every: int = 3, hours=HORIZONS, unit: int = 3600, order: tuple[str, ...] = ("time",)) -> DataFrame:
    """Per horizon and aircraft: path in order, samples, mean and largest altitude, first position, colour; of sampled rows, two
    at least. A track is a row, so its length is one aircraft's within a horizon. order begins with time: horizons are then prefixes of
    one order, so rows are numbered and thinned once, before they are carried to the later horizons."""
    if order[0] != "time":
        raise ValueError("order must begin with time")
    sampled = carried(stride(opened(obs, hours, unit), every, order), hours)
    point = F.struct(*order, F.col("lon"), F.col("lat"), F.col("altitude_agl_ft").alias("alt"))
    rows = sampled.groupBy("hours", "icao24").agg(F.sort_array(F.collect_list(point)).alias("points"), F.count(F.lit(1)).alias("samples"), F.avg("altitude_agl_ft").alias("mean_altitude_ft"), F.max("altitude_agl_ft").alias("max_altitude_ft"))
    rows = rows.where(F.col("samples") >= 2)
    path = F.transform("points", lambda p: F.array(p["lon"], p["lat"], p["alt"]))
    return rows.select("hours", "icao24", path.alias("path"), "samples", "mean_altitude_ft", "max_altitude_ft", S.band_color(F.col("mean_altitude_ft")).alias("color"))


def arrows(tracked: DataFrame, every: int = 6) -> DataFrame:
    """Segments ending at places 1, 1 + n, 1 + 2n... of each track."""
    rows = tracked.select("*", F.posexplode("path").alias("pos", "target")).where((F.col("pos") >= 1) & ((F.col("pos") - 1) % max(1, every) == 0))
    return rows.select("hours", "icao24", "pos", F.get("path", F.col("pos") - 1).alias("source"), "target", "color", "samples", "mean_altitude_ft")


def origins(tracked: DataFrame, radius_m: float = 250.0) -> DataFrame:
    return tracked.select("hours", "icao24", F.get("path", F.lit(0)).alias("position"), F.get(F.get("path", F.lit(0)), F.lit(2)).alias("altitude_ft"), F.lit(radius_m).alias("radius_m"))
