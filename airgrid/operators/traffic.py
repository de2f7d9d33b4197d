"""Traffic measures of observations (time, icao24, lat, lon, baroaltitude)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airgrid.functions import geo
from airgrid.functions.names import free
from airgrid.functions.scalars import number
from airgrid.operators.grid import Grid

HORIZONS = (1, 3, 6, 9, 12, 24)
#: A grid of at most so many cells is broadcast.
MAX_CELLS = 500_000

SCAN = """
SELECT time, lat, lon, baroaltitude, icao24
FROM {table}
WHERE hour BETWEEN :start_epoch AND :end_epoch
  AND lat BETWEEN :south AND :north AND lon BETWEEN :west AND :east
  AND baroaltitude < :max_altitude_m
  AND lat IS NOT NULL AND lon IS NOT NULL AND baroaltitude IS NOT NULL
  AND time % :sample_seconds = 0
ORDER BY time
"""


def scan(spark: SparkSession, vectors: DataFrame, **args) -> DataFrame:
    """State vectors of an inclusive range of hour buckets, a box, below an altitude, sampled by time; parameters are bound, not
    spliced. On a table partitioned by hour the range prunes."""
    return spark.sql(SCAN.replace("{table}", "{vectors}"), args=args, vectors=vectors)


def cleaned(raw: DataFrame, required: tuple[str, ...] = ("time", "lat", "lon", "baroaltitude", "icao24")) -> DataFrame:
    """Text columns to numbers; rows that miss a required one go."""
    casts = {c: number(c) for c in required if c != "icao24"}
    out = raw.select(*[(casts[c] if c in casts else F.col(c)).alias(c) for c in required]).na.drop(subset=list(required))
    return out.withColumn("time", F.col("time").cast("long")) if "time" in required else out


def counts(obs: DataFrame, cells: DataFrame, grid: Grid, by: list[str] | None = None) -> DataFrame:
    """Observations per cell (and per group of by), 0 where there are none. No join of points with cells: the cell is arithmetic,
    partial counts go before the exchange, and the grid is joined to counts."""
    by = by or []
    seen = obs.withColumn("cell_id", grid.cell_id(F.col("lon"), F.col("lat"))).where("cell_id IS NOT NULL").groupBy(*by, "cell_id").agg(F.count(F.lit(1)).alias("traffic"))
    few = grid.shape[0] * grid.shape[1] <= MAX_CELLS
    base = obs.select(*by).distinct().join(F.broadcast(cells) if few else cells) if by else cells
    return base.join(seen, [*by, "cell_id"], "left").withColumn("traffic", F.coalesce("traffic", F.lit(0).cast("long")))


def densities(counted: DataFrame) -> DataFrame:
    """With traffic_density: observations per km² of the clipped cell."""
    return counted.withColumn("traffic_density", F.col("traffic") / (F.greatest(F.col("area_m2"), F.lit(1e-9)) / 1e6))


def labelled(dense: DataFrame) -> DataFrame:
    """With traffic_density_type: air_traffic where the density is over 0, else none."""
    return dense.withColumn("traffic_density_type", F.when(F.col("traffic_density") > 0, "air_traffic").otherwise("none"))


def _spans(hours: tuple[int, ...]):
    return F.array(*[F.lit(h) for h in sorted(hours)])


def opened(obs: DataFrame, hours: tuple[int, ...] = HORIZONS, unit: int = 3600) -> DataFrame:
    """Observations with hours, the first horizon that holds them; those beyond all go. Horizons are cumulative, from the first time
    on, which is one row."""
    t0 = free("t0", obs)
    first = F.broadcast(obs.agg(F.min("time").alias(t0)))
    held = F.filter(_spans(hours), lambda h: F.col("time") < F.col(t0) + h * unit)
    return obs.join(first).withColumn("hours", F.get(held, F.lit(0))).where("hours IS NOT NULL").drop(t0)


def carried(rows: DataFrame, hours: tuple[int, ...] = HORIZONS) -> DataFrame:
    """Rows that begin with a horizon, once for each horizon from it on. Whatever can be counted, thinned or made distinct is so before
    this, so that few rows are multiplied."""
    return rows.withColumn("hours", F.explode(F.filter(_spans(hours), lambda h: h >= F.col("hours"))))


def anchored(obs: DataFrame, hours: tuple[int, ...] = HORIZONS, unit: int = 3600) -> DataFrame:
    """A row per observation and horizon that holds it, without a join on ranges."""
    return carried(opened(obs, hours, unit), hours)


def aircraft_heatmap(obs: DataFrame, grid: Grid, hours=HORIZONS, unit: int = 3600, least: int = 2) -> DataFrame:
    """Distinct aircraft per cell and horizon, cells of any index, with the cell's centre and the share of the horizon's top. An aircraft
    counts from the first horizon that holds it in the cell."""
    x0, y0, *_ = grid.corners
    ix, iy = grid.index(geo.mercator_x(F.col("lon")), geo.mercator_y(F.col("lat")))
    seen = opened(obs.select("time", "icao24", ix.alias("ix"), iy.alias("iy")), hours, unit).where("icao24 IS NOT NULL")
    new = seen.groupBy("ix", "iy", "icao24").agg(F.min("hours").alias("hours")).groupBy("hours", "ix", "iy").agg(F.count(F.lit(1)).alias("new"))
    n = carried(new, hours).groupBy("hours", "ix", "iy").agg(F.sum("new").alias("count")).where(F.col("count") >= least)
    top = n.groupBy("hours").agg(F.max("count").alias("top"))
    out = n.join(F.broadcast(top), "hours")  # a row per horizon
    centre = {"lat": geo.mercator_lat((F.col("iy") + 0.5) * grid.cell + y0), "lon": geo.mercator_lon((F.col("ix") + 0.5) * grid.cell + x0)}
    return out.withColumns({**centre, "intensity": F.col("count") / F.col("top")}).drop("top")


def histogram2d(obs: DataFrame, bins: int = 180, x: str = "lon", y: str = "lat") -> DataFrame:
    """Counts of equal bins between the data's least and largest, the last bins closed; empty bins are left out."""
    ends = F.broadcast(obs.agg(*[f(c).alias(f"_{n}{c}") for c in (x, y) for n, f in (("lo", F.min), ("hi", F.max))]))
    place = lambda c: F.least(F.lit(bins - 1), F.floor((F.col(c) - F.col(f"_lo{c}")) / (F.col(f"_hi{c}") - F.col(f"_lo{c}")) * bins))
    same = lambda c: F.when(F.col(f"_hi{c}") > F.col(f"_lo{c}"), place(c)).otherwise(F.lit(0))
    return obs.join(ends).select(same(x).alias("bx"), same(y).alias("by")).groupBy("bx", "by").agg(F.count(F.lit(1)).alias("n"))


def summary(obs: DataFrame) -> DataFrame:
    return obs.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("icao24").alias("n_flights"), F.min("time").alias("first_time"), F.max("time").alias("last_time"), F.min("lat").alias("south"), F.max("lat").alias("north"), F.min("lon").alias("west"), F.max("lon").alias("east"))
