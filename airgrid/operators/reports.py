"""Route reports: configured orders, pivots, checks and features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airgrid.functions import scalars as S
from airgrid.functions.names import free
from airgrid.sources import constants as K

COMBINED = ("destination_slug", "destination", "dataset_slug", "dataset_label", "total_cost", "path_nodes")
SMOOTHED = (*COMBINED, "final_combined_cost", "final_path_nodes")


def _place(column: str, order: list[str]):
    return F.array_position(F.array(*[F.lit(x) for x in order]), F.col(column))


def combined_costs(routes: DataFrame, destinations: list[str] | None = None, datasets: list[str] | None = None) -> DataFrame:
    """Rows of the combined preset with display names, in the configured order of destinations, then datasets."""
    rows = routes.where("route_name = 'combined'").withColumn("destination", S.display_name(F.col("destination_slug")))
    order = [_place("destination_slug", destinations or [d[0] for d in K.DESTINATIONS]), _place("dataset_slug", datasets or K.DATASETS)]
    return rows.select(*COMBINED, *[c for c in SMOOTHED[len(COMBINED) :] if c in rows.columns]).orderBy(*order)


def pivoted(routes: DataFrame, names: list[str] | None = None) -> DataFrame:
    """A row per dataset, a column per preset. Presets are configuration, so the pivot knows its columns."""
    return routes.groupBy("dataset_slug").pivot("route_name", names or [p[0] for p in K.PRESETS]).agg(F.max("total_cost"))


def complete(routes: DataFrame, datasets: list[str], names: list[str]) -> DataFrame:
    """routes, or an error that names what is missing: a chart must not show a gap as zero."""
    have = {(r["dataset_slug"], r["route_name"]) for r in routes.select("dataset_slug", "route_name").distinct().limit(len(datasets) * len(names) * 4).collect()}
    lost = [(d, n) for d in datasets for n in names if (d, n) not in have]
    if lost:
        raise ValueError(f"missing routes: {lost}")
    return routes


def checked(parts: DataFrame, total: str = "total_cost", tolerance: float = 1e-9) -> DataFrame:
    """parts with an error where the four costs do not sum to the total."""
    s = sum((F.col(f"{t}_cost") for t in ("population", "airspace", "traffic")), F.col("distance_cost"))
    off = F.abs(s - F.col(total)) > F.greatest(F.lit(tolerance), F.abs(F.col(total)) * tolerance)
    return parts.withColumn(total, F.when(off, F.raise_error(F.lit("the parts do not sum to the total")).cast("double")).otherwise(F.col(total)))


def labelled(routes: DataFrame) -> DataFrame:
    """Label and palette colour by place in label order."""
    place = F.row_number().over(Window.orderBy("dataset_slug")) - 1  # one row per dataset
    return routes.withColumns({"label": S.dataset_label(F.col("dataset_slug")), "color": S.palette_color(place)})


def features(routes: DataFrame, geometry: str = "geometry") -> DataFrame:
    """feature: GeoJSON text of each row, its line in lon/lat, everything else as properties."""
    line = F.transform(geometry, lambda p: F.array(p["x"], p["y"]))
    rest = F.struct(*[c for c in routes.columns if c != geometry])
    return routes.select(F.to_json(F.struct(F.lit("Feature").alias("type"), rest.alias("properties"), F.struct(F.lit("LineString").alias("type"), line.alias("coordinates")).alias("geometry"))).alias("feature"))


def ring_centre(ring: str = "ring"):
    """Mean of a ring's vertices, the closing one counted with the others."""
    mean = lambda c: F.aggregate(F.transform(ring, lambda p: p[c]), F.lit(0.0), lambda s, v: s + v) / F.size(ring)
    return F.struct(mean("x").alias("x"), mean("y").alias("y"))


def legend(rows: DataFrame, order: str, key: str = "label") -> DataFrame:
    """Rows with the first of each label, in order."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(order))
    n = free("place", rows)
    return rows.withColumn(n, first).where(F.col(n) == 1).drop(n)
