"""Whole plans: the risk grid, and routes by traffic date, preset and destination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airgrid.functions import geo
from airgrid.functions import scalars as S
from airgrid.operators import airspace, graph, normalize, risk, smoothing, traffic
from airgrid.operators import grid as grids
from airgrid.sources import constants as K


def risk_cells(spark: SparkSession, grid: grids.Grid, density: Column | DataFrame | None = None) -> DataFrame:
    """The study grid with every risk and class. density: a column over cells, a table (cell_id, density_p_km2), or none."""
    cells = grid.cells(spark)
    named = airspace.rings()
    flagged = airspace.memberships(cells, airspace.ring_segments(spark, named), named)
    near = airspace.boundary_distances(cells, airspace.boundary_segments(spark, named), within=1500.0)
    out = airspace.shelf_risk(flagged, near).join(airspace.corridor_risk(cells, airspace.airports(spark)), "cell_id")
    if isinstance(density, DataFrame):
        out = out.join(density, "cell_id", "left")
    else:
        out = out.withColumn("density_p_km2", F.lit(0.0) if density is None else density)
    return risk.combine(out)


def cells_in_polygons(cells: DataFrame, polygons: DataFrame, side: float = 10_000.0) -> DataFrame:
    """cell_id with the one polygon (polygon_id, ring of x, y) that holds its centre. Polygons and centres meet by squares of
    `side`, an equi-join; crossings are counted within. A centre in two polygons is an error."""
    square = lambda c: F.floor(F.col(c) / side)
    lo = lambda c, f: f(F.transform("ring", lambda p: p[c]))
    boxes = polygons.withColumns({f"{n}{c}": lo(c, f) for c in "xy" for n, f in (("lo", F.array_min), ("hi", F.array_max))})
    for c in "xy":
        boxes = boxes.withColumn(f"s{c}", F.explode(F.sequence(square(f"lo{c}"), square(f"hi{c}"))))
    placed = cells.select("cell_id", "cx", "cy", square("cx").alias("sx"), square("cy").alias("sy")).join(boxes, ["sx", "sy"])
    placed = placed.where(F.col("cx").between(F.col("lox"), F.col("hix")) & F.col("cy").between(F.col("loy"), F.col("hiy")))
    pairs = F.arrays_zip(F.col("ring").alias("a"), F.concat(F.slice("ring", 2, F.size("ring")), F.slice("ring", 1, 1)).alias("b"))

    def crossing(e):
        a, b = e["a"], e["b"]
        return ((a["y"] <= F.col("cy")) != (b["y"] <= F.col("cy"))) & (a["x"] + (F.col("cy") - a["y"]) * (b["x"] - a["x"]) / (b["y"] - a["y"]) > F.col("cx"))

    held = placed.where(F.size(F.filter(pairs, crossing)) % 2 == 1).groupBy("cell_id").agg(F.count(F.lit(1)).alias("n"), F.first("polygon_id").alias("polygon_id"))
    one = F.when(F.col("n") > 1, F.raise_error(F.lit("a cell lies in two polygons")).cast(held.schema["polygon_id"].dataType)).otherwise(F.col("polygon_id"))
    return held.select("cell_id", one.alias("polygon_id"))


def dated(obs: DataFrame, datasets: list[str]) -> DataFrame:
    """obs with a dataset per row; where they have none yet, by day of observation in turn, a stand-in for one export per date."""
    if "dataset_slug" in obs.columns:
        return obs.where(F.col("dataset_slug").isin(*datasets))
    names = F.array(*[F.lit(x) for x in datasets])
    return obs.withColumn("dataset_slug", F.get(names, F.pmod(F.floor(F.col("time") / 86400), F.lit(len(datasets))).cast("int")))


def dated_terms(spark: SparkSession, obs: DataFrame, grid: grids.Grid, datasets: list[str]) -> DataFrame:
    """Edges of the grid by dataset_slug with their terms, once whatever the number of presets."""
    graph.checkpoints(spark)
    # a row per cell, and per cell and date, read several times by the scales: observations are scanned once
    cells = risk_cells(spark, grid, F.pmod(F.col("cell_id") * 37, F.lit(1500)).cast("double")).checkpoint()
    base = normalize.normalize(cells, "city_risk", "population")
    base = normalize.normalize(base, "airport_risk_combined", "airspace", percentile=99, power=0.75).select("cell_id", "cx", "cy", "ix", "iy", "population", "airspace")
    counted = traffic.counts(dated(obs, datasets), base, grid, by=["dataset_slug"]).checkpoint()
    nodes = normalize.normalize(counted, "traffic", "traffic_norm", percentile=95, log=True, power=0.75, by=["dataset_slug"]).drop("traffic").withColumnRenamed("traffic_norm", "traffic")
    return graph.edge_terms(grids.edges(grid.cells(spark)), nodes, by=["dataset_slug"])


def weighted_edges(spark: SparkSession, obs: DataFrame, grid: grids.Grid, presets: DataFrame, datasets: list[str]) -> DataFrame:
    """Edges of the grid by dataset_slug and route_name, with terms and weight."""
    return graph.weigh(dated_terms(spark, obs, grid, datasets), presets)


def ends(spark: SparkSession, grid: grids.Grid) -> DataFrame:
    points = spark.createDataFrame([("start", *K.START), *K.DESTINATIONS], "destination string, lat double, lon double")
    cell = grid.cell_id(F.col("lon"), F.col("lat"))
    at = points.select("destination", cell.alias("cell"))
    start = at.where("destination = 'start'").select(F.col("cell").alias("start"))
    return at.where("destination <> 'start'").join(F.broadcast(start)).select("start", F.col("cell").alias("goal"), "destination")


def grid_routes(spark: SparkSession, obs: DataFrame, grid: grids.Grid, datasets: list[str] | None = None) -> DataFrame:
    """dataset_slug, route_name, destination, total_cost, path_nodes, path: one task per date searches for every preset and
    destination."""
    terms = dated_terms(spark, obs, grid, datasets or K.DATASETS)
    out = graph.preset_paths(terms, graph.presets(spark), ends(spark, grid), ["dataset_slug"], grid.centres)
    return out.withColumns({"path_nodes": F.size("path").cast("long"), "dataset_label": S.dataset_label(F.col("dataset_slug"))})


def smoothed_routes(spark: SparkSession, obs: DataFrame, grid: grids.Grid, datasets: list[str] | None = None, turn_weight: float = 1.5, samples: int = 6) -> DataFrame:
    """Three ways to smooth the combined routes: turn penalties, a spline, both; with the search's cost and the base weights'."""
    keys = ["dataset_slug", "destination", "technique"]
    graph.checkpoints(spark)
    combined = weighted_edges(spark, obs, grid, graph.presets(spark).where("route_name = 'combined'"), datasets or K.DATASETS).select("dataset_slug", "src", "dst", "weight")
    combined = combined.checkpoint(False)  # read by both searches and the scoring
    cells = grid.cells(spark)
    end = lambda n, k: cells.select(F.col("cell_id").alias(n), F.col("cx").alias(f"x{k}"), F.col("cy").alias(f"y{k}"))
    sited = combined.join(end("src", 1), "src").join(end("dst", 2), "dst")
    named = lambda df, *names: df.withColumn("technique", F.explode(F.array(*[F.lit(n) for n in names])))
    turned = named(graph.turn_paths(sited, ends(spark, grid), ["dataset_slug"], turn_weight), "turn_penalty", "turn_penalty_spline")
    every = turned.unionByName(named(graph.shortest_paths(combined, ends(spark, grid), ["dataset_slug"]), "spline")).checkpoint()
    points = every.select(*keys, F.posexplode("path").alias("pos", "cell_id")).join(cells.select("cell_id", "cx", "cy"), "cell_id")
    degrees = points.select(*keys, "pos", geo.mercator_lon(F.col("cx")).alias("x"), geo.mercator_lat(F.col("cy")).alias("y"))
    straight = degrees.where("technique = 'turn_penalty'").withColumn("pos", F.col("pos").cast("long"))
    lines = straight.unionByName(smoothing.catmull_rom(degrees.where("technique <> 'turn_penalty'"), keys, samples=samples))
    metres = lines.select(*keys, "pos", geo.mercator_x(F.col("x")).alias("x"), geo.mercator_y(F.col("y")).alias("y"))
    scored = smoothing.rescore(metres, keys, grid, combined, ["dataset_slug"])
    return every.select(*keys, "total_cost", F.size("path").cast("long").alias("path_nodes")).join(scored, keys)


def route_lines(spark: SparkSession, routes: DataFrame, grid: grids.Grid) -> DataFrame:
    """Routes (with path) with their lines in lon/lat."""
    lines = graph.polylines(routes, grid.cells(spark), ["dataset_slug", "route_name", "destination"])
    lines = lines.withColumn("geometry", geo.project(F.col("geometry"), inverse=True))
    return routes.drop("path").join(lines, ["dataset_slug", "route_name", "destination"])


def route_features(spark: SparkSession, routes: DataFrame, grid: grids.Grid) -> DataFrame:
    """Routes (with path) as GeoJSON features in lon/lat."""
    from airgrid.operators import reports

    return reports.features(route_lines(spark, routes, grid))


def ordered(routes: DataFrame) -> DataFrame:
    """Routes by destination and date, as a report lists them."""
    return routes.orderBy("destination", "dataset_slug", "route_name")
