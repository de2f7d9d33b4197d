"""The jobs a user runs, with their parameters: ``python -m airgrid.jobs routes|density|heatmap|export --help``."""

from __future__ import annotations

import argparse
import functools
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airgrid.functions import scalars as S
from airgrid.operators import grid as grids
from airgrid.operators import reports, tracks, traffic
from airgrid.plans import routes
from airgrid.sinks import writers
from airgrid.sources import constants as K
from airgrid.sources import readers


def _observed(spark: SparkSession, path: str, required: tuple[str, ...]) -> DataFrame:
    return readers.require_rows(traffic.cleaned(readers.state_vectors(spark, path), required), path)


def run_routes(spark: SparkSession, a: argparse.Namespace) -> None:
    """Least-cost routes by every export's date (in its name), preset and destination: features, the table of costs, a page."""
    dates = {path: re.search(r"\d{4}-\d{2}-\d{2}", path.rstrip("/").rsplit("/", 1)[-1]) for path in a.traffic}
    if unnamed := [path for path, date in dates.items() if not date]:
        raise ValueError(f"no date in the name: {unnamed}")
    obs = [_observed(spark, path, ("lat", "lon")).withColumn("dataset_slug", F.lit(date[0])) for path, date in dates.items()]
    found = routes.grid_routes(spark, functools.reduce(DataFrame.unionByName, obs), grids.Grid(cell=a.cell), sorted({date[0] for date in dates.values()}))
    found.write.mode("errorifexists").parquet(f"{a.out}/routes")
    found = spark.read.parquet(f"{a.out}/routes")
    writers.write_features(routes.route_features(spark, found, grids.Grid(cell=a.cell)), f"{a.out}/features")
    writers.write_csv(reports.combined_costs(found.withColumnRenamed("destination", "destination_slug")), f"{a.out}/costs", single=True)
    lines = routes.route_lines(spark, found, grids.Grid(cell=a.cell))
    writers.write_text(spark, f"{a.out}/routes.html", writers.map_page("Routes", writers.route_layers(lines)))


def run_density(spark: SparkSession, a: argparse.Namespace) -> None:
    """Costs of bins in three dimensions, gaps filled, over cumulative horizons, and the tracks' summary."""
    obs = tracks.with_altitude(_observed(spark, a.traffic, ("time", "lat", "lon", "baroaltitude", "icao24")), a.cap)
    bins = tracks.density3d(tracks.interpolate(obs, a.step, a.gap), step_deg=a.degrees, step_ft=a.feet, least=a.least)
    writers.write_csv(tracks.flatten_costs(bins), f"{a.out}/costs")
    tracks.tracks(obs, a.every).write.mode("errorifexists").parquet(f"{a.out}/tracks")


def run_heatmap(spark: SparkSession, a: argparse.Namespace) -> None:
    """Distinct aircraft by cell and horizon, as a table and a page with a slider."""
    heat = traffic.aircraft_heatmap(_observed(spark, a.traffic, ("time", "lat", "lon", "icao24")), grids.Grid(cell=a.cell), least=a.least)
    writers.write_csv(heat, f"{a.out}/heat")
    writers.write_text(spark, f"{a.out}/heat.html", writers.map_page("Aircraft", writers.heat_layers(heat)))


def run_export(spark: SparkSession, a: argparse.Namespace) -> None:
    """A local day's state vectors of a box, sampled by time, as one CSV folder."""
    start, end = spark.range(1).select(*S.day_window(F.to_date(F.lit(a.day)), a.zone)).first()
    vectors = spark.read.parquet(a.vectors)
    out = traffic.scan(spark, vectors, start_epoch=start - start % 3600, end_epoch=end, south=a.south, north=a.north, west=a.west, east=a.east, max_altitude_m=a.ceiling, sample_seconds=a.sample)
    writers.write_csv(out, writers.free_path(spark, f"{a.out}/opensky_{a.day}"))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="airgrid.jobs")
    jobs = p.add_subparsers(dest="job", required=True)

    def job(name: str, run, **more):
        j = jobs.add_parser(name, help=run.__doc__)
        j.add_argument("--out", required=True)
        for k, v in more.items():
            kind = {"type": str, "nargs": "+"} if isinstance(v, list) else {"type": str if v is None else type(v)}
            j.add_argument(f"--{k}", default=v, required=v is None or v == [], **kind)
        j.set_defaults(run=run)

    job("routes", run_routes, traffic=[], cell=K.CELL_M)
    job("density", run_density, traffic=None, cap=0.0, step=5, gap=180, degrees=0.01, feet=1000.0, least=2, every=3)
    job("heatmap", run_heatmap, traffic=None, cell=K.CELL_M, least=2)
    job("export", run_export, vectors=None, day=None, zone="America/Chicago", south=K.SOUTH, north=K.NORTH, west=K.WEST, east=K.EAST, ceiling=3048.0, sample=1)
    return p


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    a.run(SparkSession.builder.appName(f"airgrid-{a.job}").getOrCreate(), a)


if __name__ == "__main__":
    main()
