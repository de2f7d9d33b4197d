"""The study grid: cells by arithmetic, so membership and adjacency are equi-joins on integers."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from airgrid.functions import geo
from airgrid.functions.names import free
from airgrid.sources import constants as K


@dataclass(frozen=True)
class Grid:
    """Boxes of cell metres (Mercator) from the south-west corner, the last column and row clipped to the bounds."""

    west: float = K.WEST
    south: float = K.SOUTH
    east: float = K.EAST
    north: float = K.NORTH
    cell: float = K.CELL_M

    @property
    def corners(self) -> tuple[float, float, float, float]:
        return (*geo.xy(self.south, self.west), *geo.xy(self.north, self.east))

    @property
    def shape(self) -> tuple[int, int]:
        x0, y0, x1, y1 = self.corners
        return math.ceil((x1 - x0) / self.cell), math.ceil((y1 - y0) / self.cell)

    def index(self, x: Column, y: Column) -> tuple[Column, Column]:
        x0, y0, *_ = self.corners
        return F.floor((x - x0) / self.cell), F.floor((y - y0) / self.cell)

    def cell_id(self, lon: Column, lat: Column) -> Column:
        """The cell of a point within the bounds (both ends included), else null."""
        nx, ny = self.shape
        ix, iy = self.index(geo.mercator_x(lon), geo.mercator_y(lat))
        inside = lon.between(self.west, self.east) & lat.between(self.south, self.north)
        return F.when(inside, F.least(ix, F.lit(nx - 1)) * ny + F.least(iy, F.lit(ny - 1)))

    def cells(self, spark: SparkSession) -> DataFrame:
        x0, y0, x1, y1 = self.corners
        nx, ny = self.shape
        rows = spark.range(nx * ny).select(F.col("id").alias("cell_id"), F.floor(F.col("id") / ny).alias("ix"), F.pmod("id", F.lit(ny)).alias("iy"))
        box = {
            "xmin": F.col("ix") * self.cell + x0,
            "ymin": F.col("iy") * self.cell + y0,
            "xmax": F.least((F.col("ix") + 1) * self.cell + x0, F.lit(x1)),
            "ymax": F.least((F.col("iy") + 1) * self.cell + y0, F.lit(y1)),
        }
        area = (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))
        return rows.withColumns(box).withColumns({"cx": (F.col("xmin") + F.col("xmax")) / 2, "cy": (F.col("ymin") + F.col("ymax")) / 2, "area_m2": area})


    def centres(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """x and y of cells' centres, as cells() has them."""
        x0, y0, x1, y1 = self.corners
        ny = self.shape[1]
        mid = lambda k, lo, hi: (k * self.cell + lo + np.minimum((k + 1) * self.cell + lo, hi)) / 2
        return mid(ids // ny, x0, x1), mid(ids % ny, y0, y1)


def from_other(cells: DataFrame, other: Grid, values: DataFrame, columns: list[str]) -> DataFrame:
    """cells with columns of another grid's cell (values: cell_id and the columns) that holds their centre: null where none does. The
    other cell is arithmetic, whatever its size, so the join is one on integers."""
    at, inner = free("other_cell", cells), free("held", cells)
    x0, y0, x1, y1 = other.corners
    nx, ny = other.shape
    ix, iy = other.index(F.col("cx"), F.col("cy"))
    inside = F.col("cx").between(x0, x1) & F.col("cy").between(y0, y1)
    place = F.when(inside, F.least(ix, F.lit(nx - 1)) * ny + F.least(iy, F.lit(ny - 1)))
    right = values.select(F.col("cell_id").alias(inner), *columns)
    return cells.drop(*columns).withColumn(at, place).join(right, F.col(at) == F.col(inner), "left").drop(at, inner)


#: Half of the eight neighbours; the other half are the same edges from the other end.
FORWARD = ((1, -1), (1, 0), (1, 1), (0, 1))


def edges(cells: DataFrame) -> DataFrame:
    """src < dst for cells that touch, with the distance of their centres. One row per cell and offset, joined by (ix, iy)."""
    offsets = F.array(*[F.struct(F.lit(dx).cast("long").alias("dx"), F.lit(dy).cast("long").alias("dy")) for dx, dy in FORWARD])
    one = cells.select(F.col("cell_id").alias("src"), "ix", "iy", F.col("cx").alias("x"), F.col("cy").alias("y"), F.explode(offsets).alias("o"))
    one = one.select("src", "x", "y", (F.col("ix") + F.col("o.dx")).alias("ix"), (F.col("iy") + F.col("o.dy")).alias("iy"))
    two = cells.select(F.col("cell_id").alias("dst"), "ix", "iy", "cx", "cy")
    return one.join(two, ["ix", "iy"]).select("src", "dst", F.hypot(F.col("cx") - F.col("x"), F.col("cy") - F.col("y")).alias("distance_m"))


def locate(points: DataFrame, cells: DataFrame, grid: Grid) -> DataFrame:
    """points (key, lat, lon) with the cell that holds each; points outside get the cell with the nearest centre, the smaller id in
    a tie. Outside points are few, and a cell's centre nearest to a point lies in the column and row nearest to it, so that
    fallback is arithmetic too."""
    x0, y0, *_ = grid.corners
    nx, ny = grid.shape
    x, y = geo.mercator_x(F.col("lon")), geo.mercator_y(F.col("lat"))
    ix, iy = grid.index(x, y)
    near = F.greatest(F.lit(0), F.least(ix, F.lit(nx - 1))) * ny + F.greatest(F.lit(0), F.least(iy, F.lit(ny - 1)))
    held = grid.cell_id(F.col("lon"), F.col("lat"))
    guess = points.withColumns({"x": x, "y": y, "held": held, "near": near})
    # the clipped last column and row have centres off the raster: compare with the neighbours on both sides
    beside = lambda at, by, n: F.greatest(F.lit(0), F.least(at + by, F.lit(n - 1)))
    ring = F.array_distinct(F.array(*[beside(F.floor(F.col("near") / ny), dx, nx) * ny + beside(F.pmod("near", F.lit(ny)), dy, ny) for dx in (-1, 0, 1) for dy in (-1, 0, 1)]))
    options = guess.withColumn("cell_id", F.explode(F.when(F.col("held").isNotNull(), F.array("held")).otherwise(ring)))
    far = options.join(cells.select("cell_id", "cx", "cy"), "cell_id").withColumn("d", F.hypot(F.col("cx") - F.col("x"), F.col("cy") - F.col("y")))
    best = far.groupBy(*points.columns).agg(F.min(F.struct("d", "cell_id")).alias("b"), F.max("held").alias("held"))
    return best.select(*points.columns, F.col("b.cell_id").alias("cell_id"), F.col("held").isNotNull().alias("inside"))
