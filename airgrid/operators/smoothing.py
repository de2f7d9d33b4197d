"""Smoothed routes: splines, sampling, simplification and re-scoring on the base weights."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from airgrid.operators import graph
from airgrid.operators.grid import Grid


def catmull_rom(points: DataFrame, keys: list[str], order: str = "pos", samples: int = 6) -> DataFrame:
    """keys, pos, x, y: the first point, then `samples` points per segment of a Catmull-Rom spline, the end points repeated as
    neighbours; lines of under four points stay. One window sort per line."""
    w = Window.partitionBy(*keys).orderBy(order)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    rows = points.select(*keys, "x", "y", (F.row_number().over(w) - 1).alias("_i"), n.alias("_n"))
    w = Window.partitionBy(*keys).orderBy("_i")
    near = {f"{c}{k}": F.coalesce(F.lag(c, -k).over(w), F.lead(c, 1).over(w) if k == 2 else F.col(c)) for c in "xy" for k in (-1, 1, 2)}
    rows = rows.withColumns(near)
    t = F.col("_k") / samples

    def curve(c):
        p0, p1, p2, p3 = F.col(f"{c}-1"), F.col(c), F.col(f"{c}1"), F.col(f"{c}2")
        return (p1 * 2 + (p2 - p0) * t + (p0 * 2 - p1 * 5 + p2 * 4 - p3) * t * t + (p1 * 3 - p0 - p2 * 3 + p3) * t * t * t) * 0.5

    first = F.array(F.lit(0))
    ks = F.when(F.col("_n") < 4, first).when(F.col("_i") == F.col("_n") - 1, F.array().cast("array<int>")).when(F.col("_i") == 0, F.sequence(F.lit(0), F.lit(samples))).otherwise(F.sequence(F.lit(1), F.lit(samples)))
    out = rows.withColumn("_k", F.explode(ks))
    keep = F.col("_k") == 0
    pos = F.when(F.col("_n") < 4, F.col("_i")).otherwise(F.col("_i") * samples + F.col("_k"))
    return out.select(*keys, pos.cast("long").alias("pos"), F.when(keep, F.col("x")).otherwise(curve("x")).alias("x"), F.when(keep, F.col("y")).otherwise(curve("y")).alias("y"))


def sample_lines(points: DataFrame, keys: list[str], order: str = "pos", spacing: float = 75.0) -> DataFrame:
    """keys, along, x, y: points every `spacing` along each line from its start, and its end."""
    w = Window.partitionBy(*keys).orderBy(order)
    ahead = points.withColumns({"_x": F.lead("x").over(w), "_y": F.lead("y").over(w)})
    ahead = ahead.withColumn("_len", F.coalesce(F.hypot(F.col("_x") - F.col("x"), F.col("_y") - F.col("y")), F.lit(0.0)))
    ahead = ahead.withColumn("_to", F.sum("_len").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_at", F.col("_to") - F.col("_len"))
    last = F.col("_x").isNull()
    first, end = F.ceil(F.col("_at") / spacing), F.ceil(F.col("_to") / spacing) - 1
    steps = F.when(last, F.array(F.col("_to"))).when(end >= first, F.transform(F.sequence(first, F.greatest(first, end)), lambda k: k * spacing)).otherwise(F.array().cast("array<double>"))
    out = ahead.withColumn("along", F.explode(steps))
    part = F.when(last | (F.col("_len") == 0), 0.0).otherwise((F.col("along") - F.col("_at")) / F.col("_len"))
    move = lambda c: F.when(last, F.col(c)).otherwise(F.col(c) + (F.col(f"_{c}") - F.col(c)) * part)
    return out.select(*keys, "along", move("x").alias("x"), move("y").alias("y"))


def cell_paths(points: DataFrame, keys: list[str], grid: Grid, edges: DataFrame, by: list[str]) -> DataFrame:
    """keys, path: the cells that each line's samples pass, repeated ones once, cells that do not touch bridged by the least-cost
    path on the edges (by, src, dst, weight). Points beyond the bounds count for the nearest column and row."""
    nx, ny = grid.shape
    ix, iy = grid.index(F.col("x"), F.col("y"))
    cell = F.least(F.greatest(ix, F.lit(0)), F.lit(nx - 1)) * ny + F.least(F.greatest(iy, F.lit(0)), F.lit(ny - 1))
    rows = graph.cells_deduped(points.withColumn("cell_id", cell.cast("long")), keys, "along")
    line = F.transform(F.sort_array(F.collect_list(F.struct("along", "cell_id"))), lambda p: p["cell_id"])
    lines = rows.groupBy(*keys).agg(line.alias("path"))
    kinds = {f.name: f.dataType.simpleString() for f in lines.schema.fields}

    def bridge(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        near, out = None, []
        for row in left.itertuples(index=False):
            cells, path = list(row.path), []
            for c in cells:
                if path and max(abs(c // ny - path[-1] // ny), abs(c % ny - path[-1] % ny)) > 1:
                    near = near or graph._adjacency(right["src"].tolist(), right["dst"].tolist(), right["weight"].tolist())
                    found = graph.dijkstra(near, path[-1], {c})
                    path += found[c][1][1:] if c in found else [c]
                else:
                    path.append(c)
            out.append((*(getattr(row, k) for k in keys), path))
        return pd.DataFrame(out, columns=[*keys, "path"])

    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "path array<long>"])
    return lines.groupBy(*by).cogroup(edges.select(*by, "src", "dst", "weight").groupBy(*by)).applyInPandas(bridge, schema)


def rescore(points: DataFrame, keys: list[str], grid: Grid, edges: DataFrame, by: list[str], spacing: float = 75.0) -> DataFrame:
    """keys, final_combined_cost, final_path_nodes: lines scored on the base weights, without turn penalties."""
    paths = cell_paths(sample_lines(points, keys, spacing=spacing), keys, grid, edges, by)
    cost = graph.path_costs(paths, edges, keys, by, {"final_combined_cost": F.col("weight")})
    return cost.join(paths.select(*keys, F.size("path").cast("long").alias("final_path_nodes")), keys)


def simplify(points: DataFrame, keys: list[str], tolerance: float = 0.0, order: str = "pos") -> DataFrame:
    """Lines without the points nearer than tolerance to what is left (Douglas-Peucker); 0 keeps every point."""
    if tolerance <= 0:
        return points
    kinds = points.schema

    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        xs, ys = pdf["x"].to_numpy(), pdf["y"].to_numpy()
        keep, todo = {0, len(xs) - 1}, [(0, len(xs) - 1)]
        while todo:
            a, b = todo.pop()
            if b - a < 2:
                continue
            dx, dy = xs[b] - xs[a], ys[b] - ys[a]
            size = dx * dx + dy * dy
            px, py = xs[a + 1 : b] - xs[a], ys[a + 1 : b] - ys[a]
            t = ((px * dx + py * dy) / size).clip(0, 1) if size else 0.0
            d = ((px - t * dx) ** 2 + (py - t * dy) ** 2) ** 0.5
            k = int(d.argmax())
            if d[k] > tolerance:
                keep.add(a + 1 + k)
                todo += [(a, a + 1 + k), (a + 1 + k, b)]
        return pdf.iloc[sorted(keep)]

    return points.groupBy(*keys).applyInPandas(reduce, kinds)
