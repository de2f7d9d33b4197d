"""The batch operators over streams: counts per cell, horizons as windows, and gap filling with keyed state."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airgrid.operators.grid import Grid


def cell_counts(obs: DataFrame, grid: Grid) -> DataFrame:
    """Running counts per cell; write in update or complete mode."""
    return obs.withColumn("cell_id", grid.cell_id(F.col("lon"), F.col("lat"))).where("cell_id IS NOT NULL").groupBy("cell_id").agg(F.count(F.lit(1)).alias("traffic"))


def windowed_counts(obs: DataFrame, grid: Grid, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per cell and event-time window, late rows dropped behind the watermark. obs has a timestamp column ts."""
    placed = obs.withColumn("cell_id", grid.cell_id(F.col("lon"), F.col("lat"))).where("cell_id IS NOT NULL")
    return placed.withWatermark("ts", late).groupBy(F.window("ts", length), "cell_id").agg(F.count(F.lit(1)).alias("traffic"))


def fill_gaps(obs: DataFrame, step: int = 5, max_gap: int = 180, late: str = "10 minutes", columns: tuple[str, ...] = ("lat", "lon")) -> DataFrame:
    """Each row as it comes, and the points every step seconds before it on the line from the aircraft's row before, which is all
    the state there is; columns (altitude too, if named) are filled alike. Rows older than the state are passed on without
    filling, rows behind the watermark go. An aircraft's state goes once no row within max_gap of it can still come."""
    import numpy as np

    def run(key, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get if state.exists else None
        pdf = pd.concat(list(pdfs)).sort_values("time", kind="stable")  # one aircraft's rows of a micro-batch
        out = []
        for t, *now in pdf[["time", *columns]].itertuples(index=False):
            if last is not None and step < t - last[0] <= max_gap:
                t0, before = last[0], last[1:]
                out += [(key[0], s, *[a + (b - a) * (s - t0) / (t - t0) for a, b in zip(before, now, strict=True)]) for s in range(t0 + step, t, step)]
            out.append((key[0], t, *now))
            if last is None or t >= last[0]:
                last = (int(t), *[float(np.nan if v is None else v) for v in now])
        state.update(last)
        state.setTimeoutTimestamp(max((last[0] + max_gap) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["icao24", "time", *columns])

    kind = obs.schema["icao24"].dataType.simpleString()
    values = ", ".join(f"{c} double" for c in columns)
    timed = obs.select("icao24", "time", *columns, F.timestamp_seconds("time").alias("ts")).withWatermark("ts", late)
    return timed.groupBy("icao24").applyInPandasWithState(run, f"icao24 {kind}, time long, {values}", f"time long, {values}", "append", "EventTimeTimeout")
