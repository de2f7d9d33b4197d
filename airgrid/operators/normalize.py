"""Normalisation of cost columns to [0, 1]."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airgrid.functions.names import free
from airgrid.operators.quantiles import exact_quantiles


def _lifted(column: str, log: bool) -> Column:
    x = F.greatest(F.col(column), F.lit(0.0))
    return F.log1p(x) if log else x


def scale_of(df: DataFrame, column: str, percentile: float | None = None, log: bool = False, by: list[str] | None = None) -> DataFrame:
    """g0, g1, ... (the groups of by) and top: the maximum, or an exact percentile of the positive values; null if nothing is."""
    by, x = by or [], _lifted(column, log)
    if percentile is not None:
        return exact_quantiles(df, F.when(x > 0, x), [percentile / 100.0], by).withColumnRenamed("q0", "top")
    return df.groupBy(*[F.col(c).alias(f"g{k}") for k, c in enumerate(by)]).agg(F.max(F.when(x > 0, x)).cast("double").alias("top"))


def normalize(df: DataFrame, column: str, out: str, percentile: float | None = None, log: bool = False, power: float = 1.0, by: list[str] | None = None) -> DataFrame:
    """Clip below at 0, log1p, divide by the scale (1 if nothing is positive), clip at 1, raise. One row per group travels."""
    by = by or []
    scale = scale_of(df, column, percentile, log, by)
    inner = {c: free(f"scale_{c}", df) for c in scale.columns}
    sent = F.broadcast(scale.select(*[F.col(c).alias(n) for c, n in inner.items()]))
    same = [F.col(c).eqNullSafe(F.col(inner[f"g{k}"])) for k, c in enumerate(by)]
    joined = df.join(sent, same or F.lit(True), "left")
    y = F.least(F.lit(1.0), _lifted(column, log) / F.coalesce(F.col(inner["top"]), F.lit(1.0)))
    return joined.withColumn(out, y if power == 1.0 else F.pow(y, F.lit(power))).drop(*inner.values())
