"""Exact quantiles of columns of any size.

Approximate quantiles bracket each wanted place, rows below the bracket are counted, and only the few rows within it are ordered:
the exact order statistics and the straight line between them follow. What is gathered per group is a sketch of bounded size and the
distinct values of a bracket of about 4 / ACCURACY of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 10_000


def exact_quantiles(df: DataFrame, x: Column, shares: list[float], by: list[str] | None = None, accuracy: int = ACCURACY) -> DataFrame:
    """Inner columns g0, g1, ... for the groups (none: one row, of nulls if there is no value) and q0, q1, ... for the shares of the values that are
    not null."""
    by = by or []
    keys = [f"g{k}" for k in range(len(by))]
    values = df.select(*[F.col(c).alias(g) for c, g in zip(by, keys, strict=True)], x.cast("double").alias("x")).where("x IS NOT NULL")
    ends = [min(1.0, max(0.0, s + side * 2 / accuracy)) for s in shares for side in (-1, 1)]
    bounds = values.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("x", F.array(*[F.lit(e) for e in ends]), accuracy).alias("b"))
    bounds = bounds.where("n > 0")
    same = [F.col(g).eqNullSafe(F.col(f"b_{g}")) for g in keys]
    sent = F.broadcast(bounds.select(*[F.col(g).alias(f"b_{g}") for g in keys], "n", "b"))  # a row per group of a fixed set
    joined = values.join(sent, same) if by else values.join(sent)
    # the outermost brackets are open, so that they hold the least and the largest value, and so are those of few values, where two
    # neighbours in order may be further apart than a sketch can tell
    few = F.col("n") <= 4 * accuracy
    low = [F.lit(float("-inf")) if ends[2 * k] <= 0 else F.when(few, float("-inf")).otherwise(F.col("b")[2 * k]) for k in range(len(shares))]
    high = [F.lit(float("inf")) if ends[2 * k + 1] >= 1 else F.when(few, float("inf")).otherwise(F.col("b")[2 * k + 1]) for k in range(len(shares))]
    place = [F.struct(F.lit(k).alias("k"), (F.col("x") < lo).alias("below")) for k, lo in enumerate(low)]
    met = F.explode(F.filter(F.array(*[F.when(F.col("x") <= hi, p) for p, hi in zip(place, high, strict=True)]), lambda p: p.isNotNull())).alias("p")
    # below a bracket one row per group and task is left, within it one per value
    value = F.when(~F.col("p.below"), F.col("x"))
    counted = joined.select(*keys, "n", "x", met).groupBy(*keys, "n", F.col("p.k").alias("k"), value.alias("x")).agg(F.count(F.lit(1)).alias("m"))
    upto = F.sum("m").over(Window.partitionBy(*keys, "k").orderBy(F.col("x").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    share = F.element_at(F.array(*[F.lit(float(s)) for s in shares]), F.col("k") + 1)
    at = share * (F.col("n") - 1)
    ranked = counted.select(*keys, "n", "k", "x", upto.alias("upto"), at.alias("at")).where("x IS NOT NULL")
    lower = F.min(F.when(F.col("upto") > F.floor("at"), F.col("x")))
    upper = F.min(F.when(F.col("upto") > F.ceil("at"), F.col("x")))
    line = ranked.groupBy(*keys, "k", "at").agg(lower.alias("lower"), upper.alias("upper")).withColumn("q", F.col("lower") + (F.col("upper") - F.col("lower")) * (F.col("at") - F.floor("at")))
    return line.groupBy(*keys).agg(*[F.max(F.when(F.col("k") == k, F.col("q"))).alias(f"q{k}") for k in range(len(shares))])
