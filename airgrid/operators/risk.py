"""Population density, and the risk grid that joins population, corridors and airspace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from airgrid.functions import scalars as S
from airgrid.functions.names import free
from airgrid.operators.quantiles import exact_quantiles


def density(population: Column, land_m2: Column) -> Column:
    """People per km²; null where there is no land."""
    return F.try_divide(population, land_m2 / 1e6)


def population_join(groups: DataFrame, people: DataFrame) -> DataFrame:
    """Block groups (GEOID, ALAND, ...) with population and density, by the census id behind the last `US`. The second header row
    is dropped; text that is no number is missing."""
    people = people.where("GEO_ID <> 'Geography'").select(S.geoid(F.col("GEO_ID")).alias("GEOID"), S.number("B01003_001E").alias("population"))
    out = groups.join(people, "GEOID", "left")
    return out.withColumn("density_p_km2", density(F.col("population"), F.col("ALAND").cast("double")))


def quantile_risk(df: DataFrame, column: str = "density_p_km2", mid: float = 0.70, top: float = 0.90) -> DataFrame:
    """df with density_risk: at or above the exact quantiles of the non-null values. Two numbers travel."""
    names = [free(n, df) for n in ("q_mid", "q_top")]
    q = exact_quantiles(df, F.col(column), [mid, top]).select(F.col("q0").alias(names[0]), F.col("q1").alias(names[1]))
    return df.join(F.broadcast(q), F.lit(True), "left").withColumn("density_risk", S.quantile_class(F.col(column), *[F.col(n) for n in names])).drop(*names)


def profile(df: DataFrame, column: str) -> DataFrame:
    """Rows, missing, non-zero, least, largest, mean, spread and quartiles of a column."""
    c = F.col(column)
    quartiles = exact_quantiles(df, c, [0.25, 0.5, 0.75]).toDF("quartile_1", "median", "quartile_3")
    return _described(df, c).join(F.broadcast(quartiles), F.lit(True), "left")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """How often each value of a column stands, null included, the commonest first."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value")


def _described(df: DataFrame, c: Column) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(c.isNull()).alias("n_missing"), F.count_if(c != 0).alias("n_nonzero"), F.min(c).alias("min_value"), F.max(c).alias("max_value"), F.avg(c).alias("mean_value"), F.stddev_samp(c).alias("spread"))


def combine(cells: DataFrame) -> DataFrame:
    """Adds city_risk, airport_risk_combined, classes, density_type and risk_cost to cells with density_p_km2, airport_risk and
    airport_airspace_risk; missing densities count as 0."""
    out = cells.withColumn("density_p_km2", F.coalesce("density_p_km2", F.lit(0.0)))
    out = out.withColumn("city_risk", S.clip(F.col("density_p_km2") / 10.0, 0.0, 120.0))
    out = out.withColumn("airport_risk_combined", F.col("airport_risk") + F.col("airport_airspace_risk") * 70.0)
    out = out.withColumns({"pop_class": S.risk_class(F.col("city_risk"), 40.0, 90.0), "air_class": S.risk_class(F.col("airport_risk_combined"), 30.0, 70.0)})
    out = out.withColumn("density_type", S.dominant(F.col("city_risk"), F.col("airport_risk_combined"), F.col("pop_class"), F.col("air_class")))
    out = out.withColumn("risk_cost", F.col("city_risk") * 0.9 + F.col("airport_risk_combined") * 1.4)
    return out.withColumn("risk_class", S.risk_class(F.col("risk_cost"), 30.0, 70.0))


def no_fly(cells: DataFrame, sites: DataFrame, blocked: float = 9999.0) -> DataFrame:
    """Cells within a site's radius are No-Fly, unless their cost already makes them Medium or High; those left get the blocked
    cost. sites: (sx, sy, radius_m), a configuration of a few rows."""
    near = F.hypot(F.col("cx") - F.col("sx"), F.col("cy") - F.col("sy")) <= F.col("radius_m")
    flag = free("hit", cells)
    hit = cells.select("cell_id", "cx", "cy").join(F.broadcast(sites), near, "left_semi").select("cell_id", F.lit(True).alias(flag))
    out = cells.join(hit, "cell_id", "left")
    kind = F.when(F.col("risk_cost") > 70, "High").when(F.col("risk_cost") > 30, "Medium").when(F.col(flag), "No-Fly").otherwise("Low")
    out = out.withColumn("risk_class", kind)
    return out.withColumn("risk_cost", F.when(F.col("risk_class") == "No-Fly", blocked).otherwise(F.col("risk_cost"))).drop(flag)


def demote_no_fly(features: DataFrame, labs: DataFrame, weights: tuple[float, float] | None = (0.9, 1.4)) -> DataFrame:
    """Stale No-Fly features near a lab site, reclassified from their risks; weights None adds the risks unweighted. A missing
    combined airport risk falls back to the corridor's, other missing or bad numbers to 0. labs: (llat, llon, reach_m)."""
    from airgrid.functions import geo

    near = geo.equirectangular_m(F.col("lat"), F.col("lon"), F.col("llat"), F.col("llon")) <= F.col("reach_m")
    flag = free("hit", features)
    hit = features.select("feature_id", "lat", "lon").join(F.broadcast(labs), near, "left_semi").select("feature_id", F.lit(True).alias(flag))
    out = features.join(hit, "feature_id", "left")
    fine = lambda c: F.when(c.isNotNull() & ~F.isnan(c), c)
    city = F.coalesce(fine(F.col("city_risk")), F.lit(0.0))
    air = F.coalesce(fine(F.col("airport_risk_combined")), fine(F.col("airport_risk")), F.lit(0.0))
    a, b = weights or (1.0, 1.0)
    cost = city * a + air * b
    demoted = F.coalesce(flag, F.lit(False)) & (F.col("risk_class") == "No-Fly")
    out = out.withColumn("demoted", demoted)
    return out.withColumns({"risk_cost": F.when(F.col("demoted"), cost).otherwise(F.col("risk_cost")), "risk_class": F.when(F.col("demoted"), S.risk_class(cost, 30.0, 70.0)).otherwise(F.col("risk_class"))}).drop(flag)
