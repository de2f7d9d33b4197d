"""Scalar rules as Column expressions: casts, classes, units, dates, labels and colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from airgrid.functions.geo import FT_TO_M, M_TO_FT

#: A number as both Spark and other engines read it; Spark alone would also take `1d` or `1.5f`.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
# Field elevation (ft), altitude bands (ft) with colours, cost limits with colours, layer colours, palette.
FIELD_FT = 680.0
BANDS = ((1500.0, "#2b83ba"), (3000.0, "#abdda4"), (5000.0, "#fdae61"))
BAND_OVER = "#d7191c"
COST_COLORS = ((12, "#800026"), (8, "#bd0026"), (5, "#e31a1c"), (3, "#fd8d3c"))
COST_UNDER = "#fed976"
LAYER_COLORS = {"High": "#e31a1c", "Medium": "#feb24c", "Low": "#31a354", "No-Fly": "#000000"}
PALETTE = ("#1f77b4", "#ff7f0e", "#2ca02c", "#d62728", "#9467bd", "#8c564b")


def number(text) -> Column:
    """A double, or null for anything that is not a finite number."""
    c = F.col(text) if isinstance(text, str) else text
    s = c.cast("string")
    return F.when(s.rlike(NUMBER), F.trim(s).try_cast("double"))


def clip(x: Column, lo: float, hi: float | None = None) -> Column:
    out = F.greatest(x, F.lit(lo))
    return out if hi is None else F.least(out, F.lit(hi))


def risk_class(x: Column, medium: float, high: float) -> Column:
    return F.when(x > high, "High").when(x > medium, "Medium").otherwise("Low")


def quantile_class(x: Column, mid: Column, top: Column) -> Column:
    """Inclusive limits; a null is low."""
    return F.when(x >= top, "high").when(x >= mid, "medium").otherwise("low")


def dominant(city: Column, airport: Column, pop_class: Column, air_class: Column) -> Column:
    both_low = (pop_class == "Low") & (air_class == "Low")
    return F.when(both_low, "low").when(city >= airport, "population").otherwise("airspace")


def altitude_agl_ft(metres: Column, field_ft: float = FIELD_FT) -> Column:
    return F.greatest(F.lit(0.0), metres * M_TO_FT - field_ft)


def feet_to_metres(ft: Column) -> Column:
    return ft * FT_TO_M


def band_color(ft: Column) -> Column:
    out = F
    for limit, color in BANDS:
        out = out.when(ft < limit, color)
    return out.otherwise(BAND_OVER)


def cost_color(cost: Column) -> Column:
    out = F
    for limit, color in COST_COLORS:
        out = out.when(cost >= limit, color)
    return out.otherwise(COST_UNDER)


def class_color(name: Column, tint: Column | None = None) -> Column:
    """The layer's colour; tint: a risk whose positive values colour what is Low otherwise."""
    out = F
    for key, color in LAYER_COLORS.items():
        if key == "Low" and tint is not None:
            out = out.when((name == key) & (tint > 0), "#ffffb2")
        out = out.when(name == key, color)
    return out.otherwise("#cccccc")


def palette_color(index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(p) for p in PALETTE]), (F.pmod(index, F.lit(len(PALETTE))) + 1).cast("int"))


def formatted(x: Column, digits: int = 1) -> Column:
    fine = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(fine, F.format_string(f"%.{digits}f", x)).otherwise("n/a")


def day_window(day: Column, zone: str) -> tuple[Column, Column]:
    """Epoch seconds of a local day's start and of the next one's: 23 or 25 hours apart where clocks change."""
    d = day.cast("date")
    at = lambda x: F.unix_timestamp(F.to_utc_timestamp(x.cast("timestamp_ltz"), zone))
    return at(d), at(F.date_add(d, 1))


def hour_floor(epoch: Column) -> Column:
    return F.floor(epoch / 3600) * 3600


def dataset_date(path: Column) -> Column:
    return F.try_to_timestamp(F.nullif(F.regexp_extract(path, r"(\d{4}-\d{2}-\d{2})", 1), F.lit("")), F.lit("yyyy-MM-dd")).cast("date")


def dataset_label(label: Column) -> Column:
    """`Sat 03/07/2026` for an ISO date; labels that begin with a weekday stay, as does anything else."""
    day = dataset_date(label)
    named = label.rlike(r"^(Mon|Tue|Wed|Thu|Fri|Sat|Sun)")
    return F.when(named | day.isNull(), label).otherwise(F.date_format(day, "EEE MM/dd/yyyy"))


def geoid(geo_id: Column) -> Column:
    return F.element_at(F.split(geo_id, "US", -1), -1)


def display_name(slug: Column) -> Column:
    return F.when(slug == "union_station", "Chicago").when(slug == "ohare", "O'Hare").when(slug == "midway", "Midway").otherwise(F.initcap(F.replace(slug, F.lit("_"), F.lit(" "))))
