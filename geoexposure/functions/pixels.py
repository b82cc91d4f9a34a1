"""Pixel-wise functions as columns."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# When the offset of 1000 came in, and the healthcare facilities.
OFFSET_SINCE, OFFSET = datetime.date(2022, 1, 25), 1000
AMENITIES = ("hospital", "clinic", "doctors", "pharmacy", "dentist")


def harmonize(value: Column, acquired: Column, nodata: int = 0) -> Column:
    """Values acquired since the change of the processing baseline lose its offset; nodata stays."""
    return F.when((acquired >= F.lit(OFFSET_SINCE)) & (value != nodata), value - OFFSET).otherwise(value)


def class_to_area(value: Column, cls: int, pixel_area: float) -> Column:
    """The pixel's area where the class is ``cls``, else null (nodata)."""
    return F.when(value == cls, F.lit(pixel_area))


def normalize_bands(bands: Column, low: list[float], high: list[float]) -> Column:
    """Band values to (0, 1): logarithm, scale between a low and a high percentile, then a soft curve."""
    # The factor of the logarithm, and slope and shift of the curve.
    logs = F.transform(bands, lambda x: F.log(x * 0.005 + 1))
    scaled = F.zip_with(F.zip_with(logs, F.array(*map(F.lit, low)), lambda x, a: x - a), F.array(*[F.lit(b - a) for a, b in zip(low, high, strict=True)]), lambda x, d: x / d)
    return F.transform(F.transform(scaled, lambda x: F.exp(x * 5 - 1)), lambda x: x / (x + 1))


def argmax_class(scores: Column) -> Column:
    """Index of the first largest score (softmax does not change it)."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def log_radiance(value: Column) -> Column:
    """log1p of a radiance; negative ones count as zero."""
    return F.when(value >= 0, F.log1p(value)).otherwise(F.lit(0.0))


def cloud_from_quality(flags: Column) -> Column:
    """Confident cloud: bits 6 and 7 of the quality flags are both set."""
    return F.shiftright(flags, 6).bitwiseAND(F.lit(3)) == 3


def analysis_mask(land_water: Column, baseline: Column) -> Column:
    """Pixels to leave out: water classes 2 and 3, and negative baselines."""
    return land_water.isin(2, 3) | (baseline < 0)


def is_land(land_water: Column) -> Column:
    return land_water.isin(0, 1, 5)


def radiance_scale(value: Column) -> Column:
    """Radiance in the usual unit; fill values below -900 are null."""
    return F.when(value >= -900, value * 1e5)


def cell_of(x: Column, y: Column, x0: float, y0: float, dx: float, dy: float) -> tuple[Column, Column]:
    """(row, col) of a point; ``dy`` is negative where y falls with the row."""
    return F.floor((y - y0) / dy).cast("int"), F.floor((x - x0) / dx).cast("int")


def facility_filter(tags: Column) -> Column:
    """Tags (a map) of a healthcare facility."""
    return F.coalesce(tags["amenity"].isin(*AMENITIES), F.lit(False)) | tags["healthcare"].isNotNull()


def admin_level(osm_level: Column) -> Column:
    """Administrative level 0 to 2 of an OSM level; null for others."""
    return F.when(osm_level == 2, 0).when(osm_level.isin(3, 4), 1).when(osm_level.between(5, 8), 2)
