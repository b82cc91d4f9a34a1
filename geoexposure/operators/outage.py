"""Night-light outage maps from a daily and a baseline band in log space.

Cells are a dense raster: row, col, daily, base (log1p of radiance) and valid; scene scalars are aggregated once and joined as one row.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoexposure.operators import kernels as K
from geoexposure.operators.focal import _std, tiled_apply
from geoexposure.operators.graph import clumps
from geoexposure.operators.quantiles import exact_quantile


def scene_scalar(cells: DataFrame, value: Column, how: str = "mean") -> float | None:
    """Mean or median of a column over valid cells, as a number; null if there are none. Cells whose value is null or NaN don't count; the median is selected exactly, without a buffer."""
    own = cells.where("valid")
    if how == "median":
        found = exact_quantile(own, [], value).first()
        return None if found is None else found[0]
    return own.agg(F.avg(F.when(~F.isnan(value), value))).first()[0]


def invalid_share_gate(granules: DataFrame, cloudy: Column, invalid: Column, by: str = "granule", add_clouds: bool = False) -> DataFrame:
    """Per granule whether its cloud mask is used (less than 95 % cloudy) and whether it is kept (less than 97 % invalid, rounded).

    With ``add_clouds`` cloudy cells are invalid too where the cloud mask is used.
    """
    share = lambda c: F.round(F.avg(c.cast("double")) * 100)
    used = share(cloudy) < 95
    bad = F.when(used, share(invalid | cloudy)).otherwise(share(invalid)) if add_clouds else share(invalid)
    return granules.groupBy(by).agg(used.alias("use_mask"), (bad < 97).alias("keep"))


def cloud_pct(granules: DataFrame, value: str = "cloud", by: str = "granule") -> DataFrame:
    """Whole percent of cells with 1 among those with 0 or 1; null if there are none."""
    count = lambda v: F.count(F.when(F.col(value).isin(*v), 1))
    return granules.groupBy(by).agg(F.floor(F.try_divide(count([1]) * 100, count([0, 1]))).cast("int").alias("cloud_pct"))


def dynamic_threshold(losses: DataFrame, value: str = "loss", least: float = 0.01) -> DataFrame:
    """Mean plus one population deviation of the losses above ``least``; 0 if there are none."""
    over = losses.where(F.col(value) > least)
    return over.agg(F.coalesce(F.avg(value) + F.stddev_pop(value), F.lit(0.0)).alias("threshold"))


def _smoothed(cells: DataFrame, nrows: int, ncols: int, radius: int, with_std: bool) -> DataFrame:
    fill = scene_scalar(cells, F.col("base"))
    fill = F.lit(float("nan") if fill is None else fill)
    filled = cells.select("row", "col", F.when(F.col("valid"), F.col("base")).otherwise(fill).alias("base"), F.when(F.col("valid"), F.col("daily")).otherwise(fill).alias("daily"))

    def smooth(im: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        margin = 1 if with_std else 0
        base = K.convolve(im["base"], K.disk(radius))
        daily = K.convolve(im["daily"], K.disk(radius))
        core = (slice(margin, base.shape[0] - margin), slice(margin, base.shape[1] - margin))
        out = {"base_smooth": base[core], "daily_smooth": daily[core]}
        return out | ({"base_std": _std(base)} if with_std else {})

    bands = ["base_smooth", "daily_smooth"] + (["base_std"] if with_std else [])
    # The deviation of the smoothed band needs one more cell around; mirroring and smoothing commute for a symmetric kernel.
    return tiled_apply(filled, ["base", "daily"], smooth, bands, nrows, ncols, halo=radius + with_std)


def outage_logdiff(cells: DataFrame, nrows: int, ncols: int, drop: float = 50, z: float = -2.0, floor: float = 0.15) -> DataFrame:
    """(row, col, log_diff, z_score, outage): smoothed drop against the baseline and against its local noise; null where invalid."""
    smooth = _smoothed(cells, nrows, ncols, 2, True)
    diff = F.col("daily_smooth") - F.col("base_smooth")
    noise = F.greatest(F.col("base_std") / (F.expm1("base_smooth") + 1), F.lit(floor))
    both = cells.select("row", "col", "valid").join(smooth, ["row", "col"])
    out = both.select("row", "col", F.when(F.col("valid"), diff).alias("log_diff"), F.when(F.col("valid"), diff / noise).alias("z_score"))
    hit = (F.col("log_diff") < math.log(1 - drop / 100)) & (F.col("z_score") < z)
    return out.withColumn("outage", F.coalesce(hit, F.lit(False)))


def outage_zscore(cells: DataFrame, floor: float = 0.15) -> DataFrame:
    """(row, col, z_score, health): 0 healthy, 1 dimming, 2 outage, after taking out the median shift of the scene.

    Cells carry ``std``, the baseline's deviation in linear units.
    """
    shift = scene_scalar(cells, F.col("daily") - F.col("base"), "median")
    rest = F.col("daily") - F.col("base") - F.lit(shift)
    score = rest / F.greatest(F.col("std") / (F.expm1("base") + 1), F.lit(floor))
    # Limits of outage and of dimming, of the rest and of its score.
    health = F.when((rest < -0.7) | (score < -3), 2).when((rest < -0.3) | (score < -2), 1).otherwise(0)
    return cells.select("row", "col", F.when(F.col("valid"), score).alias("z_score"), F.when(F.col("valid"), health).otherwise(0).alias("health"))


def confirmed_outages(health: DataFrame, ncols: int, least: int = 2) -> DataFrame:
    """(row, col) of the outages of ``outage_zscore`` (health 2) that touch each other along sides in clumps of ``least`` cells or more."""
    return clumps(health.where("health = 2").select("row", "col"), ncols, least).select("row", "col")


def outage_confidence(cells: DataFrame, nrows: int, ncols: int, dim: float = 50, out: float = 80) -> DataFrame:
    """(row, col, log_diff, health, confidence). Cells carry ``std``, ``num`` (clear days of the baseline) and ``cloudy``.

    The confidence of an outage is the product of its signal to noise (3 is full), its history (15 days are full) and a clear view.
    """
    smooth = _smoothed(cells, nrows, ncols, 1, False)
    both = cells.join(smooth, ["row", "col"]).withColumn("log_diff", F.when(F.col("valid"), F.col("daily_smooth") - F.col("base_smooth")))
    health = F.when(F.col("log_diff") < math.log(1 - out / 100), 2).when(F.col("log_diff") < math.log(1 - dim / 100), 1).otherwise(0)
    clip = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    trust = clip(F.abs("log_diff") / F.greatest(F.col("std"), F.lit(0.05)) / 3) * clip(F.col("num") / 15) * F.when(F.col("cloudy"), 0.0).otherwise(1.0)
    both = both.withColumn("health", health)
    return both.select("row", "col", "log_diff", "health", F.when(F.col("health") == 2, trust).otherwise(0.0).alias("confidence"))
