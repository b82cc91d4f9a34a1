"""Cell-wise raster work: masks, alignment, sums, resampling, mosaics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoexposure.functions import geometry as G

CELL = ["row", "col"]


def apply_mask(cells: DataFrame, mask: DataFrame) -> DataFrame:
    """The cells that the mask (row, col of affected cells) holds."""
    return cells.join(mask.select(*CELL), CELL, "left_semi")


def clip_with_mask(cells: DataFrame, mask: DataFrame, value: int, ratio: int = 1) -> DataFrame:
    """Cells whose mask cell, on a grid ``ratio`` times as coarse, has ``value``."""
    keys = mask.where(F.col("value") == value).select(F.col("row").alias("_r"), F.col("col").alias("_c"))
    on = (F.floor(F.col("row") / ratio) == F.col("_r")) & (F.floor(F.col("col") / ratio) == F.col("_c"))
    return cells.join(keys, on, "left_semi")


def mask_clouds(classes: DataFrame, cloudy: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Cells without those under cloud."""
    return classes.join(cloudy, by or CELL, "left_anti")


def align(a: DataFrame, b: DataFrame, lenient: bool = False) -> DataFrame:
    """Rasters of one grid side by side, where both have data; leniently where one has."""
    return a.join(b, CELL, "full_outer" if lenient else "inner")


def raster_sum(rasters: list[DataFrame], strict: bool = True) -> DataFrame:
    """Sum of rasters of one grid: strict where all have data, else nodata counts as zero (and the sum is of floats)."""
    every = reduce(DataFrame.unionByName, [r.select(*CELL, "value") for r in rasters])
    summed = every.groupBy(*CELL).agg(F.sum("value").alias("value"), F.count("value").alias("_n"))
    if strict:
        return summed.where(F.col("_n") == len(rasters)).drop("_n")
    return summed.select(*CELL, F.coalesce("value", F.lit(0)).cast("float").alias("value"))


def _centre(i: Column, step: float, origin: float) -> Column:
    return (i + 0.5) * step + origin


def target_cells(cells: DataFrame, nrows: int, ncols: int) -> DataFrame:
    """Every cell of a grid, made on the executors."""
    one = cells.sparkSession.range(nrows).select(F.col("id").cast("int").alias("row"))
    return one.select("row", F.explode(F.sequence(F.lit(0), F.lit(ncols - 1))).alias("col"))


def resample_nearest(cells: DataFrame, nrows: int, ncols: int, step: float, origin: tuple[float, float] = (0.0, 0.0), complete: bool = False) -> DataFrame:
    """Values on a grid of cells of ``step`` source cells: each target cell takes the source cell under its centre.

    With ``complete`` a target cell without data raises when it is read.
    """
    targets = target_cells(cells, nrows, ncols)
    at = [F.floor(_centre(F.col(c), step, o)).cast("int").alias(f"_{c}") for c, o in zip(CELL, (origin[1], origin[0]), strict=True)]
    source = cells.select(F.col("row").alias("_row"), F.col("col").alias("_col"), "value")
    out = targets.select("*", *at).join(source, ["_row", "_col"], "left" if complete else "inner")
    if complete:
        out = out.withColumn("value", F.when(F.col("value").isNull(), F.raise_error(F.lit("the source does not cover the grid"))).otherwise(F.col("value")))
    return out.select(*CELL, "value")


def resample_bilinear(cells: DataFrame, nrows: int, ncols: int, step: float) -> DataFrame:
    """Values between the four nearest source centres, weights renormalised where some are missing (grid edges).

    A source cell goes to the targets less than one source cell away, and is summed up there: no table of targets is made, joined or broadcast.
    """
    near = cells.select(F.col("row").alias("_row"), F.col("col").alias("_col"), "value")
    for c, n in zip(CELL, (nrows, ncols), strict=True):
        first, last = F.floor((F.col(f"_{c}") - 0.5) / step - 0.5), F.ceil((F.col(f"_{c}") + 1.5) / step - 0.5)
        targets = G.between(F.greatest(F.lit(0), first), F.least(F.lit(n - 1), last))
        near = near.withColumn(c, F.explode(targets.cast("array<int>"))).withColumn(f"_{c}w", 1 - F.abs(_centre(F.col(c), step, -0.5) - F.col(f"_{c}"))).where(f"_{c}w > 0")
    weight = F.col("_roww") * F.col("_colw")
    return near.groupBy(*CELL).agg((F.sum(F.col("value") * weight) / F.sum(weight)).alias("value"))


def interpolate_years(cells: DataFrame, year: int) -> DataFrame:
    """Cells of one year from a table (row, col, year, value) of given years.

    Years up to 2020 must be there (those before 2000 take 2000), later ones lie between multiples of five, those after 2100 take 2100.
    """
    year = min(max(year, 2000), 2100)
    a = year if year <= 2020 else year // 5 * 5
    b = a if a == year else a + 5
    at = lambda y: F.max(F.when(F.col("year") == y, F.col("value")))
    wide = cells.where(F.col("year").isin(a, b)).groupBy(*CELL).agg(at(a).alias("_a"), at(b).alias("_b"))
    share = (year - a) / (b - a) if b > a else 0.0
    return wide.where("_a IS NOT NULL AND _b IS NOT NULL").select(*CELL, (F.col("_a") + (F.col("_b") - F.col("_a")) * share).alias("value"))


def mosaic_last(cells: DataFrame, order: list[str], nodata: int | None = 255) -> DataFrame:
    """Per cell the value of the raster that comes last in ``order``; nodata is transparent."""
    seen = cells.where(F.col("value") != nodata) if nodata is not None else cells
    return seen.groupBy(*CELL).agg(F.max_by("value", F.struct(*order)).alias("value"))


def fill_holes(cells: DataFrame, order: list[str], nodata: int | None = 255) -> DataFrame:
    """Per cell the value of the first raster in ``order`` that has one."""
    seen = cells.where(F.col("value") != nodata) if nodata is not None else cells
    return seen.groupBy(*CELL).agg(F.min_by("value", F.struct(*order)).alias("value"))


def first_clear_observation(cells: DataFrame, order: list[str], valid: Column, by: list[str] | None = None) -> DataFrame:
    """Per cell the whole row of the first valid observation, so that all bands come from one granule."""
    first = Window.partitionBy(*(by or CELL)).orderBy(*order)
    return cells.where(valid).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
