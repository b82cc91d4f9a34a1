"""Moving windows over cells: tiles with a halo for dense rasters, offsets for sparse masks.

Beyond the edge of the grid cells are mirrored with the edge cell repeated, at the grid's edge only and never at a tile's.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoexposure.operators import kernels as K

TILE = 64


def _places(i: Column, n: int, tile: int, halo: int) -> Column:
    """Structs (t, p) for every tile that needs cell ``i``: its number and the cell's place in it, mirrored places included."""
    at = lambda place: F.transform(
        F.sequence(F.greatest(F.floor((place - halo) / tile), F.lit(0)), F.least(F.floor((place + halo) / tile), F.lit((n - 1) // tile))),
        lambda t: F.struct(t.cast("int").alias("t"), (place - t * tile + halo).cast("int").alias("p")),
    )
    real = at(i)
    before = F.when(i < halo, at(-i - 1)).otherwise(F.slice(real, 1, 0))
    after = F.when(i >= n - halo, at(2 * n - 1 - i)).otherwise(F.slice(real, 1, 0))
    fits = lambda a: F.filter(a, lambda s: (s["p"] >= 0) & (s["p"] < tile + 2 * halo))
    return F.concat(fits(real), fits(before), fits(after))


def tiled_apply(cells: DataFrame, bands: list[str], fn: Callable[[dict[str, np.ndarray]], dict[str, np.ndarray]], out: list[str], nrows: int, ncols: int, tile: int = TILE, halo: int = 0) -> DataFrame:
    """(row, col, ``out``): run ``fn`` on overlapping tiles of a dense raster and keep their cores.

    ``fn`` gets an array for each band, with ``halo`` cells around the core, and returns arrays of the core's size. Cells
    without a row are NaN. Only tiles that hold cells are run, and only cells that have a row come back.
    """
    assert halo <= min(nrows, ncols), "the halo must not exceed the grid"
    r = cells.select("row", "col", *bands).withColumn("_r", F.explode(_places(F.col("row"), nrows, tile, halo)))
    c = r.withColumn("_c", F.explode(_places(F.col("col"), ncols, tile, halo)))
    spread = c.select(F.col("_r.t").alias("_ty"), F.col("_c.t").alias("_tx"), F.col("_r.p").alias("_y"), F.col("_c.p").alias("_x"), *bands)

    def run(key: tuple[int, int], rows: pd.DataFrame) -> pd.DataFrame:
        ty, tx = key
        h, w = min(tile, nrows - ty * tile), min(tile, ncols - tx * tile)
        rows = rows[(rows["_y"] < h + 2 * halo) & (rows["_x"] < w + 2 * halo)]
        y, x = rows["_y"].to_numpy(), rows["_x"].to_numpy()
        images = {}
        for b in bands:
            images[b] = np.full((h + 2 * halo, w + 2 * halo), np.nan)
            images[b][y, x] = rows[b].to_numpy(float)
        there = np.zeros((h + 2 * halo, w + 2 * halo), bool)
        there[y, x] = True
        i, j = np.nonzero(there[halo : halo + h, halo : halo + w])
        found = fn(images)
        return pd.DataFrame({"row": (i + ty * tile).astype("int32"), "col": (j + tx * tile).astype("int32")} | {o: found[o][i, j].astype(float) for o in out})

    return spread.groupBy("_ty", "_tx").applyInPandas(run, "row int, col int, " + ", ".join(f"{o} double" for o in out))


def focal_mean(cells: DataFrame, radius: int, nrows: int, ncols: int, value: str = "value") -> DataFrame:
    """Mean over a disk."""
    return tiled_apply(cells, [value], lambda im: {"value": K.convolve(im[value], K.disk(radius))}, ["value"], nrows, ncols, halo=radius)


def _std(image: np.ndarray) -> np.ndarray:
    """Population deviation in 3 x 3, from values less their window's mean."""
    mean = K.convolve(image, K.box(3))
    h, w = mean.shape
    total = sum((image[1 + i : 1 + i + h, 1 + j : 1 + j + w] - mean) ** 2 for i in (-1, 0, 1) for j in (-1, 0, 1))
    return np.sqrt(total / 9)


def focal_std(cells: DataFrame, nrows: int, ncols: int, value: str = "value") -> DataFrame:
    return tiled_apply(cells, [value], lambda im: {"value": _std(im[value])}, ["value"], nrows, ncols, halo=1)


# The Sobel kernel of one direction; the other is its transpose.
SOBEL = {(-1, -1): -1.0, (-1, 1): 1.0, (0, -1): -2.0, (0, 1): 2.0, (1, -1): -1.0, (1, 1): 1.0}


def focal_gradient(cells: DataFrame, nrows: int, ncols: int, value: str = "value") -> DataFrame:
    def gradient(im: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        return {"value": np.hypot(K.convolve(im[value], SOBEL), K.convolve(im[value], {(j, i): k for (i, j), k in SOBEL.items()}))}

    return tiled_apply(cells, [value], gradient, ["value"], nrows, ncols, halo=1)


def haze_mask(cells: DataFrame, nrows: int, ncols: int, radius: int = 7, most_std: float = 0.35, drop: float = -0.5, value: str = "value") -> DataFrame:
    """(row, col, haze): 1 where the regional mean drops below ``drop`` and the region is uniform."""

    def haze(im: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        mean, square = K.convolve(im[value], K.disk(radius)), K.convolve(im[value] ** 2, K.disk(radius))
        std = np.sqrt(np.maximum(square - mean**2, 0))
        return {"haze": (mean < drop) & (std < most_std)}

    out = tiled_apply(cells, [value], haze, ["haze"], nrows, ncols, halo=radius)
    return out.withColumn("haze", F.col("haze").cast("int"))


def ssim(cells: DataFrame, nrows: int, ncols: int, a: str, b: str, data_range: float = 12.0, gauss: bool = False) -> DataFrame:
    """Structural similarity of two bands per cell: 7 x 7 box, or Gaussian of sigma 1.5 (then variances are not below zero)."""
    # The windows, and the shares of the data range that keep the quotient from zero.
    kernel = K.gaussian(1.5, 3.5) if gauss else K.box(7)
    c1, c2 = (0.01 * data_range) ** 2, (0.03 * data_range) ** 2

    def index(im: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        mean = lambda x: K.convolve(x, kernel)
        x, y = im[a], im[b]
        mx, my = mean(x), mean(y)
        vx, vy, cxy = mean(x * x) - mx * mx, mean(y * y) - my * my, mean(x * y) - mx * my
        if gauss:
            vx, vy = np.maximum(vx, 0), np.maximum(vy, 0)
        return {"value": (2 * mx * my + c1) * (2 * cxy + c2) / ((mx * mx + my * my + c1) * (vx + vy + c2))}

    return tiled_apply(cells, [a, b], index, ["value"], nrows, ncols, halo=max(max(k) for k in kernel))


def _disk_offsets(radius: int) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in sorted(K.disk(radius))])


def _moved(mask: DataFrame, radius: int) -> DataFrame:
    spread = mask.select("row", "col", F.explode(_disk_offsets(radius)).alias("_o"))
    return spread.select((F.col("row") + F.col("_o.i")).alias("row"), (F.col("col") + F.col("_o.j")).alias("col"))


def dilate(mask: DataFrame, radius: int, nrows: int | None = None, ncols: int | None = None) -> DataFrame:
    """Cells within ``radius`` of the mask (row, col); within the grid if it is given."""
    out = _moved(mask, radius).distinct()
    return out if nrows is None else out.where(F.col("row").between(0, nrows - 1) & F.col("col").between(0, ncols - 1))


def erode(mask: DataFrame, radius: int) -> DataFrame:
    """Cells of the mask whose whole disk is in the mask."""
    return _moved(mask, radius).groupBy("row", "col").count().where(F.col("count") == len(K.disk(radius))).drop("count")


def close_mask(mask: DataFrame, radius: int) -> DataFrame:
    return erode(dilate(mask, radius), radius)


def open_mask(mask: DataFrame, radius: int) -> DataFrame:
    return dilate(erode(mask, radius), radius)


def buffer_zone_cells(zone_cells: DataFrame, radius: int) -> DataFrame:
    """Cells of zones (zone_id, row, col), each zone grown by ``radius`` cells."""
    spread = zone_cells.select("zone_id", "row", "col", F.explode(_disk_offsets(radius)).alias("_o"))
    return spread.select("zone_id", (F.col("row") + F.col("_o.i")).alias("row"), (F.col("col") + F.col("_o.j")).alias("col")).distinct()
