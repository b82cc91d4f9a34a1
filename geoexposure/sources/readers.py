"""Sources and sinks: zones, cells, boxes, GeoJSON, file catalogs, stats tables, multi-band output."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoexposure.functions import geometry as G


def read_zones(zones: DataFrame) -> DataFrame:
    """Zones with a geometry, with their bbox and area; attributes stay."""
    sound = zones.where(F.col("geom").isNotNull() & (F.size("geom") > 0))
    return sound.select("*", G.bbox(F.flatten("geom")).alias("bbox"), G.area(F.col("geom")).alias("area"))


#: Under a folder of cells: the ranges of rows and columns of its files.
RANGES = "_ranges"


def z_order(y: Column, x: Column) -> Column:
    """Number of a tile along a space-filling curve: the bits of both 32-bit numbers by turns, so that near numbers are near tiles."""

    def spread(v: Column) -> Column:
        v = (v.cast("long") + 2**31).bitwiseAND(F.lit(0xFFFFFFFF))
        for by, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            v = v.bitwiseOR(F.shiftleft(v, by)).bitwiseAND(F.lit(mask))
        return v

    return F.shiftleft(spread(y), 1).bitwiseOR(spread(x))


def write_cells(cells: DataFrame, path: str, tile: int = 256, files: int | None = None) -> None:
    """Store cells (row, col, ...) along a space-filling curve over tiles, in ``files`` files of about equal size (a file for each four tiles' worth of cells, if not given).

    Beside them, in a folder that readers of the cells skip, stand the ranges of rows and columns of each file, so a read of a window opens the files that it needs only.
    """
    rows = cells.withColumn("_z", z_order(F.floor(F.col("row") / tile), F.floor(F.col("col") / tile)))
    files = files or max(1, cells.count() // (4 * tile * tile))
    rows.repartitionByRange(files, "_z", "row", "col").sortWithinPartitions("_z", "row", "col").drop("_z").write.mode("overwrite").parquet(path)
    ends = [f(c).alias(f"{n}_{c}") for c in ("row", "col") for n, f in (("least", F.min), ("most", F.max))]
    stored = cells.sparkSession.read.parquet(path)
    stored.groupBy(F.col("_metadata.file_name").alias("file")).agg(*ends).coalesce(1).write.mode("overwrite").parquet(f"{path}/{RANGES}")


def read_cells(spark: SparkSession, path: str, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    """Cells (row, col, ...) that a box meets. The ranges go into the scan; of what ``write_cells`` stored only the files whose cells can lie in the box are opened."""
    row, col = (int(ymin // 1), int(ymax // 1)), (int(xmin // 1), int(xmax // 1))
    files = [path]
    if _there(spark, f"{path}/{RANGES}"):
        met = (F.col("most_row") >= row[0]) & (F.col("least_row") <= row[1]) & (F.col("most_col") >= col[0]) & (F.col("least_col") <= col[1])
        ranges = spark.read.parquet(f"{path}/{RANGES}")
        chosen = [r.file for r in ranges.where(met).select("file").collect()]
        if not chosen:  # one file gives the columns
            return spark.read.parquet(f"{path}/{ranges.first().file}").where("false") if not ranges.isEmpty() else spark.read.parquet(path)
        files = [f"{path}/{f}" for f in chosen]
    return spark.read.parquet(*files).where(F.col("row").between(*row) & F.col("col").between(*col))


def _there(spark: SparkSession, path: str) -> bool:
    context = spark.sparkContext
    where = context._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(context._jsc.hadoopConfiguration()).exists(where)


def bbox_filter(rows: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float, bbox: str = "bbox", subtype: str | None = None) -> DataFrame:
    """Rows whose nested bbox meets a box, and of one subtype; nested fields are pushed into a parquet scan."""
    b = F.col(bbox)
    met = (b["xmin"] < xmax) & (b["xmax"] > xmin) & (b["ymin"] < ymax) & (b["ymax"] > ymin)
    return rows.where(met if subtype is None else met & (F.col("subtype") == subtype))


def clip_to_bbox(boxes: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    """Extents (xmin, ymin, xmax, ymax) cut to a box."""
    low = {"xmin": F.greatest("xmin", F.lit(xmin)), "ymin": F.greatest("ymin", F.lit(ymin))}
    return boxes.withColumns(low | {"xmax": F.least("xmax", F.lit(xmax)), "ymax": F.least("ymax", F.lit(ymax))}).where("xmin < xmax AND ymin < ymax")


def _parts(shape: dict) -> Iterator[tuple[int, float, float, float]]:
    """(dimension, weight, x, y) of what a GeoJSON geometry is made of: points, segments by length, rings by area, holes less."""
    kind, at = shape.get("type"), shape.get("coordinates") or []
    if kind == "GeometryCollection":
        for part in shape.get("geometries") or []:
            yield from _parts(part)
    elif kind and kind.startswith("Multi"):
        for part in at:
            yield from _parts({"type": kind[5:], "coordinates": part})
    elif kind == "Point" and at:
        yield 0, 1.0, float(at[0]), float(at[1])
    elif kind in ("LineString", "Polygon"):
        for k, ring in enumerate([at] if kind == "LineString" else at):
            p = np.array([c[:2] for c in ring], float).reshape(-1, 2)
            yield from ((0, 1.0, x, y) for x, y in p.tolist())
            for (x, y), length in zip(((p[:-1] + p[1:]) / 2).tolist(), np.hypot(*(p[1:] - p[:-1]).T).tolist(), strict=True):
                yield 1, length, x, y
            if kind == "Polygon" and len(p):
                a, b = p - p[0], np.roll(p, -1, 0) - p[0]
                cross = a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]
                if cross.sum():
                    x, y = (a + b).T @ cross / (3 * cross.sum()) + p[0]
                    yield 2, abs(cross.sum()) * (-1 if k else 1), float(x), float(y)


def centroid_of(text: str | None) -> tuple[str | None, float | None, float | None]:
    """(type, lon, lat) of a GeoJSON geometry: the centroid of its parts of the highest dimension; nulls without coordinates."""
    shape = json.loads(text) if text else {}
    parts = np.array(list(_parts(shape or {})), float).reshape(-1, 4)
    for dimension in (2, 1, 0):
        own = parts[parts[:, 0] == dimension]
        total = own[:, 1].sum()
        if total > 0:
            x, y = own[0, 2:] if len(own) == 1 else own[:, 1] @ own[:, 2:] / total
            return shape.get("type"), float(x), float(y)
    return (shape or {}).get("type"), None, None


def read_geojson(texts: DataFrame, column: str = "text") -> DataFrame:
    """Features of FeatureCollection texts: id, tags (map), type, and the centroid of the geometry (lon, lat), of collections and multiples too."""
    schema = "features array<struct<id:string, properties:struct<tags:map<string,string>>, geometry:string>>"
    f = texts.select(F.explode(F.from_json(column, schema)["features"]).alias("f"))

    @F.pandas_udf("type string, lon double, lat double")
    def centre(geometry: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(map(centroid_of, geometry), columns=["type", "lon", "lat"])

    placed = f.select("f.id", "f.properties.tags", centre("f.geometry").alias("c"))
    return placed.select("id", "tags", "c.type", "c.lon", "c.lat")


def parse_catalog(names: DataFrame, column: str = "name") -> DataFrame:
    """product, day, tile and version of archive names like VNP46A3.A2026091.h21v04.002.2026100.h5, and product and start of swath names with _sYYYYDDDHHMMSST_."""
    archive = r"^(\w+)\.A(\d{4})(\d{3})\.(h\d{2}v\d{2})\.(\d{3})\."
    swath = r"^(.+?)_s(\d{4})(\d{3})(\d{2})(\d{2})(\d{2})(\d)_"
    part = lambda pattern, k: F.regexp_extract(column, pattern, k)
    day = lambda pattern: F.date_add(F.make_date(part(pattern, 2).cast("int"), F.lit(1), F.lit(1)), part(pattern, 3).cast("int") - 1)
    filed, flown = F.col(column).rlike(archive), F.col(column).rlike(swath)
    seconds = part(swath, 4).cast("int") * 36000 + part(swath, 5).cast("int") * 600 + part(swath, 6).cast("int") * 10 + part(swath, 7).cast("int")
    return names.select(
        column,
        F.when(filed, part(archive, 1)).when(flown, part(swath, 1)).alias("product"),
        F.when(filed, day(archive)).when(flown, day(swath)).alias("day"),
        F.when(filed, part(archive, 4)).alias("tile"),
        F.when(filed, part(archive, 5)).alias("version"),
        F.when(flown, seconds / 10.0).alias("second_of_day"),
    )


def write_stats(kept: DataFrame, new: DataFrame, path: str | None = None) -> DataFrame:
    """The stats table with the columns of ``new`` added or replaced; every zone stays. Written to ``path`` (a new one) if given."""
    fresh = [c for c in new.columns if c != "zone_id"]
    out = kept.drop(*fresh).join(new, "zone_id", "left")
    if path:
        out.write.mode("overwrite").parquet(path)
    return out


def bands_long(cells: DataFrame, bands: list[str]) -> DataFrame:
    """(row, col, band, value): a wide raster as long rows of floats; write with partitionBy("band")."""
    return cells.select("row", "col", *[F.col(b).cast("float").alias(b) for b in bands]).unpivot(["row", "col"], bands, "band", "value")


def write_bands(cells: DataFrame, bands: list[str], path: str) -> None:
    bands_long(cells, bands).write.mode("overwrite").partitionBy("band").parquet(path)


def area_label(country: Column, region: Column, local: Column, span: Column) -> Column:
    """Names of a box from coarse to fine, repeats left out: the country over 15 degrees, with the region over 1, with the place over 0.2 and below."""
    names = F.when(span > 15, F.array(country)).when(span > 1, F.array(country, region)).otherwise(F.array(country, region, local))
    return F.array_join(F.array_distinct(F.array_compact(F.transform(names, lambda n: F.regexp_replace(F.lower(n), r"[^\p{L}\p{N}]+", "-")))), "_")
