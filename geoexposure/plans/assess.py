"""End-to-end plans: assess a component, detect outages, exposure of service areas.

A component's variables, in total and on the mask, come from one aggregation over its joined layer.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoexposure.functions import geometry as G
from geoexposure.functions import pixels
from geoexposure.operators import graph, outage, raster, vector, zonal
from geoexposure.operators.stats import derive
from geoexposure.plans.catalog import CATALOG, Variable, in_order


def _percentages(stats: DataFrame, variables: list[Variable]) -> DataFrame:
    wanted = {f"{v.name}_affected_percentage": zonal.affected_pct(F.col(f"{v.name}_affected"), F.col(v.name)) for v in variables if v.percentage and f"{v.name}_affected" in stats.columns}
    return stats.withColumns(wanted) if wanted else stats


def assess_raster(component: str, zones: DataFrame, weights: DataFrame, cells: DataFrame, mask: bool) -> DataFrame:
    """A raster component. ``cells``: row, col, one column for each source, and ``affected`` (boolean) if there is a mask."""
    variables = CATALOG[component]
    direct = [v for v in variables if not v.formula]
    values = {}
    for suffix, on in [("", None)] + ([("_affected", F.col("affected"))] if mask else []):
        for v in direct:
            if v.operator == "class_area":
                picked = F.col(v.source) == v.cls
                values[v.name + suffix] = ("sum", "_one", picked if on is None else picked & on)
            else:
                values[v.name + suffix] = (v.operator, v.source, on)
    stats = zonal.zonal_stats(cells.withColumn("_one", F.lit(1.0)), weights, values)
    for v in in_order(variables):
        stats = derive(stats, v.name, v.formula)
    if mask:
        for v in in_order(variables):
            stats = derive(stats, v.name, v.formula, "_affected")
    return zonal.attach_stats(zones, _percentages(stats, variables))


def assess_lines(component: str, zones: DataFrame, lines: DataFrame, mask: DataFrame | None) -> DataFrame:
    """A line component. ``lines``: fid, cls, geom; ``mask``: polygons (zone_id, geom) of the hazard; where they overlap a line counts once."""
    variables = CATALOG[component]
    pieces = vector.overlay_with_mask(lines, zones, mask)
    picked = lambda v: F.lit(True) if v.cls is None else F.col("cls") == v.cls
    sums = {v.name + suffix: F.sum(F.when(picked(v) & (F.col(c) > 1e-12), F.col(c))) for suffix, c in [("", "length")] + ([] if mask is None else [("_affected", "affected")]) for v in variables}
    found = pieces.groupBy("zone_id").agg(*[s.alias(n) for n, s in sums.items()])
    stats = zones.select("zone_id", G.area(F.col("geom")).alias("_area")).join(found, "zone_id", "left")
    for v in variables:
        for name in {v.name, v.name + "_affected"} & set(sums):
            stats = stats.withColumn(name, F.try_divide(F.col(name), F.col("_area")) if v.operator == "density" else F.coalesce(name, F.lit(0.0)))
    return zonal.attach_stats(zones, _percentages(stats.drop("_area"), variables))


def assess_buildings(zones: DataFrame, features: DataFrame, mask: DataFrame | None) -> DataFrame:
    """Footprints (fid, x, y of the centre, area) by the zone of their centre; affected where the centre's pixel is masked. Zones without any count 0."""
    tagged = vector.read_features(features, zones)
    values = [F.count("*").cast("double").alias("nbuildings"), F.sum("area").alias("buildings_area")]
    stats = tagged.groupBy("zone_id").agg(*values)
    if mask is not None:
        hit = vector.features_on_mask(tagged, mask).groupBy("zone_id").agg(F.count("*").cast("double").alias("nbuildings_affected"), F.sum("area").alias("buildings_area_affected"))
        stats = stats.join(hit, "zone_id", "left")
    stats = zones.select("zone_id").join(stats, "zone_id", "left").fillna(0.0)
    return zonal.attach_stats(zones, _percentages(stats, CATALOG["buildings"]))


COMPONENTS: dict[str, Callable] = {c: (assess_buildings if c == "buildings" else assess_lines if c in ("roads", "elegrid") else assess_raster) for c in CATALOG}


def component(name: str) -> Callable:
    """The plan of a component by its name; unknown names raise."""
    if name not in COMPONENTS:
        raise ValueError(f"unknown component {name!r}; known: {', '.join(COMPONENTS)}")
    return COMPONENTS[name]


def detect_outage(observations: DataFrame, baseline: DataFrame, nrows: int, ncols: int, least: int = 2) -> tuple[DataFrame, DataFrame]:
    """Outage cells with bands, and outage zones, from observations of several granules.

    ``observations``: row, col, granule, order, radiance, quality; ``baseline``: row, col, radiance, land_water. Granules that are
    nearly all invalid are skipped, the first clear observation of a cell counts, and outages of fewer than ``least`` connected cells go.
    """
    seen = observations.withColumn("_cloud", pixels.cloud_from_quality(F.col("quality")))
    masked = baseline.select("row", "col", pixels.analysis_mask(F.col("land_water"), F.col("radiance")).alias("_masked"))
    there = seen.join(masked, ["row", "col"], "left")
    gate = outage.invalid_share_gate(there, F.col("_cloud"), F.col("radiance").isNull() | F.coalesce("_masked", F.lit(True)), add_clouds=True)
    seen = seen.join(gate, "granule").where("keep")
    clear = raster.first_clear_observation(seen, ["order", "granule"], F.col("radiance").isNotNull() & ~(F.col("_cloud") & F.col("use_mask")))
    base = baseline.select("row", "col", pixels.log_radiance(F.col("radiance")).alias("base"), pixels.analysis_mask(F.col("land_water"), F.col("radiance")).alias("_out"))
    daily = clear.select("row", "col", pixels.log_radiance(F.col("radiance")).alias("daily"))
    both = base.join(daily, ["row", "col"], "left")
    both = both.select("row", "col", "base", F.coalesce("daily", "base").alias("daily"), (F.col("daily").isNotNull() & ~F.col("_out")).alias("valid"))
    bands = outage.outage_logdiff(both, nrows, ncols)
    zones, cells = graph.mask_to_zones(bands.where("outage"), ncols, least)
    return bands.join(cells.select("row", "col", "zone_id"), ["row", "col"], "left"), zones


def outage_population(zones: DataFrame, cells: DataFrame, people: DataFrame) -> DataFrame:
    """Outage zones with the variables of the population component: the last step of ``detect_outage``, whose results ``zones`` and ``cells`` are.

    ``people``: row, col and one column for each group, on the grid of the outages. A zone's cells count whole.
    """
    weights = cells.where("zone_id IS NOT NULL").select("zone_id", "row", "col", F.lit(1.0).alias("w"))
    return assess_raster("population", zones, weights, people, mask=False)


def service_area_exposure(edges: DataFrame, sites: DataFrame, people: DataFrame, minutes: tuple[int, ...], barriers: DataFrame | None = None) -> DataFrame:
    """People (node, people) within each contour, and with barriers, and the difference; contours count all smaller ones."""

    def within(block: DataFrame | None) -> DataFrame:
        times = graph.travel_times(edges, sites, max(minutes) * 60, block)
        counted = people.join(times, "node").select("people", F.explode(F.filter(F.array(*map(F.lit, minutes)), lambda m: F.col("seconds") <= m * 60)).alias("contour"))
        return counted.groupBy("contour").agg(F.sum("people").alias("people"))

    base = within(None)
    return base if barriers is None else graph.compare_barriers(base, within(barriers), ["people"])


def merge_components(zones: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """One table of zones with the columns of several components."""
    return reduce(lambda a, b: a.join(b.select("zone_id", *[c for c in b.columns if c not in a.columns]), "zone_id", "left"), parts, zones)
