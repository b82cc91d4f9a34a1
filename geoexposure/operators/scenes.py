"""Choosing satellite scenes and passes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoexposure.sources.workspace import keep

#: Length of a scene's pulse in seconds.
PULSE = 85.41667


def quality_score(days: Column, cloud: Column, coverage: Column) -> Column:
    """0 to 100 from nearness in time (decay of three days), clear sky and coverage, one third each."""
    # The decay and the three equal shares.
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(100.0), c.cast("double")))
    near = F.exp(-F.abs(days) / 3.0)
    return F.round((near + (1 - clamp(cloud) / 100.0) + clamp(coverage) / 100.0) * (100.0 / 3.0), 3)


def best_scenes(scenes: DataFrame, k: int, score: str = "score", by: str = "tile", tie: str = "scene_id") -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.desc(score), tie)
    return scenes.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_scene_per_tile(scenes: DataFrame) -> DataFrame:
    """Per tile the scene with full coverage first, then the least cloud, then the newest."""
    order = Window.partitionBy("tile").orderBy(F.desc(F.col("coverage") >= 100), "cloud", F.desc("ts"), "scene_id")
    return scenes.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def expand_until_found(scenes: DataFrame, needed: int, most_days: int = 365, step: int = 7) -> DataFrame:
    """(tile, steps): by how many widenings of ``step`` days the search window must grow until ``needed`` scenes lie in it.

    ``scenes``: tile, days_outside (0 within the window). Null where a window of ``most_days`` is not enough.
    """
    steps = F.ceil(F.col("days_outside") / step).cast("int")
    counted = scenes.where(F.col("days_outside") <= most_days).groupBy("tile", steps.alias("steps")).count()
    running = Window.partitionBy("tile").orderBy("steps")
    enough = counted.withColumn("_have", F.sum("count").over(running)).where(F.col("_have") >= needed)
    return scenes.select("tile").distinct().join(enough.groupBy("tile").agg(F.min("steps").alias("steps")), "tile", "left")


def expand_until_covered(
    scenes: DataFrame, cells: DataFrame, target: DataFrame | None = None, enough: int = 6, most_days: int = 365, step: int = 7, tolerance: float = 0.01, by: str = "tile"
) -> DataFrame:
    """(tile, steps, candidates, covered): by how many widenings of ``step`` days on both sides the search window must grow until its scenes cover the tile, or are exactly ``enough``.

    ``scenes``: tile, scene_id, days_outside (0 within the window; what lies in the future isn't there yet, so the window ends today). ``cells``: tile, scene_id, cell. The
    area of a tile is that of ``target`` (tile, cell), cells outside of which don't count, or else what all of ``cells`` cover; covered means that less than
    ``tolerance`` percent of it is missing. A cell is covered from the least step of its scenes on, so the cover after each step is a running sum over the
    steps and no search is repeated. Where the window would grow by more than ``most_days`` steps is null, candidates and cover are those of the widest window.
    """
    last = most_days // step
    near = scenes.select(by, "scene_id", F.greatest(F.lit(0), F.ceil(F.col("days_outside") / step)).cast("int").alias("steps")).distinct()
    near = near.groupBy(by, "scene_id").agg(F.min("steps").alias("steps")).where(F.col("steps") <= last)
    area = (cells if target is None else target).select(by, "cell").distinct()
    own = cells.select(by, "scene_id", "cell") if target is None else cells.select(by, "scene_id", "cell").join(area, [by, "cell"], "left_semi")
    first = own.join(near, [by, "scene_id"]).groupBy(by, "cell").agg(F.min("steps").alias("steps"))
    fresh = near.groupBy(by, "steps").agg(F.count("*").alias("_scenes"), F.lit(0).cast("long").alias("_cells"))
    fresh = fresh.unionByName(first.groupBy(by, "steps").agg(F.lit(0).cast("long").alias("_scenes"), F.count("*").alias("_cells"))).groupBy(by, "steps").agg(F.sum("_scenes").alias("_scenes"), F.sum("_cells").alias("_cells"))
    so_far = Window.partitionBy(by).orderBy("steps")  # a row for each step at most
    run = fresh.select(by, "steps", F.sum("_scenes").over(so_far).alias("_have"), F.sum("_cells").over(so_far).alias("_held"))
    run = run.join(area.groupBy(by).agg(F.count("*").alias("_area")), by, "left").withColumn("covered", F.coalesce(F.col("_held") * 100.0 / F.col("_area"), F.lit(0.0)))
    run = run.withColumn("_stop", (F.col("covered") >= 100.0 - tolerance) | (F.col("_have") == enough))
    widest = F.max_by(F.struct("_have", "covered"), "steps")
    found = run.groupBy(by).agg(F.min_by(F.when(F.col("_stop"), F.struct("steps", "_have", "covered")), F.when(F.col("_stop"), F.col("steps"))).alias("_found"), widest.alias("_widest"))
    out = scenes.select(by).distinct().join(found, by, "left")
    pick = lambda c: F.coalesce(f"_found.{c}", f"_widest.{c}", F.lit(0))
    return out.select(by, F.col("_found.steps").alias("steps"), pick("_have").cast("long").alias("candidates"), pick("covered").cast("double").alias("covered"))


def latest_available_month(wanted: DataFrame, months: DataFrame, back: int = 3) -> DataFrame:
    """Each wanted month (id, month) with the latest month that has data, ``back`` months before it at most."""
    tried = wanted.withColumn("_m", F.explode(F.transform(F.sequence(F.lit(0), F.lit(back)), lambda k: F.add_months("month", -k))))
    found = tried.join(months.select(F.col("month").alias("_m")).distinct(), "_m").groupBy("id").agg(F.max("_m").alias("found"))
    return wanted.join(found, "id", "left")


def greedy_cover(cells: DataFrame, by: str = "tile", most: int = 10, target: DataFrame | None = None, rest: float = 0.001) -> DataFrame:
    """(tile, rank, added): the scenes that a walk in the order of ``rank`` takes because they add cells, and how many.

    ``cells``: tile, rank, cell. A scene adds exactly the cells that no scene before it has, so the first rank of each cell
    tells it without a walk; the first ``most`` such scenes count, and none after those that leave less than ``rest`` of the area.
    The area of a tile is that of ``target`` (tile, cell), cells outside of which don't count, or else what all its scenes cover.
    """
    if target is not None:
        target = target.select(by, "cell").distinct()
        cells = cells.join(target, [by, "cell"], "left_semi")
    taken = cells.groupBy(by, "cell").agg(F.min("rank").alias("rank")).groupBy(by, "rank").agg(F.count("*").alias("added"))
    order = Window.partitionBy(by).orderBy("rank")
    if target is None:
        taken = taken.withColumn("_area", F.sum("added").over(Window.partitionBy(by)))
    else:
        taken = taken.join(target.groupBy(by).agg(F.count("*").alias("_area")), by)
    before = F.coalesce(F.sum("added").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = taken.withColumn("_n", F.row_number().over(order)).withColumn("_left", F.col("_area") - before)
    return taken.where((F.col("_n") <= most) & (F.col("_left") >= F.col("_area") * rest)).drop("_n", "_area", "_left")


def prune_similar(cells: DataFrame, by: str = "tile", similar: float = 0.5) -> DataFrame:
    """(tile, rank) of scenes that are kept: one that shares more than ``similar`` of its union with the cover so far is left out, the first never.

    Which scenes the cover holds depends on all before, so a tile's scenes are walked through in one task, one after the other. Spark packs the cells of a scene
    into words of 64 bits first, so what comes to the task is a few words for each scene, and the task holds a batch of them and the words of the cover.
    """

    def walk(batches):
        import pandas as pd

        tile, cover, held = None, {}, 0
        for batch in batches:
            kept = []
            for key, rank, words, bits in zip(batch[by], batch["rank"], batch["words"], batch["bits"], strict=True):
                if tile is None or key != tile:
                    tile, cover, held = key, {}, 0
                own = dict(zip(words.tolist(), (int(b) % 2**64 for b in bits), strict=True))
                size, both = sum(b.bit_count() for b in own.values()), sum((b & cover.get(w, 0)).bit_count() for w, b in own.items())
                if not held or both / (size + held - both) <= similar:
                    cover |= {w: b | cover.get(w, 0) for w, b in own.items()}
                    held += size - both
                    kept.append((key, int(rank)))
            yield pd.DataFrame(kept, columns=[by, "rank"])

    cell = F.col("cell").cast("long")
    words = cells.groupBy(by, "rank", F.floor(cell / 64).alias("_w")).agg(F.expr("bit_or(shiftleft(1L, CAST(pmod(cell, 64) AS INT)))").alias("_b"))
    rows = words.groupBy(by, "rank").agg(F.sort_array(F.collect_list(F.struct("_w", "_b"))).alias("_c")).select(by, "rank", F.col("_c._w").alias("words"), F.col("_c._b").alias("bits"))
    return rows.repartition(by).sortWithinPartitions(by, "rank").mapInPandas(walk, f"{by} {cells.schema[by].dataType.simpleString()}, rank int")


def minimum_covers(cells: DataFrame, target: DataFrame, by: str = "box", most: int | None = None) -> DataFrame:
    """(box, ids, covered, pct): of each box the smallest set of granules (of any number, or of up to ``most``) that covers the most of its target cells, then the lowest ids.

    ``cells``: box, granule, cell; ``target``: box, cell. A box without a granule on its target has no row. Cells of a box that the same granules hold count as one, a set
    of granules is a word of bits (62 granules of a box at most; more end the job), and sets of one more granule come from those of the round before, as rows. A box
    is done once a set covers all that any can; there is a round for each size that some box needs.
    """
    own = cells.join(target.select(by, "cell").distinct(), [by, "cell"], "left_semi").select(by, "granule", "cell").distinct()
    names = own.groupBy(by).agg(F.sort_array(F.collect_set("granule")).alias("_names"))
    names = names.withColumn("_names", F.when(F.size("_names") <= 62, F.col("_names")).otherwise(F.raise_error(F.lit("more than 62 granules over a box"))))
    total = target.groupBy(by).agg(F.countDistinct("cell").alias("_total"))
    # The first granule by name has the highest bit, so of two sets of one size the one with the lower names is the larger number.
    numbered = names.select(by, F.posexplode("_names").alias("_k", "granule")).select(by, "granule", F.expr("shiftleft(1L, 61 - _k)").alias("_bit"))
    held = own.join(numbered, [by, "granule"]).groupBy(by, "cell").agg(F.expr("bit_or(_bit)").alias("_bits")).groupBy(by, "_bits").agg(F.count("*").alias("_n"))
    boxes = held.groupBy(by).agg(F.collect_list(F.struct("_bits", "_n")).alias("_held"), F.sum("_n").alias("_reach"))
    boxes = keep(boxes.join(names, by).join(total, by), "cover-boxes")
    single = boxes.select(by, F.explode(F.sequence(F.lit(0), F.size("_names") - 1)).alias("_last")).selectExpr(f"{by}", "_last", "shiftleft(1L, 61 - _last) AS _set")
    covered = F.expr("aggregate(_held, 0L, (n, h) -> n + IF((h._bits & _set) != 0, h._n, 0L))")
    sets, open_boxes, best, size = single, boxes, [], 1
    while True:
        scored = keep(sets.join(open_boxes, by).select(by, "_last", "_set", covered.alias("_covered"), "_reach", F.size("_names").alias("_size")), "cover-sets")
        best.append(scored.groupBy(by).agg(F.max(F.struct("_covered", F.lit(-size).alias("_less"), "_set")).alias("_b")))
        left = scored.groupBy(by).agg(F.max("_covered").alias("_c"), F.first("_reach").alias("_r"), F.first("_size").alias("_s")).where((F.col("_c") < F.col("_r")) & (F.col("_s") > size))
        if size == most or left.isEmpty():
            break
        wider = scored.join(left.select(by), by, "left_semi").where("_last < _size - 1")
        sets = wider.select(by, "_set", F.explode(F.sequence(F.col("_last") + 1, F.col("_size") - 1)).alias("_last")).selectExpr(by, "_last", "_set | shiftleft(1L, 61 - _last) AS _set")
        open_boxes, size = boxes.join(left.select(by), by, "left_semi"), size + 1
    chosen = reduce(DataFrame.unionByName, best).groupBy(by).agg(F.max("_b").alias("_b")).join(boxes.select(by, "_names", "_total"), by)
    ids = F.expr("filter(_names, (g, k) -> (_b._set & shiftleft(1L, 61 - k)) != 0)")
    return chosen.select(by, ids.alias("ids"), F.col("_b._covered").cast("int").alias("covered"), (F.col("_b._covered") * 100.0 / F.col("_total")).alias("pct"))


def minimum_cover(cells: DataFrame, target: DataFrame, most: int | None = None) -> DataFrame:
    """(ids, covered, pct): ``minimum_covers`` of one box. ``cells``: granule, cell; ``target``: cell."""
    return minimum_covers(cells.withColumn("_box", F.lit(0)), target.withColumn("_box", F.lit(0)), "_box", most).drop("_box")


def scene_filter(scenes: DataFrame, overlap: float, most_cloud: float, assets: list[str]) -> DataFrame:
    """Scenes with more than ``overlap`` percent overlap, less cloud than the limit (none if it is 0) and all assets."""
    cloud = F.col("cloud") == 0 if most_cloud == 0 else F.col("cloud") < most_cloud
    there = F.size(F.array_except(F.array(*map(F.lit, assets)), F.col("assets"))) == 0
    return scenes.where((F.col("overlap") > overlap) & cloud & there)


def pass_offset_km(lon: Column, lat: Column, track_lon: Column) -> Column:
    return (F.abs(lon - track_lon) * 111.32 * F.cos(F.radians(lat))).cast("int")


def snap_to_pulse(seconds: Column, phase: float) -> Column:
    """Start of the pulse in which a time (seconds) lies."""
    return F.floor((seconds - phase) / PULSE) * PULSE + phase


def match_minute(passes: DataFrame, files: DataFrame, tolerance: int = 60) -> DataFrame:
    """Passes (pass_id, t) with the files (file_id, ft) of up to ``tolerance`` seconds off; they meet on whole buckets of time."""
    near = files.withColumn("_b", F.explode(F.array(*[F.floor(F.col("ft") / tolerance) + i for i in (-1, 0, 1)])))
    met = passes.withColumn("_b", F.floor(F.col("t") / tolerance)).join(near, "_b").drop("_b")
    return met.where(F.abs(F.col("t") - F.col("ft")) <= tolerance)


def granule_rank(elevation: Column, cloud: Column) -> Column:
    """int(0.4 elevation share + 0.6 clear share); elevation alone where the cloud is unknown."""
    share = (elevation / 90.0 * 100.0).cast("int")
    return F.when(cloud.isNull(), share).otherwise((share * 0.4 + (100 - cloud) * 0.6).cast("int"))


def rank_granules(granules: DataFrame) -> DataFrame:
    return granules.withColumn("rank_score", granule_rank(F.col("elevation"), F.col("cloud"))).orderBy(F.desc("rank_score"), "granule")


def complete_tile_set(files: DataFrame, expected: int) -> DataFrame:
    """The products (in name order the first per day) that have all expected tiles and one timestamp. ``files``: day, product, tile, ts."""
    whole = files.groupBy("day", "product").agg(F.countDistinct("tile").alias("_t"), F.countDistinct("ts").alias("_s")).where((F.col("_t") == expected) & (F.col("_s") == 1))
    return whole.groupBy("day").agg(F.min("product").alias("product"))


def complete_tile_set_by_route(files: DataFrame, expected: int, levels: list[str], routes: list[str]) -> DataFrame:
    """(day, level, route, product, ts, first): for each level the first route, in the order of ``routes``, whose files are whole; ``first`` marks the first such level in the order of ``levels``.

    ``files``: day, level, route, product, tile, ts. Of a level and route the first product by name counts: it is whole if it has all ``expected`` tiles and one
    timestamp. Levels and routes that are not named take no part. All alternatives are ranked in one aggregation, none is tried after another.
    """
    order = lambda names, c: F.array_position(F.array(*map(F.lit, names)), F.col(c))
    known = files.withColumn("_l", order(levels, "level")).withColumn("_r", order(routes, "route")).where("_l > 0 AND _r > 0")
    sets = known.groupBy("day", "_l", "level", "_r", "route", "product").agg(F.countDistinct("tile").alias("_t"), F.countDistinct("ts").alias("_s"), F.min("ts").alias("ts"))
    by_route = sets.groupBy("day", "_l", "level", "_r", "route").agg(F.min_by(F.struct("product", "ts", "_t", "_s"), "product").alias("_p"))
    whole = by_route.where((F.col("_p._t") == expected) & (F.col("_p._s") == 1))
    best = whole.groupBy("day", "_l", "level").agg(F.min_by(F.struct("route", "_p.product", "_p.ts"), "_r").alias("_b"))
    first = F.col("_l") == F.min("_l").over(Window.partitionBy("day"))  # a row for each level
    return best.select("day", "level", "_b.route", "_b.product", "_b.ts", first.alias("first"))


def coverage_pct(a: DataFrame, b: DataFrame) -> DataFrame:
    """(coverage, similarity) in percent of two footprints as cell sets: share of b, and share of the union."""
    side = lambda df, s: df.select("cell").distinct().withColumn(s, F.lit(1))
    met = side(a, "_a").join(side(b, "_b"), "cell", "full_outer")
    both = F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1))
    return met.agg((both * 100.0 / F.count("_b")).alias("coverage"), (both * 100.0 / F.count("*")).alias("similarity"))
