"""Exact dedup over an extendible-hash index in shared files.

Texts are keyed by their 64-bit hash. A directory maps the leading bits of a key to a bucket: it doubles (one more bit) wherever a bucket
holds more keys than its capacity, until none does. Whole texts then go to the tasks that own their buckets, by ranges of
keys; there equal keys chain, and what chains is compared byte by byte. The owners write the index to shared files, in the order of buckets and
keys, and each document reads from it which row its text keeps. Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoexposure.llm.shared import bounded, keep

#: Keys that a bucket holds before it splits, and rows (as a multiple of it) that one owner takes from a bucket.
CAPACITY, ROWS = 4096, 4
#: Bits by which keys are counted in one pass; the directory doubles up to so often between two passes.
PASS_BITS = 8


def directory(keys: DataFrame, capacity: int = CAPACITY, bits: int = PASS_BITS) -> list[tuple[int, DataFrame]]:
    """The directory of an extendible hash over ``keys`` (a row for each distinct _key, and its number of rows n).

    A list of (level, table) in which every key has one entry, under its leading ``level`` bits: _prefix, _bucket (the least key that
    could be in it), _depth (its number of bits) and _owners. A bucket of more than ``capacity`` keys splits, at any depth, so none stays
    overfull; every prefix under a bucket points to it.
    """
    out, depth, left = [], 0, keys
    while True:
        before, depth = depth, min(64, depth + bits)
        cells = left.groupBy(F.shiftrightunsigned("_key", 64 - depth).alias("_cell")).agg(F.count("*").alias("_n"), F.sum("n").alias("_rows"))
        nodes = cells.select("*", F.explode(F.sequence(F.lit(before), F.lit(depth))).alias("_depth"))
        nodes = nodes.groupBy("_depth", F.expr(f"shiftrightunsigned(_cell, {depth} - _depth)").alias("_node")).agg(F.sum("_n").alias("_n"), F.sum("_rows").alias("_rows"))
        nodes = keep(nodes, "dedup-nodes")
        full = nodes.where(F.col("_n") > capacity)
        parents = full.select((F.col("_depth") + 1).alias("_depth"), F.col("_node").alias("_parent"))
        held = nodes.where(F.col("_n") <= capacity).withColumn("_parent", F.shiftrightunsigned("_node", 1))
        leaves = held.where(F.col("_depth") > before).join(parents, ["_depth", "_parent"], "left_semi")
        leaves = leaves.unionByName(held.where("_depth = 0").select(leaves.columns))
        spread = F.expr(f"sequence(shiftleft(_node, {depth} - _depth), shiftleft(_node, {depth} - _depth) + (shiftleft(1L, {depth} - _depth) - 1))")
        owners = F.ceil(F.col("_rows") / (capacity * ROWS)).cast("int").alias("_owners")
        entries = leaves.select(F.explode(spread).alias("_prefix"), F.expr("shiftleft(_node, 64 - _depth)").alias("_bucket"), "_depth", owners)
        out.append((depth, keep(entries, "dedup-directory")))
        full = full.where(F.col("_depth") == depth).select(F.col("_node").alias("_full"))
        if depth == 64 or full.isEmpty():
            return out
        left = left.join(bounded(full), F.shiftrightunsigned("_key", 64 - depth) == F.col("_full"), "left_semi")


def placed(rows: DataFrame, known: list[tuple[int, DataFrame]]) -> DataFrame:
    """``rows`` (_key) with the _bucket and its number of _owners; a key outside the directory ends the job."""
    bucket, owners = F.lit(None).cast("long"), F.lit(None).cast("int")
    for k, (level, table) in enumerate(known):
        entry = bounded(table.select(F.col("_prefix").alias(f"_p{k}"), F.col("_bucket").alias(f"_b{k}"), F.col("_owners").alias(f"_o{k}")))
        rows = rows.join(entry, F.shiftrightunsigned("_key", 64 - level) == F.col(f"_p{k}"), "left")
        bucket, owners = F.coalesce(bucket, f"_b{k}"), F.coalesce(owners, f"_o{k}")
    rows = rows.withColumns({"_bucket": F.coalesce(bucket, F.raise_error(F.lit("a key is outside the directory")).cast("long")), "_owners": owners})
    return rows.drop(*[f"_{c}{k}" for k in range(len(known)) for c in "pbo"])


def _body() -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def directory_of(docs: DataFrame, capacity: int = CAPACITY, bits: int = PASS_BITS) -> list[tuple[int, DataFrame]]:
    """The directory of the keys of ``docs``."""
    keys = docs.select(F.xxhash64(_body()).alias("_key")).groupBy("_key").agg(F.count("*").alias("n"))
    return directory(keep(keys, "dedup-keys"), capacity, bits)


def index_of(docs: DataFrame, known: list[tuple[int, DataFrame]]) -> DataFrame:
    """The index in shared files by key range: _bucket, _key, text_sha256, keep_id, group_size, for each distinct text.

    Rows go to owners by (bucket, key). A bucket of many rows has several owners, among which each task deals its rows out, so copies of one
    text never gather in one task; what owners of one bucket have found is then joined, byte by byte again.
    """
    keyed = docs.select("doc_id", _body().alias("_text"), F.spark_partition_id().alias("_part")).withColumn("_key", F.xxhash64("_text"))
    routed = placed(keyed, known).withColumn("_owner", F.pmod("_part", "_owners"))
    routed = routed.repartitionByRange("_bucket", "_key", "_owner")
    # Grouped where they are: ranges of a part of these columns hold whole groups.
    chains = routed.groupBy("_bucket", "_key", "_owner", "_owners", "_text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    again = F.when(F.col("_owners") > 1, F.col("_text")).alias("_again")
    chains = keep(chains.select("_bucket", "_key", F.sha2("_text", 256).alias("text_sha256"), again, "keep_id", "group_size"), "dedup-chains")
    entries = chains.repartitionByRange("_bucket", "_key").groupBy("_bucket", "_key", "text_sha256", "_again").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    return keep(entries.drop("_again").sortWithinPartitions("_bucket", "_key"), "dedup-index")


def duplicates(docs: DataFrame, capacity: int = CAPACITY, bits: int = PASS_BITS, known: list[tuple[int, DataFrame]] | None = None) -> DataFrame:
    """For each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their bytes are; a null text counts as empty, and a very long one is compared whole. Of equal texts the row with the
    largest doc_id stays (a null id is below all others and stays only alone). If that row is repeated
    with the same id, one of the repeats is kept. An empty table gives an empty table; other columns, of whatever names, are ignored.
    Only rows whose text has copies meet their entry, in a join that Spark can split where one text holds many rows; repeats of one
    row are told apart by the partition that they are read in, so they do not gather either. ``known``: a directory made before.
    """
    known = directory_of(docs, capacity, bits) if known is None else known
    index = index_of(docs, known)
    rows = docs.select("doc_id", F.xxhash64(_body()).alias("_key"), F.sha2(_body(), 256).alias("text_sha256"), F.spark_partition_id().alias("_part"))
    several = index.where("group_size > 1").select("_bucket", "_key", "text_sha256", "keep_id", "group_size")
    rows = placed(rows, known).join(several, ["_bucket", "_key", "text_sha256"], "left")
    alone = F.col("group_size").isNull()
    rows = rows.select("doc_id", "_key", "text_sha256", "_part", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"))
    rows = keep(rows, "dedup-rows")
    own = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    repeats = rows.where(own & (F.col("group_size") > 1)).groupBy("_key", "text_sha256").agg(F.min("_part").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    met = rows.join(bounded(keep(repeats.select("_key", "text_sha256", "_first"), "dedup-repeats")), ["_key", "text_sha256"], "left")
    one = F.row_number().over(Window.partitionBy("_key", "text_sha256", "_part", "doc_id").orderBy(F.lit(1))) == 1
    first = F.col("_first").isNull() | ((F.col("_part") == F.col("_first")) & one)
    return met.select("doc_id", "keep_id", "group_size", (own & first).alias("kept"), "text_sha256")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    found = keep(duplicates(docs), "dedup-found")
    own = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    gone = bounded(keep(found.where(~own).select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha")).distinct(), "dedup-gone"))
    repeated = bounded(keep(found.where(~F.col("kept") & own).select(F.col("text_sha256").alias("_again")).distinct(), "dedup-again"))
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), docs["doc_id"].alias("key"), F.sha2(F.coalesce(docs["text"].cast("string"), F.lit("")), 256).alias("sha"), F.spark_partition_id().alias("part"))
    rows = rows.join(gone, rows["key"].eqNullSafe(gone["_id"]) & (rows["sha"] == gone["_sha"]), "left_anti")
    # What is left of a text are repeats of one row: first one of each partition, then one of those.
    same = F.col("sha") == F.col("_again")
    again = rows.join(repeated, same, "left_semi")
    for by in (["sha", "part"], ["sha"]):
        again = again.withColumn("turn", F.row_number().over(Window.partitionBy(*by).orderBy("part"))).where("turn = 1").drop("turn")
    return rows.join(repeated, same, "left_anti").unionByName(again).select("row.*")


DUPLICATES_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, coalesce(text, '') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, CAST(count(*) OVER g AS BIGINT) AS group_size,
       (doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AND row_number() OVER (PARTITION BY body, doc_id) = 1) AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY body)
"""
