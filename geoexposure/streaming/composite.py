"""First clear observations as a stream: granules arrive as files, each cell keeps its first valid one, however late it comes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_cells(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 8) -> DataFrame:
    """Observations from parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def first_clear_stream(observations: DataFrame, order: list[str], valid: Column) -> DataFrame:
    """Of each cell (row, col) the first valid observation by ``order``, with all columns: what ``first_clear_observation`` finds in a batch.

    The state is that one observation for each cell of the grid. In update mode a cell is given when it is first seen, and again only when an observation that is
    earlier in order arrives after it and takes its place.
    """
    rest = [c for c in observations.columns if c not in ("row", "col")]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    return observations.where(valid).groupBy("row", "col").agg(first).select("row", "col", "_first.*")


def follow(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write what changes, a folder for each batch, which a repeated batch replaces; runs until all that is there has been read."""

    def store(changes: DataFrame, batch: int) -> None:
        changes.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(store).start()


def current(spark: SparkSession, path: str) -> DataFrame:
    """The composite that ``follow`` has written so far: each cell as its last batch has it."""
    stored = spark.read.parquet(path)
    rest = [c for c in stored.columns if c not in ("row", "col", "batch")]
    return stored.groupBy("row", "col").agg(F.max_by(F.struct(*rest), "batch").alias("_last")).select("row", "col", "_last.*")
