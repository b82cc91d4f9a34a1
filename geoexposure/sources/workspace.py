"""The folder that driver and executors share, and tables kept in it to end a lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A broadcast side may have this many rows at most; above it a shuffle join is used.
BROADCAST_ROWS = 200_000
#: A kept table may have this many bytes on disk to be broadcast.
BROADCAST_BYTES = 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The shared folder, from ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="shared-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it again: the lineage ends there and lost executors cost nothing."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    kept = df.sparkSession.read.schema(df.schema).parquet(path)
    kept.kept_path = path
    return kept


def _kept(table: DataFrame):
    """The file system and path of a table that ``keep`` returned."""
    context = table.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(table.kept_path)
    return path.getFileSystem(context._jsc.hadoopConfiguration()), path


def forget(*tables: DataFrame) -> None:
    """Delete tables that ``keep`` returned and that nothing reads any more, such as those of a finished round."""
    for table in tables:
        files, path = _kept(table)
        files.delete(path, True)


def bounded(small: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``small`` with a broadcast hint if it has ``rows`` rows at most and, if it was kept, BROADCAST_BYTES on disk; else as it is."""
    if hasattr(small, "kept_path"):
        files, path = _kept(small)
        if files.getContentSummary(path).getLength() > BROADCAST_BYTES:
            return small
    return F.broadcast(small) if small.limit(rows + 1).count() <= rows else small
