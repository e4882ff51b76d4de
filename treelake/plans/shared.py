"""Tables in the shared folder: they cut lineage in loops and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir. Where that is unset a local session gets a temporary folder; a cluster has none that all share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='treelake-')}"
    return f"{base}/treelake-{uuid.uuid4().hex}"


def settled(df: DataFrame, by: str | None = None) -> DataFrame:
    """The same rows, written and read back; by: a column to partition the files by."""
    path = scratch(df.sparkSession)
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names directly below a path, on any file system; none if it isn't there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in files.listStatus(at)) if files.exists(at) else []


def removed(spark: SparkSession, path: str) -> None:
    """Deletes what lies at a path, on any file system."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Rows of a task that joins or sorts.
TASK_ROWS = 1 << 19


def parts_for(stored: DataFrame) -> int:
    """Parts to deal a stored table into: as many as shuffles have, or more, so that each has about so many rows at most. Parquet's footers tell the rows."""
    return max(int(stored.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-stored.count() // TASK_ROWS))
