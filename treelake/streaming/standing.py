"""A search that stays: the same condition over catalog rows as they arrive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.patterns import checked, trailing_star
from ..operators.search import condition
from ..plans.paths import DATA, SEPARATOR


def arriving(spark: SparkSession, folder: str, schema: StructType, files: str | None = None, per_step: int | None = None) -> DataFrame:
    """The Parquet files that come into a folder, as a stream; files: a pattern for the names of those that count; per_step: files that a step takes at most."""
    reader = spark.readStream.schema(schema)
    for option, value in (("pathGlobFilter", files), ("maxFilesPerTrigger", per_step)):
        reader = reader.option(option, value) if value else reader
    return reader.parquet(folder)


def once(rows: DataFrame, time_column: str | None, late: str, keys: list[str]) -> DataFrame:
    """Drops repeats of the keys that arrive within the lateness, and rows that are later than that; all rows where there are no keys."""
    return rows.withWatermark(time_column, late).dropDuplicatesWithinWatermark(list(keys)) if keys else rows


def standing_search(spark: SparkSession, folder: str, schema: StructType, condition: Column, time_column: str | None = None, late: str = "1 hour", keys: list[str] = (), files: str | None = None) -> DataFrame:
    """The hits among Parquet files that come into a folder, as a stream. With keys, repeats of them within the lateness are dropped.

    files: a pattern for the names of the files that count.
    """
    return once(arriving(spark, folder, schema, files).filter(condition), time_column, late, keys)


def standing_paths(
    spark: SparkSession, folder: str, schema: StructType, pattern: str, folders: DataFrame, time_column: str | None = None, late: str = "1 hour", keys: list[str] = (), files: str | None = None, case: bool = False, per_step: int | None = None
) -> DataFrame:
    """A search pattern over links that arrive without a path: (volume, node_id, link_ix, parent_id, name, is_dir, ...) with the path from stored folders.

    folders: (volume, node_id, path), static. A link whose folder isn't among them is no hit. Links are those of default
    streams unless the rows have type_id and stream_name. Rows are joined and matched first, so that the state of repeats
    holds hits only.
    """
    rows = arriving(spark, folder, schema, files, per_step)
    more = {"type_id": F.lit(DATA), "stream_name": F.lit("")}
    rows = rows.withColumns({n: v for n, v in more.items() if n not in rows.columns})
    above = folders.select("volume", F.col("node_id").alias("parent_id"), F.col("path").alias("dir_path"))
    rows = rows.join(above, ["volume", "parent_id"])
    rows = rows.withColumn("path", F.concat("dir_path", "name", F.when(F.col("is_dir"), SEPARATOR).otherwise("")))
    pattern = trailing_star(pattern)
    if pattern.startswith(">"):
        checked(spark, pattern[1:])
    return once(rows.filter(condition(pattern, case)), time_column, late, keys)


def run_available(hits: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Processes what is there, appends it to ``out`` as Parquet and returns that table."""
    query = hits.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return hits.sparkSession.read.schema(hits.schema).parquet(out)
