"""Streams from the raw attributes of records: their sizes, and the parts of folder indexes merged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The attribute codes of a folder index and the name of its parts; the record and stream of bad clusters.
INDEX_CODES, INDEX_NAME = (0x90, 0xA0, 0xB0), "$I30"
BAD_NODE, BAD_NAME = 8, "$Bad"


def sized_attributes(attributes: DataFrame) -> DataFrame:
    """Adds length and allocated.

    A resident attribute has the length of its value and nothing allocated; any other has its data's size, and what is
    allocated for it, or for its compressed form where it has one. The stream of bad clusters counts by what of it was
    ever written.
    """
    c = F.col
    bad = (c("node_id") == BAD_NODE) & (c("name") == BAD_NAME)
    length = F.when(c("resident"), c("value_length")).when(bad, c("initialized_size")).otherwise(c("data_size"))
    allocated = F.when(c("resident"), F.lit(0)).when(bad, c("initialized_size")).otherwise(F.coalesce("compressed_size", "allocated_size"))
    return attributes.withColumns({"length": length.cast("long"), "allocated": allocated.cast("long")})


def merged_streams(attributes: DataFrame) -> DataFrame:
    """(volume, node_id, type_id, name, length, allocated, is_sparse, parts): the parts of a folder's index are one nameless stream of type 0, others go by type and name."""
    index = F.col("code").isin(*INDEX_CODES) & (F.col("name") == INDEX_NAME)
    type_id = F.when(index, 0).otherwise(F.shiftright("code", 4))
    rows = sized_attributes(attributes).withColumns({"type_id": type_id, "name": F.when(index, "").otherwise(F.col("name"))})
    return rows.groupBy("volume", "node_id", "type_id", "name").agg(F.sum("length").alias("length"), F.sum("allocated").alias("allocated"), F.bool_or("sparse").alias("is_sparse"), F.count(F.lit(1)).alias("parts"))
