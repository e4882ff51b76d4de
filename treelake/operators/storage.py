"""Extents of a volume's metadata table and use of its slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def extent_ranges(extents: DataFrame, cluster_size: int = 4096, record_size: int = 1024) -> DataFrame:
    """Per extent (next_vcn, lcn): clusters, first and last record, byte offset on disk, byte length."""
    before = F.lag("next_vcn", 1, 0).over(W.partitionBy("volume").orderBy("extent_ix"))
    per = cluster_size // record_size
    return extents.withColumn("first_vcn", before).select(
        "volume", "extent_ix", (F.col("next_vcn") - F.col("first_vcn")).alias("clusters"), (F.col("first_vcn") * per).alias("first_record"), (F.col("next_vcn") * per - 1).alias("last_record"),
        (F.col("lcn") * cluster_size).alias("byte_offset"), ((F.col("next_vcn") - F.col("first_vcn")) * cluster_size).alias("byte_length"), "lcn",
    )


def extent_summary(ranges: DataFrame) -> DataFrame:
    return ranges.groupBy("volume").agg(
        F.count(F.lit(1)).alias("extent_count"), F.sum("clusters").alias("clusters"), (F.max("last_record") + 1).alias("records"), F.sum("byte_length").alias("bytes"), (F.count(F.lit(1)) > 1).alias("fragmented")
    )


def split_extents(ranges: DataFrame, most: int) -> DataFrame:
    """Pieces of at most so many clusters."""
    pieces = ranges.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("clusters") - 1, F.lit(most).cast("long"))))
    return pieces.select("volume", "extent_ix", F.call_function("div", F.col("at"), F.lit(most)).alias("piece_ix"), F.least(F.col("clusters") - F.col("at"), F.lit(most).cast("long")).alias("clusters"), (F.col("lcn") + F.col("at")).alias("lcn"))


def block_use(slots: DataFrame, block: int) -> DataFrame:
    """Per block of slots: its slots, those in use, and the free ones before the first and behind the last in use. A block without any has all in front."""
    used = F.when(F.col("in_use"), F.col("slot"))
    b = slots.withColumn("block", F.call_function("div", F.col("slot"), F.lit(block))).groupBy("volume", "block")
    b = b.agg(F.count(F.lit(1)).alias("slots"), F.count_if("in_use").alias("in_use"), F.min("slot").alias("lo"), F.max("slot").alias("hi"), F.min(used).alias("first"), F.max(used).alias("last"))
    leading = F.coalesce(F.col("first") - F.col("lo"), F.col("slots"))
    return b.select("volume", "block", "slots", "in_use", leading.cast("long").alias("leading"), F.coalesce(F.col("hi") - F.col("last"), F.lit(0)).cast("long").alias("trailing"))


def popcount(bits: Column) -> Column:
    """Bits set in a binary column."""
    return F.bitmap_count(bits).cast("int")


def slot_bitmaps(slots: DataFrame) -> DataFrame:
    """(volume, bucket, bitmap): the slots in use as bitmaps of 32,768 slots each, which can be or-ed; slots count from 0 on, buckets from 1."""
    used = slots.filter("in_use").groupBy("volume", F.bitmap_bucket_number(F.col("slot") + 1).alias("bucket"))
    return used.agg(F.bitmap_construct_agg(F.bitmap_bit_position(F.col("slot") + 1)).alias("bitmap"))


def verified_extents(ranges: DataFrame, headers: DataFrame) -> DataFrame:
    """Whether the record found at each extent's start is the one expected there; null headers count as a mismatch."""
    found = headers.select("volume", F.col("slot").alias("first_record"), "found_record")
    return ranges.join(found, ["volume", "first_record"], "left").select("volume", "extent_ix", "first_record", "found_record", F.coalesce(F.col("found_record") == F.col("first_record"), F.lit(False)).alias("matches"))
