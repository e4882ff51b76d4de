"""Nested intervals of a folder tree: a subtree is a range of numbers, and a total a difference of two prefix sums.

Each folder begins with the ids of the folders down to it, eight bytes each, and ends behind all that begin with these.
Both ends of all folders are sorted together, by range partitions; where a partition's numbers begin follows from the sizes
of those before it, of which the driver sees one row each. Sums run the same way. So the work is one sort of two rows per
folder, however deep the tree is, and nothing is multiplied by the number of folders above.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import settled

KEY = ["volume", "node_id"]


def ends(folders: DataFrame, values: list[str]) -> DataFrame:
    """Two rows per folder in the order of the tree, with ``_at`` as Spark numbers them; values count where the folder begins; settled.

    Ids have 48 bits, so a byte of ones comes behind all that can follow a folder's own key.
    """
    key = F.unhex(F.array_join(F.transform("ids", lambda i: F.lpad(F.hex(i), 16, "0")), ""))
    begin = F.struct(F.col("_key").alias("key"), F.lit(False).alias("end"), *(F.col(v).cast("long").alias(v) for v in values))
    end = F.struct(F.concat("_key", F.lit(bytearray(b"\xff"))).alias("key"), F.lit(True).alias("end"), *(F.lit(0).cast("long").alias(v) for v in values))
    rows = folders.withColumn("_key", key).select(*KEY, F.xxhash64("_key").alias("_of"), F.explode(F.array(begin, end)).alias("e")).select(*KEY, "_of", "e.*")
    rows = rows.repartitionByRange("volume", "key").sortWithinPartitions("volume", "key").drop("key")
    return settled(rows.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id()))


def starts(rows: DataFrame, **sums) -> DataFrame:
    """(_part, and what of each sum the partitions before it hold): a row per partition."""
    parts = sorted(rows.groupBy("_part").agg(*(s.alias(n) for n, s in sums.items())).collect())
    before, out = [0] * len(sums), []
    for part, *held in parts:
        out.append((part, *before))
        before = [a + b for a, b in zip(before, held, strict=True)]
    return F.broadcast(rows.sparkSession.createDataFrame(out, ", ".join(["_part int", *(f"_{n} bigint" for n in sums)])))


def intervals(folders: DataFrame) -> DataFrame:
    """(volume, node_id, lo, hi): what lies below a folder has its lo between the folder's lo and hi; numbers are unique over all volumes."""
    rows = ends(folders.select(*KEY, "ids"), [])
    # numbers within a partition are consecutive from 0 on in their lower 33 bits
    begin = starts(rows, n=F.count(F.lit(1)))
    at = rows.join(begin, "_part").withColumn("number", F.col("_n") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    return at.groupBy(*KEY, "_of").agg(F.min("number").alias("lo"), F.max("number").alias("hi")).drop("_of")


def subtree_sums(folders: DataFrame, values: list[str]) -> DataFrame:
    """(volume, node_id, values): for each folder the sum over itself and all folders below it; folders have their own values beside their ids; a folder of several links, which has several rows, counts once for each."""
    rows = ends(folders.select(*KEY, "ids", *values), values)
    begin = starts(rows, **{v: F.sum(v) for v in values})
    inside = W.partitionBy("_part").orderBy("_at").rowsBetween(W.unboundedPreceding, 0)
    at = rows.select(*KEY, "end", "_part", *(F.col(v) for v in values), *(F.sum(v).over(inside).alias(f"_s_{v}") for v in values)).join(begin, "_part")
    # up to and with the end, less what came before the beginning
    part = {v: F.col(f"_{v}") + F.col(f"_s_{v}") for v in values}
    return at.groupBy(*KEY).agg(*(F.sum(F.when(F.col("end"), s).otherwise(F.col(v) - s)).alias(v) for v, s in part.items()))
