"""Sharding by a Hilbert curve: quantise several metadata dimensions, order by the curve, cut the order into runs.

Rows near each other on the curve are near each other in every dimension, so each shard covers a small box of the
metadata space and a filter on any of the dimensions skips most shards. Languages and sources are quantised in the order
of their names, by equal row counts as far as names allow; sizes by half powers of two. The runs have equal row counts
(law "rows").
The curve has a fixed number of cells; ranks come from the counts of the cells and of hash parts of crowded cells, so
that neither a sort of all rows nor one task per cell is needed. One-task windows see a row per cell or per name.

Nulls, ties, repeats: a null dimension has a slot of its own; null text has size 8 and checksum 0; rows with one id
follow each other by size and checksum; identical rows get a slot each; an empty table gives an empty result; other
columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import settle, table, whole

#: Bits of each of the three dimensions: at most 32,768 cells, whatever the input.
BITS, DIMENSIONS, SHARDS = 5, 3, 24
#: A cell with more rows is ranked in parts of about this many, up to PARTS of them.
PART_ROWS, PARTS = 1024, 1 << 16


def hilbert_index(axes: Column, dimensions: int, bits: int) -> Column:
    """The place on the Hilbert curve of a point given as an array of ``dimensions`` longs below 2 ** bits.

    Two folds: one undoes the rotation of each sub-cube from the highest bit down, one turns the Gray code into the
    binary index; then the bits of the axes are interleaved.
    """
    steps = F.array(*(F.struct(F.lit(1 << b).cast("long").alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(dimensions)))

    def turned(point: Column, step: Column) -> Column:
        here, low = F.get(point, step["i"]), step["q"] - 1
        flip = here.bitwiseAND(step["q"]) != 0
        swap = F.get(point, F.lit(0)).bitwiseXOR(here).bitwiseAND(low)
        return F.transform(point, lambda x, j: F.when(flip, F.when(j == 0, x.bitwiseXOR(low)).otherwise(x)).when((j == 0) | (j == step["i"]), x.bitwiseXOR(swap)).otherwise(x))

    point = F.aggregate(steps, axes, turned)
    gray = F.aggregate(F.sequence(F.lit(1), F.lit(dimensions - 1)), point, lambda p, i: F.transform(p, lambda x, j: F.when(j == i, x.bitwiseXOR(F.get(p, i - 1))).otherwise(x)))

    def carried(p: Column) -> Column:
        last = F.get(p, F.lit(dimensions - 1))
        levels = F.array(*(F.lit(1 << b).cast("long") for b in range(bits - 1, 0, -1)))
        mask = F.aggregate(levels, F.lit(0).cast("long"), lambda t, q: F.when(last.bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))
        return F.struct(p.alias("p"), mask.alias("mask"))

    flat = F.transform(F.array(carried(gray)), lambda s: F.transform(s["p"], lambda x: x.bitwiseXOR(s["mask"])))
    places = F.array(*(F.struct(F.lit(1 << b).cast("long").alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, -1, -1) for i in range(dimensions)))
    bit = lambda s: (F.get(F.get(flat, F.lit(0)), s["i"]).bitwiseAND(s["q"]) != 0).cast("long")
    return F.aggregate(places, F.lit(0).cast("long"), lambda h, s: h * 2 + bit(s))


def name_codes(docs: DataFrame, column: str) -> list[tuple[str, int]]:
    """(least name, code) of each code in use, at most 2 ** BITS - 1: names in their order, cut by counts of rows."""
    counts = docs.select(F.col(column).alias("name")).filter(F.col("name").isNotNull()).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("name").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("n").over(W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    code = F.call_function("div", before * ((1 << BITS) - 1), total) + 1
    return sorted((r.name, r.code) for r in counts.select("name", code.alias("code")).groupBy("code").agg(F.min("name").alias("name")).collect())


def name_code(column: str, codes: list[tuple[str, int]]) -> Column:
    """The code of a name; 0 for null."""
    return F.coalesce(*(F.when(F.col(column) >= name, F.lit(code)) for name, code in reversed(codes)), F.lit(0)).cast("long")


def quantised(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, size, checksum and its cell: language and source by name, size by half powers of two."""
    size = (F.octet_length(whole(F.col("text"))) + 8).cast("long")
    return docs.select(
        "doc_id",
        size.alias("size"),
        F.crc32(whole(F.col("text"))).alias("text_crc32"),
        name_code("lang", name_codes(docs, "lang")).alias("x0"),
        name_code("source", name_codes(docs, "source")).alias("x1"),
        F.least(F.floor(F.log2(size.cast("double")) * 2) - 6, F.lit((1 << BITS) - 1)).cast("long").alias("x2"),
    )


AXES = ["x0", "x1", "x2"]


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard and its place on the curve."""
    rows = settle(quantised(docs))
    cells = rows.groupBy(*AXES).agg(F.count(F.lit(1)).alias("n"))
    cells = cells.withColumn("curve", hilbert_index(F.array(*AXES), DIMENSIONS, BITS))
    ahead = W.orderBy("curve").rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    cells = cells.withColumns({"cell_start": F.coalesce(F.sum("n").over(ahead), F.lit(0)), "total": F.sum("n").over(everything)})
    cells = cells.withColumn("parts", F.least(F.ceil(F.col("n") / PART_ROWS), F.lit(PARTS)))
    # settled: Spark would otherwise infer a filter on the curve index and work it out for every row
    cells = settle(cells)
    # one row per cell of the grid: 32,768 at most
    placed = rows.join(F.broadcast(cells.drop("n")), AXES).withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")))
    parts = placed.groupBy("curve", "part").agg(F.count(F.lit(1)).alias("n"))
    parts = parts.withColumn("part_start", F.coalesce(F.sum("n").over(W.partitionBy("curve").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    ranked = placed.join(parts, ["curve", "part"])
    inside = F.row_number().over(W.partitionBy("curve", "part").orderBy("doc_id", "size", "text_crc32")) - 1
    ranked = ranked.withColumn("rank", F.col("cell_start") + F.col("part_start") + inside)
    ranked = ranked.withColumn("shard", F.expr(f"CAST((rank * {shards}) div total AS INT)"))
    first = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    return ranked.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("rank") - first).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve", *AXES)


def op8_hilbert_shards(spark, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents")).drop(*AXES)
