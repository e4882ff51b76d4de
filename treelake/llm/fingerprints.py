"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed share of the hash range, one in four, so its length follows the document's,
the sketch of a union is made from the sketches, and the containment of a small document in a large one can be estimated
from the two sketches alone. A text none of whose hashes is below the threshold keeps its smallest one, so that texts with
words have a fingerprint. Likeness and containment use what the fingerprints hold and nothing else: the standard deviation
of a likeness from u hashes is about half of one by the root of u, so texts of a few dozen words are told coarsely.

Nulls, ties, repeats: null or wordless text has an empty fingerprint; two texts without words are
alike (1), one with and one without are not (0); a text with fewer words than a shingle is one shingle; equal texts have
equal fingerprints. The order of documents is descending id, nulls last, then a hash of the text; equal rows follow each
other; a single row follows itself; an empty table gives an empty result; columns beyond doc_id and text don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, whole, words

SHINGLE = 5
#: A hash has HASH_BITS bits and is kept if the first KEEP_BITS are zero: one in four.
HASH_BITS, KEEP_BITS = 48, 2
BELOW = 1 << (HASH_BITS - KEEP_BITS)


def with_sketch(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the sketch, a sorted array of hashes, for a text column that has no nulls."""
    w, h = f"_{name}_w", f"_{name}_h"
    df = df.withColumn(w, words(F.col(text)))
    hashes = F.transform(F.sequence(F.lit(0), F.size(w) - SHINGLE), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(SHINGLE))))
    short = F.when(F.size(w) == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(F.array_join(w, " "))))
    numbers = F.transform(F.when(F.size(w) >= SHINGLE, hashes).otherwise(short), lambda x: F.shiftrightunsigned(x, 64 - HASH_BITS))
    return df.withColumn(h, numbers).withColumn(name, kept(F.col(h))).drop(w, h)


def kept(hashes: Column) -> Column:
    """The hashes below the threshold in order, or the smallest one."""
    low = F.array_sort(F.array_distinct(F.filter(hashes, lambda x: x < BELOW)))
    return F.when(F.size(low) > 0, low).otherwise(F.array_compact(F.array(F.array_min(hashes))))


def fingerprint(sketch: Column) -> Column:
    """The hashes of a sketch in order, eight letters of base 64 each."""
    digits = F.array_join(F.transform(sketch, lambda x: F.lpad(F.hex(x), HASH_BITS // 4, "0")), "")
    # Spark may break lines
    return F.translate(F.base64(F.unhex(digits)), "\r\n", "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets behind two sketches: the share of their hashes that both have."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b has; null for an empty sketch of a."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a))


def merged(a: Column, b: Column) -> Column:
    """The sketch of two documents together."""
    return kept(F.concat(a, b))


def range_of(bounds: list[int]) -> Column:
    """The number of bounds below doc_id, by halving; 0 for a null id."""
    array = F.array(*(F.lit(b).cast("long") for b in bounds)) if bounds else F.array().cast("array<bigint>")
    halves = F.array(*(F.lit(1 << b) for b in range(len(bounds).bit_length() - 1, -1, -1))) if bounds else F.array(F.lit(1))
    below = F.aggregate(halves, F.lit(0), lambda n, step: n + F.when(F.get(array, n + step - 1) < F.col("doc_id"), step).otherwise(0))
    return F.coalesce(below, F.lit(0))


def paired_with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, print (the sketch) and, in ``next``, text and print of the document that follows by descending id.

    Ids are cut into ranges at quantiles, found from the id column alone; there are four to a shuffle partition. Quantiles
    are computed as doubles and need not be ids, so each range's largest id becomes its upper bound. The row that follows
    the last one of a range is the one whose id is the bound of the range below: rows at bounds are dealt to both ranges,
    and the texts move once.
    """
    spark = docs.sparkSession
    ranges = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    steps = [k / ranges for k in range(1, ranges)]
    ids = docs.select(F.col("doc_id").cast("long"))
    cuts = sorted(set(ids.agg(F.percentile_approx("doc_id", steps, 10 * ranges)).first()[0] or []))
    # one row per range that has ids
    tops = ids.filter(F.col("doc_id").isNotNull()).groupBy(range_of(cuts).alias("range")).agg(F.max("doc_id").alias("top")).collect()
    bounds = sorted(t.top for t in tops)
    df = docs.select(F.col("doc_id").cast("long"), whole(F.col("text")).alias("text"))
    df = df.withColumn("range", range_of(bounds))
    array = F.array(*(F.lit(b).cast("long") for b in bounds)) if bounds else F.array().cast("array<bigint>")
    at_bound = F.get(array, F.col("range")).eqNullSafe(F.col("doc_id"))
    follows = F.when(at_bound, F.when(F.col("range") == max(len(bounds) - 1, 0), F.struct(F.lit(0).alias("range"), F.lit(1).alias("extra"))).otherwise(F.struct((F.col("range") + 1).alias("range"), F.lit(1).alias("extra"))))
    dealt = F.array_compact(F.array(F.struct(F.col("range").alias("range"), F.lit(0).alias("extra")), follows))
    df = df.withColumn("to", F.explode(dealt)).select("to.range", "to.extra", "doc_id", "text")
    # the texts are dealt before anything is computed, so that they travel alone
    df = with_sketch(df.repartition("range"), "text", "print")
    # in range 0 the extra rows are those of the highest range and come after the nulls; elsewhere they are lower anyhow
    order = W.partitionBy("range").orderBy("extra", F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    return df.withColumn("next", F.lead(F.struct("text", "print")).over(order)).filter("extra = 0")


def fingerprinted(docs: DataFrame) -> DataFrame:
    df = paired_with_next(docs).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    df = df.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next.text", F.lit(1), half)))
    df = with_sketch(df, "edited", "edited_print")
    return df.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("print")).alias("fingerprint"),
        fingerprint(F.col("edited_print")).alias("edited_fingerprint"),
        likeness(F.col("print"), F.col("edited_print")).alias("near_edited"),
        likeness(F.col("print"), F.col("next.print")).alias("near_next"),
        containment(F.col("print"), F.col("edited_print")).alias("in_edited"),
    )


def op10_scaled_sketches(spark, sf_dir: str) -> DataFrame:
    return fingerprinted(table(spark, sf_dir, "documents"))
