"""Substring dedup: hash the lines of all texts and what they hold, keep each one's earliest place, cut the rest.

A unit is a line, a sentence of a line, a clause of a long sentence, or a paragraph with lines too short to be units. It is
long enough by its words or by its characters: writing without spaces is one word, whatever its length. A part with all
the words of its whole is no unit of its own. What repeats without being a unit stays: a passage that begins or ends
inside a clause keeps that clause's words in every copy. A unit is
normalised (lower case, words only, one space between them) and hashed to 128 bits. The digests of all documents are
counted, and of each that is there more than once the occurrence ranked first stays, ranked by document id (null last),
text hash and offset; all the others are cut from their texts. A line goes with its line feed, a sentence with the spaces
after it. Cut units that touch or overlap make one span. The offsets cut are those of the input, in code points.

Nulls, ties, repeats: a null text stays null; rows with equal id and text are one document and are cut alike; rows with
one id and different texts are ranked by a hash of the text; empty and short units are never cut; an empty table gives an
empty result; columns beyond doc_id and text pass through untouched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from .common import releasing, settle, table, with_columns_of, with_rest

MIN_LINE_WORDS, MIN_SENTENCE_WORDS, MIN_CLAUSE_WORDS = 5, 6, 8
#: Word characters of a unit with fewer words; a sentence is long beyond so many words or word characters.
MIN_CHARS, LONG_WORDS, LONG_CHARS = 30, 12, 60
WORDS = re.compile(r"\w+")
#: Where a sentence ends within a line, and a clause within a sentence; the next one begins behind the spaces.
STOP = re.compile(r"""[.!?؟۔।]+["'”’»)\]]*[^\S\n]+|[。！？｡]+[”’」』）]*[^\S\n]*""")
PAUSE = re.compile(r"[,;:،؛]+[^\S\n]+|[，、；：､]+[^\S\n]*")
BATCH_UNITS = 50_000
#: What can be a unit.
LEVELS = ("paragraph", "line", "sentence", "clause")


def beyond(words: list[str], n_words: int, n_chars: int) -> bool:
    return len(words) >= n_words or sum(map(len, words)) >= n_chars


def pieces(text: str, start: int, end: int, mark: re.Pattern) -> Iterator[tuple[int, int, list[str]]]:
    """(start, end, words) of what the marks divide a stretch of text into."""
    cuts = [start, *(m.end() for m in mark.finditer(text, start, end)), end]
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield a, b, WORDS.findall(text[a:b].lower())


def units(text: str, levels: tuple[str, ...] = LEVELS) -> Iterator[tuple[int, int, bytes]]:
    """(start, end, normalised bytes) of each paragraph, line, sentence and clause that is a unit, of the levels wanted."""

    def unit(start: int, end: int, words: list[str]) -> tuple[int, int, bytes]:
        return start, end, " ".join(words).encode()

    at, block, short = 0, [], False
    # the empty line behind the text ends its last paragraph
    for line in [*text.split("\n"), ""]:
        end = at + len(line)
        found = WORDS.findall(line.lower())
        enough = beyond(found, MIN_LINE_WORDS, MIN_CHARS)
        if enough:
            if "line" in levels:
                yield unit(at, min(end + 1, len(text)), found)
            for a, b, sentence in pieces(text, at, end, STOP):
                if "sentence" in levels and len(sentence) < len(found) and beyond(sentence, MIN_SENTENCE_WORDS, MIN_CHARS):
                    yield unit(a, b, sentence)
                if "clause" in levels and beyond(sentence, LONG_WORDS + 1, LONG_CHARS + 1):
                    for c, d, clause in pieces(text, a, b, PAUSE):
                        if len(clause) < len(sentence) and beyond(clause, MIN_CLAUSE_WORDS, MIN_CHARS):
                            yield unit(c, d, clause)
        if found:
            block.append((at, end, found))
            short |= not enough
        else:
            if "paragraph" in levels and short and len(block) > 1:
                words = [w for _, _, line_words in block for w in line_words]
                if beyond(words, MIN_LINE_WORDS, MIN_CHARS):
                    yield unit(block[0][0], min(block[-1][1] + 1, len(text)), words)
            block, short = [], False
        at = end + 1


def all_units(docs: DataFrame, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """(d1, d2, id, h, start, end) of every unit of every document."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["d1", "d2", "id", "h", "start", "end"]
        for batch in batches:
            ids, hashes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            digests, rows = bytearray(), []

            def packed() -> pa.RecordBatch:
                d = np.frombuffer(bytes(digests), np.int64).reshape(-1, 2)
                columns = list(zip(*rows, strict=True)) or [(), (), (), ()]
                return pa.RecordBatch.from_arrays([pa.array(d[:, 0]), pa.array(d[:, 1]), *(pa.array(c, pa.int64()) for c in columns[:2]), *(pa.array(c, pa.int32()) for c in columns[2:])], names)

            for i, h, text in zip(ids, hashes, batch.column(2), strict=True):
                for start, end, unit in units(text.as_py() or "", levels):
                    digests += xxhash.xxh3_128_digest(unit)
                    rows.append((i, h, start, end))
                if len(rows) > BATCH_UNITS:
                    yield packed()
                    digests, rows = bytearray(), []
            yield packed()

    kinds = "d1 bigint, d2 bigint, id bigint, h bigint, start int, end int"
    return docs.select(F.col("doc_id").cast("long"), text_hash(), "text").mapInArrow(releasing(made), kinds)


def text_hash() -> Column:
    return F.xxhash64("text").alias("h")


def repeated_units(docs: DataFrame, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """(no_id, id, h, units): per document with repeats the places to cut, in order.

    The least id of a digest is a minimum with partial sums. The join that brings it to the units is written as it comes,
    with no work behind it that needs its order, so that Spark may split the partition of a very common digest. Units of a
    larger id go; those of the least one, about one per digest, are told apart by text hash and offset.
    """
    everything = settle(all_units(docs, levels))
    # null comes last
    key = F.coalesce("id", F.lit((1 << 63) - 1))
    least = everything.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("least")).filter("n > 1").drop("n")
    often = settle(everything.join(least, ["d1", "d2"]))
    ties = often.filter(key == F.col("least"))
    rank = F.struct(F.col("id").isNull().alias("x"), "h", "start")
    first = ties.groupBy("d1", "d2").agg(F.min(rank).alias("first"))
    places = ["id", "h", "start", "end"]
    later = often.filter(key > F.col("least")).select(*places).unionByName(ties.join(first, ["d1", "d2"]).filter(rank != F.col("first")).select(*places))
    # a set: rows that are equal have the same units
    return later.groupBy(F.col("id").isNull().alias("no_id"), F.coalesce("id", F.lit(0)).alias("id"), "h").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("units"))


@F.pandas_udf(StructType([StructField("kept", StringType()), StructField("starts", ArrayType(IntegerType())), StructField("ends", ArrayType(IntegerType()))]))
def without(text: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
    """The texts without their sorted units, which may overlap, and the spans that these make."""

    def cut(t, a, b):
        if t is None or a is None or not len(a):
            return t, [], []
        out, at, froms, tos = [], 0, [], []
        for x, y in zip(a, b, strict=True):
            if x > at or not tos:
                out.append(t[at:x])
                froms.append(x)
                tos.append(y)
            else:
                tos[-1] = max(tos[-1], y)
            at = tos[-1]
        out.append(t[at:])
        return "".join(out), froms, tos

    return pd.DataFrame([cut(*row) for row in zip(text, starts, ends, strict=True)], columns=["kept", "starts", "ends"])


def cut_repeats(docs: DataFrame, levels: tuple[str, ...] = LEVELS) -> DataFrame:
    """docs with the remaining text in ``_kept`` and the spans cut from the input in ``_starts`` and ``_ends``."""
    found = repeated_units(docs.select("doc_id", "text"), levels)
    found = found.select(F.col("no_id").alias("_no_id"), F.col("id").alias("_id"), F.col("h").alias("_h"), F.col("units").alias("_units"))
    keyed = docs.withColumns({"_no_id": F.col("doc_id").isNull(), "_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "_h": text_hash()})
    out = keyed.join(found, ["_no_id", "_id", "_h"], "left").drop("_no_id", "_id", "_h")
    out = out.withColumn("_cut", without("text", F.col("_units.start"), F.col("_units.end"))).drop("_units")
    return out.withColumns({"_kept": F.col("_cut.kept"), "_starts": F.col("_cut.starts"), "_ends": F.col("_cut.ends")}).drop("_cut")


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    df = cut_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n = F.length("text").cast("long")
    return df.select("doc_id", n.alias("n_chars"), F.coalesce(n - F.length("_kept"), F.lit(0)).cast("long").alias("n_removed"), F.size("_starts").alias("n_spans"), F.arrays_zip(F.col("_starts").alias("start"), F.col("_ends").alias("end")).alias("spans"), F.col("_kept").alias("text"))


def keep_first(docs: DataFrame) -> DataFrame:
    """docs with each repeated unit at its first place only; n_chars follows the text."""
    used = [c for c in ("doc_id", "text", "n_chars") if c in docs.columns]
    out = cut_repeats(with_rest(docs, used)).withColumn("text", F.col("_kept"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast("long"))
    return with_columns_of(docs, out, used)
