"""A training corpus in five stages: quality rules, near-duplicates, repeated passages, source mix, tokens.

Each stage takes (spark, docs, sf_dir) with the columns of documents and works on all the rows that it is given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from treelake.llm import bpe, mixing, near_dedup, quality, substring_dedup
from treelake.llm.common import discard, settled_alone, table


def good_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality rules reject; the references come from labelled documents of docs."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of smallest id of each group of near-duplicates: shingles of five words, similarity 0.8."""
    return near_dedup.keep_one(docs, n=5)


def first_places(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts paragraphs, lines, sentences and clauses that an earlier document has, or that stand earlier in the same one."""
    return substring_dedup.keep_first(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes from each source the words of its target: a row for each time that a document is taken."""
    return mixing.mix_texts(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE: number of tokens, digests of the ids and of the text they decode to, and the ids themselves."""
    # a smaller cache than alone, which goes with its task: the workers of all stages stay side by side
    encoded = bpe.tokenised(docs, cache=1 << 17, keep=False)
    return bpe.digests(encoded, "ids")


STAGES = [("quality rules", good_texts), ("near duplicates", one_of_each), ("repeated passages", first_places), ("source mix", mixed), ("tokens", tokens)]

#: The near-duplicate and token stages can't be put into SQL; the tests hold each stage's operator against brute force and run the stages in a row.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table documents; each stage's rows are written and read again before the next, and what it left is deleted."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES[:-1]):
        after = settled_alone(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        if number:
            discard(docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
