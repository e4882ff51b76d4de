"""Expressions and helpers that several training-data operators share."""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.shared import scratch

#: One white-space character as the word rules count it: space, tab, LF, VT, FF, CR.
SPACE = r"[\x20\x09-\x0D]"
#: One word.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; every other character stays as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def whole(text: Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """The white-space separated words of a text that isn't null."""
    return F.array_remove(F.split(text, f"{SPACE}+"), "")


def n_words(text: Column) -> Column:
    """Words of a text as a long; 0 for null."""
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")


Batches = Iterator[pa.RecordBatch]


def releasing(step: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """A step of mapInArrow whose worker gives the memory of its batches back when the task is done: workers stay, also idle ones beside later stages."""

    def made(batches: Batches) -> Batches:
        try:
            yield from step(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return made


#: Paths of the tables that this process has settled.
made: list[str] = []


def settle(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = scratch(df.sparkSession)
    made.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def settled_alone(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """Settles what make returns and deletes every table that was settled on the way there."""
    before = len(made)
    out = settle(make())
    for path in made[before:-1]:
        delete(spark, path)
    del made[before:-1]
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a settled table that nothing reads any more."""
    for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if "/treelake-" in name:
            delete(df.sparkSession, name)


def grown(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: it is never broadcast, as that takes it whole through the driver, several times its stored size."""
    return df.hint("merge")


def quoted(columns: list[str]) -> list[Column]:
    """Columns by name, also where a name has a dot."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def with_rest(docs: DataFrame, used: list[str]) -> DataFrame:
    """The used columns, and all others in one struct ``_rest``, where their names can't clash with an operator's own."""
    rest = quoted([c for c in docs.columns if c not in used])
    return docs.select(*used, F.struct(*rest).alias("_rest") if rest else F.lit(None).alias("_rest"))


def with_columns_of(docs: DataFrame, df: DataFrame, used: list[str], *more: Column) -> DataFrame:
    """The columns of docs again, in their order, from a frame made by with_rest; then more."""
    return df.select(*(F.col(c) if c in used else F.col("_rest").getField(c).alias(c) for c in docs.columns), *more)
