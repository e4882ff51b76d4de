"""Delimited reports, table exports, path lists, extent maps as JSON, and reading a report back."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.attributes import BITS, decoded, marker
from ..functions.names import file_type
from ..functions.times import local_text
from ..plans.shared import scratch
from .dump import with_scheme

# The report's columns in their order.
COLUMNS = ("path", "name", "pathonly", "size", "sizeondisk", "created", "written", "accessed", "descendants", *BITS, "attributes", "type")
TEXT_COLUMNS = ("path", "name", "pathonly", "type")
#: Bytes that are copied at a time.
CHUNK = 8 << 20
# Words for separators and quotes.
TOKENS = {"TAB": "\t", "NEWLINE": "\n", "NEW LINE": "\n", "SPACE": " ", "RETURN": "\r", "DOUBLE": '"', "SINGLE": "'", "NULL": "\0"}


def separator_token(word: str) -> str:
    return TOKENS.get(word.upper(), word)


def columns_of(offset_minutes: int = 0, yes: str = "1", no: str = "0") -> dict[str, Column]:
    """Report columns over entries; ``descendants`` needs a treesize column."""
    c = F.col
    flags = {flag: marker(x, yes, no) for flag, x in decoded(c("attrs")).items()}
    times = {t: local_text(c(f"{t}_ft"), offset_minutes) for t in ("created", "written", "accessed")}
    return {
        "path": c("path"), "name": c("name"), "pathonly": c("dir_path"), "size": c("length"), "sizeondisk": c("allocated"), **times,
        "descendants": c("treesize"), **flags, "attributes": c("attrs"), "type": file_type(c("name"), c("attrs")),
    }


def chosen(names: list[str] | str) -> list[str]:
    """The wanted columns in the report's order; 'all' for all; ValueError for unknown names."""
    wanted = [n.strip().lower() for n in (names.split(",") if isinstance(names, str) else names)]
    if wanted == ["all"]:
        return list(COLUMNS)
    if unknown := sorted(set(wanted) - set(COLUMNS)):
        raise ValueError(f"unknown columns: {', '.join(unknown)}")
    return [c for c in COLUMNS if c in wanted]


def select_columns(hits: DataFrame, names: list[str] | str, **options) -> DataFrame:
    by_name = columns_of(**options)
    return hits.select(*(by_name[n].alias(n) for n in chosen(names)))


def report_lines(report: DataFrame, separator: str = ",", quote: str = '"') -> DataFrame:
    """One column, ``line``: text columns quoted, the others bare."""
    separator, quote = separator_token(separator), separator_token(quote)
    cell = lambda c: F.concat(F.lit(quote), F.col(c), F.lit(quote)) if c in TEXT_COLUMNS else F.col(c).cast("string")
    return report.select(F.concat_ws(separator, *(F.coalesce(cell(c), F.lit("")) for c in report.columns)).alias("line"))


def report_header(report: DataFrame, separator: str = ",", quote: str = '"') -> str:
    separator, quote = separator_token(separator), separator_token(quote)
    return separator.join(f"{quote}{c}{quote}" for c in report.columns)


def write_report(report: DataFrame, path: str, separator: str = ",", quote: str = '"') -> None:
    """One folder of text files, each with the header as its first line."""
    lines = report_lines(report, separator, quote).withColumnRenamed("line", report_header(report, separator, quote))
    bare = {"header": True, "sep": "\x01", "quote": "\0", "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    lines.write.mode("overwrite").options(**bare).csv(path)


def one_file(lines: DataFrame, path: str, head: str | None = None, end: str = "\n") -> None:
    """All lines, in their order, as one file on any file system that Arrow opens, with a line in front if there is one.

    Spark's tasks write the parts; one task then joins these, by pieces of CHUNK bytes, into a file beside the wanted one,
    which it renames, so that a task that fails or runs twice leaves nothing half done. Nothing passes through the driver.
    """
    spark = lines.sparkSession
    parts = scratch(spark)
    lines.write.option("lineSep", end).text(parts)
    start = (head + end).encode() if head is not None else b""
    # a path without a scheme is that of the session's file system, which tasks can't ask
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    path = with_scheme(at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString())

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                files, inner = fs.FileSystem.from_uri(folder)
                _, target = fs.FileSystem.from_uri(path)
                aside = f"{target}.{uuid.uuid4().hex}"
                names = sorted(f.path for f in files.get_file_info(fs.FileSelector(inner)) if f.base_name.startswith("part-"))
                with files.open_output_stream(aside) as out:
                    out.write(start)
                    for name in names:
                        with files.open_input_stream(name) as part:
                            while piece := part.read(CHUNK):
                                out.write(piece)
                if files.get_file_info(target).type != fs.FileType.NotFound:
                    files.delete_file(target)
                files.move(aside, target)
            yield batch

    spark.createDataFrame([(with_scheme(parts),)], "path string").mapInArrow(joined, "path string").collect()


def write_report_file(report: DataFrame, path: str, separator: str = ",", quote: str = '"') -> None:
    """The report as one file with one header."""
    one_file(report_lines(report, separator, quote), path, report_header(report, separator, quote))


def export_lines(table: DataFrame, tab: bool = False) -> DataFrame:
    """One column, ``line``: commas or tabs; a cell is quoted only in comma mode, if it has a comma or an apostrophe."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    cell = lambda c: text(c) if tab else F.when(text(c).rlike("[,']"), F.concat(F.lit('"'), text(c), F.lit('"'))).otherwise(text(c))
    return table.select(F.concat_ws("\t" if tab else ",", *(cell(c) for c in table.columns)).alias("line"))


def write_table_export(table: DataFrame, path: str, tab: bool = False) -> None:
    export_lines(table.drop("name"), tab).write.mode("overwrite").option("lineSep", "\r\n").text(path)


def write_table_file(table: DataFrame, path: str, tab: bool = False) -> None:
    """The same as one file."""
    one_file(export_lines(table.drop("name"), tab), path, end="\r\n")


def path_list(hits: DataFrame, files_only: bool = False) -> DataFrame:
    """Full paths; as a file list without those of streams, which have a colon behind the drive."""
    paths = hits.select("path")
    return paths.filter(F.instr(F.substring("path", 3, 1 << 20), ":") == 0) if files_only else paths


def read_report(spark: SparkSession, path: str, names: list[str] | str = "all", separator: str = ",", quote: str = '"') -> DataFrame:
    """A report read back, with typed columns."""
    kinds = {"size": "bigint", "sizeondisk": "bigint", "descendants": "bigint", "attributes": "int", **dict.fromkeys(("created", "written", "accessed"), "timestamp")}
    schema = ", ".join(f"{c} {kinds.get(c, 'string')}" for c in chosen(names))
    return spark.read.schema(schema).option("header", True).option("sep", separator_token(separator)).option("quote", separator_token(quote)).option("escape", "").option("timestampFormat", "yyyy-MM-dd HH:mm:ss").csv(path)


def extents_json(ranges: DataFrame, summary: DataFrame, per_chunk: int = 4096) -> DataFrame:
    """(volume, chunk, text): texts that in the order of their chunks are one JSON object per volume, its summary first, then the extents in order.

    No row holds more than per_chunk extents; extents are numbered from 0 on without gaps.
    """
    head = F.to_json(F.struct("volume", F.struct("extent_count", "clusters", "records", "bytes", "fragmented").alias("summary")))
    heads = summary.select("volume", F.lit(-1).cast("long").alias("chunk"), F.concat(F.rtrim(head, F.lit("}")), F.lit('},"extents":[')).alias("text"))
    item = F.struct("extent_ix", F.to_json(F.struct("extent_ix", "clusters", "first_record", "last_record", "byte_offset", "byte_length")).alias("json"))
    chunk = F.call_function("div", F.col("extent_ix"), F.lit(per_chunk))
    listed = ranges.groupBy("volume", chunk.alias("chunk")).agg(F.sort_array(F.collect_list(item)).alias("x"))
    before = F.when(F.col("chunk") > 0, ",").otherwise("")
    chunks = listed.select("volume", "chunk", F.concat(before, F.array_join("x.json", ",")).alias("text"))
    ends = summary.select("volume", F.lit((1 << 62)).alias("chunk"), F.lit("]}").alias("text"))
    return heads.unionByName(chunks).unionByName(ends)


def write_extents_json(chunks: DataFrame, path: str) -> None:
    """One file with a JSON list of all volumes in order, a line for each chunk."""
    first = chunks.agg(F.min("volume")).first()[0]
    text = F.concat(F.when((F.col("chunk") < 0) & (F.col("volume") != first), ",").otherwise(""), "text")
    end = chunks.sparkSession.createDataFrame([(None, 0, "]")], "volume string, chunk bigint, line string")
    lines = chunks.select("volume", "chunk", text.alias("line")).unionByName(end)
    one_file(lines.orderBy(F.col("volume").asc_nulls_last(), "chunk").select("line"), path, "[")
