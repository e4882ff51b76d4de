"""Raw metadata dumps: reading their fixed-size records, and decoding these into catalog rows.

A dump is a 64-byte header (8-byte magic, then little-endian u32 version, flags, record size, u64 record count, original
size, compressed size, 20 reserved bytes) and the records. Slot number is place in the file. Records are decoded in
Arrow batches, one tagged row per attribute; nodes, links, streams and runs are selections of these rows. A dump of
another version, a compressed one and one shorter than its header says are refused; an attribute that is shorter than
its kind needs is left out.

Spark lists the files, tasks read the headers and cut the dumps into pieces, and other tasks read these; the driver opens
none. The same goes for dumps that arrive in a folder, as a stream. Where there are many thousands of them, stored lists of
their paths take the place of Spark's listing, which costs the driver a path and Spark a task for each file of a pattern. Paths with a scheme are opened by Arrow's file systems,
others are local.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HEADER = struct.Struct("<8sIIIQQQ20x")
HEADER_BYTES = HEADER.size
RECORDS_PER_PART = 1 << 16


VERSION = 1


def opened(path: str):
    """A dump for reading from any place."""
    if "://" not in path:
        return open(path, "rb")
    files, inner = fs.FileSystem.from_uri(path)
    return files.open_input_file(inner)


def header(path: str) -> tuple[int, int]:
    """Record size and number of records; ValueError for what isn't a whole plain dump."""
    with opened(path) as f:
        head = f.read(HEADER.size)
        if len(head) < HEADER.size:
            raise ValueError(f"no dump: {path} has no header")
        _, version, flags, record_size, count, _, compressed = HEADER.unpack(head)
        if version != VERSION or flags or compressed:
            raise ValueError(f"dump {path}: only plain dumps of version {VERSION} can be read")
        if record_size < 48:
            raise ValueError(f"dump {path}: records of {record_size} bytes")
        f.seek(0, os.SEEK_END)
        if f.tell() < HEADER.size + count * record_size:
            raise ValueError(f"dump {path} is shorter than its header says")
    return record_size, count


def with_scheme(path: str) -> str:
    """file:/x, as Spark names local files, as file:///x."""
    return re.sub(r"^(\w+):/(?!/)", r"\1:///", path)


def records(files: DataFrame, per_part: int = RECORDS_PER_PART, tasks: int | None = None) -> DataFrame:
    """volume (file name), slot, record of all dumps in files (path); pieces of so many records are dealt over the tasks, as many as shuffles have partitions if not told."""
    # a number, as Spark would put the pieces, which are small rows before they are read, into one task
    tasks = tasks or int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in map(with_scheme, batch.column(0).to_pylist()):
                size, count = header(path)
                rows += [(path, size, k, min(per_part, count - k)) for k in range(0, count, per_part)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [()] * 4, [pa.string(), *[pa.int64()] * 3], strict=True)], ["path", "size", "first", "count"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, first, count in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                volume = os.path.basename(path).split(".")[0]
                with opened(path) as f:
                    f.seek(HEADER_BYTES + first * size)
                    for k in range(first, first + count, 1024):
                        n = min(1024, first + count - k)
                        raw = f.read(n * size)
                        rows = [raw[i * size : (i + 1) * size] for i in range(n)]
                        yield pa.RecordBatch.from_arrays([pa.array([volume] * n, pa.string()), pa.array(range(k, k + n), pa.int64()), pa.array(rows, pa.binary())], ["volume", "slot", "record"])

    cut = files.select("path").mapInArrow(pieces, "path string, size bigint, first bigint, count bigint")
    return cut.repartition(tasks, "path", "first").mapInArrow(read, "volume string, slot bigint, record binary")


def read_dump(spark: SparkSession, *paths: str, per_part: int = RECORDS_PER_PART) -> DataFrame:
    """volume, slot, record of the dumps that the paths name: files, folders or patterns."""
    return records(spark.read.format("binaryFile").load(list(paths)).select("path"), per_part)


def stream_dumps(spark: SparkSession, folder: str, pattern: str = "*.dump", per_part: int = RECORDS_PER_PART, per_step: int | None = None) -> DataFrame:
    """The same of dumps that arrive in a folder, each once; per_step: dumps that a step takes at most."""
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", pattern)
    reader = reader.option("maxFilesPerTrigger", per_step) if per_step else reader
    return records(reader.load(folder).select("path"), per_part)


def stream_listed_dumps(spark: SparkSession, folder: str, per_part: int = RECORDS_PER_PART, per_step: int | None = None) -> DataFrame:
    """The same of dumps named by Parquet lists (path) that arrive in a folder, each list once; per_step: lists that a step takes at most.

    For very many dumps: a step's work on the driver goes by lists, not by dumps. A list comes when its dumps are whole.
    """
    reader = spark.readStream.schema("path string")
    reader = reader.option("maxFilesPerTrigger", per_step) if per_step else reader
    return records(reader.parquet(folder), per_part)


def repaired(record: bytes, sector: int = 512) -> bytes | None:
    """The record with the last two bytes of its sectors put back; None if signature or sector marks are wrong or it isn't in use."""
    if len(record) < 48 or record[:4] != b"FILE":
        return None
    at, n = struct.unpack_from("<HH", record, 4)
    marks = record[at : at + 2 * n]
    out = bytearray(record)
    for k in range(1, n):
        end = k * sector
        if end > len(out) or len(marks) < 2 * k + 2 or out[end - 2 : end] != marks[:2]:
            return None
        out[end - 2 : end] = marks[2 * k : 2 * k + 2]
    return bytes(out) if struct.unpack_from("<H", out, 22)[0] & 1 else None


def run_deltas(raw: bytes) -> list[tuple[int, int | None]]:
    """(clusters, change of place) per run; no change of place for a hole."""
    out, i = [], 0
    while i < len(raw) and raw[i]:
        n, m = raw[i] & 15, raw[i] >> 4
        if i + 1 + n + m > len(raw):
            break
        place = int.from_bytes(raw[i + 1 + n : i + 1 + n + m], "little", signed=True) if m else None
        out.append((int.from_bytes(raw[i + 1 : i + 1 + n], "little"), place))
        i += 1 + n + m
    return out


FIELDS = {
    "volume": "string", "slot": "bigint", "node_id": "bigint", "kind": "string", "pos": "int", "is_dir": "boolean", "attrs": "int", "created_ft": "bigint", "written_ft": "bigint", "accessed_ft": "bigint",
    "parent_id": "bigint", "namespace": "int", "name": "string", "type_id": "int", "length": "bigint", "allocated": "bigint", "is_sparse": "boolean", "lowest_vcn": "bigint", "runs": "array<struct<clusters:bigint,step:bigint>>",
}
INDEX_NAME = "$I30"


def attributes_of(record: bytes, slot: int) -> Iterator[dict]:
    """A row for each attribute of one repaired record."""
    first, flags = struct.unpack_from("<HH", record, 20)
    base = struct.unpack_from("<Q", record, 32)[0] & ((1 << 48) - 1)
    node = {"node_id": base or slot, "is_dir": bool(flags & 2)}
    at, pos = first, 0
    while at + 16 <= len(record):
        code, size = struct.unpack_from("<II", record, at)
        if code == 0xFFFFFFFF or size < 16 or at + size > len(record):
            return
        outside, name_chars, name_at, aflags = struct.unpack_from("<BBHH", record, at + 8)
        if size < (64 if outside else 24):
            at, pos = at + size, pos + 1
            continue
        row = {**node, "pos": pos, "name": record[at + name_at : at + name_at + 2 * name_chars].decode("utf-16-le", "replace"), "is_sparse": bool(aflags & 0x8000)}
        pos += 1
        if outside:
            low, _, runs_at = struct.unpack_from("<qqH", record, at + 16)
            allocated, data, filled = struct.unpack_from("<qqq", record, at + 40)
            if aflags & 0x8001 and struct.unpack_from("<H", record, at + 34)[0] and size >= 72:
                allocated = struct.unpack_from("<q", record, at + 64)[0]
            bad = node["node_id"] == 8 and row["name"] == "$Bad"
            row |= {"length": filled if bad else data, "allocated": filled if bad else allocated, "lowest_vcn": low, "runs": [{"clusters": n, "step": s} for n, s in run_deltas(record[at + runs_at : at + size])]}
        else:
            n, value_at = struct.unpack_from("<IH", record, at + 16)
            value = record[at + value_at : min(at + value_at + n, at + size)]
            row |= {"length": n, "allocated": 0, "lowest_vcn": 0}
        if code == 0x10 and not outside and len(value) >= 36:
            created, written, _, accessed, attrs = struct.unpack_from("<qqqqI", value)
            yield {**row, "kind": "node", "attrs": (attrs | (0x10 if node["is_dir"] else 0)) & 0x7FFFFFFF, "created_ft": created, "written_ft": written, "accessed_ft": accessed}
        elif code == 0x30 and not outside and len(value) >= 66 and len(value) >= 66 + 2 * value[64]:
            chars, space = value[64], value[65]
            yield {**row, "kind": "link", "parent_id": struct.unpack_from("<Q", value)[0] & ((1 << 48) - 1), "namespace": space, "name": value[66 : 66 + 2 * chars].decode("utf-16-le", "replace")}
        elif outside or code not in (0x10, 0x30):
            index = code in (0x90, 0xA0, 0xB0) and row["name"] == INDEX_NAME
            yield {**row, "kind": "stream", "type_id": 0 if index else code >> 4, "name": "" if index else row["name"]}
        at += size


def parse_records(dump: DataFrame) -> DataFrame:
    """One tagged row per attribute of each valid record in use."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
        runs = pa.list_(pa.struct([("clusters", pa.int64()), ("step", pa.int64())]))
        schema = pa.schema([(c, kinds.get(k, runs)) for c, k in FIELDS.items()])
        for batch in batches:
            rows = []
            for volume, slot, raw in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if record := repaired(raw):
                    rows += [{"volume": volume, "slot": slot, **a} for a in attributes_of(record, slot)]
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return dump.select("volume", "slot", "record").mapInArrow(made, ", ".join(f"{c} {k}" for c, k in FIELDS.items()))


def catalog_tables(attributes: DataFrame) -> dict[str, DataFrame]:
    """nodes, links and streams from the tagged rows; links and streams numbered newest first."""
    newest = W.partitionBy("volume", "node_id").orderBy(F.col("slot").desc(), F.col("pos").desc())
    nodes = attributes.filter("kind = 'node'").select("volume", "node_id", "is_dir", "attrs", "created_ft", "written_ft", "accessed_ft")
    links = attributes.filter("kind = 'link' AND namespace != 2").withColumn("link_ix", F.row_number().over(newest) - 1).select("volume", "node_id", "link_ix", "parent_id", "name")
    streams = attributes.filter("kind = 'stream' AND lowest_vcn = 0").groupBy("volume", "node_id", "type_id", "name")
    streams = streams.agg(F.sum("length").alias("length"), F.sum("allocated").alias("allocated"), F.bool_or("is_sparse").alias("is_sparse"), F.max("slot").alias("slot"), F.max("pos").alias("pos"))
    streams = streams.withColumn("stream_ix", F.row_number().over(newest) - 1)
    return {"nodes": nodes, "links": links, "streams": streams.select("volume", "node_id", "stream_ix", "type_id", F.col("name").alias("stream_name"), "length", "allocated", F.col("allocated").alias("bulkiness"), "is_sparse")}


def decode_runs(attributes: DataFrame) -> DataFrame:
    """(volume, slot, pos, run_ix, next_vcn, lcn) of every run: running sums of lengths and steps; null place for a hole."""
    runs = attributes.select("volume", "slot", "pos", "lowest_vcn", F.posexplode("runs").alias("run_ix", "run"))
    so_far = W.partitionBy("volume", "slot", "pos").orderBy("run_ix")
    return runs.select(
        "volume", "slot", "pos", "run_ix", (F.col("lowest_vcn") + F.sum("run.clusters").over(so_far)).alias("next_vcn"),
        F.when(F.col("run.step").isNotNull(), F.sum(F.coalesce("run.step", F.lit(0))).over(so_far)).alias("lcn"),
    )
