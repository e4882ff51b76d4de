"""Searching a catalog: one condition per pattern, over the cheapest column that it needs."""

from __future__ import annotations

import uuid
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import ROOT
from ..functions.patterns import checked, extension, extension_filter, extension_list, literal_head, literals, matches, pattern_mode, root_prefix, trailing_star, volume_names, with_own_extension
from ..plans.paths import DATA, SEPARATOR, base_name, entries, folder_links, replace_volumes
from ..plans.shared import listed, removed, settled
from .trigrams import BLOCK, in_blocks, narrowed, postings


def user_records(metadata: bool = False) -> Column:
    """Ids below 16 are the file system's own, but for the root."""
    return F.lit(True) if metadata else (F.col("node_id") >= 16) | (F.col("node_id") == ROOT)


def data_streams(metadata: bool = False) -> Column:
    return F.lit(True) if metadata else F.col("type_id").isin(0, DATA)


def condition(pattern: str, case: bool = False, stored: bool = False) -> Column:
    """What a pattern asks of an entry; stored: the entry has name_lc and path_lc."""
    mode = pattern_mode(pattern)
    low = stored and not case
    if not mode["path"] and not mode["stream"]:
        return matches(F.col("name_lc" if low else "name"), mode["text"], mode["kind"], case, low)
    if not mode["path"]:
        return matches(base_name(F.col("name"), F.col("type_id"), F.col("stream_name")), mode["text"], mode["kind"], case)
    with_end = matches(F.col("path"), mode["text"], mode["kind"], case)
    # a folder is found with and without its closing separator
    bare = matches(F.regexp_replace("path", r"\\$", ""), mode["text"], mode["kind"], case)
    found = with_end | (F.col("is_dir") & bare)
    head = literal_head(mode["text"]) if mode["kind"] == "globstar" else ""
    # implied by the match, and what the files can be searched by
    return F.col("path_lc").startswith(head) & found if low and head else found


def with_lower_case(entries: DataFrame) -> DataFrame:
    return entries.withColumns({"name_lc": F.lower("name"), "path_lc": F.lower("path"), "ext_lc": extension(F.col("name"))})


class Catalog:
    """The entries of one or more volumes and searches over them.

    ``store`` writes the entries by volume and part, sorted by lower-case path, with lower-case names, paths and extensions;
    ``Catalog.stored`` opens them again. Searches there compare stored columns, so that volumes, and starts, ends, parts
    and whole names reach the Parquet scan; whole names also meet the files' Bloom filters. Beside the entries lie the
    folders with their intervals, and, if asked for, postings of trigrams (see trigrams).
    """

    def __init__(self, catalog: dict[str, DataFrame], entries_: DataFrame | None = None, path: str | None = None):
        self.tables = catalog
        self.entries = entries(catalog) if entries_ is None else entries_
        self.path = path

    @classmethod
    def stored(cls, spark: SparkSession, path: str) -> Catalog:
        tables = {name: spark.read.parquet(f"{path}/{name}") for name in ("folders", "postings") if listed(spark, f"{path}/{name}")}
        return cls(tables, spark.read.parquet(f"{path}/entries"), path)

    def store(self, path: str, folders: DataFrame | None = None, parts: int | None = None, names: int = 1 << 20, grams: bool = False, block: int = BLOCK) -> Catalog:
        """Replaces the volumes of this catalog in the stored tables; other volumes there stay.

        Each call names its parts anew; a volume's earlier parts are deleted when the new ones are there.
        folders: paths with intervals, which ``subtree`` needs; parts: ranges of paths, otherwise as Spark deals them; names:
        different names that a file's Bloom filter is made for; grams: with postings; block: entries of one posting.
        """
        # what a range sort shuffles is as narrow as can be, and in the order of the folders that are written, so it is sorted once
        by = "volume", F.lower("path")
        rows = self.entries.repartitionByRange(parts, *by) if parts else self.entries.repartitionByRange(*by)
        call = uuid.uuid4().hex[:12]
        part = F.concat(F.lit(f"{call}-"), F.lpad(F.spark_partition_id().cast("string"), 6, "0"))
        rows = with_lower_case(rows).withColumn("part", part).sortWithinPartitions("volume", "part", "path_lc").withColumn("block", in_blocks(block))
        bloom = {"parquet.bloom.filter.enabled#name_lc": "true", "parquet.bloom.filter.expected.ndv#name_lc": str(names)}
        replace_volumes(rows, f"{path}/entries", "part", **bloom)
        if folders is not None:
            replace_volumes(folders.select("volume", "node_id", "path", "depth", "lo", "hi").repartition("volume").sortWithinPartitions("volume", "node_id"), f"{path}/folders")
        spark = rows.sparkSession
        for volume in listed(spark, f"{path}/entries"):
            parts_ = listed(spark, f"{path}/entries/{volume}") if volume.startswith("volume=") else []
            if any(p.startswith(f"part={call}-") for p in parts_):
                for old in (p for p in parts_ if not p.startswith(f"part={call}-")):
                    removed(spark, f"{path}/entries/{volume}/{old}")
        if grams:
            volumes = [r.volume for r in self.entries.select("volume").distinct().collect()]
            replace_volumes(postings(spark.read.parquet(f"{path}/entries").filter(F.col("volume").isin(volumes))), f"{path}/postings")
        return Catalog.stored(spark, path)

    def volumes(self) -> list[str]:
        """The volumes' names: of a stored catalog from the names of its folders."""
        if self.path:
            return [unquote(n.removeprefix("volume=")) for n in listed(self.entries.sparkSession, f"{self.path}/entries") if n.startswith("volume=")]
        return [r.volume for r in self.tables["volumes"].select("volume").distinct().collect()]

    def subtree(self, node_id: int, volumes: list[str] | None = None) -> DataFrame:
        """All entries below a folder, by a range of the stored positions; node_id may be that of a folder on several volumes."""
        found = self.tables["folders"].filter(F.col("node_id") == node_id)
        if volumes:
            found = found.filter(F.col("volume").isin(volumes))
        # one row per volume that has the folder
        below = [(F.col("volume") == r.volume) & F.col("pos").between(r.lo, r.hi) for r in found.select("volume", "lo", "hi").collect()]
        return self.entries.filter(reduce(lambda a, b: a | b, below, F.lit(False)))

    def search(self, pattern: str = "", volumes: list[str] | str = "*", ext: list[str] = (), streams: bool = False, metadata: bool = False, case: bool = False) -> DataFrame:
        spark: SparkSession = self.entries.sparkSession
        stored = "name_lc" in self.entries.columns
        hits = self.entries.filter(user_records(metadata) & data_streams(metadata))
        if not streams:
            hits = hits.filter((F.col("stream_name") == "") & F.col("type_id").isin(0, DATA))
        if found := root_prefix(pattern):
            volumes = [found]
        if volumes != "*" and "*" not in volumes:
            hits = hits.filter(F.col("volume").isin(volume_names(volumes, self.volumes())))
        pattern, ext = with_own_extension(pattern, list(ext))
        pattern = trailing_star(pattern)
        if pattern.startswith(">"):
            checked(spark, pattern[1:])
        hits = hits.filter(condition(pattern, case, stored))
        if "postings" in self.tables and not case:
            hits = narrowed(hits, self.tables["postings"], literals(pattern))
        if not ext:
            return hits
        return hits.filter(F.col("ext_lc").isin(extension_list(ext)) if stored else extension_filter(F.col("name"), ext))


def walk(catalog: dict[str, DataFrame], match: Column, descend: Column, start: DataFrame | None = None) -> DataFrame:
    """Visits links from the roots down, level by level: returns the links that meet ``match``, and enters the folders whose link meets ``descend``.

    Both are conditions on a visited link: volume, node_id, link_ix, parent_id, name, is_dir, attrs of its node, its path
    (without a closing separator) and depth, 1 below the start. A folder that fails ``descend`` is not joined to anything, so
    a level costs one join of folders with those entered before; files are joined once, to all folders entered. start:
    other folders to begin at, (volume, node_id, path, depth), their paths with a closing separator. A folder is never
    entered below itself.
    """
    links, nodes = catalog["links"], catalog["nodes"]
    of_node = nodes.select("volume", "node_id", "is_dir", "attrs")
    visited = ["volume", "node_id", "link_ix", "parent_id", "name", "is_dir", "attrs"]
    folders = settled(folder_links(links, nodes).drop("is_dir", "attrs").join(of_node, ["volume", "node_id"]).select(visited))
    if start is None:
        start = nodes.filter(F.col("node_id") == ROOT).select("volume", "node_id", F.concat("volume", F.lit(SEPARATOR)).alias("path"), F.lit(0).alias("depth"))

    def met(rows: DataFrame, entered: DataFrame) -> DataFrame:
        above = entered.select("volume", F.col("node_id").alias("parent_id"), F.col("path").alias("_path"), F.col("depth").alias("_depth"), "_ids")
        return rows.join(above, ["volume", "parent_id"]).select(*visited, F.concat("_path", "name").alias("path"), (F.col("_depth") + 1).alias("depth"), "_ids")

    entered = [settled(start.select("volume", "node_id", "path", "depth", F.array("node_id").alias("_ids")))]
    while not entered[-1].isEmpty():
        into = met(folders, entered[-1]).filter(descend & ~F.array_contains("_ids", F.col("node_id")))
        entered.append(settled(into.select("volume", "node_id", F.concat("path", F.lit(SEPARATOR)).alias("path"), "depth", F.concat("_ids", F.array("node_id")).alias("_ids"))))
    rows = links.join(of_node, ["volume", "node_id"]).filter(F.col("node_id") != F.col("parent_id"))
    return met(rows, reduce(DataFrame.unionByName, entered)).filter(match).select("volume", "node_id", "link_ix", "path", "depth")
