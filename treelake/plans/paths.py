"""Rebuilding paths: folders level by level from the root, then one join of all links to their folder's path."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..catalog import ROOT
from .shared import settled

SEPARATOR = "\\"


def folder_links(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """The links of folders, but for the root's link to itself."""
    folders = nodes.filter("is_dir").select("volume", "node_id")
    return links.join(folders, ["volume", "node_id"]).filter(F.col("node_id") != ROOT)


def below(folders: DataFrame, roots: DataFrame) -> DataFrame:
    """(volume, node_id, path, depth, ids) of the roots and all folders below them, to any depth.

    Each folder knows the names and ids up to some folder above it, at first its parent. A step joins that folder's own
    names and ids in front, so the stretch known doubles, and a tree of depth d takes about log d steps. Folders that have
    reached a root take part in no later step but as what others join. A folder that is above itself is left out, one whose
    parent is missing drops out of the join.
    """
    done = [settled(roots.select("volume", "node_id", F.col("path").alias("top"), F.array().cast("array<string>").alias("names"), "ids"))]
    open_ = folders.select("volume", "node_id", F.col("parent_id").alias("at"), F.array("name").alias("names"), F.array("node_id").alias("ids"))
    while not open_.isEmpty():
        known = reduce(DataFrame.unionByName, done)
        known = known.select("volume", F.col("node_id").alias("at"), F.lit(None).cast("long").alias("next"), "top", F.col("names").alias("up_names"), F.col("ids").alias("up_ids"))
        others = open_.select("volume", F.col("node_id").alias("at"), F.col("at").alias("next"), F.lit(None).cast("string").alias("top"), F.col("names").alias("up_names"), F.col("ids").alias("up_ids"))
        rows = open_.join(known.unionByName(others), ["volume", "at"]).select("volume", "node_id", F.col("next").alias("at"), "top", F.concat("up_names", "names").alias("names"), F.concat("up_ids", "ids").alias("ids"))
        rows = settled(rows.filter(F.size(F.array_distinct("ids")) == F.size("ids")))
        done.append(rows.filter("top IS NOT NULL").drop("at"))
        open_ = rows.filter("top IS NULL").drop("top")
    out = reduce(DataFrame.unionByName, done)
    path = F.concat("top", F.array_join(F.transform("names", lambda n: F.concat(n, F.lit(SEPARATOR))), ""))
    return out.select("volume", "node_id", path.alias("path"), F.size("names").alias("depth"), "ids")


def folder_paths(links: DataFrame, nodes: DataFrame, descend: Column | None = None) -> DataFrame:
    """(volume, node_id, path, depth, ids) of every folder that the root reaches; paths end in a separator, ids are those of the folder and all above it.

    ``descend`` is a condition on folder links: what fails it is not entered.
    """
    folders = folder_links(links, nodes).select("volume", "node_id", "parent_id", "name", "link_ix")
    if descend is not None:
        folders = folders.filter(descend)
    roots = nodes.filter(F.col("node_id") == ROOT).select("volume", "node_id", F.concat("volume", F.lit(SEPARATOR)).alias("path"), F.lit(0).alias("depth"), F.array("node_id").alias("ids"))
    return below(settled(folders), roots)


# Names of attribute types, by type id (code / 16).
ATTRIBUTE_NAMES = (
    "", "$STANDARD_INFORMATION", "$ATTRIBUTE_LIST", "$FILE_NAME", "$OBJECT_ID", "$SECURITY_DESCRIPTOR", "$VOLUME_NAME", "$VOLUME_INFORMATION", "$DATA",
    "$INDEX_ROOT", "$INDEX_ALLOCATION", "$BITMAP", "$REPARSE_POINT", "$EA_INFORMATION", "$EA", "$PROPERTY_SET", "$LOGGED_UTILITY_STREAM",
)
DATA = 8


def attribute_name(type_id: Column) -> Column:
    return F.coalesce(F.get(F.array(*map(F.lit, ATTRIBUTE_NAMES)), type_id), F.lit(""))


def stream_suffix(type_id: Column, stream_name: Column) -> Column:
    """What follows a name: :stream for named ones, :stream:$TYPE or ::$TYPE for those that aren't data."""
    other = F.concat(F.lit(":"), stream_name, F.lit(":"), attribute_name(type_id))
    return F.when(type_id.isin(0, DATA), F.when(stream_name != "", F.concat(F.lit(":"), stream_name)).otherwise("")).otherwise(other)


def entries(catalog: dict[str, DataFrame], folders: DataFrame | None = None) -> DataFrame:
    """One row per link and stream of every node that the root reaches, with path, name, depth, sizes, times and flags.

    The folders' paths come to the links in one join, and only then are these dealt by node, to which nodes and streams are
    joined; the rows, which are many more, stay dealt so. folders: as made by folder_paths, if they are there already; with
    their intervals, ``pos`` is the beginning of the folder that a link is in. A catalog that holds its links dealt by node
    may have them as ``undealt_links`` too, which saves the first dealing.
    """
    links, streams, nodes = (catalog[t] for t in ("links", "streams", "nodes"))
    folders = folder_paths(links, nodes) if folders is None else folders
    links = catalog.get("undealt_links", links)
    # a node has few links and streams
    of_node = W.partitionBy("volume", "node_id")
    streams = streams.withColumn("n_streams", F.count(F.lit(1)).over(of_node).cast("int"))
    links = links.withColumn("n_links", F.count(F.lit(1)).over(of_node).cast("int"))
    above = folders.select("volume", F.col("node_id").alias("parent_id"), F.col("path").alias("dir_path"), F.col("depth").alias("above"), *([F.col("lo").alias("pos")] if "lo" in folders.columns else []))
    linked = links.join(above, ["volume", "parent_id"]).join(nodes, ["volume", "node_id"])
    if "undealt_links" in catalog:
        # parts of a bounded size: a hash can hold a part's links, and its streams, which are more, need no sort
        linked = linked.hint("shuffle_hash")
    out = linked.join(streams, ["volume", "node_id"])
    root = F.col("node_id") == ROOT
    base = F.when(root, F.col("dir_path")).otherwise(F.concat("dir_path", "name", F.when(F.col("is_dir"), SEPARATOR).otherwise("")))
    suffix = stream_suffix(F.col("type_id"), F.col("stream_name"))
    return out.select(
        "volume", "node_id", "link_ix", "stream_ix", "parent_id", "name", F.concat(base, suffix).alias("path"), "dir_path", F.when(root, 0).otherwise(F.col("above") + 1).alias("depth"), "is_dir", "type_id", "stream_name",
        "length", "allocated", "bulkiness", "is_sparse", "attrs", "created_ft", "written_ft", "accessed_ft", "n_links", "n_streams", *(["pos"] if "lo" in folders.columns else []),
    )


def of_nodes(catalog: dict[str, DataFrame], hits: DataFrame) -> dict[str, DataFrame]:
    """The links, streams and nodes of the nodes of a few hits, which are sent to all tasks: what ``entries`` joins for these."""
    of = F.broadcast(hits.select("volume", "node_id").distinct())
    return {t: catalog[t].join(of, ["volume", "node_id"], "left_semi") for t in ("links", "streams", "nodes")}


def base_name(name: Column, type_id: Column, stream_name: Column) -> Column:
    """The last component with its stream."""
    return F.concat(name, stream_suffix(type_id, stream_name))


def lookup(catalog: dict[str, DataFrame], keys: DataFrame) -> DataFrame:
    """Name and size for keys of hits: volume, node_id and, null for any, link_ix and stream_ix.

    A null link means the first one, a null stream the default one. ``found`` is false where there is no such link and stream.
    """
    first = keys.withColumns({"at_link": F.coalesce("link_ix", F.lit(0)), "any_stream": F.col("stream_ix").isNull()})
    named = catalog["links"].select("volume", "node_id", F.col("link_ix").alias("at_link"), "name")
    default = (F.col("stream_name") == "") & F.col("type_id").isin(0, DATA)
    sizes = catalog["streams"].select("volume", "node_id", F.col("stream_ix").alias("s_ix"), default.alias("default"), "length", "allocated", F.lit(True).alias("has_stream"))
    k = first.join(named, ["volume", "node_id", "at_link"], "left").alias("k")
    same = (F.col("k.volume") == F.col("s.volume")) & (F.col("k.node_id") == F.col("s.node_id")) & F.when(F.col("k.any_stream"), F.col("s.default")).otherwise(F.col("k.stream_ix") == F.col("s.s_ix"))
    out = k.join(sizes.alias("s"), same, "left")
    found = F.col("k.name").isNotNull() & F.coalesce(F.col("s.has_stream"), F.lit(False))
    shown = [F.when(found, F.col(c)).alias(c.split(".")[1]) for c in ("k.name", "s.length", "s.allocated")]
    return out.select("k.volume", "k.node_id", "k.link_ix", "k.stream_ix", *shown, found.alias("found"))


def latest(rows: DataFrame, key: str = "volume", time: str = "snapshot_ts") -> DataFrame:
    """The rows of each volume's latest snapshot."""
    last = rows.groupBy(key).agg(F.max(time).alias(time))
    return rows.join(last, [key, time], "left_semi")


def replace_volumes(rows: DataFrame, path: str, *more: str, **options: str) -> None:
    """Writes rows into a stored table by volume, and by more columns below that; volumes that aren't among the rows keep what they have."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").options(**options).partitionBy("volume", *more).parquet(path)


def orphans(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links whose parent isn't a node of their volume."""
    return links.join(nodes.select("volume", F.col("node_id").alias("parent_id")), ["volume", "parent_id"], "left_anti")


def cycles(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links of folders that neither the root nor a folder without a parent reaches: those in a ring and all below it."""
    folders = settled(folder_links(links, nodes).select("volume", "node_id", "parent_id", "name", "link_ix"))
    start = lambda df: df.select("volume", "node_id", F.lit("").alias("path"), F.lit(0).alias("depth"), F.array("node_id").alias("ids"))
    lost = orphans(folders, nodes)
    reached = below(folders, start(nodes.filter(F.col("node_id") == ROOT)).unionByName(start(lost)))
    return folders.join(reached.select("volume", "node_id"), ["volume", "node_id"], "left_anti")
