"""Upkeep of stored folders, totals and bulk from one snapshot of a catalog to the next.

Both snapshots are compared once. Paths are made anew for folders whose link has changed and all below them, hung under
those that stay. Only folders with a changed path or content give their sums of before back to the folders they were in,
and those of now to the folders they are in. Bulk is computed for these folders and the ones above; all others are taken
as stored. The result is that of building everything from the new snapshot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import ROOT
from .paths import below, folder_links
from .rollup import KEY, SUMS, bulk_and_allocated, direct_sums
from .shared import settled

Tables = dict[str, DataFrame]
CONTENT = {"nodes": ["is_dir"], "links": ["link_ix", "parent_id", "name"], "streams": ["stream_ix", "type_id", "stream_name", "length", "allocated", "bulkiness"]}


def differing(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """The keys of rows that only one of two snapshots has, by one grouping of both."""
    both = before.select(*columns, F.lit(-1).alias("n")).unionByName(after.select(*columns, F.lit(1).alias("n")))
    return both.groupBy(*columns).agg(F.sum("n").alias("n")).filter("n != 0").select(*KEY).distinct()


def moved_folders(before: Tables, after: Tables) -> DataFrame:
    """Folders whose link is another one, or new, or gone, and all folders of now below these; settled."""
    of = [folder_links(t["links"], t["nodes"]).select(*KEY, "parent_id", "name") for t in (before, after)]
    now = settled(of[1].select(*KEY, "parent_id"))
    roots = [t["nodes"].filter(F.col("node_id") == ROOT).select(*KEY) for t in (before, after)]
    changed = differing(*of, [*KEY, "parent_id", "name"]).unionByName(differing(*roots, KEY)).distinct()
    all_ = level = settled(changed)
    while not level.isEmpty():
        under = now.join(level.select("volume", F.col("node_id").alias("parent_id")), ["volume", "parent_id"], "left_semi").select(*KEY).distinct()
        level = settled(under.join(all_, KEY, "left_anti"))
        all_ = all_.unionByName(level)
    return settled(all_)


def refreshed_folders(after: Tables, stored: DataFrame, moved: DataFrame) -> DataFrame:
    """(volume, node_id, path, depth, ids): the stored ones that haven't moved, and new paths for those that have; settled."""
    stay = stored.join(moved, KEY, "left_anti").select(*KEY, "path", "ids")
    links = folder_links(after["links"], after["nodes"]).join(moved, KEY, "left_semi").select(*KEY, "parent_id", "name", "link_ix")
    links = settled(links)
    tops = stay.join(links.select("volume", F.col("parent_id").alias("node_id")).distinct(), KEY, "left_semi")
    roots = after["nodes"].filter(F.col("node_id") == ROOT).join(moved, KEY, "left_semi").select(*KEY, F.concat("volume", F.lit("\\")).alias("path"), F.array("node_id").alias("ids"))
    made = below(links, tops.unionByName(roots).withColumn("depth", F.lit(0))).join(moved, KEY, "left_semi").select(*KEY, "path", "ids")
    return settled(stay.unionByName(made).select(*KEY, "path", (F.size("ids") - 1).alias("depth"), "ids"))


def part_of(tables: Tables, folders: DataFrame) -> Tables:
    """The tables of the files in some folders, with all their links, and of these folders themselves; links count in the wanted folders only by a filter of the caller."""
    inside = tables["links"].join(folders.select("volume", F.col("node_id").alias("parent_id")), ["volume", "parent_id"], "left_semi").select(*KEY)
    wanted = settled(inside.unionByName(folders.select(*KEY)).distinct())
    # inner joins, as semi joins would be pushed below the dealing of the tables; wanted has each key once
    return {**tables, **{t: tables[t].join(wanted, KEY) for t in CONTENT}}


def sums_of(tables: Tables, folders: DataFrame, wanted: DataFrame) -> DataFrame:
    """Ids and direct sums of those of the wanted folders that are among folders."""
    sums = direct_sums(part_of(tables, wanted)).join(wanted, KEY, "left_semi")
    return folders.select(*KEY, "ids").join(wanted, KEY, "left_semi").join(sums, KEY, "left").fillna(0, SUMS)


def reserved(tables: Tables, sign: int) -> DataFrame:
    """What the roots' totals have beyond the sums below them."""
    kept = {"allocated": F.col("reserved_clusters") * F.col("cluster_size") * sign}
    return tables["volumes"].select("volume", F.lit(ROOT).cast("long").alias("node_id"), *(kept.get(c, F.lit(0)).cast("long").alias(c) for c in SUMS))


def stored_sums(tables: Tables, stored: Tables, wanted: DataFrame) -> DataFrame:
    """The same of the stored snapshot, from its totals alone: a folder's total less those of the folders in it. No file is read."""
    totals = stored["totals"].select(*KEY, *SUMS)
    inner = stored["folders"].filter(F.size("ids") > 1).select(*KEY, F.element_at("ids", -2).alias("parent_id"))
    inner = inner.join(totals, KEY).select("volume", F.col("parent_id").alias("node_id"), *((-F.col(c)).alias(c) for c in SUMS))
    sums = _union(totals, inner, reserved(tables, -1)).join(wanted, KEY, "left_semi").groupBy(*KEY).agg(*(F.sum(c).alias(c) for c in SUMS))
    return stored["folders"].select(*KEY, "ids").join(wanted, KEY, "left_semi").join(sums, KEY, "left").fillna(0, SUMS)


def refreshed(before: Tables, after: Tables, stored: Tables) -> Tables:
    """folders, totals and bulk of the new snapshot from the stored ones of the old: as of folder_paths, folder_totals and bulk_and_allocated; settled.

    Folders have one link each.
    """
    moved = moved_folders(before, after)
    folders = refreshed_folders(after, stored["folders"], moved)
    changed = settled(_union(*(differing(before[t], after[t], [*KEY, *columns]) for t, columns in CONTENT.items())).distinct())
    # the folders that hold what has changed, of before and of now, and changed folders themselves
    holders = _union(*(t["links"].join(changed, KEY, "left_semi").select("volume", F.col("parent_id").alias("node_id")) for t in (before, after)))
    touched = settled(_union(holders, changed, moved).distinct())

    old, new = settled(stored_sums(before, stored, touched)), settled(sums_of(after, folders, touched))
    given = lambda rows, sign: rows.select("volume", F.explode("ids").alias("node_id"), *((F.col(c) * sign).alias(c) for c in SUMS))
    deltas = _union(given(old, -1), given(new, 1), reserved(before, -1), reserved(after, 1))
    totals = _union(stored["totals"].select(*KEY, *SUMS), deltas).groupBy(*KEY).agg(*(F.sum(c).alias(c) for c in SUMS))
    totals = settled(totals.join(folders.select(*KEY), KEY, "left_semi"))

    above = _union(*(f.join(touched, KEY, "left_semi").select("volume", F.explode("ids").alias("node_id")) for f in (stored["folders"], folders)))
    again = settled(folders.join(_union(above, touched).distinct(), KEY, "left_semi"))
    rest = stored["bulk"].join(again.select(*KEY), KEY, "left_anti").join(folders.select(*KEY), KEY, "left_semi")
    in_again = folder_links(after["links"], after["nodes"]).join(again.select("volume", F.col("node_id").alias("parent_id")), ["volume", "parent_id"], "left_semi").select(*KEY, "parent_id")
    known = rest.join(in_again, KEY).select("volume", "parent_id", "allocated", "bulkiness")
    tables = part_of(after, again)
    bulk = bulk_and_allocated(tables, again, known=known)
    return {"folders": folders, "totals": totals, "bulk": settled(bulk.unionByName(rest.select(*KEY, "bulkiness", "allocated")))}


def _union(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out
