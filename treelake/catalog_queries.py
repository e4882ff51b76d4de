"""The registered queries over the derived file catalog and the SQL that checks them."""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import catalog as C
from .functions import attributes as A
from .functions import names as N
from .functions import patterns as P
from .functions import times as T
from .operators import sorting as S
from .operators import storage as X
from .operators import streams as Y
from .operators.search import Catalog, data_streams, user_records, walk
from .plans import paths as J
from .plans import rollup as G
from .plans.intervals import intervals
from .plans.refresh import refreshed
from .plans.shared import listed, parts_for, scratch, settled
from .sources import reports as R
from .streaming.standing import run_available, standing_paths, standing_search

K = ["volume", "node_id", "link_ix", "stream_ix"]
KS = ", ".join(K)


class Base(dict):
    """The tables of the derived catalog; all but volumes are written when first asked for, and dealt by node wherever they are read.

    They are dealt into as many parts as the streams, or the attributes, need, so that a task's rows stay as few however large the catalog is:
    left to itself Spark fills tasks by their compressed bytes, of which these rows have few.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, text: dict[str, str] = C.TEXT):
        self.spark, self.dir, self.text = spark, sf_dir, text

    @cached_property
    def derived(self) -> dict[str, DataFrame]:
        """The files are joined once and written, as three tables read them; order lines are dealt by order, which their groups and joins then share."""
        lines = parts_for(self.spark.read.parquet(f"{self.dir}/lineitem.parquet"))
        path = scratch(self.spark)
        C.derived(self.spark, self.dir, self.text, names=("files",))["files"].write.parquet(path)
        return C.derived(self.spark, self.dir, self.text, {"files": path}, lines)

    def __missing__(self, name: str) -> DataFrame:
        df = self.derived[name]
        if name == "attributes":
            df = settled(df)
            df = df.repartition(parts_for(df), "volume", "node_id")
        elif name in ("links", "nodes", "streams"):
            df = settled(df)
            if name == "streams":
                # links and nodes are fewer
                self.parts = parts_for(df)
            elif "streams" not in self:
                self["streams"]
            if name == "links":
                self["undealt_links"] = df
            df = df.repartition(self.parts, "volume", "node_id")
        self[name] = df
        return df


class Given:
    """The derived catalog of one folder of tables, each part built when a query first asks for it.

    Within a session the parts stay: the tables, the folders, the stored catalog that searches read, and the totals that
    listings show. Only what reads the stored catalog's own order, parts or postings has it stored. What an operator's own query measures is computed each time.
    """

    kept: dict[tuple[str, str], Given] = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self.base = scratch(spark)

    @classmethod
    def of(cls, spark: SparkSession, sf_dir: str) -> Given:
        """The one of this session, or a new one where its files are gone."""
        key = spark.sparkContext.applicationId, sf_dir
        old = cls.kept.get(key)
        if old is None or not old.there():
            cls.kept.clear()
            cls.kept[key] = cls(spark, sf_dir)
        return cls.kept[key]

    def there(self) -> bool:
        held = [df for df in (*self.tables.values(), *(self.__dict__[n] for n in ("paths", "folders", "totals") if n in self.__dict__))]
        made = {f.rpartition("/")[0] for df in held for f in df.inputFiles() if "/treelake-" in f}
        made |= {self.catalog.path} if "catalog" in self.__dict__ else set()
        return all(listed(self.spark, path) for path in made)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def tables(self) -> dict[str, DataFrame]:
        return Base(self.spark, self.dir)

    @property
    def parts(self) -> int:
        """Into how many parts rows of about the number of the streams are dealt."""
        self.tables["streams"]
        return self.tables.parts

    @cached_property
    def paths(self) -> DataFrame:
        """All folders with their paths."""
        return J.folder_paths(self.tables["links"], self.tables["nodes"])

    @cached_property
    def folders(self) -> DataFrame:
        """All folders with their paths and intervals."""
        return settled(self.paths.join(intervals(self.paths), ["volume", "node_id"]))

    @cached_property
    def catalog(self) -> Catalog:
        return Catalog(self.tables, J.entries(self.tables, self.folders)).store(f"{self.base}/catalog", self.folders)

    @property
    def entries(self) -> DataFrame:
        """The stored entries where a query has had them stored; otherwise the joins, of which a query carries the columns that it needs."""
        return self.catalog.entries if "catalog" in self.__dict__ else J.entries(self.tables, self.folders if "folders" in self.__dict__ else self.paths)

    @property
    def searched(self) -> Catalog:
        """The stored catalog where there is one; otherwise one over the joins, as a single search costs less than storing all columns."""
        return self.catalog if "catalog" in self.__dict__ else Catalog(self.tables, self.entries)

    @cached_property
    def totals(self) -> DataFrame:
        return settled(G.folder_totals(self.tables, self.folders))

    @property
    def sized(self) -> DataFrame:
        """Entries with the totals of folders in place of their own sizes."""
        t = self.totals.select("volume", "node_id", F.col("length").alias("t_length"), F.col("allocated").alias("t_allocated"), F.col("treesize").alias("treesize"))
        e = self.entries.join(t, ["volume", "node_id"], "left")
        return e.withColumns({"length": F.coalesce("t_length", "length"), "allocated": F.coalesce("t_allocated", "allocated"), "treesize": F.coalesce("treesize", F.lit(0).cast("long"))})

    @property
    def bulky(self) -> DataFrame:
        """Entries with the bulk of folders in place of their own."""
        b = G.bulkiness(self.tables, self.folders).select("volume", "node_id", F.col("bulkiness").alias("t_bulk"))
        return self.entries.join(b, ["volume", "node_id"], "left").withColumn("bulkiness", F.coalesce("t_bulk", "bulkiness"))

    @property
    def extents(self) -> DataFrame:
        """An extent map for each nation: a run of clusters per customer."""
        c = self.table("customer").join(self.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        w = by_customer()
        return c.select(
            F.col("n_name").alias("volume"), (F.row_number().over(w) - 1).alias("extent_ix"), F.sum((F.col("c_custkey") % 7 + 1).cast("long")).over(w).alias("next_vcn"), (F.col("c_custkey") * 16 + 1000).cast("long").alias("lcn")
        )

    @property
    def slots(self) -> DataFrame:
        return self.table("orders").select(F.lit("C:").alias("volume"), F.col("o_orderkey").cast("long").alias("slot"), (F.col("o_orderstatus") != "F").alias("in_use"))


def by_customer():
    from pyspark.sql import Window

    return Window.partitionBy("n_name").orderBy("c_custkey")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PDF files below one nation's folder, largest first."""
    hits = Given(spark, sf_dir).catalog.search("C:\\NATION_0\\**\\*.pdf", ext=["pdf"])
    return S.ordered(hits, "size").select("path", F.col("length").alias("size"), F.col("allocated").alias("size_on_disk"), T.local_text(F.col("written_ft")).alias("written"))


# What the checking SQL of several queries has in common.
TYPE = "CASE type_id WHEN 8 THEN '$DATA' WHEN 11 THEN '$BITMAP' WHEN 14 THEN '$EA' WHEN 16 THEN '$LOGGED_UTILITY_STREAM' ELSE '' END"
SUFFIX = f"CASE WHEN type_id IN (0, 8) THEN CASE WHEN stream_name <> '' THEN ':' || stream_name ELSE '' END ELSE ':' || stream_name || ':' || {TYPE} END"
ENTRIES = f"""dp AS (
  SELECT volume, node_id, volume || chr(92) AS path, 0 AS depth, [node_id] AS ids FROM folders WHERE node_id = 5
  UNION ALL SELECT f.volume, f.node_id, dp.path || f.name || chr(92), dp.depth + 1, list_append(dp.ids, f.node_id) FROM folders f JOIN dp ON f.volume = dp.volume AND f.parent_id = dp.node_id WHERE f.node_id <> 5),
nl AS (SELECT volume, node_id, CAST(count(*) AS INT) AS n_links FROM links GROUP BY ALL),
ns AS (SELECT volume, node_id, CAST(count(*) AS INT) AS n_streams FROM streams GROUP BY ALL),
entries AS (SELECT l.volume, l.node_id, l.link_ix, s.stream_ix, l.parent_id, l.name, CASE WHEN l.node_id = 5 THEN dp.path ELSE dp.path || l.name || CASE WHEN n.is_dir THEN chr(92) ELSE '' END END AS base,
  base || {SUFFIX} AS path, dp.path AS dir_path, CAST(CASE WHEN l.node_id = 5 THEN 0 ELSE dp.depth + 1 END AS INT) AS depth, dp.ids AS above_ids,
  n.is_dir, s.type_id, s.stream_name, s.length, s.allocated, s.bulkiness, s.is_sparse, n.attrs, n.created_ft, n.written_ft, n.accessed_ft, n_links, n_streams
  FROM links l JOIN nodes n USING (volume, node_id) JOIN nl USING (volume, node_id) JOIN ns USING (volume, node_id) JOIN dp ON dp.volume = l.volume AND dp.node_id = l.parent_id JOIN streams s ON s.volume = l.volume AND s.node_id = l.node_id)"""
ROLL = """moved AS (SELECT volume, node_id, sum(allocated) AS moved FROM streams WHERE stream_name = 'WofCompressedData' GROUP BY ALL),
merged AS (SELECT s.volume, s.node_id, s.stream_ix, s.type_id, s.stream_name, CAST(CASE WHEN stream_name = 'WofCompressedData' THEN 0 ELSE length END AS BIGINT) AS length, bulkiness,
  CAST(CASE WHEN stream_name = 'WofCompressedData' THEN 0 WHEN type_id = 8 AND stream_name = '' THEN allocated + coalesce(moved, 0) ELSE allocated END AS BIGINT) AS allocated FROM streams s LEFT JOIN moved USING (volume, node_id)),
shares AS (SELECT l.volume, l.parent_id, l.node_id, l.link_ix, CAST(sum(length * (link_ix + 1) // n_links - length * link_ix // n_links) AS BIGINT) AS length, CAST(sum(allocated * (link_ix + 1) // n_links - allocated * link_ix // n_links) AS BIGINT) AS allocated,
  CAST(sum(bulkiness * (link_ix + 1) // n_links - bulkiness * link_ix // n_links) AS BIGINT) AS bulkiness, count(*) AS treesize FROM links l JOIN nl USING (volume, node_id) JOIN merged USING (volume, node_id) JOIN nodes USING (volume, node_id) WHERE NOT is_dir GROUP BY ALL),
direct AS (SELECT volume, node_id, length, allocated, 1 AS treesize, 0 AS files FROM streams WHERE type_id = 0 UNION ALL SELECT volume, parent_id, length, allocated, treesize, 1 FROM shares),
totals AS (SELECT t.volume, t.node_id, t.length, CAST(t.allocated + CASE WHEN t.node_id = 5 THEN reserved_clusters * cluster_size ELSE 0 END AS BIGINT) AS allocated, treesize, files FROM (SELECT d.volume, x.id AS node_id, CAST(sum(length) AS BIGINT) AS length, sum(allocated) AS allocated, CAST(sum(treesize) AS BIGINT) AS treesize, CAST(sum(files) AS BIGINT) AS files
  FROM direct d JOIN (SELECT volume, node_id, unnest(ids) AS id FROM dp) x ON x.volume = d.volume AND x.node_id = d.node_id GROUP BY ALL) t JOIN volumes v ON v.volume = t.volume),
sized AS (SELECT e.* EXCLUDE (length, allocated), coalesce(t.length, e.length) AS length, coalesce(t.allocated, e.allocated) AS allocated, coalesce(t.treesize, 0) AS treesize FROM entries e LEFT JOIN totals t USING (volume, node_id))"""
BULK = """l2 AS (SELECT volume, parent_id AS node_id, sum(allocated) AS a FROM shares GROUP BY ALL),
b2 AS (SELECT f.volume, f.node_id, f.parent_id, 4096 + coalesce(any_value(a), 0) AS allocated, 4096 + coalesce(sum(CASE WHEN s.bulkiness < a // 100 THEN s.bulkiness ELSE 0 END), 0) AS bulkiness FROM folders f LEFT JOIN l2 USING (volume, node_id) LEFT JOIN shares s ON s.volume = f.volume AND s.parent_id = f.node_id WHERE f.node_id >= 1000 GROUP BY ALL),
c1 AS (SELECT volume, parent_id, allocated, bulkiness FROM b2 UNION ALL SELECT volume, parent_id, allocated, bulkiness FROM shares WHERE parent_id BETWEEN 100 AND 999),
l1 AS (SELECT volume, parent_id AS node_id, sum(allocated) AS a FROM c1 GROUP BY ALL),
b1 AS (SELECT f.volume, f.node_id, 4096 + coalesce(any_value(a), 0) AS allocated, 4096 + coalesce(sum(CASE WHEN s.bulkiness < a // 100 THEN s.bulkiness ELSE 0 END), 0) AS bulkiness FROM folders f LEFT JOIN l1 USING (volume, node_id) LEFT JOIN c1 s ON s.volume = f.volume AND s.parent_id = f.node_id WHERE f.node_id BETWEEN 100 AND 999 GROUP BY ALL),
c0 AS (SELECT volume, allocated, bulkiness FROM b1 UNION ALL SELECT volume, allocated, bulkiness FROM shares WHERE parent_id = 5),
l0 AS (SELECT volume, sum(allocated) AS a FROM c0 GROUP BY ALL),
b0 AS (SELECT f.volume, f.node_id, 4096 + coalesce(sum(CASE WHEN s.bulkiness < a // 100 THEN s.bulkiness ELSE 0 END), 0) AS bulkiness FROM folders f LEFT JOIN l0 USING (volume) LEFT JOIN c0 s ON s.volume = f.volume WHERE f.node_id = 5 GROUP BY ALL),
bulk AS (SELECT volume, node_id, CAST(bulkiness AS BIGINT) AS bulkiness FROM (SELECT volume, node_id, bulkiness FROM b2 UNION ALL SELECT volume, node_id, bulkiness FROM b1 UNION ALL SELECT volume, node_id, bulkiness FROM b0)),
bulky AS (SELECT e.* EXCLUDE (bulkiness), coalesce(b.bulkiness, e.bulkiness) AS bulkiness FROM entries e LEFT JOIN bulk b USING (volume, node_id))"""
EXTENTS = """extents AS (SELECT n_name AS volume, CAST(row_number() OVER (PARTITION BY n_name ORDER BY c_custkey) - 1 AS INT) AS extent_ix, CAST(sum(c_custkey % 7 + 1) OVER (PARTITION BY n_name ORDER BY c_custkey) AS BIGINT) AS next_vcn, CAST(c_custkey * 16 + 1000 AS BIGINT) AS lcn FROM customer JOIN nation ON c_nationkey = n_nationkey),
ranges AS (SELECT volume, extent_ix, lcn, next_vcn - f AS clusters, f * 4 AS first_record, next_vcn * 4 - 1 AS last_record, lcn * 4096 AS byte_offset, (next_vcn - f) * 4096 AS byte_length FROM (SELECT *, coalesce(lag(next_vcn) OVER (PARTITION BY volume ORDER BY extent_ix), 0) AS f FROM extents))"""

FOUND: dict[str, tuple] = {}


def query(sql: str, parts: str = "entries"):
    """Registers a query under its function's name with its checking SQL; parts: which definitions that needs."""
    definitions = {"": [], "links": [], "entries": [ENTRIES], "sized": [ENTRIES, ROLL], "bulky": [ENTRIES, ROLL, BULK], "extents": [EXTENTS]}[parts]

    def put(f):
        FOUND[f.__name__] = (f, None if sql is None else (sql if parts == "" else ",\n".join([C.prefix(), *definitions]) + "\n" + sql))
        return f

    return put


#: What searches leave out unless asked for the file system's own.
OWN = "type_id IN (0, 8) AND (node_id >= 16 OR node_id = 5)"


def hits_of(name: str, where: str, **search) -> None:
    """A query that is one search, checked by a condition on all entries."""
    pattern = search.pop("pattern", "")

    def f(g: Given) -> DataFrame:
        return g.searched.search(pattern, **search).select(*K, "path")

    f.__name__ = name
    query(f"SELECT {KS}, path FROM entries WHERE {where}" + ("" if search.get("metadata") else f" AND {OWN}"))(f)


# Projections ---------------------------------------------------------------------------------------------------------


def column(name: str, sql: str, make, parts: str = "entries") -> None:
    """A query that adds one column to all entries."""

    def f(g: Given) -> DataFrame:
        return (g.sized if parts == "sized" else g.entries).select(*K, make().alias(name))

    f.__name__ = name
    query(f"SELECT {KS}, {sql} AS {name} FROM {parts}", parts)(f)


c = F.col
stamp = lambda t: f"strftime(make_timestamp(({t}_ft - {T.EPOCH}) // 10), '%Y-%m-%d %H:%M:%S')"
column("full_path", "path", lambda: c("path"))
column("base_name", f"name || {SUFFIX}", lambda: J.base_name(c("name"), c("type_id"), c("stream_name")))
column("dir_path", "dir_path", lambda: c("dir_path"))
column("size", "length", lambda: c("length"), "sized")
column("size_on_disk", "allocated", lambda: c("allocated"), "sized")
column("created", stamp("created"), lambda: T.local_text(c("created_ft")))
column("written", stamp("written"), lambda: T.local_text(c("written_ft")))
column("accessed", f"strftime(make_timestamp((accessed_ft - {T.EPOCH}) // 10 + 3600000000), '%Y-%m-%d %H:%M:%S')", lambda: T.local_text(c("accessed_ft"), 60))
column("locale_time", f"strftime(make_timestamp((written_ft - {T.EPOCH}) // 10), '%d.%m.%Y %H:%M')", lambda: T.local_text(c("written_ft"), 0, "dd.MM.yyyy HH:mm"))
column("filetime_to_ts", f"(written_ft - {T.EPOCH}) // 10", lambda: F.unix_micros(T.timestamp(c("written_ft"))))
column("descendants", "CAST(greatest(treesize - 1, 0) AS BIGINT)", lambda: F.greatest(c("treesize") - 1, F.lit(0)).cast("long"), "sized")
column("encode_flags", f"attrs & {sum(A.BITS.values())}", lambda: A.encoded(A.decoded(c("attrs"))))
column("attribute_class", "CASE WHEN attrs & 1073741824 <> 0 THEN 'deleted' WHEN attrs & 4 <> 0 THEN 'system' WHEN attrs & 2 <> 0 THEN 'hidden' WHEN attrs & 16 <> 0 THEN 'directory' WHEN attrs & 2048 <> 0 THEN 'compressed' WHEN attrs & 16384 <> 0 THEN 'encrypted' WHEN attrs & 512 <> 0 THEN 'sparse' ELSE 'default' END", lambda: A.attribute_class(c("attrs")))
column("file_type", "CASE WHEN is_dir THEN 'File folder' WHEN name ILIKE '%.pdf' THEN 'PDF Document' WHEN name ILIKE '%.jpg' THEN 'JPEG Image' WHEN name ILIKE '%.mp4' THEN 'MP4 Video' ELSE 'File' END", lambda: N.file_type(c("name"), c("attrs")))
column("stream_suffix", SUFFIX, lambda: J.stream_suffix(c("type_id"), c("stream_name")))
column("depth", "depth", lambda: c("depth"))
column("strip_stream", "CASE WHEN node_id = 5 THEN base ELSE rtrim(base, chr(92)) END", lambda: N.strip_stream(c("path")))
column("normalize_path", "CASE WHEN node_id = 5 THEN base ELSE rtrim(base, chr(92)) END", lambda: N.normalize(F.replace("path", F.lit("\\"), F.lit("\\\\")), "C:\\"))
column("format_count", "format('{:,}', length)", lambda: F.format_number("length", 0))
column("pack_key", "(CAST(link_ix AS BIGINT) << 22) | (CAST(stream_ix AS BIGINT) << 9) | CAST(depth AS BIGINT)", lambda: A.packed_key(c("link_ix"), c("stream_ix"), c("depth")))
column("wrap48", "(length * 4294967296) & 281474976710655", lambda: A.wrap48(c("length") * 4294967296))
column("attribute_name", TYPE, lambda: J.attribute_name(c("type_id")))
column("space_saved", "length - allocated", lambda: c("length") - c("allocated"))


@query(f"SELECT {KS}, " + ", ".join(f"attrs & {b} <> 0 AS {f}" for f, b in A.BITS.items()) + " FROM entries")
def decode_flags(g):
    return g.entries.select(*K, *(x.alias(f) for f, x in A.decoded(c("attrs")).items()))


@query(f"SELECT {KS}, CASE WHEN attrs & 1 <> 0 THEN '+' ELSE '-' END AS readonly, CASE WHEN attrs & 2048 <> 0 THEN '+' ELSE '-' END AS compressed FROM entries")
def flag_markers(g):
    flags = A.decoded(c("attrs"))
    return g.entries.select(*K, A.marker(flags["readonly"], "+", "-").alias("readonly"), A.marker(flags["compressed"], "+", "-").alias("compressed"))


@query("SELECT path, name, length AS size, treesize AS descendants, CASE WHEN attrs & 1 <> 0 THEN '1' ELSE '0' END AS readonly FROM sized", "sized")
def select_columns(g):
    return R.select_columns(g.sized, "readonly,size,name,path,descendants")


@query("SELECT page_id, regexp_extract(url, '([^\\\\/]*)$', 1) AS base, regexp_extract(url, '(?s)\\A(.*?)[\\\\/]*[^\\\\/]*\\z', 1) AS dir, regexp_extract(url, '(\\.[^.\\\\/]*)$', 1) AS ext FROM pages", "")
def path_parts(g):
    return g.table("pages").select("page_id", N.basename(c("url")).alias("base"), N.dirname(c("url")).alias("dir"), N.extension(c("url")).alias("ext"))


# Searches ------------------------------------------------------------------------------------------------------------

MAIN = "stream_name = ''"
hits_of("match_substring", f"{MAIN} AND contains(lower(name), 'order_1')", pattern="order_1")
hits_of("match_prefix", f"{MAIN} AND starts_with(lower(name), 'ln_')", pattern="LN_*")
hits_of("match_suffix", f"{MAIN} AND ends_with(lower(name), '7.jpg')", pattern="*7.jpg")
hits_of("match_glob", f"{MAIN} AND regexp_full_match(lower(name), 'order_.5.*\\.jpg')", pattern="order_?5*.JPG")
hits_of("match_globstar", f"{MAIN} AND regexp_full_match(lower(path), '..\\\\nation_1[^\\\\/]*\\\\([^\\\\/]+\\\\)*order_[^\\\\/]*\\.pdf')", pattern="?:\\NATION_1*\\**\\order_*.pdf")
hits_of("match_regex", f"{MAIN} AND regexp_full_match(lower(path), '.*_[0-9]*7\\.(pdf|jpg)')", pattern=">.*_[0-9]*7\\.(pdf|jpg)")
hits_of("match_any", MAIN, pattern="**")
hits_of("case_mode", f"{MAIN} AND ends_with(name, '.JPG')", pattern="*.JPG", case=True)
hits_of("pattern_mode", "name || CASE WHEN stream_name <> '' THEN ':' || stream_name ELSE '' END LIKE '%:s2'", pattern="*:s2", streams=True)
hits_of("trailing_star", f"{MAIN} AND starts_with(lower(path), 'd:\\nation_')", pattern="D:\\NATION_*")
hits_of("ext_filter", f"{MAIN} AND (name ILIKE '%.jpg' OR name ILIKE '%.png' OR name ILIKE '%.tiff' OR name ILIKE '%.mp4')", ext=["pictures", "mp4"])
hits_of("volume_filter", f"{MAIN} AND volume IN ('C:', 'D:')", volumes=["c", "D:\\"])
hits_of("root_prefix", f"{MAIN} AND volume = 'E:' AND ends_with(lower(path), '.mp4')", pattern="e:\\**.mp4")
hits_of("stream_mode", "true", streams=True)
hits_of("metadata_mode", "true", streams=True, metadata=True)


@query(f"SELECT {KS} FROM entries WHERE lower(name) = 'order_7.mp4' OR lower(name) = 'nation_3'")
def match_exact(g):
    return g.entries.filter(P.matches(c("name"), "ORDER_7.mp4", "verbatim") | P.matches(c("name"), "nation_3", "verbatim")).select(*K)


@query(f"SELECT {KS} FROM entries WHERE {OWN}")
def user_records_only(g):
    return g.entries.filter(user_records() & data_streams()).select(*K)


# Joins ---------------------------------------------------------------------------------------------------------------


@query("SELECT volume, node_id, path, CAST(depth AS INT) AS depth FROM dp")
def rebuild_paths(g):
    return J.folder_paths(g.tables["links"], g.tables["nodes"]).select("volume", "node_id", "path", "depth")


@query(f"SELECT {KS}, parent_id, name, length, allocated, n_links, n_streams FROM entries")
def expand_entries(g):
    return J.entries(g.tables).select(*K, "parent_id", "name", "length", "allocated", "n_links", "n_streams")


@query(
    """, keys AS (SELECT volume, node_id FROM files UNION ALL SELECT volume, node_id + 20000000 FROM files WHERE attrs >= 2048)
SELECT k.volume, k.node_id, coalesce(l.name, '') AS name, coalesce(s.length, -1) AS length, l.name IS NOT NULL AS found FROM keys k LEFT JOIN (SELECT * FROM links WHERE link_ix = 0) l USING (volume, node_id) LEFT JOIN (SELECT * FROM streams WHERE stream_name = '' AND type_id = 8) s USING (volume, node_id)""",
    "links",
)
def key_lookup(g):
    files = g.tables["nodes"].filter("NOT is_dir AND node_id >= 16")
    absent = files.filter("attrs >= 2048").withColumn("node_id", c("node_id") + 20000000)
    keys = files.unionByName(absent).select("volume", "node_id", F.lit(None).cast("int").alias("link_ix"), F.lit(None).cast("int").alias("stream_ix"))
    return J.lookup(g.tables, keys).select("volume", "node_id", F.coalesce("name", F.lit("")).alias("name"), F.coalesce("length", F.lit(-1).cast("long")).alias("length"), "found")


@query("SELECT volume, parent_id, node_id, link_ix, name FROM links WHERE parent_id BETWEEN 100 AND 999 AND node_id <> 5", "links")
def children_of(g):
    parents = g.table("nation").select((c("n_nationkey") + 100).cast("long").alias("parent_id"))
    return g.tables["links"].join(parents, "parent_id", "left_semi").select("volume", "parent_id", "node_id", "link_ix", "name")


@query(f"SELECT {KS}, path FROM entries WHERE list_contains(above_ids, 101)")
def subtree_of(g):
    return g.catalog.subtree(101).select(*K, "path")


@query("SELECT f.volume, f.node_id, CAST(count(*) - 1 AS BIGINT) AS below FROM dp f JOIN (SELECT volume, unnest(ids) AS node_id FROM dp) x USING (volume, node_id) GROUP BY ALL")
def tree_intervals(g):
    """Each folder's number of folders below, from its interval alone: two numbers to each of them."""
    paths = J.folder_paths(g.tables["links"], g.tables["nodes"])
    return intervals(paths).select("volume", "node_id", F.call_function("div", c("hi") - c("lo"), F.lit(2)).alias("below"))


@query(f"SELECT type_id, {TYPE} AS type_name, count(*) AS streams FROM streams GROUP BY ALL", "links")
def type_dim_join(g):
    names = g.spark.createDataFrame(list(enumerate(J.ATTRIBUTE_NAMES)), "type_id int, type_name string")
    return g.tables["streams"].groupBy("type_id").agg(F.count(F.lit(1)).alias("streams")).join(F.broadcast(names), "type_id", "left")


@query("SELECT volume, node_id, link_ix, parent_id, name FROM links WHERE parent_id >= 1000 AND parent_id < 10000000 AND parent_id % 50 = 0", "links")
def orphans(g):
    left = g.tables["nodes"].filter("NOT (is_dir AND node_id >= 1000 AND node_id % 50 = 0)")
    return J.orphans(g.tables["links"], left).select("volume", "node_id", "link_ix", "parent_id", "name")


@query("SELECT volume, node_id, parent_id FROM folders WHERE node_id >= 1000 AND node_id % 50 = 0", "links")
def cycles(g):
    ring = (c("node_id") >= 1000) & (c("node_id") < 10000000) & (c("node_id") % 50 == 0)
    links = g.tables["links"].withColumn("parent_id", F.when(ring, c("node_id")).otherwise(c("parent_id")))
    return J.cycles(links, g.tables["nodes"]).join(g.tables["links"].select("volume", "node_id", c("parent_id").alias("was")), ["volume", "node_id"]).select("volume", "node_id", c("was").alias("parent_id"))


@query(
    "SELECT volume, node_id, link_ix, name, CASE WHEN attrs & 16 <> 0 THEN 'File folder' WHEN name ILIKE '%.pdf' THEN 'PDF Document' WHEN name ILIKE '%.jpg' THEN 'JPEG Image' WHEN name ILIKE '%.mp4' THEN 'MP4 Video' WHEN contains(name, '.') AND node_id <> 5 THEN upper(regexp_extract(name, '\\\\.([^.]*)$', 1)) || ' File' ELSE 'File' END AS type FROM links JOIN nodes USING (volume, node_id)",
    "links",
)
def typed_names(g):
    types = g.spark.createDataFrame(list(N.TYPES.items()), "extension string, type_name string")
    rows = g.tables["links"].join(g.tables["nodes"].select("volume", "node_id", "attrs"), ["volume", "node_id"])
    return N.typed(rows, types).select("volume", "node_id", "link_ix", "name", "type")


@query("SELECT r.volume, r.extent_ix, r.first_record, o_orderkey AS found_record, coalesce(o_orderkey = r.first_record, false) AS matches FROM ranges r LEFT JOIN orders ON o_orderkey = r.first_record AND o_orderstatus <> 'P'", "extents")
def verify_extents(g):
    r = X.extent_ranges(g.extents)
    found = g.table("orders").filter("o_orderstatus != 'P'").select(c("o_orderkey").alias("slot"), c("o_orderkey").alias("found_record"))
    headers = r.select("volume", c("first_record").alias("slot")).distinct().join(found, "slot")
    return X.verified_extents(r, headers)


# Totals --------------------------------------------------------------------------------------------------------------


@query("SELECT volume, node_id, length, allocated FROM totals", "sized")
def dir_rollup(g):
    return G.folder_totals(g.tables, g.folders).select("volume", "node_id", "length", "allocated")


@query("SELECT volume, parent_id, node_id, link_ix, length, allocated FROM shares", "sized")
def hardlink_share(g):
    return G.link_shares(g.tables).select("volume", "parent_id", "node_id", "link_ix", "length", "allocated")


@query("SELECT volume, node_id, stream_ix, length, allocated FROM merged", "sized")
def wof_merge(g):
    return G.merged_compressed(g.tables["streams"]).select("volume", "node_id", "stream_ix", "length", "allocated")


@query("SELECT volume, node_id, bulkiness FROM bulk", "bulky")
def bulkiness(g):
    return G.bulkiness(g.tables, g.folders)


@query("SELECT volume, length, allocated FROM totals WHERE node_id = 5", "sized")
def reserved_at_root(g):
    return g.totals.filter("node_id = 5").select("volume", "length", "allocated")


@query("SELECT volume, node_id, treesize, files FROM totals", "sized")
def treesize(g):
    return G.folder_totals(g.tables, g.folders).select("volume", "node_id", "treesize", "files")


SIZES = "SELECT volume, node_id, code, name, sparse, CASE WHEN resident THEN value_length WHEN node_id = 8 AND name = '$Bad' THEN initialized_size ELSE data_size END AS length, CASE WHEN resident THEN 0 WHEN node_id = 8 AND name = '$Bad' THEN initialized_size ELSE coalesce(compressed_size, allocated_size) END AS allocated FROM attributes"


@query(f"SELECT volume, node_id, CAST(CASE WHEN name = '$I30' AND code IN (144, 160, 176) THEN 0 ELSE code // 16 END AS INT) AS type_id, CASE WHEN name = '$I30' AND code IN (144, 160, 176) THEN '' ELSE name END AS name, CAST(sum(length) AS BIGINT) AS length, CAST(sum(allocated) AS BIGINT) AS allocated, bool_or(sparse) AS is_sparse, count(*) AS parts FROM ({SIZES}) GROUP BY ALL", "links")
def merge_index_attrs(g):
    return Y.merged_streams(g.tables["attributes"])


@query("SELECT volume, count(*) AS extent_count, CAST(sum(clusters) AS BIGINT) AS clusters, max(last_record) + 1 AS records, CAST(sum(byte_length) AS BIGINT) AS bytes, count(*) > 1 AS fragmented FROM ranges GROUP BY volume", "extents")
def extent_summary(g):
    return X.extent_summary(X.extent_ranges(g.extents))


@query("SELECT volume, count(DISTINCT node_id) AS records, count(DISTINCT (node_id, link_ix)) AS names, count(*) AS hits, CAST(sum(length) AS BIGINT) AS bytes FROM entries GROUP BY volume")
def catalog_stats(g):
    first_link, first_stream = c("link_ix") == 0, c("stream_ix") == F.min("stream_ix").over(per_node())
    e = g.entries.select("volume", "node_id", "link_ix", "stream_ix", "length").withColumn("first", first_stream)
    return e.groupBy("volume").agg(F.count_if(first_link & c("first")).alias("records"), F.count_if("first").alias("names"), F.count(F.lit(1)).alias("hits"), F.sum("length").alias("bytes"))


def per_node():
    from pyspark.sql import Window

    return Window.partitionBy("volume", "node_id")


@query(f"SELECT volume, count(*) AS hits FROM entries WHERE {MAIN} AND {OWN} AND ends_with(lower(name), '.pdf') GROUP BY volume")
def hit_count(g):
    return g.catalog.search("*.pdf").groupBy("volume").agg(F.count(F.lit(1)).alias("hits"))


@query("SELECT volume, node_id, n_links, n_streams FROM entries GROUP BY ALL")
def name_stream_counts(g):
    n = g.tables["links"].groupBy("volume", "node_id").agg(F.count(F.lit(1)).cast("int").alias("n_links"))
    return n.join(g.tables["streams"].groupBy("volume", "node_id").agg(F.count(F.lit(1)).cast("int").alias("n_streams")), ["volume", "node_id"])


@query(f"SELECT volume, node_id, code, name, CAST(length AS BIGINT) AS length, CAST(allocated AS BIGINT) AS allocated FROM ({SIZES})", "links")
def stream_size_rules(g):
    return Y.sized_attributes(g.tables["attributes"]).select("volume", "node_id", "code", "name", "length", "allocated")


BLOCKS = '''SELECT 'C:' AS volume, o_orderkey // 64 AS block, count(*) AS slots, count(*) FILTER (o_orderstatus <> 'F') AS in_use, CAST(coalesce(min(o_orderkey) FILTER (o_orderstatus <> 'F') - min(o_orderkey), count(*)) AS BIGINT) AS "leading", CAST(coalesce(max(o_orderkey) - max(o_orderkey) FILTER (o_orderstatus <> 'F'), 0) AS BIGINT) AS "trailing" FROM orders GROUP BY o_orderkey // 64'''


@query(f"SELECT volume, block, slots, in_use FROM ({BLOCKS})", "")
def slot_popcount(g):
    return X.block_use(g.slots, 64).select("volume", "block", "slots", "in_use")


@query(f'SELECT volume, block, "leading", "trailing" FROM ({BLOCKS})', "")
def slot_gaps(g):
    return X.block_use(g.slots, 64).select("volume", "block", "leading", "trailing")


def refresh(g):
    """Paths and totals after some changes, from the stored ones of before."""
    after = Base(g.spark, g.dir, C.edited())
    stored = {"folders": g.folders, "totals": g.totals, "bulk": settled(G.bulk_and_allocated(g.tables, g.folders))}
    new = refreshed(g.tables, after, stored)
    return new["folders"].select("volume", "node_id", "path").join(new["totals"], ["volume", "node_id"])


FOUND["refresh"] = refresh, ",\n".join([C.prefix(C.edited()), ENTRIES, ROLL]) + "\nSELECT volume, node_id, path, length, allocated, treesize, files FROM dp JOIN totals USING (volume, node_id)"


@query(f"SELECT {KS}, path FROM entries WHERE {MAIN} AND {OWN} AND (contains(lower(name), 'order_12') OR regexp_full_match(lower(path), '.*customer#0*[0-9]*7.order_[0-9]*\\.jpg') OR contains(lower(path), 'nation_3\\ln_'))")
def indexed_search(g):
    """Three searches on a catalog that is stored with postings of trigrams.

    It has the columns that these searches and their postings read. Its parts grow with the rows.
    """
    # a sort by ranges reads its rows twice
    rows = settled(g.searched.entries.select(*K, "name", "path", "dir_path", "is_dir", "type_id", "stream_name"))
    stored = Catalog(g.tables, rows).store(f"{scratch(g.spark)}/catalog", parts=max(16, g.parts), grams=True, block=64)
    hits = [stored.search(p).select(*K, "path") for p in ("order_12", ">.*customer#0*[0-9]*7.order_[0-9]*\\.jpg", "NATION_3\\ln_")]
    return hits[0].unionByName(hits[1]).unionByName(hits[2]).distinct()


# Order-dependent work ------------------------------------------------------------------------------------------------


@query("SELECT volume, extent_ix, clusters, first_record, last_record, byte_offset, byte_length FROM ranges", "extents")
def extent_ranges(g):
    return X.extent_ranges(g.extents).drop("lcn")


@query("SELECT volume, extent_ix, p // 3 AS piece_ix, least(clusters - p, 3) AS clusters, lcn + p AS lcn FROM (SELECT *, unnest(generate_series(0, clusters - 1, 3)) AS p FROM ranges)", "extents")
def split_extents(g):
    return X.split_extents(X.extent_ranges(g.extents), 3)


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) - 1 AS INT) AS stream_ix FROM lineitem", "")
def newest_first_ordinals(g):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy(c("l_shipdate").desc(), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    return g.table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate", (F.row_number().over(w) - 1).alias("stream_ix"))


def sorted_by(name: str, order: list[str], shown: str, sql: str, of: str = "entries", reverse: bool = False) -> None:
    """A query that sorts all hits and gives each its position; sql: the order as the checking database has it."""

    def f(g: Given) -> DataFrame:
        wanted = ["attrs", "name", "path", "length", "allocated", "bulkiness", "treesize", "written_ft", "depth"]
        rows = getattr(g, of)
        hits = rows.select(*K, *(w for w in wanted if w in rows.columns))
        return S.numbered(S.ordered(hits, *order, reverse=reverse, parts=g.parts).select(*K, shown))

    f.__name__ = name
    query(f"SELECT {KS}, {shown}, row_number() OVER (ORDER BY {sql}, {KS}) AS position FROM {of}", of)(f)


TYPE_NAME = "CASE WHEN is_dir THEN 'File folder' WHEN name ILIKE '%.pdf' THEN 'PDF Document' WHEN name ILIKE '%.jpg' THEN 'JPEG Image' WHEN name ILIKE '%.mp4' THEN 'MP4 Video' ELSE 'File' END"
sorted_by("sort_name", ["name"], "name", "name")
sorted_by("sort_path", ["path"], "path", "volume, string_split(path, chr(92))")
sorted_by("sort_path_reversed", ["path"], "path", "volume DESC, string_split(path, chr(92)) DESC", reverse=True)
sorted_by("sort_type", ["type"], "name", TYPE_NAME)
sorted_by("sort_size", ["size"], "length", "length DESC", "sized")
sorted_by("sort_saved", ["saved"], "length", "length - allocated DESC", "sized")
sorted_by("sort_saved_reversed", ["saved"], "length", "length - allocated", "sized", True)
sorted_by("sort_disk", ["disk"], "allocated", "allocated DESC", "sized")
sorted_by("sort_bulkiness", ["bulkiness"], "bulkiness", "bulkiness DESC", "bulky")
sorted_by("sort_descendants", ["descendants"], "treesize", "treesize DESC", "sized")
sorted_by("sort_time", ["written"], "written_ft", "written_ft DESC")
sorted_by("sort_physical", ["physical"], "name", "node_id, link_ix DESC, stream_ix DESC")
sorted_by("sort_flags", ["flag:compressed"], "attrs", "attrs & 2048 <> 0 DESC")
sorted_by("sort_by_level", ["level", "size"], "depth", "depth, length DESC")
sorted_by("search_by_level", ["level"], "depth", "depth")


@query(f"SELECT {KS}, path, length FROM sized ORDER BY length DESC, {KS} LIMIT 100", "sized")
def top_k(g):
    return S.top(g.sized, 100, "size").select(*K, "path", "length")


@query(f"SELECT * FROM (SELECT {KS}, path, row_number() OVER (ORDER BY length DESC, {KS}) AS position FROM sized) WHERE position BETWEEN 1001 AND 1200", "sized")
def stretch_of_order(g):
    """Two hundred hits from the thousandth on, out of an order that is stored.

    The order has the hits' keys; the paths come to the stretch alone, from the rows of its nodes.
    """
    out = scratch(g.spark)
    # a sort by ranges reads its rows twice
    S.store_order(settled(g.sized.select(*K, "length")), out, "size", parts=g.parts)
    hits = settled(S.stretch(g.spark, out, 1001, 200).select(*K, "position"))
    return J.entries(J.of_nodes(g.tables, hits), g.folders).join(F.broadcast(hits), K).orderBy("position").select(*K, "path", "position")


# Sources and sinks ---------------------------------------------------------------------------------------------------


@query(f"SELECT path, name, length AS size, {stamp('written')} AS written FROM entries WHERE {MAIN} AND {OWN} AND ends_with(lower(name), '.pdf')")
def read_catalog(g):
    out = scratch(g.spark)
    R.write_report(R.select_columns(g.catalog.search("*.pdf"), "path,name,size,written"), out)
    return R.read_report(g.spark, out, "path,name,size,written").withColumn("written", F.date_format("written", "yyyy-MM-dd HH:mm:ss"))


@query(f"SELECT {KS}, path FROM entries WHERE {MAIN} AND {OWN} AND volume IN ('C:', 'D:', 'E:') AND ends_with(lower(name), '.mp4')")
def union_volumes(g):
    parts = [g.catalog.search("*.mp4", volumes=[v]) for v in ("C", "D", "E")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).select(*K, "path")


@query("SELECT o_custkey AS volume, o_orderkey AS node_id, epoch_us(CAST(o_orderdate AS TIMESTAMP)) AS snapshot_us FROM orders WHERE (o_custkey, o_orderdate) IN (SELECT o_custkey, max(o_orderdate) FROM orders GROUP BY o_custkey)", "")
def latest_snapshot(g):
    rows = g.table("orders").select(c("o_custkey").alias("volume"), c("o_orderkey").alias("node_id"), F.unix_micros(c("o_orderdate").cast("timestamp")).alias("snapshot_us"))
    return J.latest(rows, "volume", "snapshot_us")


@query("SELECT '\"' || path || '\"|\"' || name || '\"|' || length || '|' || CASE WHEN attrs & 1 <> 0 THEN '1' ELSE '0' END AS line FROM entries")
def write_report(g):
    out = scratch(g.spark)
    report = R.select_columns(g.entries, "path,name,size,readonly")
    R.write_report(report, out, "|", "DOUBLE")
    # each file begins with the header
    return g.spark.read.text(out).withColumnRenamed("value", "line").filter(c("line") != R.report_header(report, "|", "DOUBLE"))


@query("SELECT path || ',' || length || ',' || CASE WHEN length % 2 = 0 AND length >= 1000 THEN '\"' || format('{:,}', length) || '\"' WHEN length % 2 = 0 THEN CAST(length AS VARCHAR) ELSE 'it' END AS line FROM entries")
def write_table_export(g):
    rows = g.entries.select("path", "length", F.when(c("length") % 2 == 0, F.format_number("length", 0)).otherwise("it").alias("shown"))
    return R.export_lines(rows)


@query("SELECT path FROM entries WHERE stream_name = '' AND type_id IN (0, 8)")
def path_list(g):
    return R.path_list(g.entries, files_only=True)


@query("SELECT volume, count(*) AS extents, CAST(sum(clusters) AS BIGINT) AS clusters, max(last_record) + 1 AS records FROM ranges GROUP BY volume", "extents")
def extents_json(g):
    r = X.extent_ranges(g.extents)
    texts = R.extents_json(r, X.extent_summary(r), 100)
    head = F.max(F.when(c("chunk") < 0, F.concat("text", F.lit("]}"))))
    whole = texts.groupBy("volume").agg(F.sum(F.regexp_count("text", F.lit('"extent_ix"'))).cast("long").alias("extents"), head.alias("head"))
    return whole.select("volume", "extents", F.get_json_object("head", "$.summary.clusters").cast("long").alias("clusters"), F.get_json_object("head", "$.summary.records").cast("long").alias("records"))


ITEM = """'{"extent_ix":' || extent_ix || ',"clusters":' || clusters || ',"first_record":' || first_record || ',"last_record":' || last_record || ',"byte_offset":' || byte_offset || ',"byte_length":' || byte_length || '}'"""
TOTAL = """'{"volume":"' || volume || '","summary":{"extent_count":' || count(*) || ',"clusters":' || sum(clusters) || ',"records":' || max(last_record) + 1 || ',"bytes":' || sum(byte_length) || ',"fragmented":' || (count(*) > 1) || '},"extents":['"""


@query(
    f"""SELECT volume, CAST(extent_ix // 16 AS BIGINT) AS chunk, CASE WHEN extent_ix // 16 > 0 THEN ',' ELSE '' END || string_agg({ITEM}, ',' ORDER BY extent_ix) AS text FROM ranges GROUP BY volume, extent_ix // 16
    UNION ALL SELECT volume, -1, {TOTAL} FROM ranges GROUP BY volume UNION ALL SELECT DISTINCT volume, 4611686018427387904, ']}}' FROM ranges""",
    "extents",
)
def extents_json_chunks(g):
    r = X.extent_ranges(g.extents)
    return R.extents_json(r, X.extent_summary(r), 16)


@query("SELECT 'C:' AS volume, CAST(1 + o_orderkey // 32768 AS BIGINT) AS bucket, count(*) AS in_use FROM orders WHERE o_orderstatus <> 'F' GROUP BY ALL", "")
def slot_bitmaps(g):
    return X.slot_bitmaps(g.slots).select("volume", "bucket", X.popcount(c("bitmap")).cast("long").alias("in_use"))


@query(f"SELECT line FROM (SELECT -1 AS n, '\"path\"' || chr(9) || '\"size\"' AS line UNION ALL SELECT 0, '\"' || path || '\"' || chr(9) || length FROM entries WHERE {MAIN} AND {OWN} AND ends_with(lower(name), '.jpg'))")
def write_report_file(g):
    """One file under one header, read back line by line."""
    out = f"{scratch(g.spark)}.csv"
    R.write_report_file(R.select_columns(g.catalog.search("*.jpg"), "path,size"), out, "TAB")
    return g.spark.read.text(out).withColumnRenamed("value", "line")


#: Words for separators and quotes, and what they stand for.
WORDS = {"TAB": 9, "newline": 10, "New Line": 10, "SPACE": 32, "Return": 13, "SINGLE": 39, "double": 34, ";": 59}


@query(
    " UNION ALL ".join(f"SELECT '{w}' AS word, chr({n}) || path || chr({n}) || chr({n}) || length AS line FROM entries WHERE {MAIN} AND {OWN} AND ends_with(lower(name), '.mp4')" for w, n in WORDS.items())
)
def separator_words(g):
    """Each word as the separator and the quote of a report's lines."""
    report = R.select_columns(g.catalog.search("*.mp4"), "path,size")
    parts = [R.report_lines(report, w, w).select(F.lit(w).alias("word"), "line") for w in WORDS]
    return reduce(DataFrame.unionByName, parts)


@query("SELECT path || chr(9) || length || chr(9) || format('{:,}', allocated) AS line FROM entries")
def write_table_file(g):
    out = f"{scratch(g.spark)}.txt"
    R.write_table_file(g.entries.select("path", "length", F.format_number("allocated", 0).alias("shown")), out, tab=True)
    return g.spark.read.option("lineSep", "\r\n").text(out).withColumnRenamed("value", "line")


@query("SELECT event_id, user_id, event_type, value FROM events WHERE ends_with(lower(event_type), 'k')", "")
def standing(g):
    rows = g.table("events")
    schema = StructType([f for f in rows.schema.fields if f.name in ("event_id", "user_id", "event_type", "value")])
    hits = standing_search(g.spark, g.dir, schema, P.matches(c("event_type"), "*K", "glob"), files="events*.parquet")
    return run_available(hits, scratch(g.spark), scratch(g.spark)).select("event_id", "user_id", "event_type", "value")


@query("SELECT l.volume, l.node_id, l.link_ix, dp.path || l.name AS path, CAST(dp.depth + 1 AS INT) AS depth FROM links l JOIN dp ON dp.volume = l.volume AND dp.node_id = l.parent_id WHERE l.name LIKE '%.pdf' AND NOT list_contains(dp.ids, 103)")
def walk_folders(g):
    return walk(g.tables, c("name").endswith(".pdf"), c("name") != "NATION_3")


WALK = """, w AS (SELECT volume, node_id, volume || chr(92) AS path, 0 AS depth FROM folders WHERE node_id = 5
  UNION ALL SELECT f.volume, f.node_id, w.path || f.name || chr(92), w.depth + 1 FROM folders f JOIN w ON f.volume = w.volume AND f.parent_id = w.node_id WHERE f.node_id <> 5 AND ({}))
SELECT l.volume, l.node_id, l.link_ix, w.path || l.name AS path, CAST(w.depth + 1 AS INT) AS depth FROM links l JOIN w ON w.volume = l.volume AND w.node_id = l.parent_id WHERE l.node_id <> 5"""


@query(WALK.format("w.depth + 1 < 2"), "links")
def walk_by_depth(g):
    """All links but those below the second level of folders."""
    return walk(g.tables, F.lit(True), c("depth") < 2)


@query(WALK.format("regexp_full_match(w.path || f.name, '.:.NATION_1[0-9]?(.Customer#0*[0-9]*[13579])?')") + " AND (l.node_id % 3 = 0 AND w.depth + 1 = 3 OR (w.path || l.name) LIKE '%.pdf')", "links")
def walk_by_path(g):
    """Some nations, and some customers in these, chosen by the whole path; links by depth or path."""
    enter = c("path").rlike(r"^.:.NATION_1[0-9]?(.Customer#0*[0-9]*[13579])?$")
    return walk(g.tables, (c("node_id") % 3 == 0) & (c("depth") == 3) | c("path").endswith(".pdf"), enter)


@query("SELECT volume, node_id, link_ix, path FROM entries WHERE stream_name = '' AND type_id IN (0, 8) AND NOT is_dir AND regexp_full_match(lower(path), '..\\\\nation_1[^\\\\/]*\\\\([^\\\\/]+\\\\)*order_[^\\\\/]*\\.pdf')")
def standing_by_path(g):
    """Links arrive, some of them twice; the hits among them by path, each once, as the batch search has them."""
    at = F.timestamp_seconds(F.lit(1_700_000_000) + c("node_id") % 900)
    rows = g.tables["links"].join(g.tables["nodes"].filter("NOT is_dir").select("volume", "node_id", "is_dir"), ["volume", "node_id"]).withColumn("seen", at)
    again = rows.filter("node_id % 5 = 0").withColumn("seen", c("seen") + F.expr("INTERVAL 10 MINUTES"))
    arrived = settled(rows.unionByName(again))
    folder = arrived.inputFiles()[0].rpartition("/")[0]
    hits = standing_paths(g.spark, folder, arrived.schema, "?:\\NATION_1*\\**\\order_*.pdf", g.folders, "seen", keys=["volume", "node_id", "link_ix"])
    return run_available(hits, scratch(g.spark), scratch(g.spark)).select("volume", "node_id", "link_ix", "path")


BAD = ("[", "a{2", "(x", "*z", "x)", "ok.*", "a\\\\b", "[a-z]+")


@query("SELECT p AS pattern, p IN ('ok.*', 'a\\\\b', '[a-z]+') AS valid, count(*) FILTER (CASE p WHEN 'ok.*' THEN starts_with(lower(name), 'ok') WHEN '[a-z]+' THEN regexp_full_match(lower(name), '[a-z]+') ELSE false END) AS hits FROM links, (SELECT unnest(['[', 'a{2', '(x', '*z', 'x)', 'ok.*', 'a\\\\b', '[a-z]+']) AS p) GROUP BY p", "links")
def invalid_pattern(g):
    """Which patterns are refused, and the hits of the others."""
    counts = []
    for text in BAD:
        try:
            found = P.matches(c("name"), P.checked(g.spark, text), "regex")
        except ValueError:
            found = None
        n = F.count_if(F.lit(False) if found is None else found)
        counts.append(F.struct(F.lit(text).alias("pattern"), F.lit(found is not None).alias("valid"), n.alias("hits")))
    return g.tables["links"].agg(F.array(*counts).alias("x")).select(F.explode("x").alias("x")).select("x.*")


NAMES = {"path_parts": "basename_dirname_extension", "user_records_only": "user_records", "newest_first_ordinals": "link_ix_stream_ix", "standing": "standing_search", "walk_folders": "walk"}


def registered() -> dict[str, tuple]:
    from . import dump_queries  # noqa: F401  adds its own

    return FOUND


def queries():
    return {NAMES.get(n, n): (lambda spark, sf_dir, f=f: f(Given.of(spark, sf_dir))) for n, (f, _) in registered().items()}


def oracle_sql():
    return {NAMES.get(n, n): sql for n, (_, sql) in registered().items() if sql}
