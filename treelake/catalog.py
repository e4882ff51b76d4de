"""A file catalog derived from the given tables: the same SQL text for Spark and for the checking database.

Volumes are regions, folders are nations and customers, files are orders, streams are order lines. Every seventh order
has a second hard link in its nation's folder. Some files have streams of other types, each volume has three files of the
file system's own, and some files are marked as deleted. attributes are the raw ones that streams are made from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "orders", "lineitem")
NAMES = ("volumes", "links", "streams", "nodes", "attributes")
ROOT = 5

_FT = "CAST({micros}(CAST({x} AS TIMESTAMP)) * 10 + 116444736000000000 AS BIGINT)"

TEXT = {
    "volumes": """SELECT chr(67 + r_regionkey) || ':' AS volume, CAST(4096 AS INT) AS cluster_size, CAST(1024 AS INT) AS record_size,
        CAST(10 * (r_regionkey + 1) AS BIGINT) AS reserved_clusters FROM region""",
    "folders": """SELECT chr(67 + r_regionkey) || ':' AS volume, CAST(5 AS BIGINT) AS node_id, CAST(5 AS BIGINT) AS parent_id, '.' AS name FROM region
        UNION ALL SELECT chr(67 + n_regionkey) || ':', CAST(100 + n_nationkey AS BIGINT), CAST(5 AS BIGINT), n_name FROM nation
        UNION ALL SELECT chr(67 + n_regionkey) || ':', CAST(1000 + c_custkey AS BIGINT), CAST(100 + c_nationkey AS BIGINT), c_name FROM customer JOIN nation ON c_nationkey = n_nationkey""",
    "files": """SELECT chr(67 + n_regionkey) || ':' AS volume, CAST(10000000 + o_orderkey AS BIGINT) AS node_id, o_orderkey, CAST(1000 + o_custkey AS BIGINT) AS parent_id,
        CAST(100 + c_nationkey AS BIGINT) AS second_parent_id, 'Order_' || CAST(o_orderkey AS VARCHAR(20)) || CASE o_orderstatus WHEN 'F' THEN '.pdf' WHEN 'O' THEN '.JPG' ELSE '.mp4' END AS name,
        CAST(32 + CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '2-HIGH' THEN 2 WHEN '3-MEDIUM' THEN 4 WHEN '5-LOW' THEN 16384 ELSE 0 END + CASE o_orderstatus WHEN 'P' THEN 2048 ELSE 0 END + CASE WHEN o_orderkey % 17 = 0 THEN 1073741824 ELSE 0 END AS INT) AS attrs,
        {ft_orderdate} AS created_ft FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey""",
    "system": """SELECT chr(67 + r_regionkey) || ':' AS volume, CAST(id AS BIGINT) AS node_id, name FROM region CROSS JOIN (SELECT 0 AS id, '$MFT' AS name UNION ALL SELECT 6, '$Bitmap' UNION ALL SELECT 8, '$BadClus') x""",
    "links": """SELECT volume, node_id, CAST(0 AS INT) AS link_ix, parent_id, name FROM folders
        UNION ALL SELECT volume, node_id, CAST(0 AS INT), CAST(5 AS BIGINT), name FROM system
        UNION ALL SELECT volume, node_id, CAST(0 AS INT), parent_id, name FROM files
        UNION ALL SELECT volume, node_id, CAST(1 AS INT), second_parent_id, 'ln_' || CAST(o_orderkey AS VARCHAR(20)) || '.pdf' FROM files WHERE o_orderkey % 7 = 0""",
    "order_lines": """SELECT l_orderkey, CAST(l_linenumber AS INT) AS line, CAST(sum(CAST(floor(l_extendedprice) AS BIGINT)) AS BIGINT) AS length,
        CAST(sum(CASE WHEN l_extendedprice < 2000 THEN 0 ELSE CAST(ceil(floor(l_extendedprice) / 4096) AS BIGINT) * 4096 END) AS BIGINT) AS allocated,
        max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS sparse, min({ft_shipdate}) AS first_ft, max({ft_shipdate}) AS last_ft FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "streams": """SELECT volume, node_id, CAST(0 AS INT) AS stream_ix, CAST(0 AS INT) AS type_id, '' AS stream_name, CAST(256 AS BIGINT) AS length, CAST(4096 AS BIGINT) AS allocated, CAST(4096 AS BIGINT) AS bulkiness, false AS is_sparse FROM folders
        UNION ALL SELECT volume, node_id, CAST(0 AS INT), CAST(8 AS INT), '', coalesce(length, CAST(0 AS BIGINT)), coalesce(allocated, CAST(0 AS BIGINT)), coalesce(allocated, CAST(0 AS BIGINT)), coalesce(sparse, 0) = 1
            FROM files LEFT JOIN (SELECT * FROM order_lines WHERE line = 1) x ON l_orderkey = o_orderkey
        UNION ALL SELECT volume, node_id, CAST(line - 1 AS INT), CAST(8 AS INT), CASE line WHEN 7 THEN 'WofCompressedData' ELSE 's' || CAST(line AS VARCHAR(5)) END, length, allocated, allocated, sparse = 1
            FROM files JOIN order_lines ON l_orderkey = o_orderkey WHERE line > 1
        UNION ALL SELECT volume, node_id, CAST(100 AS INT), CAST(14 AS INT), '', CAST(64 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), false FROM files WHERE o_orderkey % 11 = 0
        UNION ALL SELECT volume, node_id, CAST(101 AS INT), CAST(16 AS INT), '$EFS', CAST(600 AS BIGINT), CAST(4096 AS BIGINT), CAST(4096 AS BIGINT), false FROM files WHERE o_orderkey % 13 = 0
        UNION ALL SELECT volume, node_id, CAST(0 AS INT), CAST(8 AS INT), '', CAST(262144 AS BIGINT), CAST(262144 AS BIGINT), CAST(262144 AS BIGINT), false FROM system
        UNION ALL SELECT volume, node_id, CAST(1 AS INT), CAST(11 AS INT), '', CAST(4128 AS BIGINT), CAST(8192 AS BIGINT), CAST(8192 AS BIGINT), false FROM system WHERE node_id = 0""",
    "attributes": """SELECT volume, node_id, CAST(code AS INT) AS code, '$I30' AS name, code = 144 AS resident, CAST(CASE code WHEN 144 THEN 200 + node_id % 90 ELSE 0 END AS BIGINT) AS value_length,
            CAST(CASE code WHEN 160 THEN 4096 * (1 + node_id % 3) ELSE 8 END AS BIGINT) AS data_size, CAST(CASE code WHEN 160 THEN 4096 * (1 + node_id % 3) ELSE 4096 END AS BIGINT) AS allocated_size, CAST(NULL AS BIGINT) AS compressed_size, CAST(8 AS BIGINT) AS initialized_size, false AS sparse
            FROM folders CROSS JOIN (SELECT 144 AS code UNION ALL SELECT 160 UNION ALL SELECT 176) x
        UNION ALL SELECT volume, node_id, CAST(128 AS INT), CASE line WHEN 1 THEN '' ELSE 's' || CAST(line AS VARCHAR(5)) END, allocated = 0, CASE allocated WHEN 0 THEN length ELSE 0 END, length, allocated, CASE WHEN attrs >= 2048 AND attrs < 16384 THEN CAST(floor(allocated / 8192) * 4096 AS BIGINT) END, length, sparse = 1
            FROM files JOIN order_lines ON l_orderkey = o_orderkey
        UNION ALL SELECT volume, node_id, CAST(128 AS INT), '$Bad', false, CAST(0 AS BIGINT), CAST(1048576 AS BIGINT), CAST(1048576 AS BIGINT), CAST(NULL AS BIGINT), CAST(12288 AS BIGINT), true FROM system WHERE node_id = 8""",
    "nodes": """SELECT n.volume, n.node_id, n.is_dir, n.attrs, n.created_ft, n.written_ft, n.accessed_ft FROM (
        SELECT volume, node_id, true AS is_dir, CAST(CASE WHEN node_id = 5 THEN 22 ELSE 16 END AS INT) AS attrs, CAST(125911584000000000 AS BIGINT) AS created_ft, CAST(125911584000000000 + node_id * 600000000 AS BIGINT) AS written_ft, CAST(125911584000000000 + node_id * 864000000 AS BIGINT) AS accessed_ft FROM folders
        UNION ALL SELECT volume, node_id, false, CAST(6 AS INT), CAST(125911584000000000 AS BIGINT), CAST(125911584000000000 AS BIGINT), CAST(125911584000000000 AS BIGINT) FROM system
        UNION ALL SELECT volume, node_id, false, attrs, created_ft, coalesce(first_ft, created_ft), coalesce(last_ft, created_ft)
            FROM files LEFT JOIN (SELECT l_orderkey, min(first_ft) AS first_ft, max(last_ft) AS last_ft FROM order_lines GROUP BY l_orderkey) x ON l_orderkey = o_orderkey) n""",
}


def edited() -> dict[str, str]:
    """The catalog after some changes: some customers' folders hang at the root, some have another name, and some streams have grown."""
    text = dict(TEXT)
    for part, old, new in (
        ("folders", "CAST(100 + c_nationkey AS BIGINT), c_name FROM", "CAST(CASE WHEN c_custkey % 40 = 0 THEN 5 ELSE 100 + c_nationkey END AS BIGINT), c_name || CASE WHEN c_custkey % 25 = 0 THEN '.old' ELSE '' END FROM"),
        ("order_lines", "sum(CAST(floor(l_extendedprice) AS BIGINT))", "sum(CAST(floor(l_extendedprice) AS BIGINT) + CASE WHEN l_orderkey % 37 = 0 THEN 5000 ELSE 0 END)"),
    ):
        text[part] = text[part].replace(old, new)
    return text


def filled(micros: str, text: dict[str, str] = TEXT) -> dict[str, str]:
    at = {f"ft_{c}": _FT.format(micros=micros, x=f"{p}_{c}") for p, c in (("o", "orderdate"), ("l", "shipdate"))}
    return {name: t.format(**at) for name, t in text.items()}


def prefix(text: dict[str, str] = TEXT) -> str:
    """The catalog as common table expressions of the checking database, to be followed by a query."""
    return "WITH RECURSIVE " + ",\n".join(f"{name} AS ({t})" for name, t in filled("epoch_us", text).items())


def derived(spark: SparkSession, sf_dir: str, text: dict[str, str] = TEXT, stored: dict[str, str] | None = None, parts: int | None = None, names: tuple[str, ...] = NAMES) -> dict[str, DataFrame]:
    """volumes, links, streams, nodes and attributes of the derived catalog, or other parts of it.

    stored: paths of parts that are written already. parts: how many to deal the order lines into, by order, before they are grouped and joined by it.
    """
    texts = filled("unix_micros", text)
    given = {t: f"SELECT * FROM parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}
    if parts:
        given["lineitem"] = given["lineitem"].replace("*", f"/*+ REPARTITION({parts}, l_orderkey) */ *")
    ctes = given | texts | {name: f"SELECT * FROM parquet.`{path}`" for name, path in (stored or {}).items()}
    ctes = ",\n".join(f"{name} AS ({t})" for name, t in ctes.items())
    return {name: spark.sql(f"WITH {ctes} SELECT * FROM {name}") for name in names}
