"""Functions, reports, storage analysis and the dump source on literal fixtures."""

from __future__ import annotations

import random
import struct
from itertools import groupby

import pytest
from pyspark.sql import functions as F

from treelake.functions import attributes as A
from treelake.functions import names as N
from treelake.operators import sorting as S
from treelake.operators import storage as X
from treelake.plans import paths as J
from treelake.plans import rollup as G
from treelake.sources import dump as D
from treelake.sources import reports as R


def one(spark, *columns):
    return list(spark.range(1).select(*columns).first())


def test_keys_and_sizes(spark):
    key = A.packed_key(F.lit(1022), F.lit(8190), F.lit(3))
    none = A.packed_key(F.lit(None).cast("int"), F.lit(None).cast("int"), F.lit(0))
    assert one(spark, *A.unpacked_key(key).values()) == [1022, 8190] and one(spark, *A.unpacked_key(none).values()) == [None, None]
    assert one(spark, A.wrap48(F.lit(0xFFFFFFFFFFFF)), A.wrap48(F.lit(1 << 48))) == [0xFFFFFFFFFFFF, 0]
    assert one(spark, *(G.share(F.lit(10), F.lit(i), F.lit(3)) for i in range(3))) == [3, 3, 4]


def test_flags_go_round(spark):
    mask = sum(A.BITS.values())
    df = spark.createDataFrame([(random.Random(k).getrandbits(30) & mask,) for k in range(50)], "attrs int")
    assert df.filter(A.encoded(A.decoded(F.col("attrs"))) != F.col("attrs")).count() == 0
    assert one(spark, A.attribute_class(F.lit(0x40000006)), A.attribute_class(F.lit(0x12)), A.attribute_class(F.lit(0))) == ["deleted", "hidden", "default"]


def test_names(spark):
    p = lambda x: F.lit(x)
    assert one(spark, N.basename(p("C:\\a\\b.txt")), N.dirname(p("C:\\a\\b.txt")), N.extension(p("a.b\\c")), N.extension(p("x.tar.gz"))) == ["b.txt", "C:\\a", "", ".gz"]
    assert one(spark, N.strip_stream(p("C:\\f:s:$DATA")), N.strip_stream(p("C:\\a\\.")), N.strip_stream(p("C:\\")), N.strip_stream(p("C:\\a\\\\"))) == ["C:\\f", "C:\\a", "C:\\", "C:\\a"]
    assert one(spark, N.normalize(p("a\\\\b\\"), "C:\\"), N.normalize(p("C:\\\\a\\\\\\b:s"), "D:\\")) == ["C:\\a\\b", "C:\\a\\b"]
    assert one(spark, J.stream_suffix(F.lit(14), F.lit("")), J.stream_suffix(F.lit(8), F.lit("s")), J.stream_suffix(F.lit(8), F.lit(""))) == ["::$EA", ":s", ""]


@pytest.mark.parametrize(("raw", "slots", "used", "leading", "trailing"), [("FFFF", 16, 16, 0, 0), ("0000", 16, 0, 16, 0), ("F00F", 16, 8, 4, 4), ("0001", 16, 1, 8, 7)])
def test_slots(spark, raw, slots, used, leading, trailing):
    raw = bytes.fromhex(raw)
    rows = [("C:", k, bool(raw[k // 8] >> k % 8 & 1)) for k in range(slots)]
    r = X.block_use(spark.createDataFrame(rows, "volume string, slot bigint, in_use boolean"), slots).first()
    assert (r.slots, r.in_use, r.leading, r.trailing) == (slots, used, leading, trailing)
    assert one(spark, X.popcount(F.lit(bytearray(raw)))) == [used]


def test_popcount_of_more_bytes(spark):
    assert one(spark, X.popcount(F.lit(bytearray.fromhex("FFFFFEFF7FFFFF03"))), X.popcount(F.lit(bytearray()))) == [56, 0]


def test_extents(spark):
    e = spark.createDataFrame([("a", 0, 10, 500), ("b", 0, 250, 1000)], "volume string, extent_ix int, next_vcn bigint, lcn bigint")
    pieces = X.split_extents(X.extent_ranges(e), 100).orderBy("volume", "piece_ix").collect()
    assert [(p.volume, p.clusters, p.lcn) for p in pieces] == [("a", 10, 500), ("b", 100, 1000), ("b", 100, 1100), ("b", 50, 1200)]


def test_report_columns_and_tokens():
    assert R.chosen("size, name") == ["name", "size"] and R.chosen("all") == list(R.COLUMNS)
    with pytest.raises(ValueError):
        R.chosen("nope")
    assert [R.separator_token(t) for t in ("tab", "New Line", "|")] == ["\t", "\n", "|"]


def test_report_goes_round(spark, tmp_path):
    df = spark.createDataFrame([("C:\\a", "a", 5), ("C:\\b|c", "b|c", 6)], "path string, name string, size bigint")
    R.write_report(df, str(tmp_path / "r"), "|")
    first = {p.read_text().split("\n")[0] for p in (tmp_path / "r").glob("part-*")}
    assert first == {'"path"|"name"|"size"'}
    back = R.read_report(spark, str(tmp_path / "r"), "path,name,size", "|")
    assert sorted(back.collect()) == sorted(df.collect())
    R.write_table_export(df.withColumn("x", F.lit("it's")), str(tmp_path / "t"))
    text = "".join(p.read_bytes().decode() for p in sorted((tmp_path / "t").glob("part-*")))
    assert 'C:\\a,5,"it\'s"\r\n' in text


def tree(spark, seed=3, n=120):
    r = random.Random(seed)
    nodes, links, streams = [("C:", 5, True)], [("C:", 5, 0, 5, ".")], [("C:", 5, 0, 0, "", 10, 4096, 4096)]
    folders = [5]
    for k in range(100, 100 + n):
        is_dir = r.random() < 0.4
        n_links = 1 if is_dir else r.choice([1, 1, 2, 3])
        nodes.append(("C:", k, is_dir))
        links += [("C:", k, i, r.choice(folders), f"n{k}_{i}") for i in range(n_links)]
        size = r.randrange(10**7)
        streams.append(("C:", k, 0, 0 if is_dir else 8, "", size, size, size))
        if is_dir:
            folders.append(k)
        elif r.random() < 0.2:
            streams.append(("C:", k, 1, 8, "WofCompressedData", 77, 99, 99))
    return {
        "nodes": spark.createDataFrame(nodes, "volume string, node_id bigint, is_dir boolean").withColumns({c: F.lit(0).cast("long") for c in ("created_ft", "written_ft", "accessed_ft")}).withColumn("attrs", F.lit(0)),
        "links": spark.createDataFrame(links, "volume string, node_id bigint, link_ix int, parent_id bigint, name string"),
        "streams": spark.createDataFrame(streams, "volume string, node_id bigint, stream_ix int, type_id int, stream_name string, length bigint, allocated bigint, bulkiness bigint").withColumn("is_sparse", F.lit(False)),
        "volumes": spark.createDataFrame([("C:", 4096, 1024, 3)], "volume string, cluster_size int, record_size int, reserved_clusters bigint"),
    }, nodes, links, streams


def test_random_tree(spark):
    tables, nodes, links, streams = tree(spark)
    is_dir = {k: d for _, k, d in nodes}
    below = {}
    for _, k, i, p, _ in links:
        if k != 5:
            below.setdefault(p, []).append((k, i))
    count = {k: sum(x[1] == k for x in links) for k in is_dir}

    def visit(k, i):
        n = count[k]
        part = lambda v: v * (i + 1) // n - v * i // n
        own = [s for s in streams if s[1] == k]
        twin = sum(s[6] for s in own if s[4] == "WofCompressedData")
        kids = [visit(*c) for c in below.get(k, [])]
        total = [sum(x) for x in zip(*kids, strict=True)] if kids else [0, 0, 0]
        total[2] -= sum(x[2] for x in kids if x[2] >= sum(y[1] for y in kids) // 100)
        for s in own:
            total[0] += 0 if s[4] else part(s[5])
            total[1] += 0 if s[4] else part(s[6] + twin)
            total[2] += part(s[7])
        if is_dir[k]:
            found[k] = tuple(total)
        return total

    found = {}
    visit(5, 0)
    sums = {r.node_id: (r.length, r.allocated - (3 * 4096 if r.node_id == 5 else 0)) for r in G.folder_totals(tables).collect()}
    assert sums == {k: v[:2] for k, v in found.items()}
    assert {r.node_id: r.bulkiness for r in G.bulkiness(tables).collect()} == {k: v[2] for k, v in found.items()}
    entries = J.entries(tables)
    assert entries.count() == sum(count[s[1]] for s in streams) and entries.select("node_id", "link_ix", "stream_ix").distinct().count() == entries.count()


def test_cycles_and_orphans(spark):
    nodes = spark.createDataFrame([("C:", 5, True), ("C:", 20, True), ("C:", 21, True)], "volume string, node_id bigint, is_dir boolean")
    links = spark.createDataFrame([("C:", 5, 0, 5, "."), ("C:", 20, 0, 21, "a"), ("C:", 21, 0, 20, "b"), ("C:", 22, 0, 99, "c")], "volume string, node_id bigint, link_ix int, parent_id bigint, name string")
    assert [r.node_id for r in J.folder_paths(links, nodes).collect()] == [5]
    assert [r.node_id for r in J.orphans(links, nodes).collect()] == [22]
    assert sorted(r.node_id for r in J.cycles(links, nodes).collect()) == [20, 21]


def test_paths_of_any_depth(spark):
    """A chain of 300 folders comes back whole."""
    n = 300
    nodes = spark.createDataFrame([("C:", 5, True), *(("C:", 100 + k, True) for k in range(n))], "volume string, node_id bigint, is_dir boolean").coalesce(1)
    links = spark.createDataFrame([("C:", 5, 0, 5, "."), *(("C:", 100 + k, 0, 99 + k if k else 5, "d") for k in range(n))], "volume string, node_id bigint, link_ix int, parent_id bigint, name string").coalesce(1)
    got = {r.node_id: (r.depth, r.path) for r in J.folder_paths(links, nodes).collect()}
    assert got == {5: (0, "C:\\"), **{100 + k: (k + 1, "C:\\" + "d\\" * (k + 1)) for k in range(n)}}


def test_lookup_and_snapshots(spark, tmp_path):
    tables = {
        "links": spark.createDataFrame([("C:", 20, 0, 5, "a"), ("C:", 20, 1, 5, "b")], "volume string, node_id bigint, link_ix int, parent_id bigint, name string"),
        "streams": spark.createDataFrame([("C:", 20, 0, 8, "s", 1, 10), ("C:", 20, 1, 8, "", 2, 20)], "volume string, node_id bigint, stream_ix int, type_id int, stream_name string, length bigint, allocated bigint"),
    }
    keys = spark.createDataFrame([("C:", 20, None, None), ("C:", 20, 1, 0), ("C:", 20, 2, 0), ("C:", 20, 0, 9), ("D:", 20, None, None)], "volume string, node_id bigint, link_ix int, stream_ix int")
    got = {(r.volume, r.link_ix, r.stream_ix): (r.name, r.length, r.found) for r in J.lookup(tables, keys).collect()}
    assert got == {("C:", None, None): ("a", 2, True), ("C:", 1, 0): ("b", 1, True), ("C:", 2, 0): (None, None, False), ("C:", 0, 9): (None, None, False), ("D:", None, None): (None, None, False)}
    rows = spark.createDataFrame([("C:", 1, "old"), ("C:", 2, "new"), ("D:", 1, "only")], "volume string, snapshot_ts int, x string")
    path = str(tmp_path / "store")
    J.replace_volumes(J.latest(rows), path)
    J.replace_volumes(spark.createDataFrame([("C:", 3, "newest")], rows.schema), path)
    assert sorted((r.volume, r.x) for r in spark.read.parquet(path).collect()) == [("C:", "newest"), ("D:", "only")]


def test_orders_and_their_reverse(spark):
    r = random.Random(5)
    names = ["b.pdf", "a.JPG", "c", "d.mp4", "B.txt"]
    rows = [("CD"[r.randrange(2)] + ":", k, r.randrange(2), r.randrange(2), r.choice(names), f"C:\\x{r.randrange(3)}\\{r.choice(names)}", *(r.randrange(4) for _ in range(7)), r.choice([0, 16, 2048])) for k in range(60)]
    fields = ["volume", "node_id", "link_ix", "stream_ix", "name", "path", "length", "allocated", "bulkiness", "treesize", "created_ft", "written_ft", "depth", "attrs"]
    hits = spark.createDataFrame(rows, "volume string, node_id bigint, link_ix int, stream_ix int, name string, path string, length bigint, allocated bigint, bulkiness bigint, treesize bigint, created_ft bigint, written_ft bigint, depth int, attrs int")
    kinds = {"pdf": "PDF Document", "jpg": "JPEG Image", "mp4": "MP4 Video", "txt": "Text Document"}
    type_of = lambda x: "File folder" if x["attrs"] & 16 else kinds.get(x["name"].lower().rpartition(".")[2], "File")
    orders = {
        "name": lambda x: [x["name"].encode()], "type": lambda x: [type_of(x).encode()], "path": lambda x: [x["volume"], [p.encode() for p in x["path"].split("\\")]], "size": lambda x: [-x["length"]],
        "saved": lambda x: [x["allocated"] - x["length"]], "disk": lambda x: [-x["allocated"]], "bulkiness": lambda x: [-x["bulkiness"]], "descendants": lambda x: [-x["treesize"]], "created": lambda x: [-x["created_ft"]],
        "written": lambda x: [-x["written_ft"]], "physical": lambda x: [x["node_id"], -x["link_ix"], -x["stream_ix"]], "flag:compressed": lambda x: [-(x["attrs"] & 2048)], "attributes": lambda x: [-x["attrs"]], "level": lambda x: [x["depth"]],
    }
    dicts = [dict(zip(fields, x, strict=True)) for x in rows]
    ties = lambda x: [x[t] for t in S.TIES]
    for order, key in orders.items():
        for reverse in (False, True):
            expected = sorted(sorted(dicts, key=ties), key=key, reverse=reverse)
            if reverse:
                # a reversed sort keeps equal ones in their order
                expected = [x for _, same in groupby(expected, key=key) for x in sorted(same, key=ties)]
            got = [[r[t] for t in S.TIES] for r in S.ordered(hits, order, reverse=reverse).collect()]
            assert got == [ties(x) for x in expected], (order, reverse)
    numbered = S.numbered(S.ordered(hits.repartition(7), "size").select(*S.TIES, "length")).orderBy("position").collect()
    assert [r.position for r in numbered] == list(range(1, 61)) and [r.length for r in numbered] == sorted((r.length for r in numbered), reverse=True)
    with pytest.raises(ValueError):
        S.ordered(hits, "nope")


def test_types_by_a_table(spark):
    rows = spark.createDataFrame([("a.PDF", 0), ("b", 0), ("c.xyz", 0), ("d.pdf", 16)], "name string, attrs int")
    types = spark.createDataFrame([("pdf", "PDF Document")], "extension string, type_name string")
    assert sorted((r.name, r.type) for r in N.typed(rows, types).collect()) == [("a.PDF", "PDF Document"), ("b", "File"), ("c.xyz", "XYZ File"), ("d.pdf", "File folder")]


# Dumps ---------------------------------------------------------------------------------------------------------------


def attribute(code, value=b"", name="", runs=None, sizes=(0, 0, 0), low=0):
    title = name.encode("utf-16-le")
    if runs is None:
        at = 24 + (len(title) + 7) // 8 * 8
        body = struct.pack("<IHH", len(value), at, 0) + title.ljust(at - 24, b"\0") + value
        return _sized(code, 0, len(name), 24, body)
    at = 64 + (len(title) + 7) // 8 * 8
    body = struct.pack("<qqHHI", low, 0, at, 0, 0) + struct.pack("<qqq", *sizes) + title.ljust(at - 64, b"\0") + runs
    return _sized(code, 1, len(name), 64, body)


def _sized(code, outside, chars, name_at, body):
    size = (16 + len(body) + 7) // 8 * 8
    return (struct.pack("<IIBBHHH", code, size, outside, chars, name_at, 0, 0) + body).ljust(size, b"\0")


def standard(attrs):
    return attribute(0x10, struct.pack("<qqqqI", 11, 12, 13, 14, attrs).ljust(48, b"\0"))


def named(parent, text, space=1):
    return attribute(0x30, struct.pack("<Q", parent).ljust(64, b"\0") + bytes([len(text), space]) + text.encode("utf-16-le"))


def record(attributes, flags=1, base=0, broken=False):
    body = b"".join(attributes) + struct.pack("<II", 0xFFFFFFFF, 0)
    raw = bytearray((b"FILE" + struct.pack("<HHQHHHHIIQ", 48, 3, 0, 1, 1, 56, flags, 0, 1024, base)).ljust(56, b"\0") + body).ljust(1024, b"\0")
    raw = bytearray(raw)
    raw[48:50] = b"\x07\x00"
    for k in (1, 2):
        raw[48 + 2 * k : 50 + 2 * k] = raw[512 * k - 2 : 512 * k]
        raw[512 * k - 2 : 512 * k] = b"\x07\x00"
    if broken:
        raw[510] ^= 1
    return bytes(raw)


RUNS = bytes.fromhex("3110001000" + "1104F0" + "0108" + "00")


def test_dump(spark, tmp_path):
    file = [standard(0x20), named(30, "twice.txt"), named(5, "again.txt"), named(5, "AGAIN~1", 2), attribute(0x80, b"hello"), attribute(0x80, name="s", runs=RUNS, sizes=(8192, 5000, 5000))]
    slots = {5: record([standard(6), named(5, "."), attribute(0x90, b"x" * 40, "$I30"), attribute(0xA0, name="$I30", runs=RUNS, sizes=(4096, 4096, 4096))], 3), 30: record([standard(0), named(5, "dir")], 3), 31: record(file), 32: record(file, 0), 33: record(file, broken=True), 34: record([attribute(0x80, name="t", runs=RUNS, sizes=(4096, 10, 10)), attribute(0x80, name="s", runs=RUNS, low=28)], base=31)}
    path = tmp_path / "C.dump"
    path.write_bytes(struct.pack("<8sIIIQQQ20x", b"DUMPTEST", 1, 0, 1024, 35, 35 * 1024, 0) + b"".join(slots.get(k, bytes(1024)) for k in range(35)))
    dump = D.read_dump(spark, str(path), per_part=10)
    assert dump.count() == 35
    attributes = D.parse_records(dump).cache()
    t = D.catalog_tables(attributes)
    assert sorted((r.node_id, r.is_dir, r.attrs) for r in t["nodes"].collect()) == [(5, True, 0x16), (30, True, 0x10), (31, False, 0x20)]
    assert sorted((r.node_id, r.link_ix, r.parent_id, r.name) for r in t["links"].collect()) == [(5, 0, 5, "."), (30, 0, 5, "dir"), (31, 0, 5, "again.txt"), (31, 1, 30, "twice.txt")]
    assert sorted((r.node_id, r.type_id, r.stream_name, r.length, r.allocated) for r in t["streams"].collect()) == [(5, 0, "", 4136, 4096), (31, 8, "", 5, 0), (31, 8, "s", 5000, 8192), (31, 8, "t", 10, 4096)]
    runs = [(r.next_vcn, r.lcn) for r in D.decode_runs(attributes.filter("kind = 'stream' AND name = 's' AND lowest_vcn = 0")).orderBy("run_ix").collect()]
    assert runs == [(16, 4096), (20, 4080), (28, None)]


def test_dump_with_malformed_attributes(spark, tmp_path):
    short = [attribute(0x10, b"abc"), attribute(0x30, b"x" * 20), attribute(0x30, struct.pack("<Q", 5).ljust(64, b"\0") + bytes([200, 1])), named(5, "good.txt"), _sized(0x80, 1, 0, 64, b"1234")]
    path = tmp_path / "D.dump"
    header = struct.Struct("<8sIIIQQQ20x")
    path.write_bytes(header.pack(b"DUMPTEST", 1, 0, 1024, 1, 1024, 0) + record(short))
    rows = D.parse_records(D.read_dump(spark, f"file://{path}")).collect()
    assert [(r.kind, r.name) for r in rows] == [("link", "good.txt")]
    for bad in (header.pack(b"DUMPTEST", 2, 0, 1024, 1, 1024, 0), header.pack(b"DUMPTEST", 1, 1, 1024, 1, 1024, 600), header.pack(b"DUMPTEST", 1, 0, 1024, 9, 9216, 0), header.pack(b"DUMPTEST", 1, 0, 0, 1, 1024, 0), b"short"):
        path.write_bytes(bad + record(short))
        if bad == b"short":
            path.write_bytes(bad)
        with pytest.raises(Exception, match="dump"):
            D.read_dump(spark, str(path)).collect()
