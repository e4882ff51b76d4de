"""Intervals and totals of trees, walks, standing searches by path, the stored catalog's subtrees, postings and Bloom filters, reports and dumps as files."""

from __future__ import annotations

import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from treelake import catalog_queries as Q
from treelake.functions import patterns as P
from treelake.operators.search import Catalog, walk
from treelake.plans import paths as J
from treelake.plans.intervals import intervals, subtree_sums
from treelake.sources import dump as D
from treelake.sources import reports as R
from treelake.streaming.standing import run_available, standing_paths

from .test_parts import tree

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def given(spark):
    return Q.Given(spark, SMALL)


def plan(df) -> str:
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "4000")
    return df._jdf.queryExecution().executedPlan().toString()


def below(parents: dict, i) -> set:
    """A folder and all folders below it."""
    return {i} | {x for j, p in parents.items() if p == i and j != i for x in below(parents, j)}


@pytest.mark.parametrize("shape", ["chain", "random", "wide"])
def test_intervals_hold_subtrees_and_sums(spark, shape):
    r = random.Random(4)
    n = 60
    parents = {5: 5} | {k: {"chain": k - 1 if k > 16 else 5, "random": r.choice([5, *range(16, k)]), "wide": 5}[shape] for k in range(16, 16 + n)}
    names = {k: r.choice("ab!") + str(r.randrange(3)) for k in parents}
    nodes = spark.createDataFrame([(v, k, True) for v in "CD" for k in parents], "volume string, node_id bigint, is_dir boolean")
    links = spark.createDataFrame([(v, k, 0, p, names[k]) for v in "CD" for k, p in parents.items()], "volume string, node_id bigint, link_ix int, parent_id bigint, name string")
    folders = J.folder_paths(links, nodes)
    got = {(x.volume, x.node_id): (x.lo, x.hi) for x in intervals(folders).collect()}
    assert len(got) == 2 * len(parents) and len({e for x in got.values() for e in x}) == 4 * len(parents)
    own = {k: r.randrange(100) for k in parents}
    sums = subtree_sums(folders.join(spark.createDataFrame(list(own.items()), "node_id bigint, x bigint"), "node_id"), ["x"])
    sums = {(s.volume, s.node_id): s.x for s in sums.collect()}
    for i in parents:
        inside = below(parents, i)
        for v in "CD":
            lo, hi = got[v, i]
            assert {k for k in got if lo <= got[k][0] <= hi} == {(v, k) for k in inside} and hi - lo == 2 * len(inside) - 1
            assert sums[v, i] == sum(own[k] for k in inside)
    assert intervals(folders.limit(0)).collect() == []


def test_totals_multiply_nothing_by_depth(given):
    text = Q.G.folder_totals(given.tables, given.folders)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(ids" not in text and "array_contains" not in text


def test_walk_starts_anywhere_and_sees_path_and_depth(spark):
    t = tree(spark)[0]
    nodes = t["nodes"]
    folders = {(r.volume, r.node_id): r for r in J.folder_paths(t["links"], nodes).collect()}
    links = [r for r in t["links"].collect() if r.node_id != r.parent_id and (r.volume, r.parent_id) in folders]
    start = sorted(k for k, f in folders.items() if f.depth == 1)[0]
    at = spark.createDataFrame([(*start, "X\\", 0)], "volume string, node_id bigint, path string, depth int")
    got = {(r.volume, r.node_id, r.link_ix, r.depth) for r in walk(t, F.col("depth") <= 2, F.col("depth") < 2, at).collect()}
    want = set()
    for r in links:
        f = folders[r.volume, r.parent_id]
        if r.volume == start[0] and start[1] in f.ids and f.depth - 1 < 2:
            want.add((r.volume, r.node_id, r.link_ix, f.depth))
    assert got == want and got
    # a folder that isn't entered hides all below it
    barred = sorted(f.path for f in folders.values() if f.depth == 1)[0].rstrip("\\")
    got = {(r.volume, r.node_id, r.link_ix) for r in walk(t, F.lit(True), F.col("path") != barred).collect()}
    assert got == {(r.volume, r.node_id, r.link_ix) for r in links if not folders[r.volume, r.parent_id].path.startswith(barred + "\\")}


def test_standing_search_by_path_drops_late_and_repeated_rows(spark, tmp_path):
    schema = "volume string, node_id bigint, link_ix int, parent_id bigint, name string, is_dir boolean, seen timestamp"
    folders = spark.createDataFrame([("C:", 20, "C:\\logs\\"), ("C:", 21, "C:\\tmp\\")], "volume string, node_id bigint, path string")
    row = lambda n, parent, name, hour, minute=0: ("C:", n, 0, parent, name, False, datetime(2024, 1, 1, hour, minute))
    first = [row(1, 20, "a.txt", 12), row(2, 20, "b.txt", 15), row(3, 21, "c.txt", 15), row(4, 99, "lost.txt", 15)]
    # b again, a again but late, a new one too late, and a new one
    second = [row(2, 20, "b.txt", 15, 10), row(1, 20, "a.txt", 12, 1), row(5, 20, "late.txt", 13), row(6, 20, "d.txt", 15, 20)]
    hits = lambda: standing_paths(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, "c:\\logs\\*.txt", folders, "seen", "1 hour", ["volume", "node_id", "link_ix"])
    for rows in (first, second):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = run_available(hits(), str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted((r.node_id, r.path) for r in out.collect()) == [(1, "C:\\logs\\a.txt"), (2, "C:\\logs\\b.txt"), (6, "C:\\logs\\d.txt")]


def test_subtree_is_a_pushed_range(given):
    hits = given.catalog.subtree(101)
    text = plan(hits)
    assert "GreaterThanOrEqual(pos," in text and "LessThanOrEqual(pos," in text and "array_contains" not in text and "Join" not in text
    assert given.catalog.subtree(101, ["Z:"]).count() == 0 and given.catalog.subtree(5).count() == given.entries.count()


def test_volumes_come_from_the_folders_names(given, spark, tmp_path):
    stored = given.catalog.store(str(tmp_path / "c"), given.folders, parts=9)
    assert stored.volumes() == ["C:", "D:", "E:", "F:", "G:"]
    one = Catalog(given.tables, given.entries.filter("volume = 'D:'").drop("part", "block"))
    # another number of parts: none of the earlier ones may stay
    again = one.store(str(tmp_path / "c"), parts=4)
    assert again.entries.count() == given.entries.count() == again.entries.select(*Q.K).distinct().count()
    assert again.search("*.pdf", volumes=["D"]).count() == given.catalog.search("*.pdf", volumes=["D"]).count()


@pytest.fixture(scope="module")
def posted(given, tmp_path_factory):
    return given.catalog.store(str(tmp_path_factory.mktemp("posted")), parts=12, grams=True, block=16)


@pytest.mark.parametrize("pattern", ["order_5", "D:\\NATION_1*\\**\\order_*9.pdf", ">.*Customer#0000001[0-9]+\\\\.*\\.jpg", "*ln_*", "?", "customer#000000013\\", "nowhere"])
def test_postings_give_the_same_hits(given, posted, pattern):
    key = lambda df: sorted(map(tuple, df.select(*Q.K).collect()))
    assert key(posted.search(pattern)) == key(given.catalog.search(pattern))


def test_postings_leave_files_out(given, posted):
    pattern = "Customer#000000013\\Order"
    plain = Catalog({"volumes": given.tables["volumes"]}, posted.entries, posted.path)
    few, all_ = (c.search(pattern) for c in (posted, plain))
    assert few.count() == all_.count() > 0
    counts = []
    for hits in (few, all_):
        hits.collect()
        counts.append(max(m.value() for m in metrics(hits, "numFiles")))
    assert 0 < counts[0] < counts[1] / 2, counts


def test_literals_of_patterns():
    assert P.regex_literals(r"abc+def?gh") == ["abc", "de", "gh"] and P.regex_literals(r".*_[0-9]*7\.(pdf|jpg)") == ["_", "7."]
    assert P.regex_literals(r"(?i)abc") == P.regex_literals("foo|bar") == P.regex_literals(r"\Qa.b\E") == P.regex_literals("[a[bc]]def") == []
    assert P.regex_literals(r"[]a]bcd(e[)]f)ghi") == ["bcd", "ghi"] and P.regex_literals("a{2}bcd") == ["bcd"]
    assert P.literals("?:\\NATION_1*\\**\\order_*.pdf") == [".pdf", ":\\nation_1", "\\", "\\order_"] and P.literals("é*abc") == ["abc"]
    r = random.Random(3)
    import re

    for _ in range(300):
        regex = "".join(r.choice(["ab", "c", "x+", "y?", "z*", "(?:q|w)", "[ef]", ".", "\\.", "(gh)"]) for _ in range(r.randrange(1, 6)))
        for _ in range(20):
            text = "".join(r.choice("abcxyzqwefgh.") for _ in range(r.randrange(0, 9)))
            if re.fullmatch(regex, text):
                assert all(p in text for p in P.regex_literals(regex)), (regex, text)


def test_bloom_filters_skip_names_that_are_not_there(given, spark, tmp_path):
    """With dictionaries too small to tell, only the filter can: no row of an absent name is read, though it lies between those that are there."""
    spark.conf.set("parquet.dictionary.page.size", "64")
    path = str(tmp_path / "c")
    rows = given.entries.filter("NOT is_dir").drop("part", "block")
    stored = Catalog(given.tables, rows).store(path, names=10_000)
    read = {}
    name = stored.entries.filter("name_lc LIKE 'order_5%.pdf'").first().name_lc
    for name in (name, name[:-1] + "g"):
        hits = stored.entries.filter(F.col("name_lc") == name)
        hits.collect()
        read[name] = sum(m.value() for m in metrics(hits, "numOutputRows"))
    there, absent = read.values()
    assert absent == 0 < there


def metrics(df, name: str) -> list:
    """One counter of all scans of a plan that has run."""
    p = df._jdf.queryExecution().executedPlan()
    if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        p = p.executedPlan()
    found, left = [], [p]
    while left:
        p = left.pop()
        kind = p.getClass().getSimpleName()
        if kind == "FileSourceScanExec":
            found.append(p.metrics().apply(name))
        left += [p.plan()] if kind.endswith("QueryStageExec") else [p.children().apply(k) for k in range(p.children().size())]
    return found


def test_a_stretch_of_a_stored_order_reads_few_rows(given, spark, tmp_path):
    from treelake.operators import sorting as S

    spark.conf.set("parquet.block.size", "20000")
    S.store_order(given.entries.select(*Q.K, "name", "length"), str(tmp_path / "o"), "size", "name")
    spark.conf.unset("parquet.block.size")
    got = S.stretch(spark, str(tmp_path / "o"), 100, 50)
    rows = got.collect()
    want = S.ordered(given.entries, "size", "name").limit(149).collect()[99:]
    assert [r.position for r in rows] == list(range(100, 150)) and [(r.volume, r.node_id, r.link_ix, r.stream_ix) for r in rows] == [(r.volume, r.node_id, r.link_ix, r.stream_ix) for r in want]
    text = plan(got)
    assert "GreaterThanOrEqual(position,100)" in text and "LessThanOrEqual(position,149)" in text


def test_a_report_is_one_file_in_order(spark, tmp_path):
    df = spark.range(0, 5000, 1, 7).select(F.concat(F.lit("C:\\f"), "id").alias("path"), F.col("id").alias("size"))
    for _ in range(2):
        R.write_report_file(df, str(tmp_path / "r.csv"), "|", "SINGLE")
    assert [p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")] == ["r.csv"]
    assert (tmp_path / "r.csv").read_text().split("\n") == ["'path'|'size'", *(f"'C:\\f{k}'|{k}" for k in range(5000)), ""]
    R.write_table_file(df.limit(1), f"file://{tmp_path}/t.txt")
    assert (tmp_path / "t.txt").read_bytes() == b"C:\\f0,0\r\n"


def test_extents_of_a_volume_are_one_json_text(spark, tmp_path):
    import json

    e = spark.createDataFrame([(v, k, 3 * k + 3, 100 * k) for v in ("a", 'b"\\') for k in range(50)], "volume string, extent_ix int, next_vcn bigint, lcn bigint")
    from treelake.operators import storage as X

    ranges = X.extent_ranges(e)
    chunks = R.extents_json(ranges, X.extent_summary(ranges), 7)
    assert chunks.groupBy("volume").count().first()["count"] == 10
    R.write_extents_json(chunks, str(tmp_path / "x.json"))
    got = json.loads((tmp_path / "x.json").read_text())
    assert [g["volume"] for g in got] == ["a", 'b"\\'] and all([x["extent_ix"] for x in g["extents"]] == list(range(50)) and g["summary"]["clusters"] == 150 for g in got)


def test_dumps_by_pattern_and_as_they_arrive(spark, tmp_path):
    head = lambda n: D.HEADER.pack(b"DUMPFILE", D.VERSION, 0, 64, n, 64 * n, 0)
    for name, n in (("C", 5), ("D", 0), ("E", 2500)):
        (tmp_path / f"{name}.dump").write_bytes(head(n) + b"".join(k.to_bytes(64, "little") for k in range(n)))
    got = D.read_dump(spark, f"{tmp_path}/*.dump", per_part=100)
    assert {(r.volume, r.slot, int.from_bytes(r.record, "little")) for r in got.collect()} == {(v, k, k) for v, n in (("C", 5), ("E", 2500)) for k in range(n)}
    out = lambda: run_available(D.stream_dumps(spark, str(tmp_path), per_step=1), str(tmp_path / "out"), str(tmp_path / "state")).count()
    assert out() == 2505
    (tmp_path / "F.dump").write_bytes(head(3) + bytes(192))
    assert out() == 2508 and out() == 2508


def test_refresh_equals_a_rebuild_on_random_edits(spark):
    """Folders and files are moved, renamed, resized, added and deleted; a folder goes below another; a hard link comes and one goes."""
    from treelake.plans import rollup as G
    from treelake.plans.refresh import refreshed

    r = random.Random(12)
    kinds = {"nodes": "volume string, node_id bigint, is_dir boolean", "links": "volume string, node_id bigint, link_ix int, parent_id bigint, name string", "streams": "volume string, node_id bigint, stream_ix int, type_id int, stream_name string, length bigint, allocated bigint, bulkiness bigint"}

    def tables(state, reserved):
        rows = {"nodes": [("C:", k, d) for k, (d, _, _) in state.items()], "links": [("C:", k, i, p, n) for k, (_, ls, _) in state.items() for i, (p, n) in enumerate(ls)], "streams": [("C:", k, i, 0 if d else 8, f"s{i}" if i else "", x, x + 7, x // 2) for k, (d, _, xs) in state.items() for i, x in enumerate(xs)]}
        out = {t: spark.createDataFrame(rows[t], kinds[t]) for t in kinds}
        return {**out, "volumes": spark.createDataFrame([("C:", 4096, 1024, reserved)], "volume string, cluster_size int, record_size int, reserved_clusters bigint")}

    state = {5: (True, [(5, ".")], [10])}
    for k in range(16, 110):
        folders = [j for j, s in state.items() if s[0]]
        d = r.random() < 0.4
        state[k] = d, [(r.choice(folders), f"n{k}_{i}") for i in range(1 if d else r.choice([1, 1, 2]))], [r.randrange(10**6) for _ in range(1 if d else r.randrange(1, 3))]
    built = lambda t: {"folders": (f := J.folder_paths(t["links"], t["nodes"])), "totals": G.folder_totals(t, f), "bulk": G.bulk_and_allocated(t, f)}
    plain = lambda t: {n: sorted(map(tuple, df.select(sorted(df.columns)).collect())) for n, df in t.items()}
    before, reserved = tables(state, 3), 3
    stored = built(before)
    for _ in range(2):
        under = lambda k: {k} | {x for j, s in state.items() if s[0] and j != 5 and s[1][0][0] == k for x in under(j)}  # noqa: E731, B023
        for _ in range(6):
            k = r.choice([x for x in state if x != 5])
            d, links, sizes = state[k]
            folders = [j for j, s in state.items() if s[0]]
            what = r.choice(["move", "rename", "size", "add", "delete", "link"])
            if what == "move":
                links = [(r.choice([j for j in folders if not d or j not in under(k)]), links[0][1]), *links[1:]]
            elif what == "rename":
                links = [(links[0][0], links[0][1] + "x"), *links[1:]]
            elif what == "size":
                sizes = [s + 1000 for s in sizes]
            elif what == "link" and not d:
                links = links[:-1] if len(links) > 1 else [*links, (r.choice(folders), f"l{k}")]
            elif what == "add":
                state[max(state) + 1] = r.random() < 0.5, [(r.choice(folders), "new")], [5]
            if what == "delete" and (not d or under(k) == {k} and not any(p == k for s in state.values() for p, _ in s[1])):
                del state[k]
            else:
                state[k] = d, links, sizes
        reserved += 1
        after = tables(state, reserved)
        stored = refreshed(before, after, stored)
        assert plain(stored) == plain(built(after))
        before = after
