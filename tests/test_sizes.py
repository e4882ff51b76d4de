"""What must not grow with the tables: work on the driver, steps of streams, what a narrow query carries along."""

from __future__ import annotations

import os
import random

import pyarrow as pa
from pyspark.sql import functions as F

from treelake import catalog_queries as Q
from treelake import dump_queries
from treelake.operators import sorting as S
from treelake.operators import trigrams
from treelake.operators.search import Catalog
from treelake.plans import refresh, rollup, shared
from treelake.sources import dump as D
from treelake.streaming.standing import run_available

SMALL = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().toString()


def test_dumps_come_by_stored_lists(spark):
    """No pattern of many files is listed."""
    df = dump_queries.dumps(Q.Given(spark, SMALL))
    assert "binaryFile" not in plan_of(df) and df.count() > 1000


def test_a_step_takes_lists_of_dumps(spark, tmp_path):
    """Thirty dumps in two lists take two steps, and each record comes once."""
    (tmp_path / "lists").mkdir()
    paths = []
    for k in range(30):
        path = tmp_path / f"v{k}.dump"
        path.write_bytes(D.HEADER.pack(b"DUMPFILE", D.VERSION, 0, 64, 3, 192, 0) + bytes(192))
        paths.append((str(path),))
    for part in (paths[:15], paths[15:]):
        spark.createDataFrame(part, "path string").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/lists")
    arrived = D.stream_listed_dumps(spark, f"file://{tmp_path}/lists", per_step=1).select("volume", "slot")
    got = run_available(arrived, f"file://{tmp_path}/out", f"file://{tmp_path}/ck")
    assert got.count() == got.distinct().count() == 90
    assert sum(not f.startswith(".") for f in os.listdir(tmp_path / "ck" / "commits")) == 2


def test_sort_keys_are_columns(spark):
    """A comparison reads keys; it computes none. The order of paths is that of their components."""
    names = ["a", "a\x00", "a\x01", "a\x01\x02", "a\x01\x01b", "a b", "", "B", "\x02"]
    paths = [f"C:\\{x}\\{y}" for x in names for y in names] + [f"C:\\{x}" for x in names]
    rows = spark.createDataFrame([("C:", p, "n.pdf", 0) for p in paths], "volume string, path string, name string, attrs int")
    for order in ("path", "type"):
        sort = next(line for line in plan_of(S.ordered(rows, order)).splitlines() if "Sort [" in line)
        assert "split(" not in sort and "regexp" not in sort and "CASE" not in sort
    assert [r.path for r in S.ordered(rows, "path").collect()] == sorted(paths, key=lambda p: p.split("\\"))


def test_a_lone_projection_or_search_stores_no_catalog(spark):
    g = Q.Given(spark, SMALL)
    for name in ("file_type", "stream_mode", "sort_type"):
        df = Q.registered()[name][0](g)
        assert "catalog" not in g.__dict__
    assert df.count() == g.entries.count()
    plan = g.entries.select("accessed_ft")._jdf.queryExecution().optimizedPlan().toString()
    used = "".join(line for line in plan.splitlines() if "Relation [" not in line)
    assert "written_ft" not in used and "dir_path" not in used


def test_parts_grow_with_rows(spark, monkeypatch):
    monkeypatch.setattr(shared, "TASK_ROWS", 100)
    g = Q.Given(spark, SMALL)
    rows = spark.read.parquet(g.tables["streams"].inputFiles()[0].rpartition("/")[0]).count()
    assert g.tables.parts == g.tables["links"].rdd.getNumPartitions() == -(-rows // 100) > 8


def test_postings_make_the_grams_of_a_folder_once_per_block(spark):
    """The same grams as of whole paths, from pieces of them."""
    paths = [("C:\\", "C:\\"), ("C:\\", "C:\\a.pdf"), ("C:\\\u03a3\u03a3\\", "C:\\\u03a3\u03a3\\\u03a3x:s\u0130"), ("C:\\ab\\", "C:\\ab\\"), (None, "C:\\lost"), ("C:\\ab\\", "C:\\ab\\cd:s2")]
    rows = spark.createDataFrame([("C:", "p", 0, d, x) for d, x in paths], "volume string, part string, block long, dir_path string, path string")
    made = trigrams.postings(rows)
    whole = rows.select(F.explode(trigrams.grams(trigrams.folded(F.col("path")))).alias("gram")).distinct()
    assert sorted(r.gram for r in made.collect()) == sorted(r.gram for r in whole.collect())
    assert "piece" in plan_of(made)


def test_postings_are_lists_made_where_a_part_is_read(monkeypatch):
    """Whatever a task holds at a time, and whatever letters there are, each trigram has the blocks of all texts that have it."""
    r = random.Random(4)
    rows = []
    for part in ("a", "b"):
        for block in range(6):
            folder = "".join(r.choice("ab\u03c3\\x" if block % 2 else "ab\\") for _ in range(r.randrange(0, 5)))
            rows += [("C:" if block < 3 else "D:", part, block, None if r.random() < 0.1 else folder, "".join(r.choice("abc\U0001f642.0") for _ in range(r.randrange(0, 6)))) for _ in range(9)]
    want = {(v, t[k : k + 3], p, b) for v, p, b, *texts in rows for t in texts if t for k in range(len(t) - 2)}
    for marks, listed, stretch, batch in [(1 << 25, 1 << 22, 1 << 20, 1000), (0, 5, 30, 7), (1 << 25, 1, 1, 1000)]:
        for name, value in (("MARKS", marks), ("LISTED", listed), ("STRETCH", stretch)):
            monkeypatch.setattr(trigrams, name, value)
        table = pa.table(list(zip(*rows, strict=True)), schema=pa.schema([("volume", pa.string()), ("part", pa.string()), ("block", pa.int64()), ("folder_piece", pa.string()), ("piece", pa.string())]))
        got = pa.Table.from_batches(trigrams.listed_grams(iter(table.to_batches(max_chunksize=batch)))).to_pylist()
        assert {(x["volume"], x["gram"], x["part"], b) for x in got for b in x["blocks"]} == want
        assert all(x["blocks"] == sorted(set(x["blocks"])) for x in got)


def test_an_index_has_parts_that_grow_and_the_columns_it_reads(spark, monkeypatch):
    """And a row per trigram and part, not per trigram and block."""
    monkeypatch.setattr(shared, "TASK_ROWS", 200)
    stored = []
    monkeypatch.setattr(Catalog, "store", lambda self, *a, put=Catalog.store, **b: stored.append((self.entries, put(self, *a, **b))) or stored[-1][1])
    g = Q.Given(spark, SMALL)
    assert Q.registered()["indexed_search"][0](g).count() > 0
    rows, made = stored[0]
    assert g.parts > 16 and made.entries.select("part").distinct().count() > 16
    assert "accessed_ft" not in rows.columns and len(made.entries.columns) < 20
    posted = made.tables["postings"]
    assert posted.count() == posted.select("volume", "gram", "part").distinct().count() < posted.selectExpr("sum(size(blocks))").first()[0]
    assert made.entries.count() == g.entries.count()


def test_attributes_are_dealt_by_rows(spark, monkeypatch):
    monkeypatch.setattr(shared, "TASK_ROWS", 100)
    assert Q.Given(spark, SMALL).tables["attributes"].rdd.getNumPartitions() > 8


def below(plan: str, line: int) -> str:
    """What of a printed plan stands under a line."""
    lines = plan.splitlines()
    depth = lambda text: len(text) - len(text.lstrip(" :+-*()0123456789"))
    end = next((n for n in range(line + 1, len(lines)) if depth(lines[n]) <= depth(lines[line])), len(lines))
    return "\n".join(lines[line + 1 : end])


def test_streams_are_joined_in_parts_that_grow(spark, monkeypatch):
    """Also those of the folders themselves, of which a semi join would go below the dealing."""
    monkeypatch.setattr(shared, "TASK_ROWS", 100)
    g = Q.Given(spark, SMALL)
    assert g.parts > 8
    made = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        own = rollup.of_folders(g.tables["streams"], g.tables["nodes"])._jdf.queryExecution().executedPlan().toString()
        assert own.count("Exchange hashpartitioning") == own.count(f", {g.parts})") == 2
        plan = g.sized._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", made)
    # links come to their folders before the streams come to them, so the many rows are dealt once
    dealt = [n for n, line in enumerate(plan.splitlines()) if "Exchange hashpartitioning" in line and "stream_ix" in below(plan, n)]
    assert len(dealt) == 1


def test_lines_and_files_are_dealt_and_joined_once(spark, monkeypatch):
    monkeypatch.setattr(shared, "TASK_ROWS", 500)
    g = Q.Given(spark, SMALL)
    plan = g.tables.derived["streams"]._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [l_orderkey" in plan and "o_custkey" not in plan


def test_a_stored_order_has_parts_that_grow(spark, tmp_path):
    g = Q.Given(spark, SMALL)
    hits = g.sized.select(*Q.K, "length")
    assert S.ordered(hits, "size", parts=20).rdd.getNumPartitions() == 20
    S.store_order(hits, f"file://{tmp_path}/o", "size", parts=20)
    rows = spark.read.parquet(f"file://{tmp_path}/o")
    want = [tuple(r) for r in S.ordered(g.sized.select(*Q.K, "length"), "size").collect()]
    assert [tuple(r)[:5] for r in rows.orderBy("position").collect()] == want


def test_a_refresh_reads_no_file_of_before_for_its_sums(spark):
    """Direct sums of the stored snapshot come from its totals; parts of the new one's tables stay dealt."""
    g = Q.Given(spark, SMALL)
    wanted = g.folders.filter("node_id = 5 OR node_id % 3 = 0").select("volume", "node_id")
    got = refresh.stored_sums(g.tables, {"folders": g.folders, "totals": g.totals}, wanted)
    assert "stream_name" not in got._jdf.queryExecution().optimizedPlan().toString()
    rows = lambda df: sorted((r.volume, r.node_id, *(r[s] for s in rollup.SUMS)) for r in df.collect())
    part = refresh.part_of(g.tables, wanted)
    assert rows(got) == rows(refresh.sums_of(g.tables, g.folders, wanted)) and "LeftSemi" not in plan_of(part["streams"])


def test_a_lone_search_numbers_no_folders(spark):
    """Intervals are for totals and subtrees; a search's streams are joined without a sort."""
    g = Q.Given(spark, SMALL)
    hits = Q.registered()["stream_mode"][0](g)
    assert "folders" not in g.__dict__
    made = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert "ShuffledHashJoin" in plan_of(hits.select(*Q.K, "path"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", made)


def test_a_stored_order_has_keys_alone(spark, monkeypatch):
    """Paths come to the two hundred hits of the stretch, not to all that is sorted."""
    stored = []
    monkeypatch.setattr(S, "store_order", lambda hits, *a, put=S.store_order, **b: (stored.append(hits), put(hits, *a, **b)))
    g = Q.Given(spark, SMALL)
    got = Q.registered()["stretch_of_order"][0](g)
    assert stored[0].columns == [*Q.K, "length"]
    rows = got.collect()
    assert [r.position for r in rows] == list(range(1001, 1201))
    want = S.ordered(g.sized.select(*Q.K, "path", "length"), "size").limit(1200).collect()[1000:]
    assert [tuple(r)[:5] for r in rows] == [tuple(r)[:5] for r in want]
