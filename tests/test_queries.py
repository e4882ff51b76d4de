"""Each registered catalog query against its SQL in DuckDB on the smallest tables."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from treelake import catalog_queries as Q
from treelake.operators.search import Catalog

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_query(spark, db, name):
    mine = Q.queries()[name](spark, SMALL).toPandas()
    theirs = db.execute(Q.oracle_sql()[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    plain = lambda d: sorted(map(str, d[sorted(d.columns)].astype(object).where(d[sorted(d.columns)].notna(), None).values.tolist()))
    if name == "verify_extents":
        mine, theirs = (d.astype({"found_record": "Int64"}) for d in (mine, theirs))
    assert plain(mine) == plain(theirs)


def test_entry(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert rows and [r["size"] for r in rows] == sorted((r["size"] for r in rows), reverse=True)
    assert set(Q.queries()) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_stored_catalog_pushes_searches_down(spark, tmp_path):
    g = Q.Given(spark, SMALL)
    # plans as text are cut short otherwise
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    stored = g.catalog.store(str(tmp_path / "entries"))
    keys = lambda df: sorted((r.volume, r.node_id, r.link_ix, r.stream_ix) for r in df.select(*Q.K).collect())
    for pattern, options, pushed in [
        ("order_1*", {}, "StringStartsWith(name_lc,order_1)"), ("*7.jpg", {}, "StringEndsWith(name_lc,7.jpg)"), ("order_1", {}, "StringContains(name_lc,order_1)"), ("D:\\NATION_1*\\**\\order_*.pdf", {}, "StringStartsWith(path_lc,d:\\nation_1)"),
        ("*.pdf", {"volumes": ["c", "e"]}, "volume"), ("*", {"ext": ["pictures"]}, "In(ext_lc"), ("*.JPG", {"case": True}, "StringEndsWith(name,.JPG)"), ("order_?5*.JPG", {"streams": True}, "IsNotNull(name_lc)"),
    ]:
        hits = stored.search(pattern, **options)
        plan = hits._jdf.queryExecution().executedPlan().toString()
        assert pushed in plan[plan.index("PartitionFilters") :], (pattern, plan)
        assert keys(hits) == keys(g.catalog.search(pattern, **options))
    assert "PartitionFilters: [isnotnull(volume" in stored.search("d:\\**.mp4")._jdf.queryExecution().executedPlan().toString()


def test_own_extension_is_another_alternative(spark):
    g = Q.Given(spark, SMALL)
    both = g.catalog.search("order_1*.pdf", ext=["jpg"]).select(F.lower("name").alias("n")).collect()
    assert {r.n.rpartition(".")[2] for r in both} == {"pdf", "jpg"} and all(r.n.startswith("order_1") for r in both)


def test_unknown_volume_and_bad_pattern(spark):
    g = Q.Given(spark, SMALL)
    assert isinstance(g.catalog, Catalog)
    with pytest.raises(ValueError):
        g.catalog.search("*", volumes=["Q"])
    with pytest.raises(ValueError):
        g.catalog.search(">(")


def test_the_rest_works_without_the_training_data_part(tmp_path):
    """A copy without its two folders imports, with and without the pipeline's file, and has all other queries."""
    root = Path(entry.__file__).parent
    for f in root.glob("*.py"):
        shutil.copy(f, tmp_path)
    shutil.copytree(root / "treelake", tmp_path / "treelake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), e.llm, e.corpus_pipeline)"
    for name in ("", "corpus_pipeline.py"):
        (tmp_path / name).unlink() if name and (tmp_path / name).exists() else None
        done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={**os.environ, "PYTHONPATH": str(tmp_path)})
        assert done.stdout.split() == [str(len(Q.queries())), str(len(Q.oracle_sql())), "None", "None"], done.stderr
