"""Registered queries with SQL against DuckDB on the smallest tables, and the pipeline's stages in a row."""

from __future__ import annotations

import duckdb
import pytest

import corpus_pipeline
from treelake import llm
from treelake.llm.common import settle

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "pages", "labels"):
        db.execute(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    mine = llm.queries()[name](spark, SMALL).toPandas()
    theirs = db.execute(llm.oracle_sql()[name]).df()[list(mine.columns)]
    plain = lambda d: sorted(map(str, d.astype(object).where(d.notna(), None).values.tolist()))
    assert plain(mine) == plain(theirs.astype(mine.dtypes.to_dict()))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = settle(stage(spark, docs, SMALL))
        assert after.columns == docs.columns
        assert name == "source mix" or after.count() <= n
        docs, n = after, after.count()
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SMALL).toPandas()
    assert len(last) == n and (last.n_tokens >= 0).all() and len(corpus_pipeline.run(spark, SMALL).toPandas()) == n
