"""Times the catalog's own work on many rows: the derived catalog of $BENCH_SF_DIR, repeated on $COPIES sets of volumes.

Prints one JSON line: rows of the catalog, seconds and rows a second to build all paths and entries from the tables, to store
them, to search the stored ones and to sort them all by size with their positions.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from treelake import catalog as C
from treelake.operators import sorting as S
from treelake.operators.search import Catalog
from treelake.plans import paths as J
from treelake.plans.intervals import intervals
from treelake.plans.shared import scratch, settled


def main() -> None:
    sf_dir, cpus, copies = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("COPIES", "30"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", 4 * int(cpus)).config("spark.ui.enabled", "false").config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{tempfile.mkdtemp(prefix='treelake-measure-')}").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sets = spark.range(copies).select(F.col("id").alias("set"))
    again = lambda df: df.join(F.broadcast(sets)).withColumn("volume", F.concat(F.rtrim("volume", F.lit(":")), F.col("set"), F.lit(":"))).drop("set")
    tables = {t: settled(again(df)) for t, df in C.derived(spark, sf_dir).items() if t != "attributes"}
    seconds = {}

    def timed(name: str, work):
        began = time.time()
        out = work()
        seconds[name] = round(time.time() - began, 2)
        return out

    def built():
        folders = J.folder_paths(tables["links"], tables["nodes"])
        return settled(folders.join(intervals(folders), ["volume", "node_id"]))

    noop = lambda df: df.write.format("noop").mode("overwrite").save()
    folders = timed("paths and intervals", built)
    stored = timed("entries stored", lambda: Catalog(tables, J.entries(tables, folders)).store(f"{scratch(spark)}/catalog", folders))
    n = stored.entries.count()
    timed("sorted by size", lambda: noop(S.numbered(S.ordered(stored.entries.select("volume", "node_id", "link_ix", "stream_ix", "length"), "size"))))
    timed("substring search", lambda: stored.search("order_12345").count())
    timed("one volume's suffix search", lambda: stored.search("*7.jpg", volumes=[stored.volumes()[0]]).count())
    timed("subtree", lambda: stored.subtree(101).count())
    load = sum(seconds[s] for s in ("paths and intervals", "entries stored", "sorted by size"))
    print(json.dumps({"rows": n, "seconds": seconds, "rows a second, built, stored and sorted": round(n / load)}))


if __name__ == "__main__":
    main()
