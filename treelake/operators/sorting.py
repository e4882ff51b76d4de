"""Orders of hits. Text keys ascend, numbers descend; ties go by volume, node, link and stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.attributes import has
from ..functions.names import file_type
from ..plans.shared import settled

TIES = ("volume", "node_id", "link_ix", "stream_ix")


def path_key(path: Column) -> Column:
    """A text in the order of the path's components: the separator comes before all other characters, also control characters."""
    return F.replace(F.replace(F.replace(path, F.lit("\x01"), F.lit("\x01\x02")), F.lit("\x00"), F.lit("\x01\x01")), F.lit("\\"), F.lit("\x00"))


def keys(order: str) -> list[tuple[Column, bool]]:
    """The columns of an order and whether each ascends."""
    c = F.col
    flag = order.removeprefix("flag:")
    if flag != order:
        return [(has(c("attrs"), flag), False)]
    known = {
        "name": lambda: [(c("name"), True)],
        "path": lambda: [(c("volume"), True), (path_key(c("path")), True)],
        "type": lambda: [(file_type(c("name"), c("attrs")), True)],
        "size": lambda: [(c("length"), False)],
        "saved": lambda: [(c("length") - c("allocated"), False)],
        "disk": lambda: [(c("allocated"), False)],
        "bulkiness": lambda: [(c("bulkiness"), False)],
        "descendants": lambda: [(c("treesize"), False)],
        "created": lambda: [(c("created_ft"), False)],
        "written": lambda: [(c("written_ft"), False)],
        "accessed": lambda: [(c("accessed_ft"), False)],
        "physical": lambda: [(c("node_id"), True), (c("link_ix"), False), (c("stream_ix"), False)],
        "attributes": lambda: [(c("attrs"), False)],
        "level": lambda: [(c("depth"), True)],
    }
    if order not in known:
        raise ValueError(f"unknown order: {order}")
    return known[order]()


def ordered(hits: DataFrame, *orders: str, reverse: bool = False, parts: int | None = None) -> DataFrame:
    """Sorted by each of the orders in turn; reverse turns the first one round. Ties stay as they are.

    Keys are columns before the sort, which would otherwise compute them again at each comparison. parts: into how many
    ranges to deal the rows, where shuffles have too few for them.
    """
    by = [(k, up != (reverse and n == 0)) for n, o in enumerate(orders) for k, up in keys(o)]
    rows = hits.withColumns({f"_key{i}": k for i, (k, _) in enumerate(by)})
    keyed = [F.col(f"_key{i}").asc() if up else F.col(f"_key{i}").desc() for i, (_, up) in enumerate(by)]
    keyed += [F.col(t) for t in TIES if t in hits.columns]
    rows = rows.repartitionByRange(parts, *keyed).sortWithinPartitions(*keyed) if parts else rows.orderBy(*keyed)
    return rows.select(*(F.col(f"`{n}`") for n in hits.columns))


def numbered(hits: DataFrame) -> DataFrame:
    """The sorted hits with their ``position`` from 1 on: row numbers within the sorted partitions, and a start for each of these."""
    rows = settled(hits.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    # one row per partition
    sizes = sorted((r.part, r.n) for r in rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    starts, total = [], 0
    for p, n in sizes:
        starts.append((p, total))
        total += n
    begin = F.broadcast(rows.sparkSession.createDataFrame(starts, "_part bigint, _start bigint"))
    position = F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return rows.join(begin, part == F.col("_part")).withColumn("position", position).drop("_at", "_part", "_start")


def store_order(hits: DataFrame, path: str, *orders: str, reverse: bool = False, parts: int | None = None) -> None:
    """Writes the sorted hits with their positions, in their order, so that any stretch of them can be fetched without sorting again."""
    numbered(ordered(hits, *orders, reverse=reverse, parts=parts)).write.mode("overwrite").parquet(path)


def stretch(spark: SparkSession, path: str, first: int, n: int) -> DataFrame:
    """n hits of a stored order from a position on; the files say which of them hold these."""
    return spark.read.parquet(path).filter(F.col("position").between(first, first + n - 1)).orderBy("position")


def top(hits: DataFrame, k: int, *orders: str, reverse: bool = False) -> DataFrame:
    return ordered(hits, *orders, reverse=reverse).limit(k)
