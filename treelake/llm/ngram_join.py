"""N-gram Jaccard join: near-duplicates by an exact prefix filter over word n-grams, the rarest first.

Two sets of similarity 0.8 or more share one of the first n - ceil(0.8 n) + 1 n-grams of both in any order that is the same
for all documents. Here n-grams go by the number of different sets that have them, then by hash, so those that only one
set has come first and most documents have nothing left to be joined by.

The numbers come from one exchange. A task sends the hashes of its n-grams, six bytes each, to buckets, with the digest of
the set beside each stretch; a bucket counts and keeps what two sets have. Buckets grow in number with the n-grams.
N-grams that about one document in HOT has are found by counts within tasks; they come last in the order, by these counts,
and are not sent to one bucket but dealt evenly.

Of the sets that have something left, each n-gram of the prefix is an entry with the set's size, its place, and how many of
the further n-grams fall into each of CELLS classes. Two sets meet on an entry. Their sizes (length filter), the places
with what can follow these (positional filter), and the smaller number of each class behind them (suffix filter) bound what
they can share. A bucket's pairs are not written out: each entry has a centre, and each set is tried against the CENTRES
centres that it meets most often; then come the pairs of one entry that still lie in different components, all of them
where an entry has up to CROWD sets, by the exact prefix filter over differences from a centre of near_dedup where it has
more. Every pair is confirmed once, on its full sets. A pair inside one component needs no look, so the components are those of all links.

Hashes only choose candidates and count distinct n-grams of a text (64 bits); equal digests (128 bits) are equal sets.

Nulls, ties, repeats: null or wordless text has an empty set and is linked with nothing; rows without an id are linked
with nothing; equal sets share a component under their smallest id, and so do different sets with one such id, should ids
repeat; an empty table gives an empty result; columns beyond doc_id and text don't matter. A task holds one whole text at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, grown, settle, table
from .components import connected_components
from .near_dedup import CENTRES, CROWD, across, alike_in_size, confirmed, differences, packed_texts, prefix_pairs, release, with_component

#: N-grams that a bucket counts, about; the share of documents that makes an n-gram frequent, as one in HOT; least number of its documents in a task.
BUCKET, HOT, HOT_LEAST = 1 << 22, 1024, 8
#: Classes of n-grams in the suffix filter.
CELLS = 8
#: Bytes of text that a task takes together.
BATCH_BYTES = 4 << 20
_FACTOR, _SHIFT = np.uint64(0x9E3779B97F4A7C15), np.uint64(29)


def ngram_hashes(text: bytes, n: int) -> np.ndarray:
    """The sorted 64-bit hashes of the distinct n-grams of a UTF-8 text, A-Z lower-cased; all words as one if they are fewer than n."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    long = min(n, len(h))
    m = len(h) - long + 1
    out = h[:m] + np.uint64(long)
    for k in range(1, long):
        out = (out ^ out >> _SHIFT) * _FACTOR + h[k : m + k]
    return np.unique((out ^ out >> _SHIFT) * _FACTOR)


def digest(h: np.ndarray) -> np.ndarray:
    return np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), np.int64)


def in_parts(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Ids and hashes of the n-grams of some texts at a time."""
    ids, found, held = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
            text = text.as_py() or b""
            ids.append(doc_id)
            found.append(ngram_hashes(text, n))
            held += len(text) + 64
            if held > BATCH_BYTES:
                yield ids, found
                ids, found, held = [], [], 0
    if ids:
        yield ids, found


def measured(docs: DataFrame, n: int) -> DataFrame:
    """Per row of docs doc_id, n_shingles and the set's digest k1, k2; and apart from these, with a null size, n-grams that many documents of a task have; settled."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_shingles", "k1", "k2", "item", "times"]
        many, times, seen = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0
        for ids, found in in_parts(batches, n):
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            keys = np.array([digest(h) if len(h) else (0, 0) for h in found], np.int64).reshape(-1, 2)
            none = pa.nulls(len(ids), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes), pa.array(keys[:, 0]), pa.array(keys[:, 1]), none, none], names)
            seen += len(ids)
            items, counts = np.unique(np.concatenate(found) >> np.uint64(16), return_counts=True)
            items, back = np.unique(np.concatenate([many, items]), return_inverse=True)
            counts = np.bincount(back, np.concatenate([times, counts])).astype(np.int64)
            left = counts * HOT >= seen
            many, times = items[left], counts[left]
        left = times >= HOT_LEAST
        none = pa.nulls(int(left.sum()), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(many[left].astype(np.int64)), pa.array(times[left])], names)

    return settle(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(made, "doc_id bigint, n_shingles bigint, k1 bigint, k2 bigint, item bigint, times bigint"))


def common_items(docs: DataFrame, n: int, total: int, hot: dict[int, int]) -> DataFrame:
    """(k1, item, holders): the n-grams of each set that another set has too, with the number of sets that have them; settled."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(parts, -(-total // BUCKET))
    hot_items = np.array(sorted(hot), np.uint64)
    hot_times = np.array([hot[x] for x in sorted(hot)], np.int64)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = TaskContext.get().partitionId()
        for ids, found in in_parts(batches, n):
            sets = {int(digest(h)[0]): h for doc_id, h in zip(ids, found, strict=True) if len(h) and doc_id is not None}
            if not sets:
                continue
            node = np.repeat(np.array([*sets], np.int64), [*map(len, sets.values())])
            item = np.concatenate([*sets.values()]) >> np.uint64(16)
            bucket = (item % np.uint64(buckets)).astype(np.int64)
            if len(hot_items):
                at = np.searchsorted(hot_items, item).clip(max=len(hot_items) - 1)
                bucket[hot_items[at] == item] = -1 - turn % buckets
            turn += 1
            # stable, so that what one set sends to a bucket stays together
            order = np.argsort(bucket, kind="stable")
            node, item, bucket = node[order], item[order], bucket[order]
            starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
            rows = []
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(bucket)], strict=True):
                first = np.flatnonzero(np.r_[True, node[a + 1 : b] != node[a : b - 1]])
                six = item[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
                rows.append((int(bucket[a]), node[a:b][first].tobytes(), np.diff(np.r_[first, b - a]).astype(np.uint32).tobytes(), six.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int64(), *[pa.binary()] * 3], strict=True)], ["bucket", "nodes", "sizes", "items"])

    def counted(rows: pa.Table) -> pa.Table:
        columns = [b"".join(rows.column(c).to_pylist()) for c in ("nodes", "sizes", "items")]
        node = np.repeat(np.frombuffer(columns[0], np.int64), np.frombuffer(columns[1], np.uint32))
        item = np.zeros((len(node), 8), np.uint8)
        item[:, :6] = np.frombuffer(columns[2], np.uint8).reshape(-1, 6)
        item = item.view("<u8").ravel()
        frequent = rows.column("bucket")[0].as_py() < 0
        order = np.lexsort((node, item))
        node, item = node[order], item[order]
        new = np.r_[True, (item[1:] != item[:-1]) | (node[1:] != node[:-1])]
        node, item = node[new], item[new]
        if frequent:
            holders = hot_times[np.searchsorted(hot_items, item)]
        else:
            starts = np.flatnonzero(np.r_[True, item[1:] != item[:-1]])
            size = np.diff(np.r_[starts, len(item)])
            holders = np.repeat(size, size)
            node, item, holders = (x[holders > 1] for x in (node, item, holders))
        return pa.table({"k1": pa.array(node), "item": pa.array(item.astype(np.int64)), "holders": pa.array(holders.astype(np.int64)), "frequent": pa.array(np.full(len(node), frequent))})

    sent = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(dealt, "bucket bigint, nodes binary, sizes binary, items binary")
    rows = settle(sent.groupBy("bucket").applyInArrow(counted, "k1 bigint, item bigint, holders bigint, frequent boolean"))
    # each task sends its own frequent ones, so one set may come from several
    return rows.filter("NOT frequent").unionByName(rows.filter("frequent").distinct()).drop("frequent")


def prefixes(common: DataFrame, sets: DataFrame) -> DataFrame:
    """(key, node, n, rank, tail): the shared n-grams within each set's prefix.

    rank: its number among the set's shared n-grams; those that no other set has come before these, and can't be common.
    tail: how many of those behind it fall into each class. Sets whose first half of a digest is the same, which are told apart
    by the other half only, enter with all their n-grams and pass all bounds.
    """
    sizes = sets.groupBy("k1").agg(F.max("n_shingles").alias("n"), (F.count(F.lit(1)) > 1).alias("mixed"))
    shared = common.groupBy("k1").agg(F.count(F.lit(1)).alias("shared"))
    # n - ceil(0.8 n) + 1
    prefix = F.col("n") - F.call_function("div", 4 * F.col("n") + 4, F.lit(5)) + 1
    live = shared.join(grown(sizes), "k1").withColumn("room", prefix - (F.col("n") - F.col("shared"))).filter((F.col("room") > 0) | F.col("mixed")).select("k1", "room", "mixed")
    own = W.partitionBy("k1").orderBy("holders", "item")
    rows = common.join(grown(live), "k1").withColumn("rank", F.row_number().over(own))
    # a running sum taken from the whole: Spark adds frames up to the end anew for each row
    of_cell = lambda k: (F.pmod("item", F.lit(CELLS)) == k).cast("int")
    up_to = own.rowsBetween(W.unboundedPreceding, 0)
    tail = F.array(*((F.sum(of_cell(k)).over(W.partitionBy("k1")) - F.sum(of_cell(k)).over(up_to)).cast("int") for k in range(CELLS)))
    rows = rows.withColumn("tail", tail).filter((F.col("rank") <= F.col("room")) | F.col("mixed"))
    rows = rows.select("k1", F.col("item").alias("key"), F.when(F.col("mixed"), 1 << 40).otherwise(F.col("rank")).alias("rank"), "tail")
    return rows.join(grown(sets.select("k1", "node", F.col("n_shingles").alias("n"))), "k1").select("key", "node", "n", "rank", "tail")


def fits(a: str, b: str) -> Column:
    """Whether two sets that meet on an n-gram can be alike: by their sizes, and by what they can share up to it and behind it."""
    up_to = F.least(f"{a}.rank", f"{b}.rank")
    behind = F.lit(0)
    for k in range(CELLS):
        behind = behind + F.least(F.get(f"{a}.tail", F.lit(k)), F.get(f"{b}.tail", F.lit(k)))
    # one more, should two n-grams of a set have one hash of six bytes
    return alike_in_size(f"{a}.n", f"{b}.n") & (9 * (up_to + behind + 1) >= 4 * (F.col(f"{a}.n") + F.col(f"{b}.n")))


ENTRY = ["node", "n", "rank", "tail"]


def joined(docs: DataFrame, n: int = 5) -> DataFrame:
    """Per row of docs: doc_id, n_shingles and component_id, and kept for the smallest id of each component."""
    docs = docs.select("doc_id", "text")
    rows = measured(docs, n)
    sizes = rows.filter("item IS NULL").drop("item", "times")
    sets = settle(sizes.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("k1", "k2").agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles")))
    total, n_docs = sizes.agg(F.coalesce(F.sum("n_shingles"), F.lit(0)), F.count(F.lit(1))).first()
    # at most HOT times a document's n-grams, whatever the corpus
    hot = rows.filter("item IS NOT NULL").groupBy("item").agg(F.sum("times").alias("times")).filter(F.col("times") * HOT >= n_docs)
    hot = {r.item: r.times for r in hot.collect()}
    common = common_items(docs, n, total, hot)
    entries = settle(prefixes(common, sets))
    met = entries.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    shared = settle(entries.join(grown(met), "key"))
    # how many others a set meets in all its entries, with a few bits of hash against ties
    reach = shared.groupBy("node").agg(F.sum("size").alias("reach"))
    ranked = shared.join(grown(reach), "node").withColumn("reach", F.shiftleft("reach", 20) + F.pmod(F.xxhash64("node"), F.lit(1 << 20)))
    centres = settle(ranked.groupBy("key").agg(F.max_by(F.struct(*ENTRY), "reach").alias("c"), F.max("reach").alias("reach")))
    stars = shared.select("key", F.struct(*ENTRY).alias("e")).join(grown(centres), "key").filter((F.col("e.node") != F.col("c.node")) & fits("e", "c"))
    stars = stars.groupBy(F.col("c.node").alias("a"), F.col("e.node").alias("b")).agg(F.count(F.lit(1)).alias("times"))
    # a set has at most as many rows here as it has entries
    often = F.row_number().over(W.partitionBy("b").orderBy(F.col("times").desc(), "a"))
    stars = settle(stars.withColumn("nth", often).filter(F.col("nth") <= CENTRES).drop("nth"))
    members = shared.select("node").distinct()
    texts = settle(packed_texts(docs).join(grown(members), "node", "left_semi"))
    release()

    links, tried = [], []
    parts = None

    def confirm(pairs: DataFrame) -> None:
        """Looks at the pairs that weren't looked at before, and makes the components anew."""
        nonlocal parts
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        if tried:
            pairs = pairs.join(grown(reduce(DataFrame.unionByName, tried)), ["a", "b"], "left_anti")
        pairs = settle(pairs)
        if parts is not None and pairs.isEmpty():
            return
        tried.append(pairs)
        links.append(confirmed(pairs, texts, n))
        parts = connected_components(reduce(DataFrame.unionByName, links))
        release()

    # the centre met most often first; then one pair of two components; then whatever is left between components
    confirm(stars.groupBy("b").agg(F.max_by("a", "times").alias("a")))
    left = across(stars, parts)
    confirm(left.groupBy(F.least("ca", "cb"), F.greatest("ca", "cb")).agg(F.max_by(F.struct("a", "b"), "times").alias("p")).select("p.a", "p.b"))
    confirm(across(stars, parts))

    # pairs of one entry in different components
    placed = with_component(shared, parts)
    mixed = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x != y").select("key")
    placed = settle(placed.join(grown(mixed), "key", "left_semi"))
    few = placed.filter(F.col("size") <= CROWD)
    one, two = (few.select("key", F.struct("component", *ENTRY).alias(e)) for e in "ab")
    pairs = one.join(grown(two), "key").filter((F.col("a.node") < F.col("b.node")) & (F.col("a.component") != F.col("b.component")) & fits("a", "b"))
    pairs = pairs.select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()
    crowd = placed.filter(F.col("size") > CROWD)
    if not crowd.isEmpty():
        # any set may stand in for a centre: that of longest reach in its component does, so that a group has one
        of_centre = with_component(centres.groupBy(F.col("c.node").alias("node")).agg(F.max("reach").alias("reach")), parts)
        hubs = of_centre.groupBy("component").agg(F.max_by("node", "reach").alias("hub"))
        hubs = of_centre.join(grown(hubs), "component").select(F.col("node").alias("centre"), "hub")
        of_key = centres.select("key", F.col("c.node").alias("centre")).join(grown(hubs), "centre").select("key", "hub")
        of_hub = crowd.join(grown(of_key), "key").filter("node != hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
        apart = differences(settle(of_hub), texts, n)
        # members that are alike to a centre which they weren't tried against
        near = apart.filter(9 * F.size("hashes") <= F.col("n") + F.col("n_centre")).select("a", F.col("node").alias("b")).distinct()
        confirm(across(near, parts))
        pairs = pairs.unionByName(prefix_pairs(apart, with_component(apart.select("node").distinct(), parts))).distinct()
    confirm(across(pairs, parts))
    for used_up in (entries, shared, centres, placed, texts):
        discard(used_up)
    release()

    by_set = sets.select("k1", "k2", "node").join(grown(parts), "node", "left").select("k1", "k2", F.coalesce("component", "node").alias("component"))
    ids = sizes.join(grown(by_set), ["k1", "k2"], "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")))
    return ids.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op11_ngram_join(spark, sf_dir: str) -> DataFrame:
    return joined(table(spark, sf_dir, "documents")).drop("kept")
