"""MinHash near-duplicates by a multi-index Hamming join.

Each document's set of word shingles gets SYMBOLS MinHash values of b = 16 bits. The signature is split into CHUNKS chunks
of WIDTH symbols, and each chunk is entered once for every symbol that may be wrong in it (that symbol left out). By the
pigeonhole principle two signatures that differ in fewer than 2 * CHUNKS symbols meet in at least one entry; pairs that
meet otherwise are looked at too, up to MAX_DISTANCE. At a similarity of 0.8 a pair is missed with a chance of 2e-5.

Equal sets are one node from the start. A bucket's pairs are not written out: each bucket has a centre, the member that
meets most others in all its entries, and each node is tried against the CENTRES centres that it meets most often, so a
group of n near copies costs a few n links. Links are confirmed on the full sets, best first, and components are built.
Then come the pairs of a bucket that still lie in different components. In buckets of up to CROWD members all of them are
compared. In crowded ones an exact prefix filter names the pairs that can be alike at all. Each member is described by
what sets it apart from one set, the same for the whole bucket: the shingles that only one of the two has. That set may be
any; it is the bucket's centre, or the one with the longest reach among the centres linked to it. Two sets of sizes m and n are alike
if they differ in at most (m + n) / 9 shingles, so members with s and t differences must share (s + t - (m + n) / 9) / 2 of
them, and with differences ordered by how many members have them, the rarest first, share one among the first of both.
Differences that one member has alone take places there but make no pair, so copies edited each in its own way meet
nothing; and per difference only members outside the component that holds most of it look at the others, so one linked
group costs no pairs either. All that is left is compared by signature and confirmed. A pair inside one component needs
no look, so the components are those of all links that the index can see.

Nulls, ties, repeats: null or wordless text has an empty set and is linked with nothing; rows without an id are linked
with nothing and kept; rows with one id are one document with several sets; equal sets share a component; an empty table
gives an empty result; columns beyond doc_id and text pass through keep_one untouched.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, grown, quoted, releasing, settle, table
from .components import connected_components

CHUNKS, WIDTH, PER_LONG = 10, 6, 3
SYMBOLS = CHUNKS * WIDTH
LONGS = SYMBOLS // PER_LONG
#: Signatures that differ in more symbols aren't confirmed: at a similarity of 0.8 the mean is 12, the deviation 3.1.
MAX_DISTANCE = 27
PERCENT = 80
SIGNATURE = [f"s{k}" for k in range(LONGS)]
#: Centres that a node is tried against before all that is left gets compared.
CENTRES = 4
#: Members up to which a bucket's pairs are all compared; above, the prefix filter names them.
CROWD = 32
#: Pairs of one node that share a copy of its text.
BLOCK_PAIRS = 256
#: Tasks, about, that the members of one centre are dealt to.
SHARES = 64
#: Shingles whose hashes are held against all symbols at once.
STEP = 4096


def shingles(text: str, n: int) -> set[bytes]:
    """The distinct n-word shingles of a text as UTF-8, A-Z lower-cased; all words as one if they are fewer than n."""
    w = text.encode("utf-8").lower().split()
    if not w:
        return set()
    if len(w) < n:
        return {b" ".join(w)}
    return {b" ".join(s) for s in set(zip(*(w[k:] for k in range(n)), strict=False))}


class MinHash:
    def __init__(self, seed: int = 1):
        draw = np.random.Generator(np.random.PCG64(seed))
        self.a = draw.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = draw.integers(0, 1 << 63, SYMBOLS, dtype=np.uint64)

    def longs(self, hashes: np.ndarray) -> np.ndarray:
        """The signature of a set of hashes, three 16-bit symbols to a long."""
        least = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
        for k in range(0, len(hashes), STEP):
            least = np.minimum(least, (hashes[k : k + STEP, None] * self.a + self.b).min(axis=0))
        least ^= least >> np.uint64(29)
        symbols = ((least * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(48)).reshape(LONGS, PER_LONG)
        return symbols[:, 0] | symbols[:, 1] << np.uint64(16) | symbols[:, 2] << np.uint64(32)


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, k1, k2, s0...): set size, 128-bit digest of the set, signature; per row of docs."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        family = MinHash()
        for batch in batches:
            rows = batch.num_rows
            ints, sig = np.zeros((rows, 3), np.int64), np.zeros((rows, LONGS), np.uint64)
            for r, text in enumerate(batch.column(1)):
                units = shingles(text.as_py() or "", n)
                if units:
                    h = np.fromiter(map(xxhash.xxh3_64_intdigest, units), np.uint64, len(units))
                    h.sort()
                    ints[r] = len(units), *np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), np.int64)
                    sig[r] = family.longs(h)
            columns = [batch.column(0), *(pa.array(ints[:, k]) for k in range(3)), *(pa.array(sig[:, k].view(np.int64)) for k in range(LONGS))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_shingles", "k1", "k2", *SIGNATURE])

    kinds = ", ".join(f"{c} bigint" for c in ["doc_id", "n_shingles", "k1", "k2", *SIGNATURE])
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(releasing(made), kinds)


def entries(sets: DataFrame) -> DataFrame:
    """(key, node, n): each set once per chunk and symbol of the chunk that may be wrong."""
    chunks = F.array(*(F.struct(F.lit(c).alias("c"), F.col(f"s{2 * c}").alias("x"), F.col(f"s{2 * c + 1}").alias("y")) for c in range(CHUNKS)))
    rows = sets.select("node", F.col("n_shingles").alias("n"), F.explode(chunks).alias("q"))
    without = lambda lane: F.lit(((1 << 48) - 1) ^ (0xFFFF << 16 * lane)).cast("long")
    first = [F.xxhash64(F.col("q.c") * WIDTH + k, F.col("q.x").bitwiseAND(without(k)), "q.y") for k in range(PER_LONG)]
    second = [F.xxhash64(F.col("q.c") * WIDTH + PER_LONG + k, "q.x", F.col("q.y").bitwiseAND(without(k))) for k in range(PER_LONG)]
    return rows.select(F.explode(F.array(*first, *second)).alias("key"), "node", "n")


def distance(a: str, b: str) -> Column:
    """Symbols in which two signatures differ: per long, the 16-bit lanes of the exclusive-or that aren't zero."""
    low, high = F.lit(0x7FFF_7FFF_7FFF).cast("long"), F.lit(0x8000_8000_8000).cast("long")
    out = F.lit(0)
    for s in SIGNATURE:
        x = F.col(f"{a}{s}").bitwiseXOR(F.col(f"{b}{s}"))
        out = out + F.bit_count(((x.bitwiseAND(low) + low).bitwiseOR(x)).bitwiseAND(high))
    return out


def prefix_pairs(apart: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs (a, b) of different components that can be alike, among sets with a common centre.

    apart: as made by ``differences``; parts: (node, component) of all its nodes.
    """
    rows = apart.join(grown(parts), "node")
    mixed = rows.groupBy("centre").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x != y").select("centre")
    # most rows may be of one centre, so its members are joined in SHARES shares
    share = F.pmod(F.xxhash64("node"), F.lit(SHARES))
    mixed = mixed.select("centre", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long"))).alias("share"))
    rows = settle(rows.withColumn("share", share).join(grown(mixed), ["centre", "share"]).select("centre", "node", "set", "n", "component", F.size("hashes").cast("long").alias("s"), F.explode("hashes").alias("h")))
    holders = rows.groupBy("centre", "h").agg(F.count(F.lit(1)).alias("holders")).filter("holders > 1")
    # the differences of one set from its centre
    own = W.partitionBy("centre", "node", "set")
    ranked = rows.join(grown(holders), ["centre", "h"]).withColumns({"rank": F.row_number().over(own.orderBy("holders", "h")), "common": F.count(F.lit(1)).over(own)})
    ranked = settle(ranked.withColumn("position", F.col("s") - F.col("common") + F.col("rank")))
    held = ranked.groupBy("centre", "h", "component").agg(F.count(F.lit(1)).alias("k"))
    most = held.groupBy("centre", "h").agg(F.max_by("component", "k").alias("major"), F.count(F.lit(1)).alias("components")).filter("components > 1")
    ranked = ranked.join(grown(most), ["centre", "h"]).withColumn("minor", F.col("component") != F.col("major"))
    one, two = (ranked.select("centre", "h", *(F.col(c).alias(f"{e}_{c}") for c in ["node", "n", "s", "position", "rank", "component", "minor"])) for e in "ab")
    # 18 times the differences that the pair must share; what comes before this one in both, itself included, and after it in both
    needed = 9 * (F.col("a_s") + F.col("b_s")) - (F.col("a_n") + F.col("b_n"))
    room = F.least("a_rank", "b_rank") + F.least(F.col("a_s") - F.col("a_position"), F.col("b_s") - F.col("b_position"))
    among_first = lambda e: 18 * (F.col(f"{e}_s") + 1 - F.col(f"{e}_position")) >= needed
    fits = (F.col("a_component") != F.col("b_component")) & alike_in_size("a_n", "b_n") & among_first("a") & among_first("b") & (18 * room >= needed)
    # with the major ones each minor one meets once, with other minor ones too
    pairs = one.filter("a_minor").join(grown(two.filter("NOT b_minor")), ["centre", "h"]).filter(fits).unionByName(one.filter("a_minor").join(grown(two.filter("b_minor")), ["centre", "h"]).filter(fits & (F.col("a_node") < F.col("b_node"))))
    return pairs.select(F.least("a_node", "b_node").alias("a"), F.greatest("a_node", "b_node").alias("b")).distinct()


def alike_in_size(a: str, b: str) -> Column:
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def packed_texts(docs: DataFrame) -> DataFrame:
    """(node, packed): each text compressed, for the trip to its partners."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([press.compress((t.as_py() or "").encode()) for t in batch.column(1)], pa.binary())], ["node", "packed"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(releasing(made), "node bigint, packed binary")


def in_blocks(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, block, b, packed): the texts of pairs (a, b), dealt and sorted by a and block.

    The pairs of one a are dealt into blocks of about BLOCK_PAIRS. a's text goes to each block once, with a null b, and
    comes before the texts of its partners, which can be read one after the other.
    """
    sizes = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK_PAIRS).alias("blocks"))
    dealt = pairs.select("a", "b").join(grown(sizes), "a").select("a", F.pmod(F.xxhash64("b"), F.col("blocks")).alias("block"), "b")
    heads = dealt.select("a", "block").distinct().join(grown(texts.select(F.col("node").alias("a"), "packed")), "a").select("a", "block", F.lit(None).cast("long").alias("b"), "packed")
    partners = dealt.join(grown(texts.select(F.col("node").alias("b"), "packed")), "b").select("a", "block", "b", "packed")
    return heads.unionByName(partners).repartition("a", "block").sortWithinPartitions("a", "block", F.col("b").asc_nulls_first())


def partners_of(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[list[tuple[int, int, list[set], set]]]:
    """Per batch of in_blocks: (a, b, the sets of a, a set of b). An id with several texts has several sets."""
    unpack, block, held = zstandard.ZstdDecompressor(), None, []
    for batch in batches:
        found = []
        for x, k, y, packed in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
            q = shingles(unpack.decompress(packed).decode(), n)
            if block != (x, k):
                block, held = (x, k), []
            if y is None:
                held.append(q)
            elif q:
                found.append((x, y, held, q))
        yield found


def confirmed(pairs: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """The pairs (a, b) whose full sets are alike; written to the shared folder."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found in partners_of(batches, n):
            found = [(x, y) for x, y, held, q in found if any(100 * (both := len(p & q)) >= PERCENT * (len(p) + len(q) - both) for p in held)]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return settle(in_blocks(pairs, texts).mapInArrow(releasing(made), "a bigint, b bigint"))


def differences(pairs: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """(a, node, centre, set, n, n_centre, hashes): per pair of a centre a and a node the hashes of the shingles that one of them has."""
    names = ["a", "node", "centre", "set", "n", "n_centre"]

    def hashed(s: set) -> np.ndarray:
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, s), np.uint64, len(s))
        h.sort()
        return h

    def digest(h: np.ndarray) -> int:
        return xxhash.xxh3_64_intdigest(h.tobytes()) >> 1

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None, []
        for found in partners_of(batches, n):
            rows, hashes = [], []
            for x, y, held, q in found:
                if last[0] is not held:
                    last = held, [hashed(p) for p in held if p]
                h = hashed(q)
                for p in last[1]:
                    rows.append((x, y, digest(p), digest(h), len(h), len(p)))
                    hashes.append(np.setxor1d(p, h, assume_unique=True).view(np.int64))
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), pa.array(hashes, pa.list_(pa.int64()))], [*names, "hashes"])

    return settle(in_blocks(pairs, texts).mapInArrow(releasing(made), ", ".join(f"{c} bigint" for c in names) + ", hashes array<bigint>"))


def across(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs whose ends lie in different components, with these as ca and cb."""
    one = parts.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    two = parts.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    p = pairs.join(grown(one), "a", "left").join(grown(two), "b", "left").withColumns({"ca": F.coalesce("ca", "a"), "cb": F.coalesce("cb", "b")})
    return p.filter(F.col("ca") != F.col("cb"))


def with_component(nodes: DataFrame, parts: DataFrame) -> DataFrame:
    """nodes with their component; a node without links is one of its own."""
    return nodes.join(grown(parts), "node", "left").withColumn("component", F.coalesce("component", "node"))


def release() -> None:
    """Lets Python and the driver drop the plans of finished steps, so that Spark's cleaner may delete their shuffle files and the driver's heap doesn't grow to its limit."""
    gc.collect()
    if spark := SparkSession.getActiveSession():
        spark._jvm.System.gc()


def grouped(docs: DataFrame, n: int = 5) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id and kept."""
    measured = settle(signatures(docs, n))
    sets = measured.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    sets = sets.groupBy("k1", "k2").agg(F.min("doc_id").alias("node"), *(F.first(c).alias(c) for c in ["n_shingles", *SIGNATURE]))
    sets = settle(sets)
    keys = entries(sets)
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    # only entries that share their bucket matter from here on
    shared = settle(keys.join(grown(sizes), "key"))
    # how many others a node meets in all its entries, with a few bits of hash against ties
    reach = shared.groupBy("node").agg(F.sum("size").alias("reach"))
    ranked = shared.join(grown(reach), "node").select("key", "node", (F.shiftleft("reach", 20) + F.pmod(F.xxhash64("node"), F.lit(1 << 20))).alias("reach"))
    centres = settle(ranked.groupBy("key").agg(F.max_by("node", "reach").alias("centre"), F.max("reach").alias("reach")))

    def with_signatures(pairs: DataFrame) -> DataFrame:
        one, two = (sets.select(F.col("node").alias(e), F.col("n_shingles").alias(f"{e}_n"), *(F.col(s).alias(f"{e}_{s}") for s in SIGNATURE)) for e in "ab")
        both = pairs.join(grown(one), "a").join(grown(two), "b").filter(alike_in_size("a_n", "b_n"))
        return both.select("a", "b", distance("a_", "b_").alias("distance")).filter(F.col("distance") <= MAX_DISTANCE)

    met = shared.join(grown(centres), "key").filter("node != centre").groupBy(F.col("centre").alias("a"), F.col("node").alias("b")).agg(F.count(F.lit(1)).alias("times"))
    # a node has at most as many rows here as it has entries
    often = F.row_number().over(W.partitionBy("b").orderBy(F.col("times").desc(), "a"))
    stars = settle(with_signatures(met.withColumn("nth", often).filter(F.col("nth") <= CENTRES).select("a", "b")))
    members = shared.select(F.col("node")).distinct()
    texts = settle(packed_texts(docs).join(grown(members), "node", "left_semi"))
    release()

    # the best link of each node first; then the best between two components; then whatever is left between components
    links = confirmed(stars.groupBy("b").agg(F.min_by("a", "distance").alias("a")), texts, n)
    parts = connected_components(links)
    for best_only in (True, False):
        left = settle(across(stars, parts))
        if left.isEmpty():
            break
        if best_only:
            x = left.groupBy(F.least("ca", "cb").alias("x"), F.greatest("ca", "cb").alias("y")).agg(F.min_by(F.struct("a", "b"), "distance").alias("p"))
            left = x.select("p.a", "p.b")
        links = settle(links.unionByName(confirmed(left, texts, n)))
        parts = connected_components(links)
        release()

    # pairs of one bucket in different components
    placed = with_component(shared, parts)
    mixed = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x != y").select("key")
    placed = settle(placed.join(grown(mixed), "key", "left_semi"))
    few = placed.filter(F.col("size") <= CROWD)
    one, two = (few.select("key", *(F.col(c).alias(f"{e}_{c}") for c in ("node", "n", "component"))) for e in "ab")
    pairs = one.join(grown(two), "key").filter((F.col("a_node") < F.col("b_node")) & (F.col("a_component") != F.col("b_component")) & alike_in_size("a_n", "b_n"))
    pairs = pairs.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")).distinct()
    crowd = placed.filter(F.col("size") > CROWD)
    if not crowd.isEmpty():
        # any set may stand in for a centre: the centre of longest reach in its component does, so that a group has one
        of_centre = with_component(centres.groupBy("centre").agg(F.max("reach").alias("reach")).withColumnRenamed("centre", "node"), parts)
        hubs = of_centre.groupBy("component").agg(F.max_by("node", "reach").alias("hub"))
        hubs = of_centre.join(grown(hubs), "component").select(F.col("node").alias("centre"), "hub")
        of_hub = crowd.join(grown(centres.join(grown(hubs), "centre").select("key", "hub")), "key").filter("node != hub")
        apart = differences(settle(of_hub.select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()), texts, n)
        # members that are alike to a centre which they weren't tried against
        near = across(apart.filter(9 * F.size("hashes") <= F.col("n") + F.col("n_centre")).select("a", F.col("node").alias("b")).distinct(), parts)
        links = settle(links.unionByName(confirmed(near, texts, n)))
        parts = connected_components(links)
        pairs = pairs.unionByName(prefix_pairs(apart, with_component(apart.select("node").distinct(), parts))).distinct()
    other = settle(with_signatures(pairs))
    if not other.isEmpty():
        links = links.unionByName(confirmed(other, texts, n))
        parts = connected_components(links)
    for used_up in (shared, centres, placed, texts):
        discard(used_up)
    release()

    by_set = sets.select("k1", "k2", "node").join(grown(parts), "node", "left").select("k1", "k2", F.coalesce("component", "node").alias("component"))
    ids = measured.join(grown(by_set), ["k1", "k2"], "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")))
    return ids.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op6_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return grouped(table(spark, sf_dir, "documents").select("doc_id", "text"), n=2)


def keep_one(docs: DataFrame, n: int = 5) -> DataFrame:
    """The rows of docs but those of documents with a near copy of smaller id; an id is dropped with all its rows."""
    gone = grouped(docs.select("doc_id", "text"), n).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(grown(gone), "doc_id", "left_anti").select(*quoted(docs.columns))
