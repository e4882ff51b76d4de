"""Source divergence audit: how the sources of a language differ in their use of its terms.

Terms that enough documents of a language have are its vocabulary. They are counted once per document, sorted and cut
into ranges of about SHARD_TERMS; the start of each range and the number of terms before it are all that the driver sees.
Then the texts are read again: each task adds up its terms per language and source, sorted, and sends each range's part to
where that range's minimal acyclic transducer is built from the kept terms. The transducer takes these terms in, drops those
that it doesn't accept, and counts the others by ordinal. A range's terms go to as many tasks as keep the work in
proportion, so frequent terms and large sources are added up in tasks, in ranges and at last by language, source and ordinal.

Shares are p = 1 + floor(10^9 * (count + 5) / (N + 5 * V)), all in whole numbers. Ties between terms go by ordinal, which is
the order of their UTF-8 bytes. Distances between sources are added up in blocks of ordinals, dense within a block.

Nulls, ties, repeats: null text, language and source count as ''; a text without terms, or empty, still makes its (language,
source) group; a repeated row counts again; an empty table gives an empty result; columns beyond text, lang and source don't
matter. A task holds one whole text and at most FLUSH counts at a time. The number of sources of one language must allow a
row for each pair of them, which the result has anyhow.
"""

from __future__ import annotations

import itertools
import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import settle, table, whole
from .transducer import Transducer

#: Documents of a language that a kept term has at least; ranks that are shown of terms.
LEAST_DOCS, TOP = 30, 50
SCALE, SMOOTH = 1_000_000_000, 5
#: Terms of one transducer, about; counts that a task holds by term, and by ordinal; cells of a dense block, about.
SHARD_TERMS, FLUSH, CELLS_HELD, CELLS = 1 << 16, 1 << 19, 1 << 22, 1 << 18
GROUP = ["lang", "source"]

_LETTERS = {*range(0x41, 0x5B), *range(0x61, 0x7B)}
_FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _LETTERS or b >= 0x80 else 0x20 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The runs of ASCII letters and of characters beyond ASCII in a UTF-8 text, A-Z lower-cased."""
    return text.translate(_FOLD).split()


def read(docs: DataFrame) -> DataFrame:
    return docs.select(*(whole(F.col(c)).alias(c) for c in ("lang", "source", "text")))


def rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True)


def kept_terms(docs: DataFrame, least: int = LEAST_DOCS) -> DataFrame:
    """(lang, term) of the terms that at least so many documents of the language have; settled."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}

        def made() -> pa.RecordBatch:
            rows = [(lang, t, n) for lang, c in found.items() for t, n in c.items()]
            found.clear()
            langs, terms, n = zip(*rows, strict=True) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(terms, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())], ["lang", "term", "n"])

        for batch in batches:
            for lang, _, text in rows_of(batch):
                found.setdefault(lang, Counter()).update(set(terms_of(text.as_py())))
                if sum(map(len, found.values())) > FLUSH:
                    yield made()
        yield made()

    counts = read(docs).mapInArrow(counted, "lang string, term string, n bigint")
    return settle(counts.groupBy("lang", "term").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("lang", "term"))


def ranges(kept: DataFrame, per_shard: int = SHARD_TERMS) -> tuple[DataFrame, list[tuple]]:
    """The kept terms with their shard, and (lang, shard, first term, terms of the language before it), in order; one for each language and shard."""
    shards = max(1, math.ceil(kept.count() / per_shard))
    dealt = settle(kept.repartitionByRange(shards, "lang", "term").select("lang", "term", F.spark_partition_id().alias("shard")))
    starts, before = [], Counter()
    for r in dealt.groupBy("lang", "shard").agg(F.min("term").alias("first"), F.count(F.lit(1)).alias("n")).orderBy("lang", "shard").collect():
        starts.append((r.lang, r.shard, r.first, before[r.lang]))
        before[r.lang] += r.n
    return dealt, starts


def packed_counts(docs: DataFrame, starts: list[tuple], salts: int) -> DataFrame:
    """(shard, salt, lang, source, terms, counts): what a task has counted of a shard's range; the terms ascend, one a line."""
    bounds: dict[str, tuple[list[bytes], list[int]]] = {}
    for lang, shard, first, _ in starts:
        firsts, shards = bounds.setdefault(lang, ([], []))
        firsts.append(first.encode())
        shards.append(shard)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, Counter] = {}
        turn = TaskContext.get().partitionId()

        def made() -> pa.RecordBatch:
            rows = []
            for (lang, source), c in found.items():
                firsts, shards = bounds[lang]
                terms = sorted(c)
                for shard, some in itertools.groupby(terms, lambda t: bisect_right(firsts, t) - 1):
                    if shard >= 0:
                        some = list(some)
                        rows.append((shards[shard], turn % salts, lang, source, b"\n".join(some), np.fromiter(map(c.__getitem__, some), np.int64, len(some)).tobytes()))
            found.clear()
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.binary(), pa.binary()]
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], ["shard", "salt", "lang", "source", "terms", "counts"])

        for batch in batches:
            for lang, source, text in rows_of(batch):
                if lang in bounds:
                    found.setdefault((lang, source), Counter()).update(terms_of(text.as_py()))
                    if sum(map(len, found.values())) > FLUSH:
                        yield made()
                        turn += 1
        yield made()

    return read(docs).mapInArrow(counted, "shard int, salt int, lang string, source string, terms binary, counts binary")


def recounted(docs: DataFrame, dealt: DataFrame, starts: list[tuple]) -> DataFrame:
    """(lang, source, ordinal, n): occurrences of the kept terms, by the transducers of their ranges; settled."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    salts = max(1, parts // max(1, len(starts)))
    before = {(lang, shard): n for lang, shard, _, n in starts}
    # a shard's terms are few by construction
    heads = dealt.groupBy("shard", "lang").agg(F.array_join(F.sort_array(F.collect_list("term")), "\n").cast("binary").alias("terms"))
    heads = heads.select("shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), "lang", F.lit(None).cast("string").alias("source"), "terms", F.lit(None).cast("binary").alias("counts"))
    rows = heads.unionByName(packed_counts(docs, starts, salts)).repartition(parts, "shard", "salt", "lang")
    rows = rows.sortWithinPartitions("shard", "salt", "lang", F.col("source").asc_nulls_first())

    def streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, vocabulary, offset, held = None, None, 0, {}

        def made() -> Iterator[pa.RecordBatch]:
            for source, sums in held.items():
                at = sums.nonzero()[0]
                names = [pa.array([x], pa.string()).take(pa.array(np.zeros(len(at), np.int32))) for x in (group[2], source)]
                yield pa.RecordBatch.from_arrays([*names, pa.array(at + offset), pa.array(sums[at])], ["lang", "source", "ordinal", "n"])
            held.clear()

        for batch in batches:
            for shard, salt, lang, source, terms, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group != (shard, salt, lang):
                    yield from made()
                    group, offset, vocabulary = (shard, salt, lang), before[lang, shard], Transducer(terms.split(b"\n"))
                if counts is None:
                    continue
                if source not in held:
                    if (len(held) + 1) * len(vocabulary) > CELLS_HELD:
                        yield from made()
                    held[source] = np.zeros(len(vocabulary), np.int64)
                terms = terms.split(b"\n")
                at = np.fromiter(map(vocabulary.ordinal, terms), np.int64, len(terms))
                # no term comes twice
                held[source][at[at >= 0]] += np.frombuffer(counts, np.int64)[at >= 0]
        yield from made()

    counts = rows.mapInArrow(streamed, "lang string, source string, ordinal bigint, n bigint")
    return settle(counts.groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n")))


def share(n: Column | str, total: str, v: str) -> Column:
    """A smoothed share in billionths, exactly."""
    n = F.col(n) if isinstance(n, str) else n
    over = (n.cast("decimal(28,0)") + SMOOTH) * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", over, F.col(total).cast("decimal(20,0)") + F.col(v).cast("decimal(20,0)") * SMOOTH) + 1


def pair_sums(shares: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): the sums of all terms' differences between two sources, one row for both directions."""
    sized = groups.groupBy("lang").agg(F.greatest(F.lit(16), F.call_function("div", F.lit(CELLS), F.count(F.lit(1)))).alias("wide"))
    groups = groups.filter("v > 0").join(sized, "lang")
    blocks = F.sequence(F.lit(0).cast("long"), F.call_function("div", F.col("v") - 1, F.col("wide")))
    heads = groups.select("lang", F.explode(blocks).alias("block"), "source", "p0", F.least("wide", F.col("v") - F.col("block") * F.col("wide")).alias("at"), F.lit(None).cast("long").alias("p"))
    cells = shares.join(sized, "lang").select("lang", F.call_function("div", F.col("ordinal"), F.col("wide")).alias("block"), "source", F.lit(None).cast("long").alias("p0"), F.pmod("ordinal", "wide").alias("at"), "p")

    def summed(block: pa.Table) -> pa.Table:
        part = {c: block.column(c) for c in block.column_names}
        source, p0, at, p = part["source"].to_pylist(), part["p0"].to_numpy(zero_copy_only=False), part["at"].to_numpy(), part["p"].to_numpy(zero_copy_only=False)
        head = ~np.isnan(p0.astype(float))
        names = sorted(s for s, h in zip(source, head, strict=True) if h)
        row = {s: k for k, s in enumerate(names)}
        rows = np.fromiter(map(row.__getitem__, source), np.int64, len(source))
        wide = int(at[head][0])
        dense = np.zeros((len(names), wide), np.int64)
        dense[rows[head]] = p0[head].astype(np.int64)[:, None]
        dense[rows[~head], at[~head]] = p[~head].astype(np.int64)
        one, two, value = [], [], []
        for k in range(len(names) - 1):
            one += [names[k]] * (len(names) - 1 - k)
            two += names[k + 1 :]
            value.append(np.abs(dense[k + 1 :] - dense[k]).sum(axis=1))
        lang = part["lang"][0].as_py()
        return pa.table({"lang": pa.array([lang] * len(one), pa.string()), "source": pa.array(one, pa.string()), "item": pa.array(two, pa.string()), "value": pa.array(np.concatenate(value) if value else [], pa.int64())})

    sums = heads.unionByName(cells).groupBy("lang", "block").applyInArrow(summed, "lang string, source string, item string, value bigint")
    return sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audited(docs: DataFrame, least: int = LEAST_DOCS, top: int = TOP, per_shard: int = SHARD_TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` with all other sources of the language, ``term`` with the terms that the source has more of than its language."""
    dealt, starts = ranges(kept_terms(docs, least), per_shard)
    counts = recounted(docs, dealt, starts)
    sizes = dealt.groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
    totals = counts.groupBy(*GROUP).agg(F.sum("n").alias("total"))
    groups = read(docs).select(*GROUP).distinct().join(totals, GROUP, "left").join(sizes, "lang", "left").fillna(0, ["total", "v"])
    groups = settle(groups.withColumn("p0", F.when(F.col("v") > 0, share(F.lit(0), "total", "v"))))

    shares = counts.join(groups.drop("p0"), GROUP).withColumn("p", share("n", "total", "v"))
    sums = settle(pair_sums(shares.select(*GROUP, "ordinal", "p"), groups))
    both = sums.select("lang", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("x"), "value").select("lang", "x.source", "x.item", "value")
    others = groups.select(*GROUP).join(groups.select("lang", F.col("source").alias("item")), "lang").filter("source != item")
    pairs = others.join(both, ["lang", "source", "item"], "left").fillna(0, ["value"]).select(*GROUP, F.lit("pair").alias("part"), "item", "value")
    ranked = W.partitionBy(*GROUP).orderBy(F.col("value").desc(), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(ranked))

    of_lang = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    q = counts.groupBy("lang", "ordinal").agg(F.sum("n").alias("lang_n")).join(of_lang, "lang").join(sizes, "lang").select("lang", "ordinal", share("lang_n", "lang_total", "v").alias("q"))
    more = shares.join(q, ["lang", "ordinal"]).filter("p > q").select(*GROUP, "ordinal", (F.col("p") - F.col("q")).alias("value"))
    more = more.withColumn("rank", F.row_number().over(W.partitionBy(*GROUP).orderBy(F.col("value").desc(), "ordinal"))).filter(F.col("rank") <= top)
    offsets = docs.sparkSession.createDataFrame([(lang, shard, n) for lang, shard, _, n in starts], "lang string, shard int, before bigint")
    place = F.row_number().over(W.partitionBy("lang", "shard").orderBy("term")) - 1
    names = dealt.withColumn("place", place).join(offsets, ["lang", "shard"]).select("lang", (F.col("before") + F.col("place")).alias("ordinal"), F.col("term").alias("item"))
    terms = more.join(names, ["lang", "ordinal"]).select(*GROUP, F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.unionByName(terms)


def op12_source_divergence(spark, sf_dir: str) -> DataFrame:
    return audited(table(spark, sf_dir, "documents"))


ORACLE = """WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
t AS (SELECT i, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT i) >= 30),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT x.lang, x.source, coalesce(n, 0)::HUGEINT AS total, coalesce(v, 0)::HUGEINT AS v FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL) y ON x.lang = y.lang AND x.source = y.source LEFT JOIN (SELECT lang, count(*) AS v FROM kept GROUP BY ALL) z ON x.lang = z.lang),
s AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0)::HUGEINT + 5) // (total + 5 * v) AS p FROM g JOIN kept k ON k.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
q AS (SELECT x.lang, x.term, 1 + 1000000000 * (x.n::HUGEINT + 5) // (y.total + 5 * y.v) AS q FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY ALL) x JOIN (SELECT lang, sum(total) AS total, any_value(v) AS v FROM g GROUP BY ALL) y ON x.lang = y.lang),
pairs AS (SELECT a.lang, a.source, b.source AS item, CAST(coalesce(f, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS f FROM s x JOIN s y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) z ON z.lang = a.lang AND z.source = a.source AND z.item = b.source),
terms AS (SELECT lang, source, term AS item, CAST(p - q AS BIGINT) AS value FROM s JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS INT) AS rank FROM pairs
UNION ALL SELECT * FROM (SELECT lang, source, 'term', item, value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS INT) AS rank FROM terms) WHERE rank <= 50"""
