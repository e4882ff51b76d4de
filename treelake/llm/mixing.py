"""Mixing sources to target weights: Sainte-Lague quotas of equal-token blocks, then a seeded choice of blocks.

Every source is read as one stream of words: its documents in a seeded order, one after the other. The stream is cut
into blocks of ``block_words`` words. The mix holds N blocks; Sainte-Lague gives seat j of a source with target t the
quotient t / (2j - 1), and the N highest quotients win. Seats are dealt to the shards in the order of their quotients,
so each shard has whole quotas and the quotas of the first k shards are themselves a Sainte-Lague apportionment.

A source with more seats than blocks takes its whole stream once, or as often as they suffice for. The blocks of the last,
partial pass are chosen by seed: in runs of RUN blocks, evenly spread over the stream from a seeded offset, so that few
documents are cut; what is left behind the last whole run fills up. The taken words, in the order of the passes, are cut
into blocks again and dealt to the shards by the source's quotas.

Nulls, ties, repeats: a null text has no words and is never taken; null is a source of its own and comes last; an empty
string is another source; rows without an id are ordered by their text; rows with one id follow each other by size and
text checksum; identical rows are separate documents; an empty table gives an empty result. Columns beyond doc_id, text
and source don't matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import n_words, settle, table, whole, words, with_columns_of, with_rest

WEIGHTS = (3, 1, 2)
#: The share of all words that the mix takes, and how often one source may be used up.
SHARE, REPEATS = 1.5, 2
BLOCK_WORDS, SHARDS, SEED = 16, 24, 17
#: Blocks that are chosen together where not all are.
RUN = 64
#: Documents of a part of a source's seeded order, about; the parts are summed on their own.
PART_ROWS = 4096


def measured(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """Per row: doc_id, size, its source as a key without nulls, and its place in the seeded order."""
    return docs.select("doc_id", *(x.alias(c) for c, x in row_key(seed).items()))


def row_key(seed: int) -> dict[str, Column]:
    id_ = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.md5(whole(F.col("text")).cast("binary"))))
    return {
        "place": F.md5(F.concat(F.lit(f"{seed}:"), id_)),
        "size": n_words(F.col("text")),
        "crc": F.crc32(whole(F.col("text"))),
        "no_source": F.col("source").isNull(),
        "source_key": whole(F.col("source")),
    }


def source_seed(seed: int) -> Column:
    """A whole number below 2 ** 28 from the seed and the source."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), "source_key")), 1, 7), 16, 10).cast("long")


SOURCE = ["no_source", "source_key"]


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """Per source: its words and its target. One row per source passes through the ranking windows.

    A source stops at ``repeats`` times its words. Sources ordered by cap / weight are capped as long as the level of
    what remains, per unit of weight, lies above that ratio.
    """
    sources = sizes.groupBy(*SOURCE).agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = sources.withColumn("rank", F.row_number().over(W.orderBy(*SOURCE)) - 1).withColumn("weight", weight.cast("long"))
    ranked = ranked.withColumn("cap", F.col("source_size") * repeats).withColumn("ratio", F.col("cap") / F.col("weight"))
    before = W.orderBy("ratio", "rank").rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ranked = ranked.withColumns(
        {
            "left": F.sum("source_size").over(everything) * share - F.coalesce(F.sum("cap").over(before), F.lit(0)),
            "weights_left": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    ).withColumn("capped", F.col("left") / F.col("weights_left") >= F.col("ratio"))
    free = F.when(~F.col("capped"), F.struct("ratio", "rank", "left", "weights_left"))
    ranked = ranked.withColumn("level", F.min(free).over(everything))
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("level.left") * F.col("weight") / F.col("level.weights_left"))
    return ranked.select(*SOURCE, "source_size", target.alias("target"))


def shard_quotas(targets: DataFrame, block_words: int = BLOCK_WORDS, shards: int = SHARDS) -> DataFrame:
    """Sainte-Lague: per source and number of shards k (1 to ``shards``) the blocks that the first k shards take.

    Rounding t * n / total gives each source's seats but for at most half a seat each; the seats still missing go to
    the highest next quotients, those too many come from the lowest. A source's seats change by its share of the
    difference and one at most, so that only so many quotients need comparing.
    """
    everything = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    t = targets.withColumn("all", F.sum("target").over(everything)).withColumn("n_sources", F.count(F.lit(1)).over(everything))
    t = t.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(shards))))
    t = t.withColumn("seats", F.floor(F.floor(F.col("all") / block_words + 0.5) * F.col("k") / shards))
    first = F.when(F.col("all") > 0, F.floor(F.col("target") * F.col("seats") / F.col("all") + 0.5)).otherwise(F.lit(0))
    t = t.withColumn("first", first.cast("long"))
    t = t.withColumn("lack", (F.col("seats") - F.sum("first").over(W.partitionBy("k"))).cast("long"))
    most = F.ceil(F.col("n_sources") * F.col("target") / F.greatest(F.col("all"), F.lit(1.0))) + 2
    gains = F.when(F.col("lack") > 0, F.sequence(F.col("first") + 1, F.col("first") + most))
    losses = F.when((F.col("lack") < 0) & (F.col("first") > 0), F.sequence(F.greatest(F.col("first") - most, F.lit(1)).cast("long"), F.col("first")))
    seat = t.withColumn("seat", F.explode(F.coalesce(gains, losses, F.array().cast("array<bigint>"))))
    seat = seat.withColumn("quotient", F.col("target") / (2 * F.col("seat") - 1))
    # among equal quotients the first source and seat win, so the last ones lose
    best = F.row_number().over(W.partitionBy("k").orderBy(F.col("quotient").desc(), *SOURCE, "seat"))
    worst = F.row_number().over(W.partitionBy("k").orderBy("quotient", *(F.col(c).desc() for c in SOURCE), F.col("seat").desc()))
    seat = seat.withColumn("rank", F.when(F.col("lack") > 0, best).otherwise(worst))
    change = seat.filter(F.col("rank") <= F.abs("lack")).groupBy("k", *SOURCE).agg(F.sum(F.signum("lack")).cast("long").alias("change"))
    quotas = t.join(change, ["k", *SOURCE], "left").select(*SOURCE, "k", (F.col("first") + F.coalesce("change", F.lit(0))).alias("blocks"), "source_size", "target")
    return quotas


def div(a: Column | int, b: Column | int) -> Column:
    return F.call_function("div", a if isinstance(a, Column) else F.lit(a), b if isinstance(b, Column) else F.lit(b))


def with_choice(quotas: DataFrame, block_words: int, repeats: int, seed: int) -> DataFrame:
    """Per source the numbers that fix its choice: whole passes ``full``, and for the last pass ``runs`` whole runs of blocks,
    of which ``chosen_runs`` are taken with ``in_runs`` blocks in all, from ``offset`` on, and ``in_tail`` blocks behind them."""
    c = F.col
    q = quotas.withColumn("n_blocks", F.ceil(c("source_size") / block_words))
    q = q.withColumn("blocks", F.least(c("blocks"), c("n_blocks") * repeats)).withColumn("some", F.greatest("n_blocks", F.lit(1)))
    q = q.withColumns({"full": div(c("blocks"), c("some")), "rest": c("blocks") % c("some"), "runs": div(c("n_blocks"), RUN)})
    q = q.withColumn("in_runs", F.least(c("rest"), c("runs") * RUN)).withColumn("in_tail", c("rest") - c("in_runs"))
    return q.withColumns({"chosen_runs": F.ceil(c("in_runs") / RUN), "offset": source_seed(seed) % F.greatest("runs", F.lit(1))}).drop("some", "rest")


def chosen_before(x: Column, block_words: int) -> Column:
    """Words that the last, partial pass takes from the first x words of a source's stream."""
    c = F.col
    run_words = RUN * block_words
    run = F.least(div(x, run_words), c("runs"))
    # chosen runs among the first so many: spread evenly, all of them after the last run
    rank = lambda s: div(s * c("chosen_runs") + c("offset"), F.greatest("runs", F.lit(1)))
    before = F.least(rank(run) * RUN, c("in_runs"))
    here = F.when(rank(run + 1) > rank(run), F.least(F.lit(RUN).cast("long"), c("in_runs") - before)).otherwise(F.lit(0))
    inside = before * block_words + F.least(x - run * run_words, here * block_words)
    behind = c("in_runs") * block_words + F.least(x - c("runs") * run_words, c("in_tail") * block_words)
    return F.when(run < c("runs"), inside).otherwise(behind).cast("long")


def passes_of(block_words: int, repeats: int) -> Column:
    """Per pass through the stream the words of the source's take, as (start, end), that a document gives."""
    c = F.col
    end = c("start") + c("size")
    out = []
    for k in range(repeats):
        whole_pass = F.struct((c("source_size") * k + c("start")).alias("start"), (c("source_size") * k + end).alias("end"))
        last = c("source_size") * k
        partial = F.struct((last + chosen_before(c("start"), block_words)).alias("start"), (last + chosen_before(end, block_words)).alias("end"))
        nothing = F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"))
        out.append(F.when(c("full") > k, whole_pass).when(c("full") == k, partial).otherwise(nothing))
    return F.array(*out)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def shards_of(passes: Column, block_words: int, shards: int) -> Column:
    """(shard, words) of each shard that gets words of a document; ``ends`` has the source's blocks in the first 1, 2, ... shards."""

    def words_in(k: Column) -> Column:
        first = F.when(k > 0, F.get("ends", k - 1)).otherwise(F.lit(0)) * block_words
        last = F.when(k < shards - 1, F.get("ends", k) * block_words).otherwise(F.lit(1 << 62))
        return total(F.transform(passes, lambda p: F.greatest(F.least(p["end"], last) - F.greatest(p["start"], first), F.lit(0).cast("long"))))

    every = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda k: F.struct(k.alias("shard"), words_in(k).alias("words")))
    return F.filter(every, lambda s: s["words"] > 0)


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, repeats: int = REPEATS, block_words: int = BLOCK_WORDS, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Per row of docs: its words, its source's words and target, its offset in the source's stream, the words taken from
    it, in all (``taken``) and by pass (``passes``), and the shards that they go to (``shards``)."""
    sizes = settle(measured(docs, seed))
    digits = max(2, math.ceil(math.log(max(sizes.count() / PART_ROWS, 1), 16)))
    sizes = sizes.withColumn("part", F.substring("place", 1, digits))
    parts = sizes.groupBy(*SOURCE, "part").agg(F.sum("size").alias("part_size"))
    before = W.partitionBy(*SOURCE).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.withColumn("part_start", F.coalesce(F.sum("part_size").over(before), F.lit(0))).drop("part_size")
    targets = settle(source_targets(sizes, weights, share, repeats))
    quotas = shard_quotas(targets, block_words, shards)
    ends = F.transform(F.array_sort(F.collect_list(F.struct("k", "blocks"))), lambda x: x["blocks"])
    quotas = quotas.groupBy(*SOURCE, "source_size", "target").agg(F.max("blocks").alias("blocks"), ends.alias("ends"))
    # settled: else the quotas' plan would be copied into each expression that reads them
    quotas = settle(with_choice(quotas, block_words, repeats, seed))
    inside = W.partitionBy(*SOURCE, "part").orderBy("place", "doc_id", "size", "crc").rowsBetween(W.unboundedPreceding, -1)
    out = sizes.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(parts, [*SOURCE, "part"]).join(quotas, SOURCE)
    out = out.withColumn("start", F.col("part_start") + F.col("inside")).withColumn("passes", passes_of(block_words, repeats))
    out = out.withColumn("taken", total(F.transform("passes", lambda p: p["end"] - p["start"])))
    return out.withColumn("shards", shards_of(F.col("passes"), block_words, shards))


def op9_mix_sources(spark, sf_dir: str) -> DataFrame:
    shown = F.array_join(F.transform("shards", lambda s: F.concat_ws(":", s["shard"], s["words"])), ",")
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", shown.alias("shards"))


CHOICE = ["start", "source_size", "full", "runs", "chosen_runs", "in_runs", "in_tail", "offset"]


def mix_texts(docs: DataFrame, shard_column: str | None = None, **options) -> DataFrame:
    """The mixed corpus, with the columns of docs: a row per document and pass with the words that the pass takes.

    A document taken whole keeps its text; of one that the choice cuts, the chosen words are joined by a space.
    shard_column: a further column for the shard that the row's first word goes to.
    """
    block_words = options.get("block_words", BLOCK_WORDS)
    key = ["place", "size", "crc", *SOURCE]
    first = F.transform("passes", lambda p: F.struct(*(p[e].alias(e) for e in ("start", "end")), F.size(F.filter("ends", lambda e: e * block_words <= p["start"])).alias("shard")))
    taken = mix(docs, **options).select(*key, *CHOICE, first.alias("_passes"), F.size("ends").alias("_shards"))
    # rows alike in all of the key share the passes that they were given, in any order
    taken = taken.withColumn("_nth", F.row_number().over(W.partitionBy(*key).orderBy("start")))
    used = [c for c in ("doc_id", "text", "source", "n_chars") if c in docs.columns]
    named = with_rest(docs, used).withColumns({f"_{c}": x for c, x in row_key(options.get("seed", SEED)).items()})
    named = named.withColumn("_nth", F.row_number().over(W.partitionBy(*(f"_{c}" for c in key)).orderBy(F.lit(0))))
    taken = taken.withColumnsRenamed({c: f"_{c}" for c in key})
    rows = named.join(taken, [*(f"_{c}" for c in key), "_nth"]).withColumn("_pass", F.explode("_passes"))
    rows = rows.withColumn("_take", F.col("_pass.end") - F.col("_pass.start")).filter("_take > 0")
    chosen = F.filter(words(F.col("text")), lambda w, i: chosen_before(F.col("start") + i + 1, block_words) > chosen_before(F.col("start") + i, block_words))
    rows = rows.withColumn("text", F.when(F.col("_take") == F.col("_size"), F.col("text")).otherwise(F.array_join(chosen, " ")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    if not shard_column:
        return with_columns_of(docs, rows, used)
    shard = F.least(F.col("_pass.shard"), F.col("_shards") - 1)
    return with_columns_of(docs, rows, used, shard.alias(shard_column))


ORACLE = f"""
WITH m AS (SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size, source IS NULL AS no_source,
    coalesce(source, '') AS source_key, md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, '')))) AS place FROM documents),
r AS (SELECT *, [3, 1, 2][1 + (row_number() OVER (ORDER BY no_source, source_key) - 1) % 3] AS weight
    FROM (SELECT no_source, source_key, sum(size)::BIGINT AS source_size FROM m GROUP BY ALL)),
c AS (SELECT *, 2 * source_size AS cap, 2 * source_size / weight AS ratio FROM r),
f AS (SELECT *, (SELECT sum(source_size)::DOUBLE FROM r) * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY ratio, no_source, source_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS rest,
    ((SELECT sum(weight) FROM r) - coalesce(sum(weight) OVER (ORDER BY ratio, no_source, source_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS wrest FROM c),
l AS (SELECT arg_min(rest, ratio) AS rest, arg_min(wrest, ratio) AS wrest FROM f WHERE rest / wrest < ratio),
l1 AS (SELECT rest, wrest FROM f WHERE rest / wrest < ratio ORDER BY ratio, no_source, source_key LIMIT 1),
t AS (SELECT no_source, source_key, source_size, CASE WHEN f.rest / f.wrest >= ratio THEN cap::DOUBLE ELSE l1.rest * weight / l1.wrest END AS target FROM f LEFT JOIN l1 ON true),
n AS (SELECT sum(target) AS whole_mix, CAST(floor(sum(target) / {BLOCK_WORDS} + 0.5) AS BIGINT) AS seats FROM t),
s AS (SELECT no_source, source_key, target / (2 * j - 1) AS quotient, j FROM (SELECT no_source, source_key, target, unnest(generate_series(1, CAST(ceil(target / {BLOCK_WORDS}) AS BIGINT) + 2)) AS j FROM t)),
o AS (SELECT *, row_number() OVER (ORDER BY quotient DESC, no_source, source_key, j) AS nth FROM s),
k AS (SELECT k, CAST(floor((SELECT seats FROM n) * k / {SHARDS}) AS BIGINT) AS upto FROM (SELECT unnest(generate_series(1, {SHARDS})) AS k)),
e AS (SELECT no_source, source_key, k, count(nth) FILTER (nth <= upto) AS blocks FROM o CROSS JOIN k GROUP BY ALL),
q AS (SELECT no_source, source_key, list(blocks ORDER BY k) AS ends, max(blocks) AS blocks FROM e GROUP BY ALL),
c1 AS (SELECT t.*, ends, CAST(ceil(source_size / {BLOCK_WORDS}) AS BIGINT) AS nb, least(coalesce(blocks, 0), 2 * CAST(ceil(source_size / {BLOCK_WORDS}) AS BIGINT)) AS blocks FROM t LEFT JOIN q USING (no_source, source_key)),
c2 AS (SELECT *, blocks // greatest(nb, 1) AS fullp, least(blocks % greatest(nb, 1), nb // {RUN} * {RUN}) AS ir, nb // {RUN} AS runs FROM c1),
c3 AS (SELECT *, blocks % greatest(nb, 1) - ir AS it, (ir + {RUN - 1}) // {RUN} AS cr, greatest(runs, 1) AS r1, CAST('0x' || substr(md5('{SEED}:' || source_key), 1, 7) AS BIGINT) % greatest(runs, 1) AS off FROM c2),
p AS (SELECT m.*, c3.* EXCLUDE (no_source, source_key), coalesce(sum(size) OVER (PARTITION BY m.no_source, m.source_key ORDER BY place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS a
    FROM m JOIN c3 USING (no_source, source_key)),
x AS (SELECT *, unnest([a, a + size]) AS x, unnest([0, 1]) AS side FROM p),
y AS (SELECT *, CASE WHEN x // {RUN * BLOCK_WORDS} < runs THEN least((x // {RUN * BLOCK_WORDS} * cr + off) // r1 * {RUN}, ir) * {BLOCK_WORDS} + least(x % {RUN * BLOCK_WORDS}, CASE WHEN ((x // {RUN * BLOCK_WORDS} + 1) * cr + off) // r1 > (x // {RUN * BLOCK_WORDS} * cr + off) // r1
    THEN least({RUN}, ir - least((x // {RUN * BLOCK_WORDS} * cr + off) // r1 * {RUN}, ir)) * {BLOCK_WORDS} ELSE 0 END) ELSE ir * {BLOCK_WORDS} + least(x - runs * {RUN * BLOCK_WORDS}, it * {BLOCK_WORDS}) END AS g FROM x),
z AS (SELECT any_value(doc_id) AS doc_id, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target, any_value(ends) AS ends, any_value(a) AS a, any_value(fullp) AS fullp, min(g) AS g0, max(g) AS g1 FROM y GROUP BY no_source, source_key, place, doc_id, size, a),
w AS (SELECT *, list_transform([0, 1], lambda i: CASE WHEN fullp > i THEN [source_size * i + a, source_size * i + a + size] WHEN fullp = i THEN [source_size * i + g0, source_size * i + g1] ELSE [0, 0] END) AS passes FROM z),
v AS (SELECT *, list_transform(generate_series(1, {SHARDS}), lambda k: list_sum(list_transform(passes, lambda b: greatest(least(b[2], CASE WHEN k < {SHARDS} THEN ends[k] * {BLOCK_WORDS} ELSE 4611686018427387904 END) - greatest(b[1], CASE WHEN k > 1 THEN ends[k - 1] * {BLOCK_WORDS} ELSE 0 END), 0)))) AS inshard FROM w)
SELECT doc_id, size, source_size, target, CAST(list_sum(list_transform(passes, lambda b: b[2] - b[1])) AS BIGINT) AS taken,
  array_to_string(list_transform(list_filter(generate_series(1, {SHARDS}), lambda k: inshard[k] > 0), lambda k: CAST(k - 1 AS VARCHAR) || ':' || CAST(CAST(inshard[k] AS BIGINT) AS VARCHAR)), ',') AS shards FROM v
"""
