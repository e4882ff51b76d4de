"""Quality rules: distribution divergence from language references, beside the word-count and repetition rules.

A text is described by two histograms: characters by class and common words by word. The references are fitted once, on a
bounded sample: of the labelled good documents the SAMPLE_ROWS of least id hash, their histograms summed by language. So a
verdict doesn't change with the documents that happen to be judged along. A document is rejected if the Jensen-Shannon
distance (base 2, 0 to 1) to its language's reference exceeds the threshold of either histogram. Short texts have noisy
histograms: the squared threshold grows with the inverse of the length, and below a minimum length a distance counts not
at all.

Nulls, ties, repeats: null text has no words and fails the base rule; a null language, or one with too few labelled words,
has no reference, so the method abstains, as it does without labels; identical rows are judged alike; an empty table gives
an empty result; columns beyond doc_id, text and lang pass through untouched. Texts are judged whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, quoted, table, whole, words

# Frequent function words of the declared languages.
COMMON = {
    "de": "der die das und in zu den von mit sich des auf für ist im dem nicht ein eine als".split(),
    "en": "the of and to a in is that for it as was with be by on not he at this".split(),
    "es": "de la que el en y a los del se las por un para con no una su al lo".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur au pas ce".split(),
}
#: The words with bins of their own; the last bin has all others.
BINS = sorted({w for ws in COMMON.values() for w in ws})
CLASSES = ("lower", "upper", "digit", "space", "mark", "symbol", "other ASCII", "beyond ASCII")
#: Labelled documents that the references are fitted on, at most, and the words that a language's sample must have.
SAMPLE_ROWS, SAMPLE_WORDS = 4096, 500
#: The squared threshold on a distance is LIMIT ** 2 + NOISE / length, from a least length on; set on one half of the
#: labelled texts of a sample of 10,000 documents. Of the other half it rejects none of 1,683 good ones and 141 of 157 bad ones.
CHAR_LIMIT, CHAR_NOISE, MIN_CHARS = 0.14, 22.0, 100
WORD_LIMIT, WORD_NOISE, MIN_WORDS = 0.15, 10.0, 20
#: The base rule: at least so many words, at most so many of 100 words in repeated windows of so many words.
LEAST_WORDS, MOST_REPEATED, WINDOW = 10, 20, 5
SYMBOLS = "#*$%&|<>"
LOWER, DIGITS, MARKS, MORE_SYMBOLS = "abcdefghijklmnopqrstuvwxyz", "0123456789", ".,;:!?'\"()-", SYMBOLS + "@^~=+_/\\{}[]`"


def class_counts(df: DataFrame, text: str) -> DataFrame:
    """Adds ``chars``: code points by CLASSES. Each step removes one class from what is left and counts by length."""
    steps = [LOWER, " \n\t\x0b\x0c\r", LOWER.upper(), MARKS, DIGITS, MORE_SYMBOLS]
    df = df.withColumn("_r0", F.col(text))
    for k, chars in enumerate(steps):
        df = df.withColumn(f"_r{k + 1}", F.translate(f"_r{k}", chars, ""))
    gone = [F.length(f"_r{k}") - F.length(f"_r{k + 1}") for k in range(len(steps))]
    rest = f"_r{len(steps)}"
    beyond = F.octet_length(F.regexp_replace(rest, r"[^\x00-\x7F]", "")).cast("int")
    counts = [gone[0], gone[2], gone[4], gone[1], gone[3], gone[5], beyond, F.length(rest) - beyond]
    return df.withColumn("chars", F.array(*counts)).drop(*(f"_r{k}" for k in range(len(steps) + 1)))


def described(docs: DataFrame) -> DataFrame:
    """docs with _text, _words and the two histograms, ``chars`` and ``common``."""
    df = docs.withColumn("_text", whole(F.col("text"))).withColumn("_words", words(F.col("_text")))
    df = class_counts(df, "_text")
    hits = F.filter(F.transform("_words", lambda w: F.lower(w)), lambda w: w.isin(BINS))
    # a text's common words as one string, a character for each, so that a bin is counted by a change of length
    df = df.withColumn("_hits", F.array_join(F.transform(hits, lambda w: F.char(F.array_position(F.array(*map(F.lit, BINS)), w) + 32)), ""))
    count = lambda k: F.length("_hits") - F.length(F.replace(F.col("_hits"), F.char(k + 32), F.lit("")))
    counts = F.transform(F.sequence(F.lit(1).cast("long"), F.lit(len(BINS)).cast("long")), count)
    return df.withColumn("common", F.concat(counts, F.array(F.size("_words") - F.length("_hits"))))


def fitted(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> DataFrame:
    """One row per language with enough words in the sample: the summed histograms of labelled good documents.

    labels: doc_id and quality, 1 for good. ``most`` bounds the ids that are broadcast and the rows that come back.
    """
    ids = labels.filter("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long")).distinct()
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    sample = docs.select(F.col("doc_id").cast("long"), "text", "lang").filter(F.col("lang").isNotNull()).join(F.broadcast(ids), "doc_id", "left_semi")
    sums = [F.sum(F.get("chars", F.lit(k))).alias(f"c{k}") for k in range(len(CLASSES))]
    sums += [F.sum(F.get("common", F.lit(k))).alias(f"w{k}") for k in range(len(BINS) + 1)]
    rows = described(sample).groupBy("lang").agg(*sums).collect()
    shares = lambda r, letter, n: [r[f"{letter}{k}"] / max(sum(r[f"{letter}{j}"] for j in range(n)), 1) for k in range(n)]
    enough = [r for r in rows if sum(r[f"w{k}"] for k in range(len(BINS) + 1)) >= SAMPLE_WORDS]
    kept = [(r.lang, shares(r, "c", len(CLASSES)), shares(r, "w", len(BINS) + 1)) for r in enough]
    return docs.sparkSession.createDataFrame(kept, "_lang string, _ref_chars array<double>, _ref_common array<double>")


def total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("double"), lambda a, x: a + x)


def js_distance(counts: Column, shares: Column) -> Column:
    """Jensen-Shannon distance of a histogram of counts and one of shares: the root of the divergence in bits, from 0 to 1."""

    def part(a: Column, m: Column) -> Column:
        return F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))

    pair = F.struct(counts.alias("p"), shares.alias("q"), total(counts).alias("n"))
    spread = F.transform(F.array(pair), lambda s: F.zip_with(s["p"], s["q"], lambda a, b: part(a / s["n"], (a / s["n"] + b) / 2) + part(b, (a / s["n"] + b) / 2)))
    return F.sqrt(F.greatest(total(F.get(spread, F.lit(0))) / 2, F.lit(0.0)))


def too_far(distance: str, length: Column, limit: float, noise: float) -> Column:
    """Whether a distance, null where it doesn't count, is beyond the threshold for the length."""
    return F.coalesce(F.col(distance) * F.col(distance) > limit * limit + noise / length, F.lit(False))


def repeated_words(df: DataFrame) -> DataFrame:
    """Adds ``n_repeat_words``: the words that lie in a window of WINDOW words found twice or more in the text.

    Windows are compared by 64-bit hashes within one text. Only texts with a repeated hash get sorted.
    """
    many = F.size("_words") > WINDOW
    hashes = F.transform(F.sequence(F.lit(0), F.size("_words") - WINDOW), lambda i: F.xxhash64(*(F.get("_words", i + k) for k in range(WINDOW))))
    df = df.withColumn("_h", F.when(many, hashes).otherwise(F.array().cast("array<bigint>")))
    again = F.size(F.array_distinct("_h")) < F.size("_h")
    df = df.withColumn("_s", F.when(again, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))

    def twin(e: Column, k: Column) -> Column:
        return F.get("_s", k - 1)["h"].eqNullSafe(e["h"]) | F.get("_s", k + 1)["h"].eqNullSafe(e["h"])

    df = df.withColumn("_p", F.sort_array(F.transform(F.filter("_s", twin), lambda e: e["i"])))
    covered = F.transform("_p", lambda i, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_p", k + 1) - i, F.lit(WINDOW))))
    n = F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", F.coalesce(n, F.lit(0).cast("long"))).drop("_h", "_s", "_p")


def judged(docs: DataFrame, references: DataFrame) -> DataFrame:
    """docs with the counts of the base rule, the two distances, base_failed and kept; references as made by ``fitted``."""
    df = repeated_words(described(docs))
    # a row per language of the sample
    df = df.join(F.broadcast(references), F.col("lang") == F.col("_lang"), "left")
    lines = F.filter(F.split("_text", "\n", -1), lambda x: F.regexp_like(x, F.lit(WORD)))
    df = df.withColumn("_lines", lines)
    n = F.size("_words").cast("long")
    df = df.withColumns(
        {
            "n_words": n,
            "word_chars": F.length(F.regexp_replace("_text", f"{SPACE}+", "")).cast("long"),
            "n_symbols": (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "char_distance": F.when(F.length("_text") >= MIN_CHARS, js_distance(F.col("chars"), F.col("_ref_chars"))),
            "word_distance": F.when(n >= MIN_WORDS, js_distance(F.col("common"), F.col("_ref_common"))),
        }
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    far = too_far("char_distance", F.length("_text"), CHAR_LIMIT, CHAR_NOISE) | too_far("word_distance", F.col("n_words"), WORD_LIMIT, WORD_NOISE)
    return df.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & ~far)


RULES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def op5_divergence_rules(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return judged(docs, fitted(docs, table(spark, sf_dir, "labels"))).select("doc_id", *RULES)


def oracle() -> str:
    """The same by plain counting; valid where fewer than SAMPLE_ROWS documents are labelled good."""
    quoted_ = lambda x: "'" + x.replace("'", "''") + "'"
    count = lambda chars: f"len(t) - len(translate(t, {chars}, ''))"
    sets = [quoted_(LOWER), quoted_(LOWER.upper()), quoted_(DIGITS), "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)", quoted_(MARKS), quoted_(MORE_SYMBOLS)]
    known = " + ".join(count(x) for x in sets)
    ascii_ = "len(regexp_replace(t, '[^\\x00-\\x7F]', '', 'g'))"
    chars = "[" + ", ".join([*(count(x) for x in sets), f"{ascii_} - ({known})", f"len(t) - {ascii_}"]) + "]"
    bins = "[" + ", ".join(quoted_(b) for b in BINS) + "]"
    kl = lambda a, b: f"CASE WHEN {a} > 0 THEN {a} * log2({a} / (({a} + {b}) / 2)) ELSE 0 END"
    js = lambda p, q: f"(SELECT sum({kl('a', 'b')} + {kl('b', 'a')}) / 2 FROM (SELECT unnest(list_transform({p}, lambda x: x / list_sum({p}))) AS a, unnest({q}) AS b))"
    total = lambda c, n: "[" + ", ".join(f"sum({c}[{k + 1}])" for k in range(n)) + "]"
    far = lambda d, n, limit, noise, least, ref: f"coalesce({ref} IS NOT NULL AND {n} >= {least} AND {d} > {limit * limit} + {noise} / {n}, false)"
    return f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
i AS (SELECT doc_id, unnest(range(1, len(w) - {WINDOW - 2})) AS i, w FROM d WHERE len(w) >= {WINDOW}),
n AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i + {WINDOW - 1}], ' ')) AS n FROM i),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM n CROSS JOIN (SELECT unnest(range(0, {WINDOW})) AS k) WHERE n > 1 GROUP BY doc_id),
h AS (SELECT *, {chars} AS chars, list_filter(list_transform(w, lambda x: lower(x)), lambda x: list_contains({bins}, x)) AS hits, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
c AS (SELECT *, list_transform({bins}, lambda b: len(list_filter(hits, lambda x: x = b))) || [len(w) - len(hits)] AS common FROM h),
s AS (SELECT lang, {total('chars', len(CLASSES))} AS rc, {total('common', len(BINS) + 1)} AS rw FROM c WHERE lang IS NOT NULL AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) GROUP BY lang),
f AS (SELECT lang, list_transform(rc, lambda x: x / list_sum(rc)) AS rc, list_transform(rw, lambda x: x / list_sum(rw)) AS rw FROM s WHERE list_sum(rw) >= {SAMPLE_WORDS}),
j AS (SELECT c.*, rc, rw, coalesce(n_repeat_words, 0) AS n_repeat_words, len(w) < {LEAST_WORDS} OR 100 * coalesce(n_repeat_words, 0) > {MOST_REPEATED} * len(w) AS base_failed FROM c LEFT JOIN f ON f.lang = c.lang LEFT JOIN r ON r.doc_id = c.doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, len(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g'))::BIGINT AS word_chars, CAST({count(quoted_(SYMBOLS))} AS BIGINT) AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND NOT {far(js('chars', 'rc'), 'len(t)', CHAR_LIMIT, CHAR_NOISE, MIN_CHARS, 'rc')} AND NOT {far(js('common', 'rw'), 'len(w)', WORD_LIMIT, WORD_NOISE, MIN_WORDS, 'rw')} AS kept FROM j
"""


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with its columns."""
    df = judged(docs.select(F.struct(*quoted(docs.columns)).alias("_row"), "text", "lang"), fitted(docs, labels))
    # not a filter: Spark would copy the verdict's expressions into it, all the way down to the scan
    return df.select(F.explode(F.when(F.col("kept"), F.array("_row"))).alias("_row")).select("_row.*")
