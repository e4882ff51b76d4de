"""License scans: a positional index of rare tokens.

Templates are word sequences. The index has postings, (template, position), for the words of each template with the
highest inverse document frequency over the templates: two of its mandatory key phrases at least, and others up to RARE. A
file's words that the index knows are looked up once, and every posting votes for a start: the word's place in the file
less its place in the template. A start with two votes or more is a candidate. A template is found there if its mandatory
key phrases stand at their places; as two of the indexed words lie in them, none is missed. The score is the best share of
a template's words that stand at their places at a candidate, so a worn or cut notice lies between 0 and 1. The work on a
file is one pass over its words plus the few hits; no data moves between files.

Nulls, ties, repeats: null or empty text has no words, no labels and score 0; of equally rare words the earlier is indexed;
overlapping places all count; a file may begin or end inside a notice; identical rows give identical results; an empty
table gives an empty result; columns beyond doc_id and text don't matter.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, table, whole

#: Runs of characters that are no part of a word.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Fixed values: (phrase, label) of the base rule.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

# Fixed values: (label, words of a public licence notice, mandatory key phrases).
NOTICES = (
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("bsd-notice", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution", "4 0 international")),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    ("isc-notice", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify", "without fee is hereby granted")),
    ("mit-notice", "released under the mit license", ("mit license",)),
    ("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted free of charge",)),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
)
#: Words of a template that are indexed, and how many of them must agree on a start.
RARE, VOTES = 6, 2


def templates(phrases=PHRASES, notices=NOTICES, rare: int = RARE) -> list[dict]:
    """Per template its label, words, the places of its key words and those of its indexed words."""
    rows = [{"label": label, "base": True, "words": phrase.split(), "keys": (phrase,)} for phrase, label in phrases]
    rows += [{"label": label, "base": False, "words": text.split(), "keys": keys} for label, text, keys in notices]
    holders = lambda w: sum(w in r["words"] for r in rows)
    for r in rows:
        idf = {i: math.log(len(rows) / holders(w)) for i, w in enumerate(r["words"])}
        r["must"] = set()
        for key in r["keys"]:
            n = key.split()
            at = next(i for i in range(len(r["words"])) if r["words"][i : i + len(n)] == n)
            r["must"] |= set(range(at, at + len(n)))
        rarest = sorted(idf, key=lambda i: (-idf[i], i))
        first = [i for i in rarest if i in r["must"]][:VOTES]
        if len(first) < VOTES:
            raise ValueError(f"the key phrases of {r['label']} need {VOTES} words")
        r["rare"] = sorted([*first, *(i for i in rarest if i not in first)][: max(rare, VOTES)])
    return rows


def scanned(docs: DataFrame, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """docs with n_words, n_base, first_word, last_word, base_labels, labels, score, and ``places``: (label, start, share) of all that was found."""
    index = templates(phrases, notices)
    known = sorted({r["words"][i] for r in index for i in r["rare"]})
    posting = lambda t, i: F.struct(F.lit(t).alias("t"), F.lit(i).alias("at"))
    entries = {w: F.array(*(posting(t, i) for t, r in enumerate(index) for i in r["rare"] if r["words"][i] == w)) for w in known}
    postings = F.create_map(*(x for w, e in entries.items() for x in (F.lit(w), e)))
    literal = lambda xs: F.array(*map(F.lit, xs))
    texts, musts = F.array(*(literal(r["words"]) for r in index)), F.array(*(literal(sorted(r["must"])) for r in index))
    labels, bases = literal([r["label"] for r in index]), literal([r["base"] for r in index])

    df = docs.withColumn("_words", F.array_remove(F.split(ascii_lower(whole(F.col("text"))), BREAK), ""))
    hits = F.filter(F.transform("_words", lambda w, i: F.struct(i.alias("i"), w.alias("w"))), lambda x: x["w"].isin(known))
    votes = F.flatten(F.transform(hits, lambda x: F.transform(F.element_at(postings, x["w"]), lambda p: F.struct(p["t"].alias("t"), (x["i"] - p["at"]).alias("s")))))
    df = df.withColumn("_votes", F.when(F.arrays_overlap("_words", literal(known)), F.array_sort(votes)).otherwise(F.array().cast("array<struct<t:int,s:int>>")))
    agreed = F.array_distinct(F.filter("_votes", lambda v, k: F.get("_votes", k + (VOTES - 1)).eqNullSafe(v)))

    def judged(c: Column) -> Column:
        text = F.get(texts, c["t"])
        there = lambda i: F.get("_words", c["s"] + i).eqNullSafe(F.get(text, i))
        same = F.size(F.filter(text, lambda w, i: F.get("_words", c["s"] + i).eqNullSafe(w)))
        return F.struct(
            F.get(labels, c["t"]).alias("label"), c["s"].alias("start"), (same / F.size(text)).alias("share"),
            F.get(bases, c["t"]).alias("base"), F.forall(F.get(musts, c["t"]), there).alias("found"),
        )

    df = df.withColumn("_seen", F.transform(agreed, judged))
    names = lambda xs: F.array_join(F.array_sort(F.array_distinct(F.transform(xs, lambda c: c["label"]))), ",")
    df = df.withColumn("_found", F.filter("_seen", lambda c: c["found"])).withColumn("_base", F.filter("_found", lambda c: c["base"]))
    starts = F.transform("_base", lambda c: c["start"])
    return df.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "n_base": F.size("_base").cast("long"),
            "first_word": F.array_min(starts).cast("long"),
            "last_word": F.array_max(starts).cast("long"),
            "base_labels": names(F.col("_base")),
            "labels": names(F.col("_found")),
            "score": F.coalesce(F.array_max(F.transform("_seen", lambda c: c["share"])), F.lit(0.0)),
            "places": F.transform("_found", lambda c: F.struct(c["label"], c["start"], c["share"])),
        }
    ).drop("_words", "_votes", "_seen", "_found", "_base")


RESULT = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents").select("doc_id", "text")).select(*RESULT)


def oracle() -> str:
    """The same by plain comparison of every template at every place; only the score's candidates need the index."""
    index = templates()

    def at(i: int, w: str) -> str:
        return f"(s + {i} >= 0 AND coalesce(w[s + {i + 1}] = '{w}', false))"

    def seen(k: int, r: dict) -> str:
        count = lambda places: " + ".join(f"CAST({at(i, r['words'][i])} AS INT)" for i in places)
        must = " AND ".join(at(i, w) for key in r["keys"] for i, w in enumerate(key.split(), " ".join(["", *r["words"], ""]).partition(f" {key} ")[0].count(" ")))
        rows = f"list_filter(range({1 - len(r['words'])}, len(w)), lambda s: ({must}) OR {count(r['rare'])} >= {VOTES})"
        return f"list_transform({rows}, lambda s: {{'s': s, 'share': ({count(range(len(r['words'])))}) / {len(r['words'])}, 'found': {must}}}) AS t{k}"

    found = lambda k: f"list_filter(t{k}, lambda x: x.found)"
    base = [k for k, r in enumerate(index) if r["base"]]
    names = lambda ks: "array_to_string(list_sort(list_distinct(list_filter([" + ", ".join(f"CASE WHEN len({found(k)}) > 0 THEN '{index[k]['label']}' END" for k in ks) + "], lambda x: x IS NOT NULL))), ',')"
    every = "list_transform(" + " || ".join(found(k) for k in base) + ", lambda x: x.s)"
    shares = ", ".join(f"coalesce(list_max(list_transform(t{k}, lambda x: x.share)), 0.0)" for k in range(len(index)))
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH d AS (SELECT doc_id, regexp_extract_all({low}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
t AS (SELECT doc_id, w, {", ".join(seen(k, r) for k, r in enumerate(index))} FROM d)
SELECT doc_id, len(w)::BIGINT AS n_words, len({every})::BIGINT AS n_base, list_min({every})::BIGINT AS first_word, list_max({every})::BIGINT AS last_word,
{names(base)} AS base_labels, {names(range(len(index)))} AS labels, CAST(greatest({shares}) AS DOUBLE) AS score FROM t
"""
