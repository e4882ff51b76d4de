"""The training-data operators' methods against independent brute force, on awkward columns and on very long texts."""

from __future__ import annotations

import base64
import math
import random
import re
from collections import Counter, defaultdict
from urllib.parse import urljoin, urlsplit

import pytest
import xxhash
from pyspark.sql import functions as F

from treelake.llm import alignment, bpe, divergence, fingerprints, license_scan, mixing, near_dedup, ngram_join, quality, sharding, substring_dedup, suffix_dedup, url_filter

SMALL = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SMALL}/labels.parquet")


def components(sets: dict) -> dict:
    """Smallest id reachable over links of similarity 0.8, by an exact search over shared members."""
    part = {i: i for i in sets}

    def root(x):
        while part[x] != x:
            part[x] = part[part[x]]
            x = part[x]
        return x

    holders = Counter(x for s in sets.values() for x in s)
    index = defaultdict(list)
    for i, s in sorted(sets.items()):
        rare = sorted(s, key=lambda x: (holders[x], x))[: len(s) - math.ceil(0.8 * len(s)) + 1]
        for j in {j for x in rare for j in index[x]}:
            a, b = root(i), root(j)
            if a != b and 100 * len(s & sets[j]) >= 80 * len(s | sets[j]):
                part[max(a, b)] = min(a, b)
        for x in rare:
            index[x].append(i)
    return {i: root(i) for i in sets}


def shingles(text: str, n: int) -> frozenset:
    w = re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) or (frozenset([tuple(w)]) if w else frozenset())


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates_of_the_given_documents(spark, n):
    """Recall of links, by the components of 1,000 documents: all of them."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    expected = components({r.doc_id: shingles(r.text, n) for r in docs.collect()})
    got = {r.doc_id: r.component_id for r in near_dedup.grouped(docs, n).collect()}
    right = sum(got[i] == c for i, c in expected.items())
    assert len(got) == len(expected) and right >= 0.99 * len(expected)


def family(size: int, low: int, high: int) -> list[tuple[int, str]]:
    """Copies of one text of 150 words, each with so many other words in it; the text itself is not among them."""
    r = random.Random(3)
    base = [f"w{r.randrange(10**6)}" for _ in range(150)]
    out = []
    for i in range(size):
        words = list(base)
        for at in r.sample(range(1, 149), r.randint(low, high)):
            words[at] = f"x{r.randrange(10**7)}"
        out.append((i, " ".join(words)))
    return out


def test_a_large_family_of_unlike_copies_makes_few_pairs(spark):
    """2,000 copies that resemble each other by 0.5 to 0.8: candidates stay in proportion, components are exact."""
    docs = spark.createDataFrame(family(2000, 7, 14), "doc_id bigint, text string")
    texts = near_dedup.packed_texts(docs)
    apart = near_dedup.differences(docs.filter("doc_id > 0").select(F.lit(0).cast("long").alias("a"), F.col("doc_id").alias("b")), texts, 2)
    each = docs.select(F.col("doc_id").alias("node"), F.col("doc_id").alias("component"))
    assert near_dedup.prefix_pairs(apart, each).count() <= 10 * 2000
    got = {r.doc_id: r.component_id for r in near_dedup.grouped(docs, 2).collect()}
    assert got == components({i: shingles(t, 2) for i, t in family(2000, 7, 14)})


def test_a_large_family_of_near_copies_is_one_group(spark):
    rows = family(600, 0, 6)
    got = {r.doc_id: r.component_id for r in near_dedup.grouped(spark.createDataFrame(rows, "doc_id bigint, text string"), 2).collect()}
    assert got == components({i: shingles(t, 2) for i, t in rows})


def hashes_of(text: str) -> set[int]:
    """Shingle hashes as chained by Spark, which seeds each with the one before, the first with 42."""
    w = re.findall(WORD, text)

    def chained(parts):
        h = 42
        for p in parts:
            h = xxhash.xxh64_intdigest(p.encode(), seed=h)
        return h >> 16

    return {chained(w[k : k + 5]) for k in range(len(w) - 4)} or ({chained([" ".join(w)])} if w else set())


def held(print_: str) -> set[int]:
    """The hashes of a returned fingerprint."""
    raw = base64.b64decode(print_)
    return {int.from_bytes(raw[k : k + 6], "big") for k in range(0, len(raw), 6)}


def test_likeness_is_that_of_the_fingerprints(small):
    """From the returned strings alone; the strings by the rule; and the error of the estimate."""
    texts = sorted(((r.doc_id, r.text or "") for r in small.collect()), reverse=True)
    got = {r.doc_id: r for r in fingerprints.fingerprinted(small).collect()}
    rule = lambda s: {h for h in s if h < 1 << 46} or {min(s)} if s else set()
    share = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
    errors = []
    for k, (i, t) in enumerate(texts):
        j, following = texts[(k + 1) % len(texts)]
        edited = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        own, after = held(got[i].fingerprint), held(got[i].edited_fingerprint)
        a, b = hashes_of(t), hashes_of(edited)
        assert own == rule(a) and after == rule(b) and len(own) * 8 == len(got[i].fingerprint)
        assert got[i].near_edited == pytest.approx(share(own, after)) and got[i].near_next == pytest.approx(share(own, held(got[j].fingerprint)))
        errors.append(abs(got[i].near_edited - share(a, b)))
    assert sum(errors) / len(errors) < 0.05


def test_sketches_merge(spark):
    r = random.Random(4)
    words = [f"w{r.randrange(500)}" for _ in range(4000)]
    a, b, both = " ".join(words[:2500]), " ".join(words[2000:]), " ".join(words)
    got = [x.s for x in fingerprints.with_sketch(spark.createDataFrame([(a,), (b,), (both,)], "text string"), "text", "p").select(F.col("p").alias("s")).collect()]
    assert sorted(set(got[0]) | set(got[1])) == got[2]
    assert all(h < 1 << 46 for s in got for h in s)
    few = [fingerprints.kept(F.lit(x).cast("array<bigint>")) for x in ([], [1 << 47, (1 << 46) + 1], [5, 1 << 47, 5])]
    assert list(spark.range(1).select(*few).first()) == [[], [(1 << 46) + 1], [5]]
    assert spark.range(1).select(fingerprints.merged(F.array(F.lit(1 << 47)), F.array(F.lit(7).cast("bigint")))).first()[0] == [7]


def test_quality_verdicts(small, labels):
    """Histograms, references, distances and verdicts by plain Python."""
    rows = small.collect()
    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    classes = [lambda c: "a" <= c <= "z", lambda c: "A" <= c <= "Z", lambda c: "0" <= c <= "9", lambda c: c in " \n\t\x0b\x0c\r", lambda c: c in ".,;:!?'\"()-", lambda c: c in quality.SYMBOLS + "@^~=+_/\\{}[]`", lambda c: c < "\x80", lambda c: True]

    def histograms(text):
        chars = Counter(next(k for k, f in enumerate(classes) if f(c)) for c in text)
        w = [x.lower() for x in re.findall(WORD, text)]
        common = Counter(quality.BINS.index(x) if x in quality.BINS else len(quality.BINS) for x in w)
        return [chars[k] for k in range(8)], [common[k] for k in range(len(quality.BINS) + 1)]

    sums = {}
    for r in rows:
        if r.doc_id in good and r.lang is not None:
            c, w = histograms(r.text or "")
            x, y = sums.setdefault(r.lang, ([0] * len(c), [0] * len(w)))
            sums[r.lang] = [p + q for p, q in zip(x, c, strict=True)], [p + q for p, q in zip(y, w, strict=True)]
    sums = {k: v for k, v in sums.items() if sum(v[1]) >= quality.SAMPLE_WORDS}
    assert len(sums) > 1

    def distance(p, q):
        p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
        m = [(a + b) / 2 for a, b in zip(p, q, strict=True)]
        kl = lambda a: sum(x * math.log2(x / y) for x, y in zip(a, m, strict=True) if x)
        return math.sqrt(max((kl(p) + kl(q)) / 2, 0))

    got = {r.doc_id: r for r in quality.judged(small, quality.fitted(small, labels)).collect()}
    for r in rows:
        text, g = r.text or "", got[r.doc_id]
        n = len(re.findall(WORD, text))
        c, w = histograms(text)
        far = False
        if r.lang in sums and len(text) >= quality.MIN_CHARS:
            d = distance(c, sums[r.lang][0])
            assert g.char_distance == pytest.approx(d, abs=1e-9)
            far |= d * d > quality.CHAR_LIMIT**2 + quality.CHAR_NOISE / len(text)
        else:
            assert g.char_distance is None
        if r.lang in sums and n >= quality.MIN_WORDS:
            d = distance(w, sums[r.lang][1])
            assert g.word_distance == pytest.approx(d, abs=1e-9)
            far |= d * d > quality.WORD_LIMIT**2 + quality.WORD_NOISE / n
        else:
            assert g.word_distance is None
        assert g.kept == (not g.base_failed and not far)


def test_quality_on_held_out_labels(spark):
    """References from one half of the labelled documents, verdicts on the other."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    rows = quality.judged(docs.join(labels.filter(half == 1), "doc_id"), quality.fitted(docs, labels.filter(half == 0))).select("quality", "kept", "base_failed").collect()
    # not a filter in Spark, which would copy the rule's expressions into it
    good, bad = ([r.kept for r in rows if r.quality == q and not r.base_failed] for q in (1, 0))
    assert len(good) > 100 and sum(good) >= 0.98 * len(good) and sum(bad) <= 0.25 * len(bad)


def test_quality_verdicts_do_not_hang_on_the_neighbours(spark, small, labels):
    refs = quality.fitted(small, labels)
    junk = small.unionByName(spark.createDataFrame([(10**9 + k, "%% ## " * 400, "en", "s", 2400) for k in range(300)], small.schema))
    again = quality.fitted(junk, labels)
    assert sorted(map(str, refs.collect())) == sorted(map(str, again.collect()))


def test_filters_skip_shards(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sharding.shard(docs).join(docs.select("doc_id", "lang", "source"), "doc_id").collect()
    box = defaultdict(list)
    for r in rows:
        box[r.shard].append(r)
    touched = lambda f, v: sum(min(getattr(r, f) for r in b) <= v <= max(getattr(r, f) for r in b) for b in box.values())
    langs = [touched("lang", v) for v in {r.lang for r in rows}]
    sources = [touched("source", v) for v in {r.source for r in rows}]
    sizes = [touched("size", r.size) for r in rows]
    assert len(box) == 24 and max(langs) <= 18 and sum(langs) / len(langs) <= 12
    assert sum(sources) / len(sources) <= 14 and sum(sizes) / len(sizes) <= 14


def test_choice_of_blocks(spark):
    """Words chosen by closed form against the list of blocks; shards by the quotas."""
    r = random.Random(6)
    rows = [(i, " ".join("w" for _ in range(r.randrange(1, 900))), "big" if i % 3 else "small") for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = mixing.mix(docs, weights=(1, 4), share=0.7).collect()
    for source in ("big", "small"):
        mine = sorted((g for g in got if g.source_key == source), key=lambda g: g.start)
        g = mine[0]
        size, blocks = g.source_size, -(-g.source_size // 16)
        runs = blocks // 64
        rest = g.in_runs + g.in_tail
        chosen = set()
        rank = lambda s: (s * g.chosen_runs + g.offset) // max(runs, 1)
        for s in range(runs):
            if rank(s + 1) > rank(s):
                chosen |= set(range(64 * s, min(64 * s + 64, 64 * s + rest - 64 * rank(s))))
        assert len(chosen) == g.in_runs
        chosen |= set(range(64 * runs, 64 * runs + g.in_tail))
        for d in mine:
            once = sum((x // 16) in chosen for x in range(d.start, d.start + d.size))
            assert d.taken == g.full * d.size + once and sum(s.words for s in d.shards) == d.taken
        per = Counter()
        for d in mine:
            for s in d.shards:
                per[s.shard] += s.words
        quotas = [b - a for a, b in zip([0, *g.ends], g.ends, strict=False)]
        assert all(per[k] == 16 * q for k, q in enumerate(quotas[:-1])) and abs(per[23] - 16 * quotas[23]) <= 32
        assert len({g.offset for g in mine}) == 1 and size == sum(d.size for d in mine)
    texts = mixing.mix_texts(docs, shard_column="shard", weights=(1, 4), share=0.7).collect()
    assert sum(len(t.text.split()) for t in texts) == sum(g.taken for g in got) and {t.shard for t in texts} == set(range(24))


def test_license_notices(spark):
    cases = {
        1: ("Licensed under the Mozilla Public License v. 2.0", "mpl-2.0", None),
        2: ("This program is licensed under the GNU General Public License version 3.", "gpl,gpl-3.0", 1.0),
        3: ("the MIT licence", "", None),
        4: ("is hereby granted, free of charge, to any person", "", None),
        5: ("mit license, mit license", "mit,mit-notice", 1.0),
        6: (None, "", 0.0),
        7: ("nothing of the kind here", "", 0.0),
    }
    docs = spark.createDataFrame([(k, t) for k, (t, _, _) in cases.items()], "doc_id bigint, text string")
    got = {r.doc_id: r for r in license_scan.scanned(docs).collect()}
    for k, (_, found, score) in cases.items():
        assert got[k].labels == found and (score is None or got[k].score == score)
    assert 0 < got[4].score < 1 and got[5].n_base == 2


def test_url_classes_by_plain_union(spark):
    """Components and verdicts of the given pages and some planted ones by plain Python."""
    tracking = re.compile(url_filter.TRACKING.replace("\\z", "$"))
    link = '<link rel="canonical" href="%s">'
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{SMALL}/pages.parquet").collect()]
    planted = [
        ("http://a.net/x?id=1", link % "http://b.com/de/1"), ("http://a.net/x?id=2", ""), ("http://a.net/x?id=1&utm_source=feed", ""), ("http://www.a.net/x/?id=1#top", ""),
        ("http://c.net/y", link % "?id=3"), ("http://c.net/y?id=3", link % "//m.b.com:80/de/"), ("http://d.net/z?ref=b", ""), ("http://d.net/z", link % "../b/./c?q=1"), ("http://d.net/b/c?q=1", link % "http://q.com/de/x"),
    ]
    pages += [(10**6 + k, u, h) for k, (u, h) in enumerate(planted)]

    def node(url):
        if url is None or "://" not in url:
            return None
        parts = urlsplit(url[url.index("://") - 4 :] if False else "x" + url[url.index("://") :])
        host = re.sub("[A-Z]", lambda m: m[0].lower(), parts.netloc)
        return (host, parts.path, parts.query) if host else None

    def normal(n):
        host = re.sub(r"^(www|m)\.(?=[^.]+\.)", "", re.sub(r":(80|443)$", "", n[0]))
        return host, n[1].rstrip("/"), "&".join(q for q in n[2].split("&") if q and not tracking.match(q))

    part = {}

    def root(x):
        while part.setdefault(x, x) != x:
            x = part[x]
        return x

    def join(x, y):
        part[root(y)] = root(x)

    def rule(n):
        fits = [(r, v) for r, v in url_filter.RULES if (n[0] == r.split("/")[0] or n[0].endswith("." + r.split("/")[0])) and n[1].startswith(r[r.index("/") :])]
        return max(fits, key=lambda f: len(f[0]), default=(None, None))

    for _, url, html in pages:
        if n := node(url):
            join(n, normal(n))
            for target in re.findall(r'rel="canonical" href="([^"]+)"', html or ""):
                to = node(urljoin("http://" + n[0] + n[1] + ("?" + n[2] if n[2] else ""), target))
                join(n, to)
                join(to, normal(to))
    votes = defaultdict(set)
    for n in list(part):
        if v := rule(n)[1] or rule((normal(n)[0], n[1], ""))[1]:
            votes[root(n)].add(v)
    expected = {}
    for i, url, _ in pages:
        n = node(url)
        found, verdict = rule(n) if n else (None, None)
        expected[i] = found, verdict or ("block" if n and votes[root(n)] == {"block"} else "allow")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.classified(spark.createDataFrame(pages, "page_id bigint, url string, html string")).collect()}
    assert got == expected
    assert [expected[10**6 + k][1] for k in range(9)] == ["block", "allow", "block", "block", "block", "block", "block", "block", "block"]


def removed_by_counting(rows: list[tuple[int, bytes]]) -> dict[int, bytes]:
    count = Counter(b[p : p + 200] for _, b in rows for p in range(len(b) - 199))
    out = {}
    for i, b in rows:
        gone = bytearray(len(b))
        for p in range(len(b) - 199):
            if count[b[p : p + 200]] > 1:
                gone[p : p + 200] = b"\1" * 200
        out[i] = bytes(x for x, g in zip(b, gone, strict=True) if not g)
    return out


@pytest.mark.parametrize("bits", [64, 10])
def test_suffixes_are_told_by_their_bytes(spark, bits):
    """Also with hashes so short that nearly all suffixes collide."""
    r = random.Random(9)
    passages = ["".join(r.choice("ab cdé") for _ in range(r.randrange(150, 420))) for _ in range(8)]
    rows = []
    for i in range(60):
        own = lambda: "".join(r.choice("efgh ") for _ in range(r.randrange(0, 260)))
        p = r.choice(passages)
        at = r.randrange(len(p))
        rows.append((i, own() + (p if r.random() < 0.6 else p[:at] + "#" + p[at + 1 :]) + own() + (p[at:] if r.random() < 0.3 else "")))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {x.doc_id: bytes(x.kept) for x in suffix_dedup.without_repeats(docs, suffix_bits=bits).collect()}
    assert got == removed_by_counting([(i, t.encode()) for i, t in rows])


def test_sorted_suffixes():
    r = random.Random(2)
    base = [bytes(r.choice(b"ab ") for _ in range(500)) for _ in range(3)]
    pieces = [b"a" * 460, b"a" * 230 + b"b" + b"a" * 230]
    for _ in range(40):
        t = bytearray(r.choice(base)[r.randrange(200) :])
        t[r.randrange(len(t))] = r.choice(b"ab ")
        pieces.append(bytes(t))
    count = Counter(p[k : k + 200] for p in pieces for k in range(len(p) - 199))
    assert [x.tolist() for x in suffix_dedup.told_by_bytes(pieces)] == [[count[p[k : k + 200]] > 1 for k in range(len(p) - 199)] for p in pieces]


def test_columns_with_dots_and_clashing_names(spark, labels):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, `a.b` string, `c``d` string, n string, h string, start bigint, part string, words string, `_words` string, key string, chars string"
    rows = [(i, "one two three four five six seven eight nine ten eleven twelve. " * (1 + i % 3), "en", "s", 0, f"x{i}", "y", *["z"] * 2, 5, *["z"] * 5) for i in range(12)]
    docs = spark.createDataFrame(rows, schema)
    for stage in (lambda d: quality.keep_good(d, labels), near_dedup.keep_one, substring_dedup.keep_first, mixing.mix_texts):
        out = stage(docs)
        assert out.columns == docs.columns and all(r["a.b"] == f"x{r.doc_id}" and r["c`d"] == "y" and r["start"] == 5 for r in out.collect())
    for made in (suffix_dedup.without_repeats(docs), bpe.tokenised(docs), sharding.shard(docs), mixing.mix(docs), fingerprints.fingerprinted(docs), near_dedup.grouped(docs), license_scan.scanned(docs.select("doc_id", "text", "`a.b`"))):
        assert made.count() == 12


@pytest.fixture(scope="module")
def long_docs(spark):
    r = random.Random(8)
    long = " ".join(f"w{r.randrange(10**5)}" for _ in range(500_000))
    assert len(long) > 3 << 20
    return spark.createDataFrame([(1, long, "en", "s"), (2, long, "en", "s"), (3, "short one", "en", "s")], "doc_id bigint, text string, lang string, source string")


#: What each operator makes of two equal texts of 3 MB and a short one, by doc_id.
LONG = {
    "near_dedup": (lambda d, _: near_dedup.grouped(d, 5), lambda r: (r.component_id, r.n_shingles > 499_000), [(1, True), (1, True), (3, False)]),
    "ngram_join": (lambda d, _: ngram_join.joined(d, 5), lambda r: (r.component_id, r.n_shingles > 499_000), [(1, True), (1, True), (3, False)]),
    "substring_dedup": (lambda d, _: substring_dedup.cut_repeats(d), lambda r: len(r._kept) > 3 << 20 or len(r._kept), [True, 0, 9]),
    "bpe": (lambda d, _: bpe.digests(bpe.tokenised(d)), lambda r: r.n_tokens > 10**6, [True, True, False]),
    "alignment": (lambda d, _: alignment.compared(d), lambda r: (r.n_a > 10**6, r.n_best > r.n_groups > 499_000), [(True, True), (True, True), (False, False)]),
    "suffix_dedup": (lambda d, _: suffix_dedup.without_repeats(d), lambda r: len(r.kept), [0, 0, 9]),
    "license_scan": (lambda d, _: license_scan.scanned(d), lambda r: r.n_words, [500_000, 500_000, 2]),
    "quality": (lambda d, labels: quality.judged(d, quality.fitted(d, labels)), lambda r: r.n_words, [500_000, 500_000, 2]),
    "mixing": (lambda d, _: mixing.mix(d), lambda r: r.size, [500_000, 500_000, 2]),
}


@pytest.mark.parametrize("name", sorted(LONG))
def test_texts_of_several_megabytes(long_docs, labels, name):
    make, seen, expected = LONG[name]
    assert [seen(r) for r in make(long_docs, labels).orderBy("doc_id").collect()] == expected


def test_sketches_and_shards_of_texts_of_several_megabytes(long_docs):
    assert [x.near_next for x in fingerprints.fingerprinted(long_docs).orderBy("doc_id").collect()][1] == 1.0
    assert sharding.shard(long_docs).count() == 3


def test_audit_of_texts_of_several_megabytes(long_docs):
    assert divergence.audited(long_docs, least=2).collect() == []
    assert divergence.audited(long_docs, least=1).count() == 0


def test_a_task_leaves_no_tokenizer_behind(spark):
    """In the pipeline, whose workers hold what all stages leave; the results are the same."""
    docs = spark.createDataFrame([(k, f"some words {k} and some more of them") for k in range(20)], "doc_id long, text string").coalesce(1)

    def held(batches):
        list(batches)
        import pyarrow as pa

        yield pa.RecordBatch.from_arrays([pa.array([bpe.tokenizer.cache_info().currsize])], ["n"])

    def rows(df):
        return sorted(tuple(r) for r in bpe.digests(df).collect())

    before = docs.mapInArrow(held, "n long").first().n
    alone = rows(bpe.tokenised(docs, cache=1 << 10, keep=False))
    assert docs.mapInArrow(held, "n long").first().n == before
    assert alone == rows(bpe.tokenised(docs, cache=1 << 10))
