"""The training-data operators on small tables: against brute force, and on nulls, ties, repeats, empties and odd columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from array import array
from collections import Counter

import pytest

from treelake.llm import bpe, fingerprints, license_scan, mixing, near_dedup, quality, sharding, substring_dedup, suffix_dedup, url_filter
from treelake.llm.components import connected_components

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, _h string, size string, node string, _row string, _rest string, k1 string"
WORD = r"[^\x20\x09-\x0D]+"


def prose(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choice(["the", "an", "or", "in", "ed", "re"]) for _ in range(r.randrange(1, 5))) for _ in range(n))


def texts() -> list:
    r = random.Random(5)
    base = [prose(r, n) for n in (3, 12, 80, 80, 200, 200)]
    passage = prose(r, 60)
    near = base[4].split()
    out = [*base, None, "", " \n\t", "word", base[4], " ".join([*near[:-2], "odd", "end"]), f"{base[2]}\n{passage}", f"{passage}\n{base[3]}", "é" * 300, "漢 字 " * 40, "Released under the MIT License.", "a\nb\na\n" * 9]
    return out + ["x " * 40_000]


@pytest.fixture(scope="module")
def rows():
    t = texts()
    out = [(i, x, ("en", "fr", None, "xx")[i % 4], ("a", "b", None, "", "Z")[i % 5], len(x or ""), *["c"] * 6) for i, x in enumerate(t)]
    return [*out, out[4], (None, t[4], None, None, None, *[None] * 6)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def unique(spark, rows):
    return spark.createDataFrame(rows[:-2], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_stages_keep_columns_and_take_empty_tables(docs, empty):
    labels = docs.sparkSession.createDataFrame([(i, 1) for i in range(30)], "doc_id bigint, quality int")
    for stage in (lambda d: quality.keep_good(d, labels), near_dedup.keep_one, substring_dedup.keep_first, mixing.mix_texts):
        assert stage(empty).collect() == []
        assert stage(docs).columns == docs.columns


def test_operators_take_empty_tables(spark, empty):
    for made in (substring_dedup.cut_repeats(empty.select("doc_id", "text")), license_scan.scanned(empty), suffix_dedup.without_repeats(empty), quality.judged(empty, quality.fitted(empty, empty.selectExpr("doc_id", "1 AS quality"))), near_dedup.grouped(empty), bpe.tokenised(empty), sharding.shard(empty), mixing.mix(empty), fingerprints.fingerprinted(empty)):
        assert made.collect() == []
    assert url_filter.classified(spark.createDataFrame([], "page_id bigint, url string, html string")).collect() == []
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_line_dedup(docs, rows):
    seen, expected = {}, Counter()
    order = sorted({(r[0] is None, r[0] or 0, r[1] or "") for r in rows})
    for none, i, t in order:
        for start, _, unit in substring_dedup.units(t):
            seen.setdefault(unit, (none, i, t, start))
    for none, i, t in order:
        cut = sorted((s, e) for s, e, u in substring_dedup.units(t) if seen[u] != (none, i, t, s))
        kept, at = "", 0
        for s, e in cut:
            kept += t[at:s] if s > at else ""
            at = max(at, e)
        expected[(None if none else i, kept + t[at:])] += sum((r[0] is None, r[0] or 0, r[1] or "") == (none, i, t) for r in rows)
    got = Counter((r.doc_id, r._kept or "") for r in substring_dedup.cut_repeats(docs.select("doc_id", "text")).collect())
    assert got == expected


def test_line_dedup_of_writing_without_spaces_clauses_and_paragraphs(spark):
    han = "漢字" * 15
    clause, verse = "one two three four five six seven eight", "red rose\nblue sea\ngold sun"
    texts = [f"{han}甲。{han}乙。", f"新{han}丙。{han}甲。", f"Here, {clause}, and then they all went away again", f"Other people say that, {clause}, nobody knows why", f"{verse}\n\nend", f"start\n\n{verse}\n", "... a b c d e f g"]
    got = {r.doc_id: r._kept for r in substring_dedup.cut_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    cut = {1: f"新{han}丙。", 3: "Other people say that, nobody knows why", 5: "start\n\n"}
    assert got == {k: cut.get(k, t) for k, t in enumerate(texts)}


def test_license_scan(docs):
    got = {r.doc_id: r for r in license_scan.scanned(docs).collect()}
    assert (got[16].base_labels, got[16].labels, got[16].n_base, got[16].first_word, got[16].score) == ("mit", "mit,mit-notice", 1, 3, 1.0)
    assert (got[6].n_words, got[6].labels, got[6].score, got[6].first_word) == (0, "", 0.0, None)


def test_suffix_dedup(docs, rows):
    raw = [(r[0], (r[1] or "").encode()) for r in rows]
    count = Counter(b[p : p + 200] for _, b in raw for p in range(len(b) - 199))
    expected = Counter()
    for i, b in raw:
        gone = bytearray(len(b))
        for p in range(len(b) - 199):
            if count[b[p : p + 200]] > 1:
                gone[p : p + 200] = b"\1" * 200
        expected[i, bytes(x for x, g in zip(b, gone, strict=True) if not g)] += 1
    assert Counter((r.doc_id, bytes(r.kept)) for r in suffix_dedup.without_repeats(docs).collect()) == expected


def test_cover_holds_a_common_shift_for_all_offsets():
    cover = set(suffix_dedup.COVER)
    assert all(any((i + d) % 73 in cover and (j + d) % 73 in cover for d in range(73)) for i in range(73) for j in range(73))


def test_url_filter(spark):
    pages = [(1, "http://a.example.org/es/x", None), (2, "https://m.shop.net/p/", ""), (3, "http://shop.net/p", '<link rel="canonical" href="http://bad.example.org/es/">'), (4, "nothing", None), (5, None, None), (6, "http://x.COM/fr/a?b", ""), (7, "http://x.com/de/", ""), (8, "http://z.org", ""), (2, "https://m.shop.net/p/", "")]
    blocked = [(9, "http://bad.example.org/es/", "")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.classified(spark.createDataFrame(pages + blocked, "page_id bigint, url string, html string")).collect()}
    assert got[1] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[2] == ("m.shop.net", "/p/", None, "block") and got[3][3] == "block"
    assert got[4] == ("", "", None, "allow") and got[5] == ("", "", None, "allow")
    assert got[6] == ("x.com", "/fr/a", "com/fr/", "allow") and got[7][2:] == ("com/de/", "block") and got[8][2:] == (None, "allow")


def test_url_filter_judges_nodes_that_are_no_pages(spark):
    link, refresh = '<link rel="canonical" href="%s">', '<meta http-equiv="refresh" content="0; url=%s">'
    cases = [
        ("http://shop.net/a", link % "http://bad.example.org/es/", "block"),
        ("http://shop.net/b", refresh % "https://www.example.org:443/es/", "block"),
        ("http://shop.com:443/de/1", "", "block"),
        ("http://shop.com:80/de/", "", "block"),
        ("http://shop.com/x/y", link % "../de/1?q", "block"),
        ("http://shop.com/z", link % "/de/../it/1", "allow"),
        ("http://shop.com", link % "de/2", "block"),
        ("https://shop.net/c", link % "//shop.com/de/3", "block"),
        ("http://shop.net/d/e", f'<base href="//shop.com/de/">{link % "f"}', "block"),
        ("http://shop.net/f", link % "/to?next=http://shop.com/de/", "allow"),
        ("http://shop.net/g", refresh % "mailto:me@shop.com", "allow"),
        ("http://shop.net/h", (link % "http://shop.com/de/4") + refresh % "http://shop.com/fr/4", "allow"),
        ("http://www.chain.net/1", "", "block"),
        ("http://chain.net/5", "", "allow"),
        ("nothing", link % "/de/1", "allow"),
    ]
    redirects = [("http://chain.net/1", "/2"), ("http://chain.net/2", "http://shop.com/de/9"), ("http://shop.com/de/9", "http://chain.net/3"), ("http://chain.net/5", None), (None, "http://shop.com/de/")]
    pages = spark.createDataFrame([(k, url, html) for k, (url, html, _) in enumerate(cases)], "page_id bigint, url string, html string")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.classified(pages, redirects=spark.createDataFrame(redirects, "from_url string, to_url string")).collect()}
    assert got == {k: (None, verdict) for k, (_, _, verdict) in enumerate(cases)}


def test_quality_base_rule(docs, rows):
    labels = docs.sparkSession.createDataFrame([(i, 1) for i in range(30)], "doc_id bigint, quality int")
    got = {r.doc_id: r for r in quality.judged(docs, quality.fitted(docs, labels)).collect()}
    for i, text, *_ in rows[:-2]:
        w = re.findall(WORD, text or "")
        windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        n = Counter(windows)
        again = {j for k, x in enumerate(windows) if n[x] > 1 for j in range(k, k + 5)}
        lines = [x for x in (text or "").split("\n") if re.search(WORD, x)]
        assert (got[i].n_words, got[i].word_chars, got[i].n_dup_lines, got[i].n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(again))
        assert got[i].base_failed == (len(w) < 10 or 100 * len(again) > 20 * len(w))


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates(docs, rows, n):
    sets = [(r[0], near_dedup.shingles(r[1] or "", n)) for r in rows if r[0] is not None]
    part = {i: i for i, _ in sets}

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if a and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((root(i), root(j)))
                part[y] = x
    got = near_dedup.grouped(docs.select("doc_id", "text"), n).collect()
    assert len(got) == len(rows)
    assert all(r.component_id == root(r.doc_id) for r in got if r.doc_id is not None)
    assert [r.kept for r in got if r.doc_id is None] == [True]


def test_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(90)] + [(1000 + k, 1001 + k) for k in range(40)] + [(5, 5), (None, 3)]
    part = {}

    def root(x):
        while part.setdefault(x, x) != x:
            x = part[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = sorted((root(a), root(b)))
            part[y] = x
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: root(x) for x in part}


def test_bpe_is_the_librarys(docs, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(bpe.default_path())
    library.no_truncation()
    library.no_padding()
    mine = bpe.tokenizer(bpe.default_path())
    r = random.Random(1)
    pool = ["a", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "　", "é", "漢", "😀", "1", "²", "'s", "the", "ing", "<|endoftext|>", "_", "́", "\0"]
    for text in [*("".join(r.choice(pool) for _ in range(r.randrange(25))) for _ in range(2000)), "a" * 5000, *(x[1] or "" for x in rows)]:
        ids = library.encode(text, add_special_tokens=False).ids
        codes = mine.encode(text)
        assert list(array("I", codes)) == ids and mine.decode(codes) == library.decode(ids, skip_special_tokens=False)
    got = bpe.digests(bpe.tokenised(docs)).collect()
    text_of = {x[0]: x[1] or "" for x in rows}
    assert len(got) == len(rows) and all(g.decoded_sha256 == hashlib.sha256(text_of[g.doc_id].encode()).hexdigest() for g in got)


def test_shards(spark, docs, rows):
    got = sharding.shard(docs, 5).collect()
    per = Counter(g.shard for g in got)
    assert sum(per.values()) == len(rows) and max(per.values()) - min(per.values()) <= 1
    assert all(sorted(g.slot for g in got if g.shard == k) == list(range(n)) for k, n in per.items())
    assert all(g.text_crc32 == zlib.crc32((dict((r[0], r[1]) for r in rows)[g.doc_id] or "").encode()) for g in got)
    from pyspark.sql import functions as F

    cells = spark.range(512).select(F.array(F.expr("id % 8"), F.expr("(id div 8) % 8"), F.expr("id div 64")).alias("x"))
    curve = sorted((r.h, r.x) for r in cells.select("x", sharding.hilbert_index(F.col("x"), 3, 3).alias("h")).collect())
    assert [h for h, _ in curve] == list(range(512))
    assert all(sum(abs(p - q) for p, q in zip(a, b, strict=True)) == 1 for (_, a), (_, b) in zip(curve, curve[1:], strict=False))


def test_mix(docs, rows):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and all(0 <= g.taken <= 2 * g.size for g in got)
    taken, targets = Counter(), {}
    for g in got:
        key = None if g.no_source else g.source_key
        taken[key] += g.taken
        targets[key] = g.target
        assert g.target <= 2 * g.source_size
    assert all(abs(taken[s] - targets[s]) <= mixing.BLOCK_WORDS * 1.5 for s in targets)
    assert sum(targets.values()) == pytest.approx(1.5 * sum(g.size for g in got))
    mixed = mixing.mix_texts(docs).collect()
    assert sum(len((m.text or "").split()) for m in mixed) == sum(g.taken for g in got)


def test_quotas_are_the_highest_quotients(spark):
    targets = spark.createDataFrame([(False, s, 0, float(t)) for s, t in zip("abcdefghi", (1000, 731, 500, 500, 500, 77, 64, 13, 1), strict=True)], "no_source boolean, source_key string, source_size bigint, target double")
    got = mixing.shard_quotas(targets, block_words=16, shards=6).collect()
    t = {r.source_key: r.target for r in got}
    seats = sorted(((t[s] / (2 * j - 1), s) for s in t for j in range(1, 300)), key=lambda x: (-x[0], x[1]))
    whole = int(sum(t.values()) / 16 + 0.5)
    for k in range(1, 7):
        n = Counter(s for _, s in seats[: whole * k // 6])
        assert {r.source_key: r.blocks for r in got if r.k == k} == {s: n[s] for s in t}


def test_fingerprints(unique, rows, docs):
    got = {r.doc_id: r for r in fingerprints.fingerprinted(unique).collect()}
    order = sorted(((r[0], r[1] or "") for r in rows[:-2]), reverse=True)
    for k, (i, t) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        assert got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    assert got[4].fingerprint == got[10].fingerprint and got[6].fingerprint == ""
    assert fingerprints.fingerprinted(docs).count() == len(rows)


def test_fingerprints_of_ids_beyond_doubles(spark):
    r = random.Random(3)
    order = sorted(((r.randrange(2**60, 2**62) | 1, prose(r, 20)) for _ in range(90)), reverse=True)
    got = {x.doc_id: x.edited_sha256 for x in fingerprints.fingerprinted(spark.createDataFrame(order, "doc_id bigint, text string")).collect()}
    for k, (i, t) in enumerate(order):
        half = len(t) // 2
        assert got[i] == hashlib.sha256((t[: len(t) - half] + order[(k + 1) % len(order)][1][:half]).encode()).hexdigest()
