"""The n-gram join, the divergence audit and the token alignment against brute force, on nulls, ties, repeats, empties and odd columns."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import pytest

from treelake import llm
from treelake.llm import alignment, common, divergence, near_dedup, ngram_join
from treelake.llm import components as components_
from treelake.llm.transducer import Transducer

from .test_methods import components, shingles

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, key string, n string, `a.b` string, term string, node string"


@pytest.fixture(scope="module")
def small(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def rows():
    r = random.Random(11)
    base = [" ".join(r.choice("red green blue Grün 漢字 naïve it's x1 y-2".split()) for _ in range(n)) for n in (3, 9, 60, 60, 200)]
    near = base[4].split()
    texts = [*base, None, "", " \t\n", base[4], " ".join([*near[:-2], "odd", "end"]), base[2].upper(), "one two  three　four", "a ▁ b", "▁", "<|endoftext|> and </s>", "x\0y é é 🙂👍🏽", " " * 50, "word " * 3000, "z" * 5000, "漢字" * 400]
    out = [(i, t, ("en", "de", None, "")[i % 4], ("a", "b", None, "Z", "é")[i % 5], *["q"] * 5) for i, t in enumerate(texts)]
    return [*out, out[4], (None, base[4], None, None, *[None] * 5), (None, None, "en", "only", *[None] * 5), (7, base[0], "en", "a", *["q"] * 5)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


# The n-gram join -------------------------------------------------------------------------------------------------------


def test_join_of_the_given_documents(small):
    sets = {r.doc_id: shingles(r.text, 5) for r in small.collect()}
    expected = components(sets)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.joined(small).collect()}
    assert got == {i: (len(s), expected[i]) for i, s in sets.items()}


def test_join_of_odd_rows(docs, rows):
    # a set stands under its smallest id; sets of one such id count as linked
    nodes = {}
    for r in rows:
        if r[0] is not None and (x := shingles(r[1], 5)):
            nodes[x] = min(r[0], nodes.get(x, r[0]))
    part = {i: i for i in nodes.values()}

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for s, i in nodes.items():
        for t, j in nodes.items():
            if 100 * len(s & t) >= 80 * len(s | t) and root(i) != root(j):
                part[max(root(i), root(j))] = min(root(i), root(j))
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.joined(docs).collect())
    sets = [(r[0], shingles(r[1], 5)) for r in rows]
    assert got == Counter((i, len(s), None if i is None else root(nodes[s]) if s else i) for i, s in sets)


def test_join_of_large_families(spark):
    """Near copies of one text, some of which are too far from each other, with common lines: as many components as an exact search finds."""
    r = random.Random(5)
    word = lambda: f"w{r.randrange(4000)}"
    base, line = [word() for _ in range(120)], " ".join(word() for _ in range(12))
    texts = []
    for i in range(260):
        own = list(base)
        for _ in range(i % 6):
            own[r.randrange(len(own))] = word()
        texts.append(" ".join(own) if i % 3 else f"{line} {' '.join(own)}")
    texts += [f"{line} {' '.join(word() for _ in range(r.randrange(1, 40)))}" for _ in range(120)]
    sets = {i: shingles(t, 5) for i, t in enumerate(texts)}
    expected = components(sets)
    got = {x.doc_id: x.component_id for x in ngram_join.joined(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()}
    assert got == expected
    assert 120 < len(set(got.values())) < 360


@pytest.mark.parametrize("joined", [ngram_join.joined, near_dedup.grouped])
def test_no_table_goes_through_the_driver(spark, monkeypatch, joined):
    """No step broadcasts a side that grows with the documents, however small it is here."""
    r = random.Random(7)
    base = [f"w{r.randrange(4000)}" for _ in range(120)]
    texts = [" ".join([*base[: 119 - i % 50], f"x{i}", *base[120 - i % 50 :]]) for i in range(80)]
    plans = []

    def settled(df, settle=common.settle):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return settle(df)

    for module in (ngram_join, near_dedup, components_):
        monkeypatch.setattr(module, "settle", settled)
    out = joined(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"))
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) > 8 and not any("Broadcast" in p for p in plans)


def test_hashes_tell_short_texts_from_shingles():
    h = lambda t: set(ngram_join.ngram_hashes(t.encode(), 5).tolist())
    assert len(h("a b c d e f")) == 2 and not h("a b c d") & h("a b c d e") and h("A b\tc") == h("a  b c") and h(" \n") == set()
    words = ["x", "y"]
    seen = {tuple(random.Random(k).choice(words) for _ in range(5)) for k in range(200)}
    assert len(set().union(*(h(" ".join(s)) for s in seen))) == len(seen)


# The audit -------------------------------------------------------------------------------------------------------------


def plain(rows):
    return sorted(map(repr, rows))


@pytest.mark.parametrize(("least", "per_shard"), [(1, 1), (2, 3), (2, 1 << 16), (500, 4)])
def test_audit_of_odd_rows(docs, rows, least, per_shard):
    db = duckdb.connect()
    db.execute("create table documents (text varchar, lang varchar, source varchar)")
    db.executemany("insert into documents values (?, ?, ?)", [r[1:4] for r in rows])
    mine = divergence.audited(docs, least=least, per_shard=per_shard)
    theirs = db.execute(f"select {', '.join(mine.columns)} from ({divergence.ORACLE.replace('>= 30', f'>= {least}')})").fetchall()
    assert plain(map(tuple, mine.collect())) == plain(theirs)


def test_audit_by_hand(spark):
    rows = [("b b a", "en", "s"), ("a c", "en", "t"), ("A b", "en", "t")]
    got = {tuple(r) for r in divergence.audited(spark.createDataFrame(rows, "text string, lang string, source string"), least=2).collect()}
    # a and b are kept; s has 1 a and 2 b of 3, t has 2 a and 1 b of 3, the language 3 and 3 of 6
    p = lambda n, total: 1 + 10**9 * (n + 5) // (total + 10)
    far = abs(p(1, 3) - p(2, 3)) * 2
    assert got == {("en", "s", "pair", "t", far, 1), ("en", "t", "pair", "s", far, 1), ("en", "s", "term", "b", p(2, 3) - p(3, 6), 1), ("en", "t", "term", "a", p(2, 3) - p(3, 6), 1)}


def test_transducer_is_minimal_and_goes_round():
    r = random.Random(2)
    terms = sorted({bytes(r.choice(b"abc\xc3\xa9") for _ in range(r.randrange(0, 7))) for _ in range(400)})
    t = Transducer(terms)
    assert len(t) == len(terms) and [t.ordinal(x) for x in terms] == list(range(len(terms))) and [t.term(k) for k in range(len(terms))] == terms
    assert all(t.ordinal(x) == -1 for x in (b"zz", b"abcabcabc", b"\xc3\xa9\xa9\xa9\xa9\xa9\xa9\xa9") if x not in terms)
    # one state for each different set of endings
    starts = {x[:k] for x in terms for k in range(len(x) + 1)}
    assert len(t.arcs) == len({frozenset(x[len(s) :] for x in terms if x.startswith(s)) for s in starts})
    assert len(Transducer([])) == 0 and Transducer([]).ordinal(b"a") == -1
    with pytest.raises(ValueError):
        Transducer([b"b", b"a"])


# The alignment ---------------------------------------------------------------------------------------------------------


def by_the_libraries(texts):
    """Per text (ids of A, ids of B, groups), or None, one token after the other."""
    import sentencepiece
    from tokenizers import Tokenizer

    path_a, path_b = alignment.default_paths()
    one, two = Tokenizer.from_file(path_a), sentencepiece.SentencePieceProcessor(model_file=path_b)
    one.encode_special_tokens = True
    one.no_truncation()
    one.no_padding()
    letters = alignment.byte_letters()
    for text in texts:
        a, b = one.encode(f" {text or ''}", add_special_tokens=False), two.encode(text or "")
        pieces = [two.id_to_piece(i) for i in b]
        raw_a = [bytes(letters[c] for c in t) for t in a.tokens]
        raw_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in pieces]
        if not text or not b"".join(raw_a) == b"".join(raw_b) == f" {text}".encode():
            yield None
            continue
        groups, ends = [([], [])], [0, 0]
        left = [list(zip(a.ids, raw_a, strict=True)), list(zip(b, raw_b, strict=True))]
        while left[0] or left[1]:
            side = 0 if ends[0] <= ends[1] and left[0] else 1
            i, raw = left[side].pop(0)
            groups[-1][side].append(i)
            ends[side] += len(raw)
            if ends[0] == ends[1]:
                groups.append(([], []))
        yield a.ids, b, groups[:-1]


def expected_alignment(rows):
    all_, of = Counter(), []
    for found in by_the_libraries([t for _, t in rows]):
        links = Counter()
        for xs, ys in found[2] if found else []:
            nx, ny = Counter(xs), Counter(ys)
            links.update({(x, y): nx[x] * ny[y] for x in nx for y in ny})
        all_.update(links.keys())
        of.append((found, links))
    best = defaultdict(int)
    for (x, _), n in all_.items():
        best[x] = max(best[x], n)
    out = Counter()
    for (i, _), (found, links) in zip(rows, of, strict=True):
        a, b, groups = found or ([], [], [])
        shown = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        sums = sum(n for p, n in links.items() if all_[p] == best[p[0]]), sum(n * all_[p] for p, n in links.items())
        out[(i, len(a), len(b), len(groups), sum(links.values()), *sums, hashlib.sha256(shown.encode()).hexdigest() if found else "")] += 1
    return out


def test_alignment_of_odd_rows(docs, rows):
    assert Counter(map(tuple, alignment.compared(docs).collect())) == expected_alignment([r[:2] for r in rows])


def test_alignment_of_the_given_documents(small):
    got = alignment.compared(small)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(map(tuple, got.collect())) == expected_alignment([(r.doc_id, r.text) for r in small.collect()])


def test_runs_are_merged_and_streamed_in_parts(spark, small):
    """The same results from many small runs in several salts as from one."""
    import numpy as np

    rows = alignment.align(small.repartition(9), *alignment.default_paths())
    runs = rows.filter("radix IS NOT NULL")
    assert runs.count() > 9
    totals = []
    for salts in (1, 7):
        counts = alignment.merged_counts(runs, salts)
        sums = alignment.contributions(runs, counts, salts).selectExpr("sum(n_best)", "sum(count_sum)").first()
        pairs = {(r.a, b): n for r in counts.collect() for b, n in zip(r.bs, r.counts, strict=True)}
        totals.append((pairs, tuple(sums)))
    assert totals[0] == totals[1]
    steps = np.array([3, 9, 2**31], np.uint64)
    assert [x.tolist() for x in alignment.unpacked(alignment.packed(steps, steps), 2)] == [steps.tolist()] * 2


# All of them -------------------------------------------------------------------------------------------------------------


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    for made in (ngram_join.joined(empty), divergence.audited(empty), alignment.compared(empty)):
        assert made.collect() == []
    assert {"op11_ngram_join", "op12_source_divergence", "op13_token_alignment"} <= set(llm.queries())
