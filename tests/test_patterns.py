"""The truth table of patterns, and the driver-side helpers."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from treelake.functions import patterns as P

# The next four tables, (pattern, text, expected); the first holds for glob and globstar.
BOTH = [("", "a", 0), ("?", "", 0), ("*", "", 1), ("?", "a", 1), ("*", "a", 1), ("*?", "a", 1), ("?*", "a", 1), ("*?*", "a", 1), ("*a*", "a", 1), ("*b*", "a", 0), ("?*?", "a", 0), ("?*?", "ab", 1), ("a*b", "a", 0), ("a*b", "ab", 1)]
GLOB = [("*?", r"a\b", 1), ("?*?", r"a\b", 1), ("?*?", "a\\", 1), ("?*?", "a", 0), ("**?", r"a\b", 1), (r"*\*", r"a\b", 1), ("*\\", r"a\b", 0), (r"\*", r"a\b", 0), ("**", "a", 1), ("**", "a\\", 1), ("**", r"\b", 1)]
DEEP = "a\\b\\c\\d\\"
GLOBSTAR = [
    ("*?", r"a\b", 0), ("?*?", r"a\b", 0), ("?*?", "a\\", 0), ("?*?", "a", 0), ("**?", r"a\b", 1), (r"*\*", r"a\b", 1), ("*\\", r"a\b", 0), (r"\*", r"a\b", 0), ("**", "a", 1), ("**", "a\\", 1), ("**", r"\b", 1),
    ("a**b", "ab", 1), ("a**b", "ac", 0), ("a**b", "acb", 1), ("a**c**b", "acb", 1), ("a**cd**b", "acb", 0),
    (r"*\**", DEEP, 1), ("*\\**\\", DEEP, 1), (r"*\**\**", DEEP, 1), ("*\\**\\**\\", DEEP, 1), (r"*\**\**\**", DEEP, 1), ("*\\**\\**\\**\\", DEEP, 1), ("*\\**\\**\\**\\", "a\\b\\c\\", 1), ("*\\**\\**\\**\\", r"a\b\c", 0), ("*\\**\\**\\**\\", "a\\b\\", 0),
    (r"*\**", "a\\", 1), ("**\\*\\", DEEP, 1), ("**\\*\\*\\", DEEP, 1), (r"\**", DEEP, 0), (r"a\**", DEEP, 1), (r"a?\**", "ab\\b\\c\\d\\", 1), ("**\\", DEEP, 1), (r"**\*", DEEP, 1), (r"**\**", DEEP, 1), (r"**\*\**", DEEP, 1), (r"\*\**", DEEP, 0),
    ("**\\**\\", DEEP, 1), (r"**\**\**", DEEP, 1), ("**\\*\\*\\*\\", DEEP, 1), ("**\\*\\*\\*\\*\\", DEEP, 0),
]
REGEX = [(".", "ab", 0), ("..", "ab", 1), (".*", "ab", 1), ("^.", "ab", 0), ("^.*", "ab", 1), ("^.*$", "ab", 1)]


# further cases: deep runs, letter case, either separator
MORE = [
    ("globstar", "a\\**\\**\\**\\b", "a\\x\\y\\z\\b", 1), ("globstar", "a\\**\\**\\**\\b", "a\\x\\b", 0), ("globstar", "a\\**\\b", "a\\b", 1), ("globstar", "**\\n?me*.TXT", "c:\\q\\Name1.txt", 1), ("globstar", "c:\\*.txt", "c:\\a\\b.txt", 0),
    ("glob", "*.TXT", "a.txt", 1), ("glob", "a.b", "axb", 0), ("glob", "[a]*", "[A]b", 1), ("glob", "a+(b)*", "a+(b)c", 1), ("verbatim", "A$", "a$", 1), ("regex", "[a-c]+", "ABC", 1), ("globstar", "a*b", "a/b", 0),
]


def test_truth_table(spark):
    cases = [("glob", *c) for c in BOTH + GLOB] + [("globstar", *c) for c in BOTH + GLOBSTAR] + [("regex", *c) for c in REGEX] + MORE
    wrong = spark.range(1).select(*(P.matches(F.lit(text), pattern, kind).alias(f"c{k}") for k, (kind, pattern, text, _) in enumerate(cases))).first()
    assert [(c, r) for c, r in zip(cases, wrong, strict=True) if r != bool(c[3])] == []


def test_case_folds_beyond_ascii(spark):
    r = spark.range(1).select(P.matches(F.lit("ÄRGER.TXT"), "ärger.*", "glob"), P.matches(F.lit("ÄRGER.TXT"), "är?er.*", "glob"), P.matches(F.lit("A"), "a", "verbatim", case=True)).first()
    assert list(r) == [True, True, False]


def test_simple_forms_need_no_regular_expression():
    for pattern in ("*.pdf", "ab*", "*mid*", "exact"):
        assert "RLIKE" not in str(P.matches(F.col("x"), pattern, "glob")).upper()


def test_helpers(spark):
    assert P.volume_names(["c", "D:\\"], ["C:", "D:", "E:"]) == ["C:", "D:"] and P.volume_names("*", ["D:", "C:"]) == ["C:", "D:"]
    with pytest.raises(ValueError):
        P.volume_names(["q"], ["C:"])
    with pytest.raises(ValueError):
        P.checked(spark, "(")
    assert P.extension_list(["pictures", ".PDF"]) == ["jpg", "pdf", "png", "tiff"] and P.extension_list(["movies"]) == ["mp4", "mpeg"]
    assert P.root_prefix("c:\\x") == "C:" and P.root_prefix("x*") is None
    assert P.trailing_star("C:\\a\\*") == "C:\\a\\*" and P.trailing_star("C:\\?\\a*") == "C:\\?\\a*"
    assert P.with_own_extension("C:\\a\\*.txt", ["pdf"]) == ("C:\\a\\*", ["pdf", "txt"]) and P.with_own_extension("a.txt", []) == ("a.txt", []) and P.with_own_extension(">a.txt", ["x"]) == (">a.txt", ["x"])
    assert P.trailing_star("C:\\a.b*", ["pdf"]) == r">C:\\a\.b.*\.(?:pdf)" and P.trailing_star("C:\\a\\**") == "C:\\a\\**"
    assert P.pattern_mode("a/b")["path"] and P.pattern_mode("xy:s")["stream"] and not P.pattern_mode("x")["path"]
