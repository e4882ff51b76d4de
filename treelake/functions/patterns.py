"""Search patterns as Spark conditions: substring, prefix, suffix, exact, glob, recursive glob and regular expression.

A pattern compiles once, on the driver, to one Column. The cheapest form is chosen, so that starts-with, ends-with,
contains and equality on a stored lower-case column reach the Parquet scan. All patterns cover the whole string.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

SPECIAL = re.compile(r"[\\^$.|?*+()\[\]{}]")

# Extension groups.
GROUPS = {"pictures": ("jpg", "png", "tiff"), "documents": ("doc", "txt", "pdf"), "videos": ("mpeg", "mp4"), "music": ("mp3", "wav")}
GROUPS["movies"] = GROUPS["videos"]


def quoted(text: str) -> str:
    return SPECIAL.sub(lambda m: "\\" + m[0], text)


def glob_regex(pattern: str) -> str:
    """* any run, ? any character; separators are ordinary."""
    return "".join(".*" if c == "*" else "." if c == "?" else quoted(c) for c in re.sub(r"\*+", "*", pattern))


def globstar_regex(pattern: str) -> str:
    """* and ? stay within a component, ** crosses; a run of \\**\\ stands for as many components, or more, as it has."""
    out, i = [], 0
    while i < len(pattern):
        run = re.compile(r"\\(?:\*\*\\)+").match(pattern, i)
        if run:
            n = pattern.count("**", i, run.end())
            out.append(r"\\(?:[^\\/]+\\)" + ("*" if n == 1 else "+" if n == 2 else f"{{{n - 1},}}"))
            i = run.end()
        elif pattern.startswith("**", i):
            out.append(".*")
            i += 2
            while pattern.startswith("*", i):
                i += 1
        else:
            out.append({"*": r"[^\\/]*", "?": r"[^\\/]"}.get(pattern[i]) or quoted(pattern[i]))
            i += 1
    return "".join(out)


def whole_match(column: Column, regex: str, case: bool = False) -> Column:
    return column.rlike(rf"({'?s' if case else '?isu'})\A(?:{regex})\z")


def simple(column: Column, pattern: str, case: bool, lowered: bool = False) -> Column | None:
    """A condition without a regular expression, where the only wildcards are stars at the ends."""
    core = pattern.strip("*")
    if not core or re.search(r"[*?]", core):
        return None
    if not case:
        column, core = column if lowered else F.lower(column), core.lower()
    before, after = pattern.startswith("*"), pattern.endswith("*")
    return column.contains(core) if before and after else column.endswith(core) if before else column.startswith(core) if after else column == core


def matches(column: Column, pattern: str, kind: str, case: bool = False, lowered: bool = False) -> Column:
    """kind: any, verbatim, glob, globstar or regex. lowered: the column is in lower case, as stored, and can be compared as it is."""
    if kind == "any":
        return F.lit(True)
    if kind == "regex":
        return whole_match(column, pattern, case)
    if kind == "verbatim":
        return column == pattern if case else (column if lowered else F.lower(column)) == pattern.lower()
    if kind == "glob":
        easy = simple(column, pattern, case, lowered)
        return easy if easy is not None else whole_match(column, glob_regex(pattern), case)
    if kind == "globstar":
        return whole_match(column, globstar_regex(pattern), case)
    raise ValueError(f"unknown kind of pattern: {kind}")


def pattern_mode(pattern: str) -> dict:
    """What a typed pattern means: kind, text, and whether path and stream take part in the match."""
    if pattern.startswith(">"):
        return {"kind": "regex", "text": pattern[1:], "path": True, "stream": True}
    text = pattern.replace("/", "\\")
    path, stream = "\\" in text or "**" in text, ":" in text[2:] if re.match(r"[A-Za-z]:", text) else ":" in text
    if not text or set(text) == {"*"}:
        return {"kind": "any", "text": text, "path": False, "stream": False}
    if not re.search(r"[*?]", text):
        text = f"*{text}*" if not path else f"**{text}**"
    return {"kind": "globstar" if path else "glob", "text": text, "path": path, "stream": stream}


def trailing_star(pattern: str, extensions: list[str] = ()) -> str:
    """A path whose only wildcard is a star at the end of a name means everything that begins like it, of the given extensions; all literals are quoted."""
    if pattern.startswith(">") or "\\" not in pattern or not re.search(r"[^*\\]\*$", pattern) or re.search(r"[*?]", pattern[:-1]):
        return pattern
    tail = rf"\.(?:{'|'.join(map(quoted, extensions))})" if extensions else ""
    return ">" + quoted(pattern[:-1]) + ".*" + tail


def extension(name: Column) -> Column:
    """Lower-cased text behind the last dot, '' without one."""
    return F.lower(F.regexp_extract(name, r"\.([^.\\/]*)$", 1))


def extension_list(wanted: list[str]) -> list[str]:
    return sorted({e for w in wanted for e in GROUPS.get(w.lower(), (w.lower().lstrip("."),))})


def with_own_extension(pattern: str, wanted: list[str]) -> tuple[str, list[str]]:
    """With extensions wanted, a pattern's own one is another of them, and the rest of the pattern may end in anything."""
    own = re.search(r"\.([^.\\/*?:|]+)$", pattern)
    if not wanted or not own or pattern.startswith(">"):
        return pattern, list(wanted)
    return pattern[: own.start()].rstrip("*") + "*", [*wanted, own[1]]


def literal_head(pattern: str) -> str:
    """What every match of a path pattern begins with, in lower case; '' where letters beyond ASCII make that unsure."""
    head = re.match(r"[^*?]*", pattern)[0].lower()
    return head if head.isascii() else ""


def regex_literals(regex: str) -> list[str]:
    """Runs of plain characters that every match has, outside of groups and classes; none where an unusual construct makes that unsure."""
    out, run, i = [], "", 0
    if re.search(r"\(\?(?!:)|\\[QExupPc0NRXkG]|&&|\[[^\]]*\[", regex):
        return []
    while i < len(regex):
        c = regex[i]
        step = 1
        if c == "|":
            return []
        if c in "([":
            step = closed(regex, i) - i
            if step <= 0:
                return []
            c = ""
        elif c == "\\":
            step, c = 2, regex[i + 1 : i + 2]
            c = "" if c.isalnum() else c
        elif c in ".^$":
            c = ""
        after = regex[i + step : i + step + 1]
        if c and after and after in "?*{":
            c = ""
        run += c
        if not c or after == "+":
            out.append(run)
            run = ""
        i += step
        while i < len(regex) and regex[i] in "?*+{":
            i = regex.find("}", i) + 1 if regex[i] == "{" else i + 1
            if i == 0:
                return []
    return [r for r in [*out, run] if r]


def closed(regex: str, i: int) -> int:
    """Where the group or class that opens at i ends; -1 if it doesn't."""
    depth, in_class = 0, False
    while i < len(regex):
        c = regex[i]
        if c == "\\":
            i += 1
        elif in_class:
            in_class = c != "]" or regex[i - 1] == "["
        elif c == "[":
            in_class = True
        elif c == "(":
            depth += 1
        elif c == ")":
            depth -= 1
        if not in_class and depth == 0:
            return i + 1
        i += 1
    return -1


def literals(pattern: str) -> list[str]:
    """Texts in lower case that the path of every hit of a search pattern has; only those in ASCII."""
    mode = pattern_mode(pattern)
    pieces = regex_literals(mode["text"]) if mode["kind"] == "regex" else re.split(r"[*?]+", mode["text"])
    return sorted({p.lower() for p in pieces if p and p.isascii()})


def extension_filter(name: Column, wanted: list[str]) -> Column:
    return extension(name).isin(extension_list(wanted))


def volume_names(wanted: list[str] | str, known: list[str]) -> list[str]:
    """c, C: and D:\\ as volume names, * as all; ValueError for unknown ones."""
    wanted = [wanted] if isinstance(wanted, str) else wanted
    if "*" in wanted:
        return sorted(known)
    names = sorted({w.rstrip("\\/").rstrip(":").upper() + ":" for w in wanted})
    if unknown := [n for n in names if n not in known]:
        raise ValueError(f"unknown volumes: {', '.join(unknown)}")
    return names


def root_prefix(pattern: str) -> str | None:
    """The volume that a path pattern begins with, in upper case."""
    found = re.match(r"([A-Za-z]:)(?:[\\/]|$)", pattern)
    return found[1].upper() if found else None


def checked(spark: SparkSession, regex: str) -> str:
    """The expression itself; ValueError if Spark can't compile it."""
    try:
        spark.range(1).select(F.lit("").rlike(regex)).collect()
    except Exception as e:
        raise ValueError(f"bad regular expression {regex!r}") from e
    return regex
