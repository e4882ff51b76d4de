"""Attribute bits of files, their markers and classes, and packed keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Attribute bits.
BITS = {
    "readonly": 0x1, "hidden": 0x2, "system": 0x4, "directory": 0x10, "archive": 0x20, "sparse": 0x200, "reparse": 0x400, "compressed": 0x800, "offline": 0x1000,
    "notcontent": 0x2000, "encrypted": 0x4000, "integrity": 0x8000, "noscrub": 0x20000, "pinned": 0x80000, "unpinned": 0x100000,
}
DELETED = 0x40000000
NONE_LINK, NONE_STREAM = 1023, 8191


def has(attrs: Column, flag: str) -> Column:
    return attrs.bitwiseAND(F.lit(BITS[flag])) != 0


def decoded(attrs: Column) -> dict[str, Column]:
    return {flag: has(attrs, flag) for flag in BITS}


def encoded(flags: dict[str, Column]) -> Column:
    out = F.lit(0)
    for flag, column in flags.items():
        out = out.bitwiseOR(F.when(column, F.lit(BITS[flag])).otherwise(F.lit(0)))
    return out


def marker(flag: Column, yes: str = "1", no: str = "0") -> Column:
    return F.when(flag, F.lit(yes)).otherwise(F.lit(no))


def attribute_class(attrs: Column) -> Column:
    """The first that holds of deleted, system, hidden, directory, compressed, encrypted, sparse; else default."""
    out = F.when(attrs.bitwiseAND(F.lit(DELETED)) != 0, "deleted")
    for flag in ("system", "hidden", "directory", "compressed", "encrypted", "sparse"):
        out = out.when(has(attrs, flag), flag)
    return out.otherwise("default")


def packed_key(link: Column, stream: Column, index: Column) -> Column:
    """10 bits of link, 13 of stream, 9 of index in one number; null stands for the largest value of its field."""
    l, s, i = F.coalesce(link, F.lit(NONE_LINK)), F.coalesce(stream, F.lit(NONE_STREAM)), F.coalesce(index, F.lit(511))
    return (l.cast("long") * (1 << 22)).bitwiseOR(s.cast("long") * (1 << 9)).bitwiseOR(i.cast("long"))


def unpacked_key(key: Column) -> dict[str, Column]:
    field = lambda shift, size: F.shiftright(key, shift).bitwiseAND(F.lit(size).cast("long")).cast("int")
    return {"link_ix": F.nullif(field(22, NONE_LINK), F.lit(NONE_LINK)), "stream_ix": F.nullif(field(9, NONE_STREAM), F.lit(NONE_STREAM))}


def wrap48(value: Column) -> Column:
    return value.bitwiseAND(F.lit((1 << 48) - 1).cast("long"))
