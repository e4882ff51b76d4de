"""File times: 100 ns ticks since 1601."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ticks between 1601 and 1970.
EPOCH = 116_444_736_000_000_000


def timestamp(ticks: Column) -> Column:
    return F.timestamp_micros(F.call_function("div", ticks - EPOCH, F.lit(10)))


def local_text(ticks: Column, offset_minutes: int = 0, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Local time under one constant offset for all rows."""
    return F.date_format(timestamp(ticks + offset_minutes * 600_000_000), pattern)
