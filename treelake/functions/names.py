"""Parts of path strings. Separators are / and \\."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .attributes import BITS

# Type names of common extensions.
TYPES = {"pdf": "PDF Document", "jpg": "JPEG Image", "png": "PNG Image", "mp4": "MP4 Video", "mp3": "MP3 Audio", "txt": "Text Document", "doc": "Word Document"}


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^\\/]*)$", 1)


def dirname(path: Column) -> Column:
    """Everything before the last component, without the separators between."""
    return F.regexp_extract(path, r"(?s)\A(.*?)[\\/]*[^\\/]*\z", 1)


def extension(path: Column) -> Column:
    """From the last dot of the last component on; '' without one."""
    return F.regexp_extract(path, r"(\.[^.\\/]*)$", 1)


def strip_stream(path: Column) -> Column:
    """Without :stream in the last component, closing separators and a final lone dot; the root stays."""
    p = F.regexp_replace(path, r"(?<!^[A-Za-z]):[^\\/]*$", "")
    p = F.regexp_replace(p, r"(?<=[\\/])\.$", "")
    return F.when(p.rlike(r"\A([A-Za-z]:)?[\\/]*\z"), p).otherwise(F.regexp_replace(p, r"(?<!:)[\\/]+$", ""))


def normalize(path: Column, base: str) -> Column:
    """One separator for several (but for leading ones), below ``base`` if not rooted, then stripped."""
    p = F.regexp_replace(path, r"(?<=[^\\/])([\\/])[\\/]+", "$1")
    return strip_stream(F.when(p.rlike(r"\A([A-Za-z]:|[\\/])"), p).otherwise(F.concat(F.lit(base), p)))


def file_type(name: Column, attrs: Column, types: dict[str, str] = TYPES) -> Column:
    """Type name by extension; folders and unknown extensions get a name of their own. For a larger table of types there is ``typed``."""
    ext = F.lower(F.regexp_extract(name, r"\.([^.\\/:]*)$", 1))
    known = F.coalesce(*(F.when(ext == e, F.lit(t)) for e, t in types.items()))
    named = F.when(ext == "", "File").otherwise(F.concat(F.upper(ext), F.lit(" File")))
    return F.when(attrs.bitwiseAND(F.lit(BITS["directory"])) != 0, "File folder").otherwise(F.coalesce(known, named))


def typed(rows: DataFrame, types: DataFrame) -> DataFrame:
    """rows (name, attrs) with ``type`` by a join to a table (extension, type_name), whose size Spark judges; lower-case extensions, each once."""
    ext = F.lower(F.regexp_extract("name", r"\.([^.\\/:]*)$", 1))
    out = rows.withColumn("_ext", ext).join(types.select(F.col("extension").alias("_ext"), F.col("type_name").alias("_type")), "_ext", "left")
    named = F.when(F.col("_ext") == "", "File").otherwise(F.concat(F.upper("_ext"), F.lit(" File")))
    folder = F.col("attrs").bitwiseAND(F.lit(BITS["directory"])) != 0
    return out.withColumn("type", F.when(folder, "File folder").otherwise(F.coalesce("_type", named))).drop("_ext", "_type")
