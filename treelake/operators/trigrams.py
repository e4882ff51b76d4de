"""Postings of trigrams over a stored catalog: which blocks of entries have which three characters in a row.

Entries lie in the order of their paths, so that a block, some neighbouring entries, shares most of its characters. A
pattern's literal pieces are cut into trigrams; the blocks that have all of them are the candidates, their parts become a
filter on the table's folders, and the pattern itself decides. A piece of fewer than three characters narrows nothing.
A trigram's blocks are one list per part, made where the part is read, so that no row per trigram and block is dealt or sorted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entries of a block; a part has fewer than 2 ** 32 of them.
BLOCK = 1024
#: Parts that are named in a filter on folders; with more the blocks alone narrow the search.
NAMED_PARTS = 4096
#: Possible trigrams of some blocks that are marked in an array; (trigram, block) that a task holds before it lists them; bytes of text that it cuts at a time.
MARKS, LISTED, STRETCH = 1 << 25, 1 << 22, 1 << 20


def in_blocks(size: int = BLOCK) -> Column:
    """Numbers the blocks of sorted rows: the partition above, the rows of it below."""
    at = F.monotonically_increasing_id()
    return F.shiftleft(F.shiftright(at, 33), 32) + F.call_function("div", at.bitwiseAND(F.lit((1 << 33) - 1)), F.lit(size))


def grams(text: Column) -> Column:
    """The trigrams of a text."""
    at = F.sequence(F.lit(1), F.length(text) - 2)
    return F.when(F.length(text) > 2, F.array_distinct(F.transform(at, lambda i: F.substring(text, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def folded(path: Column) -> Column:
    """Lower case, and the letters beyond ASCII that a search takes for ASCII ones."""
    return F.lower(F.translate(path, "\u017f\u0131\u0130\u212a", "siik"))


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The characters of some texts in a row, as numbers, and how many each text has."""
    data, ends = texts.buffers()[2], np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, texts.offset * 4)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.zeros(0, np.uint8)
    if len(raw) == 0 or raw.max() < 128:
        return raw, np.diff(ends)
    decoded = [t.decode(errors="replace") for t in texts.cast(pa.binary()).to_pylist()]
    return np.frombuffer("".join(decoded).encode("utf-32-le"), np.uint32), np.fromiter(map(len, decoded), np.int64, len(decoded))


def grams_in(texts: pa.Array, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different (trigram, block) of some texts and the block of each; a trigram has 21 bits for each character."""
    chars, lengths = code_points(texts)
    row = np.repeat(np.arange(len(lengths)), lengths)
    at = np.flatnonzero(row[2:] == row[:-2])
    blocks, block = np.unique(of, return_inverse=True)
    # few different characters: so few possible trigrams that those that are there can be marked
    known, c = np.unique(chars, return_inverse=True)
    n = len(known)
    key = ((block[row[at]] * n + c[at]) * n + c[at + 1]) * n + c[at + 2]
    if len(blocks) * n**3 <= MARKS:
        there = np.zeros(len(blocks) * n**3, bool)
        there[key] = True
        key = np.flatnonzero(there)
    else:
        key = np.unique(key)
    known = known.astype(np.int64)
    return known[key // n**2 % n] << 42 | known[key // n % n] << 21 | known[key % n], blocks[key // n**3]


def listed_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(volume, gram, part, blocks) from (volume, part, block, folder piece, piece): each trigram once with its blocks, for what a task has of a part, or for a stretch of it."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    place, count = None, 0

    def taken() -> pa.RecordBatch:
        gram, block = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((block, gram))
        gram, block = gram[order], block[order]
        new = np.r_[True, (gram[1:] != gram[:-1]) | (block[1:] != block[:-1])][: len(gram)]
        gram, block = gram[new], block[new]
        starts = np.flatnonzero(np.r_[True, gram[1:] != gram[:-1]][: len(gram)])
        names = [chr(g >> 42) + chr(g >> 21 & 0x1FFFFF) + chr(g & 0x1FFFFF) for g in gram[starts].tolist()]
        lists = pa.ListArray.from_arrays(pa.array(np.r_[starts, len(gram)], pa.int32()), pa.array(block, pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array([place[0]] * len(names), pa.string()), pa.array(names, pa.string()), pa.array([place[1]] * len(names), pa.string()), lists], ["volume", "gram", "part", "blocks"])

    for batch in batches:
        if not batch.num_rows:
            continue
        volume, part, block, folder, piece = batch.columns
        changed = lambda x: pc.fill_null(pc.not_equal(x.slice(1), x.slice(0, len(x) - 1)), True).to_numpy(zero_copy_only=False)
        size = pc.fill_null(pc.add(pc.binary_length(folder), pc.binary_length(piece)), 0).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.r_[True, changed(volume) | changed(part) | (np.diff(np.cumsum(size, dtype=np.int64) // STRETCH) > 0)])
        # neighbours share their folder, so its trigrams are made once per block
        first = np.r_[True, changed(folder) | changed(block)]
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True):
            here = volume[a].as_py(), part[a].as_py()
            if held and (here != place or count > LISTED):
                yield taken()
                held, count = [], 0
            place = here
            own, mine = block.slice(a, b - a).to_numpy(), first[a:b].copy()
            mine[0] = True
            texts = pa.concat_arrays([folder.slice(a, b - a).filter(pa.array(mine)), piece.slice(a, b - a)])
            held.append(grams_in(pc.fill_null(texts, ""), np.concatenate([own[mine], own])))
            count += len(held[-1][0])
    if held:
        yield taken()


def postings(entries: DataFrame) -> DataFrame:
    """(volume, gram, part, blocks): for each trigram the blocks of a part that have it, in the order of the trigrams within each volume.

    A task makes the lists of the rows that it reads, and only these lists are dealt by trigram and joined.
    """
    whole = entries.select("volume", "part", "block", folded(F.col("path")).alias("text"), F.coalesce(F.length("dir_path"), F.lit(0)).alias("at"))
    # a folder's last two characters go before the rest
    rest = F.substring("text", F.greatest(F.col("at") - 1, F.lit(1)), F.length("text"))
    pieces = whole.select("volume", "part", "block", F.substring("text", F.lit(1), F.col("at")).alias("folder_piece"), rest.alias("piece"))
    lists = pieces.mapInArrow(listed_grams, "volume string, gram string, part string, blocks array<long>")
    # tasks may have read different rows of one part, or of one block
    lists = lists.groupBy("volume", "gram", "part").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("blocks")))).alias("blocks"))
    return lists.repartitionByRange("volume", "gram").sortWithinPartitions("volume", "gram", "part")


def grams_of(pieces: list[str]) -> list[str]:
    return sorted({p[k : k + 3] for p in pieces for k in range(len(p) - 2)})


def narrowed(hits: DataFrame, posted: DataFrame, pieces: list[str]) -> DataFrame:
    """The hits in blocks that have all trigrams of all pieces; hits that have the pieces in their path are never lost."""
    wanted = grams_of(pieces)
    if not wanted:
        return hits
    lists = posted.filter(F.col("gram").isin(wanted)).groupBy("volume", "part").agg(F.collect_list("blocks").alias("lists")).filter(F.size("lists") == len(wanted))
    both = F.aggregate("lists", F.element_at("lists", 1), F.array_intersect)
    found = lists.select("volume", "part", F.explode(both).alias("block"))
    parts = found.select("volume", "part").distinct().limit(NAMED_PARTS + 1).collect()
    if len(parts) <= NAMED_PARTS:
        hits = hits.filter(F.col("part").isin(sorted({r.part for r in parts})) & F.col("volume").isin(sorted({r.volume for r in parts})))
    return hits.join(found, ["volume", "part", "block"], "left_semi")
